"""Order-dependent work on keys of any size: a key's rows are cut into time slices, which tasks handle apart.

A window over a hot key puts all its rows into one task. Here a slice's rows are handled first, then a key's slices, of
which there are few, and then what the slices before it leave is added to each slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: Column, slice_by: str, name: str) -> DataFrame:
    """rows with the running sum of value in the order of the key's rows; slice_by is SQL that must not fall along that order."""
    cut = rows.withColumn("_slice", F.expr(slice_by)).withColumn("_value", value)
    sums = cut.groupBy(*keys, "_slice").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = cut.withColumn("_run", F.sum("_value").over(inside))
    return null_safe_join(run, starts, [*keys, "_slice"]).withColumn(name, F.col("_run") + F.col("_start")).drop("_slice", "_value", "_run", "_start")


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join in which null keys are equal; the columns of left, then the rest of right."""
    named = right.select(*[F.col(c).alias(f"_right_{c}") for c in on], *[c for c in right.columns if c not in on])
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return left.join(named, condition).drop(*[f"_right_{c}" for c in on])


def numbered(rows: DataFrame, keys: list[str], order: list[str], slice_by: str, name: str) -> DataFrame:
    """rows with their number in the order of the key's rows, from 1."""
    return running_sum(rows, keys, order, F.lit(1).cast("long"), slice_by, name)
