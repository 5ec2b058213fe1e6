"""Counters, histograms and traces of message handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counters(handled: DataFrame) -> DataFrame:
    """Messages by endpoint, type and outcome."""
    return handled.groupBy("endpoint", "message_type", "outcome").agg(F.count("*").alias("messages"))


def histogram(rows: DataFrame, by: list[str], value: Column, bounds: list[float]) -> DataFrame:
    """count, sum, min and max of value, and how many values are at most each bound."""
    held = rows.withColumn("_v", value)
    return held.groupBy(*by).agg(F.count("_v").alias("n"), F.sum("_v").alias("total"), F.min("_v").alias("least"), F.max("_v").alias("most"), *[F.count(F.when(F.col("_v") <= b, 1)).alias(f"le_{b:g}".replace(".", "_")) for b in bounds])


def parents(spans: DataFrame) -> DataFrame:
    """Each span with its parent's name, over (trace_id, span_id, parent_id, name)."""
    up = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.col("name").alias("parent_name"))
    return spans.join(up, ["trace_id", "parent_id"], "left")
