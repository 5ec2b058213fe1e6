"""Routing slips: steps in order, and on a failure the compensation of those done, in reverse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run(slips: DataFrame) -> DataFrame:
    """(slip_id, outcome, failed_at, log, compensated) for slips (slip_id, steps array<string>, failing int or null).

    failing is the position, from 0, of the first step that fails. log is what was done, compensated what was undone.
    """
    done = F.when(F.col("failing").isNull(), F.col("steps")).otherwise(F.slice("steps", F.lit(1), F.col("failing")))
    failed = F.col("failing").isNotNull()
    return slips.select("slip_id", F.when(failed, F.lit("Faulted")).otherwise(F.lit("Completed")).alias("outcome"), F.col("failing").alias("failed_at"), done.alias("log"), F.when(failed, F.reverse(done)).otherwise(F.array().cast("array<string>")).alias("compensated"))
