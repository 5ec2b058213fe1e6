"""Retries, queue limits, partitions and flow control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered, running_sum


def interval_delay(attempt: Column, ms: int) -> Column:
    return F.lit(ms).cast("long") + 0 * attempt


def incremental_delay(attempt: Column, initial_ms: int, step_ms: int) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.lit(initial_ms).cast("long") + F.lit(step_ms).cast("long") * attempt)


def exponential_delay(attempt: Column, min_ms: int, max_ms: int, jitter: Column | None = None) -> Column:
    """min * 2^attempt up to max, moved by jitter (-1 to 1) times a tenth, kept between the two."""
    plain = F.least(F.lit(float(max_ms)), F.lit(float(min_ms)) * F.pow(F.lit(2.0), F.least(attempt, F.lit(62))))
    moved = plain * (1 + 0.1 * (F.lit(0.0) if jitter is None else jitter))
    return F.least(F.lit(max_ms), F.greatest(F.lit(min_ms), F.round(moved))).cast("long")


def retryable(error: Column, attempt: Column, most: int, handled: list[str] = (), ignored: list[str] = ()) -> Column:
    """Whether another attempt follows: the limit first, then ignored errors, then the list of handled ones, if there is one."""
    return (attempt < most) & (~error.isin(*ignored) if ignored else F.lit(True)) & (error.isin(*handled) if handled else F.lit(True))


def subtypes(kinds: list[str], parents: dict[str, str]) -> list[str]:
    """kinds and every kind that descends from one of them, for the lists of `retryable`."""
    found = list(dict.fromkeys(kinds))
    for kind in found:
        found.extend(c for c, p in parents.items() if p == kind and c not in found)
    return found


def attempts(failures: DataFrame, most: int) -> DataFrame:
    """failures once for each attempt after the first, 1 to most."""
    return failures.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(most))))


def keep_newest(messages: DataFrame, queue: str, order: list[str], length: int) -> DataFrame:
    """A full queue drops its head: the newest rows stay. Ranks are limited in each task before the shuffle."""
    w = Window.partitionBy(queue).orderBy(*[F.desc(c) for c in order])
    return messages.withColumn("_n", F.row_number().over(w)).where(f"_n <= {length}").drop("_n")


def keep_oldest(messages: DataFrame, queue: str, order: list[str], length: int) -> DataFrame:
    """A full queue rejects what is published: the oldest rows stay."""
    w = Window.partitionBy(queue).orderBy(*order)
    return messages.withColumn("_n", F.row_number().over(w)).where(f"_n <= {length}").drop("_n")


def rejected(messages: DataFrame, queue: str, order: list[str], length: int, slice_by: str) -> DataFrame:
    """What a full queue that rejects what is published hands to its dead-letter exchange: all that `keep_oldest` leaves out."""
    return numbered(messages, [queue], order, slice_by, "_n").where(f"_n > {length}").drop("_n")


def keep_bytes(messages: DataFrame, queue: str, order: list[str], size: Column, most: int, slice_by: str) -> DataFrame:
    """The oldest messages of each queue whose sizes together are most at most."""
    return running_sum(messages, [queue], order, size.cast("long"), slice_by, "bytes_so_far").where(f"bytes_so_far <= {most}")


def expired(published: Column, ttl_ms: int, consumed: Column) -> Column:
    if not 0 < ttl_ms <= 2**31 - 1:
        raise ValueError("a time to live is positive and fits in an int")
    return published + F.expr(f"make_dt_interval(0, 0, 0, {ttl_ms / 1000})") < consumed


def lanes(messages: DataFrame, key: str, n: int) -> DataFrame:
    """messages dealt to n lanes; all of a key are in one lane, in their order there."""
    return messages.withColumn("lane", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def in_flight(starts: DataFrame, ends: DataFrame, slice_by: str) -> DataFrame:
    """(endpoint, ts, id, delta, in_flight): up by one at each start and down at each end; ends come first in a tie."""
    both = starts.select("endpoint", "ts", "id", F.lit(1).alias("delta")).unionByName(ends.select("endpoint", "ts", "id", F.lit(-1).alias("delta")))
    return running_sum(both, ["endpoint"], ["ts", "delta", "id"], F.col("delta").cast("long"), slice_by, "in_flight")


def level(changes: DataFrame, keys: list[str], order: list[str], delta: str, slice_by: str, name: str = "level") -> DataFrame:
    """changes with what an up-down counter shows after each: bytes in flight, messages that wait to be published."""
    return running_sum(changes, keys, order, F.col(delta).cast("long"), slice_by, name)


def utilisation(in_flight_now: Column, most: int) -> Column:
    return in_flight_now / F.lit(float(most)) * 100


def health(in_flight_now: Column, bytes_now: Column, most: int, most_bytes: int) -> Column:
    """Unhealthy when full, Degraded from 90 %, else Healthy; unknown is Healthy."""
    used = utilisation(in_flight_now, most)
    return F.when((used >= 100) | (bytes_now >= most_bytes), F.lit("Unhealthy")).when(used >= 90, F.lit("Degraded")).otherwise(F.lit("Healthy"))


def granted(wanted: Column, in_flight_now: Column, most: int) -> Column:
    """Credits that a request gets: what is free, at most what is wanted."""
    return F.greatest(F.lit(0), F.least(wanted, F.lit(most) - in_flight_now))


def worst(statuses: DataFrame, by: list[str]) -> DataFrame:
    """The bus is as well as its worst endpoint."""
    rank = F.when(F.col("status") == "Unhealthy", 2).when(F.col("status") == "Degraded", 1).otherwise(0)
    return statuses.groupBy(*by).agg(F.max(rank).alias("_r")).withColumn("status", F.element_at(F.array(F.lit("Healthy"), F.lit("Degraded"), F.lit("Unhealthy")), F.col("_r") + 1)).drop("_r")


def back_pressure(pending: Column, pending_bytes: Column, most: int, most_bytes: int) -> Column:
    """(accepts, alert): whether a publisher may go on, and whether it is near a limit."""
    share = F.greatest(pending / F.lit(float(most)), pending_bytes / F.lit(float(most_bytes)))
    return F.struct((share < 1).alias("accepts"), (share >= 0.9).alias("alert"))
