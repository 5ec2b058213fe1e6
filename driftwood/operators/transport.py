"""What a transport does to messages: confirm, refuse, redeliver, deploy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered


def confirmed(messages: DataFrame, queue: str, order: list[str], slice_by: str, capacity: int = 1000) -> DataFrame:
    """messages with delivery_tag, from 1 in each queue, and is_confirmed: false once the queue is full."""
    out = numbered(messages, [queue], order, slice_by, "delivery_tag")
    return out.withColumn("is_confirmed", F.col("delivery_tag") <= capacity)


def sink_errors(messages: DataFrame, default_exchange: str | None) -> DataFrame:
    """Messages that no exchange header and no default give an exchange: an error of configuration."""
    if default_exchange is not None:
        return messages.where("false")
    return messages.where(F.col("header_exchange").isNull() | (F.col("header_exchange") == ""))


def deploy_order(topology: DataFrame) -> DataFrame:
    """topology (kind, name) with the step at which each part is declared: exchanges, queues, then bindings."""
    kinds = ["exchange", "queue", "queue_binding", "exchange_binding"]
    step = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    return topology.withColumn("step", step)


def delay_queue(delay_ms: Column, destination: Column, prefix: str = "driftwood.delay") -> Column:
    """The queue that holds a message for delay_ms and then dead-letters it to destination."""
    return F.concat_ws(".", F.lit(prefix), delay_ms.cast("string"), destination)


def dead_lettered(settled: DataFrame, queues: DataFrame) -> DataFrame:
    """Rejected, nacked and deferred messages as they are published again: to the queue's dead-letter exchange, under its key or
    their own. A deferred one waits there until it expires."""
    bad = settled.where("action IN ('Nack', 'Reject', 'Defer')").join(F.broadcast(queues), "endpoint")
    return bad.where("dead_letter_exchange <> ''").withColumn("exchange", F.col("dead_letter_exchange")).withColumn("routing_key", F.coalesce("dead_letter_key", "routing_key"))


def in_order(rows: DataFrame, key: str, order: str, time: str, slice_by: str) -> DataFrame:
    """(key, ordered): whether time never falls in the order of a key's rows; slice_by is SQL that does not fall along that order.

    A key's slices are looked at apart, and then only their first and last times.
    """
    rising = "aggregate(_x, named_struct('last', _x[0].a, 'ok', true), (s, x) -> named_struct('last', x.b, 'ok', s.ok AND x.ok AND x.a >= s.last)).ok"
    items = F.struct(F.col(order).alias("k"), F.col(time).alias("a"), F.col(time).alias("b"), F.lit(True).alias("ok"))
    parts = rows.groupBy(key, F.expr(slice_by).alias("_s")).agg(F.array_sort(F.collect_list(items)).alias("_x"))
    ends = parts.select(key, F.struct(F.col("_s").alias("k"), F.expr("_x[0].a").alias("a"), F.expr("_x[size(_x) - 1].b").alias("b"), F.expr(rising).alias("ok")).alias("x"))
    return ends.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("_x")).select(key, F.expr(rising).alias("ordered"))
