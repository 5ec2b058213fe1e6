"""Consuming: which handler gets a message, and how it is settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def typed(messages: DataFrame, registrations: DataFrame) -> DataFrame:
    """messages with the consumer that is registered for their type (endpoint, message_type, consumer, position); null if none.

    Types are equal letter by letter; of several registrations the first counts.
    """
    first = registrations.groupBy("endpoint", "message_type").agg(F.min_by("consumer", "position").alias("consumer"))
    return messages.join(F.broadcast(first), ["endpoint", "message_type"], "left")


def fallback(dispatched: DataFrame, registrations: DataFrame, raw_consumers: DataFrame, sagas: DataFrame | None = None) -> DataFrame:
    """dispatched with handlers (array): the typed consumer; else, for a message without a type, the first registered decoder
    that takes any JSON object; else the first saga, of sagas (endpoint, message_type, saga, position), that has an event of the
    message's type, or of any type if the message is a JSON object without one; else all raw consumers of the endpoint."""
    first = registrations.groupBy("endpoint").agg(F.min_by("consumer", "position").alias("_any"))
    raw = raw_consumers.groupBy("endpoint").agg(F.array_sort(F.collect_set("consumer")).alias("_raw"))
    out = dispatched.join(F.broadcast(first), "endpoint", "left").join(F.broadcast(raw), "endpoint", "left")
    untyped = F.col("message_type").isNull() | (F.col("message_type") == "")
    decodes = F.coalesce(F.trim("body").startswith("{") & F.get_json_object("body", "$").isNotNull(), F.lit(False))
    handlers = F.when(F.col("consumer").isNotNull(), F.array("consumer")).when(untyped & decodes & F.col("_any").isNotNull(), F.array("_any"))
    if sagas is not None:
        of_type = sagas.groupBy("endpoint", "message_type").agg(F.min_by("saga", "position").alias("_saga"))
        of_any = sagas.groupBy("endpoint").agg(F.min_by("saga", "position").alias("_some"))
        out = out.join(F.broadcast(of_type), ["endpoint", "message_type"], "left").join(F.broadcast(of_any), "endpoint", "left")
        saga = F.when(~untyped & decodes, F.col("_saga")).when(untyped & decodes, F.col("_some"))
        handlers = handlers.when(saga.isNotNull(), F.array(saga))
    handlers = handlers.otherwise(F.coalesce("_raw", F.array().cast("array<string>")))
    return out.withColumn("handlers", handlers).drop("_any", "_raw", "_saga", "_some")


def settlement(handled: Column, duplicate: Column, failed: Column, stopping: Column, deferred: Column | None = None, defer_enabled: bool = False) -> Column:
    """Ack, Nack, Reject, Requeue or Defer, exactly one for each message. Deferring needs a transport that is set up for it."""
    if deferred is not None and not defer_enabled:
        raise ValueError("deferring is not enabled")
    return F.when(stopping, F.lit("Requeue")).when(F.lit(False) if deferred is None else deferred, F.lit("Defer")).when(duplicate, F.lit("Ack")).when(~handled, F.lit("Reject")).when(failed, F.lit("Nack")).otherwise(F.lit("Ack"))


def lost(settled: DataFrame, queues: DataFrame) -> DataFrame:
    """Messages that are nacked or rejected on a queue without a dead-letter exchange, with (endpoint, dead_letter_exchange)."""
    return settled.where("action IN ('Nack', 'Reject')").join(F.broadcast(queues), "endpoint", "left").withColumn("lost", F.coalesce(F.col("dead_letter_exchange") == "", F.col("dead_letter_exchange").isNull()))


def valid_order(order_id: Column, amount: Column) -> Column:
    """(is_valid, reason): a non-blank id and an amount above zero."""
    blank = F.coalesce(F.trim(order_id) == "", F.lit(True))
    low = ~F.coalesce(amount > 0, F.lit(False))
    return F.struct((~blank & ~low).alias("is_valid"), F.when(blank, F.lit("id is blank")).when(low, F.lit("amount must be positive")).alias("reason"))
