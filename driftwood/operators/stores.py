"""Transactional inbox and outbox over plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_deliveries(deliveries: DataFrame) -> DataFrame:
    """The first arrival of each (message_id, consumer), where every handler succeeds: a minimum, partial before the shuffle."""
    rest = [c for c in deliveries.columns if c not in ("message_id", "consumer")]
    first = F.min(F.struct("arrived", "delivery", *[c for c in rest if c not in ("arrived", "delivery")])).alias("x")
    return deliveries.groupBy("message_id", "consumer").agg(first).select("message_id", "consumer", "x.*")


def lock(deliveries: DataFrame, seconds: int) -> DataFrame:
    """deliveries with outcome processed, failed or filtered, by the inbox's lock.

    A delivery gets the lock if the key is new, or its lock has run out (strictly before the arrival) and the message was never
    processed. A handler that fails keeps its lock until then. A key's deliveries are those of one message to one consumer.
    """
    rows = deliveries.groupBy("message_id", "consumer").agg(F.array_sort(F.collect_list(F.struct("arrived", "delivery", "succeeds"))).alias("rows"))
    span = F.expr(f"make_dt_interval(0, 0, 0, {seconds})")

    def step(acc: Column, x: Column) -> Column:
        gets = acc["until"].isNull() | (~acc["done"] & (acc["until"] < x["arrived"]))
        outcome = F.when(~gets, F.lit("filtered")).when(x["succeeds"], F.lit("processed")).otherwise(F.lit("failed"))
        return F.struct((acc["done"] | (gets & x["succeeds"])).alias("done"), F.when(gets, x["arrived"] + span).otherwise(acc["until"]).alias("until"), F.concat(acc["out"], F.array(F.struct(x["delivery"].alias("delivery"), x["arrived"].alias("arrived"), outcome.alias("outcome")))).alias("out"))

    kinds = {c: deliveries.schema[c].dataType.simpleString() for c in ("arrived", "delivery")}
    zero = F.struct(F.lit(False).alias("done"), F.lit(None).cast(kinds["arrived"]).alias("until"), F.array().cast(f"array<struct<delivery:{kinds['delivery']},arrived:{kinds['arrived']},outcome:string>>").alias("out"))
    return rows.select("message_id", "consumer", F.explode(F.aggregate("rows", zero, step)["out"]).alias("o")).select("message_id", "consumer", "o.*")


def inbox_kept(inbox: DataFrame, now: Column, retention_seconds: int) -> DataFrame:
    """inbox without rows whose lock ran out longer than the retention ago."""
    return inbox.where(F.col("expires_at") >= now - F.expr(f"make_dt_interval(0, 0, 0, {retention_seconds})"))


def consumer_key(endpoint: Column, message_type: Column, class_name: Column) -> Column:
    return F.coalesce(F.nullif(endpoint, F.lit("")), F.nullif(message_type, F.lit("")), class_name)


def pending(outbox: DataFrame, batch: int) -> DataFrame:
    """The first undelivered rows by id."""
    if not 1 <= batch <= 10_000:
        raise ValueError("a batch has 1 to 10000 rows")
    return outbox.where("delivered_at IS NULL").orderBy("id").limit(batch)


def mark_delivered(outbox: DataFrame, confirmed: DataFrame, at: Column) -> DataFrame:
    """outbox with delivered_at set for the confirmed ids that had none."""
    ids = confirmed.select("id").distinct().withColumn("_hit", F.lit(True))
    return outbox.join(ids, "id", "left").withColumn("delivered_at", F.coalesce("delivered_at", F.when(F.col("_hit"), at))).drop("_hit")


def outbox_kept(outbox: DataFrame, now: Column, retention_seconds: int) -> DataFrame:
    """outbox without rows delivered longer than the retention ago."""
    return outbox.where(F.col("delivered_at").isNull() | (F.col("delivered_at") >= now - F.expr(f"make_dt_interval(0, 0, 0, {retention_seconds})")))


def append(outbox: DataFrame, new: DataFrame) -> DataFrame:
    """outbox and new rows; rows whose id is there already are passed over."""
    return outbox.unionByName(new.dropDuplicates(["id"]).join(outbox.select("id"), "id", "left_anti"), allowMissingColumns=True)


def request_response(requests: DataFrame, responses: DataFrame, timeout_seconds: int) -> DataFrame:
    """requests (request_id, sent) with the first response (correlation_id, replied, reply) within the timeout, or null."""
    span = F.expr(f"make_dt_interval(0, 0, 0, {timeout_seconds})")
    met = requests.join(responses, (requests["request_id"] == responses["correlation_id"]) & (responses["replied"] >= requests["sent"]) & (responses["replied"] <= requests["sent"] + span), "left")
    return met.groupBy("request_id", "sent").agg(F.min(F.struct("replied", "reply")).alias("x")).select("request_id", "sent", "x.replied", "x.reply")


def orphans(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses that nobody asked for; a missing correlation id is one."""
    return responses.join(requests.select(F.col("request_id").alias("correlation_id")), "correlation_id", "left_anti")


def last_of_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key: an upsert's result."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def update_versions(store: DataFrame, changes: DataFrame, key: str = "correlation_id") -> DataFrame:
    """Optimistic updates: store (key, version, state) after changes (key, expected, new_state), with outcome.

    A change holds if the version is the expected one, and adds one to it; of several for a key the smallest state wins.
    A key without a change is unchanged, one whose version has moved on is a conflict and stays as it is.
    """
    one = changes.groupBy(key, "expected").agg(F.min("new_state").alias("new_state"))
    per_key = one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("expected", "new_state"))).alias("_new"))
    met = store.join(per_key, key, "left").withColumn("_to", F.try_element_at("_new", F.col("version")))
    outcome = F.when(F.col("_new").isNull(), F.lit("unchanged")).when(F.col("_to").isNull(), F.lit("conflict")).otherwise(F.lit("updated"))
    return met.select(key, F.when(F.col("_to").isNotNull(), F.col("version") + 1).otherwise(F.col("version")).alias("version"), F.coalesce("_to", "state").alias("state"), outcome.alias("outcome"))


def single(rows: DataFrame, condition: Column):
    """The one row that meets the condition, or None; two are an error."""
    found = rows.where(condition).limit(2).collect()
    if len(found) > 1:
        raise ValueError("more than one row matches")
    return found[0] if found else None
