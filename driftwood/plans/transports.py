"""Registered queries over transports, topology and configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import config, stores, transport
from ..sources.queues import read
from .catalog import _DISPATCH, _SETTLE, DAY, _inbound, _settled, _values, query


@query("SELECT event_id, delivery_tag, delivery_tag <= 1000 AS is_confirmed FROM (SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS delivery_tag FROM events) x")
def transport_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.confirmed(read(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], DAY).select("event_id", "delivery_tag", "is_confirmed")


@query("SELECT event_id FROM events WHERE event_id % 5 <> 0")
def transport_sink_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.sink_errors(read(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 5 = 0 THEN 'x' WHEN event_id % 5 = 1 THEN '' END AS header_exchange"), None).select("event_id")


@query("SELECT * FROM (VALUES ('queue', 'q', 2), ('exchange', 'x', 1), ('exchange_binding', 'x-y', 4), ('queue_binding', 'x-q', 3), ('exchange', 'y', 1)) AS t(kind, name, step)")
def topology_deploy(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _values(spark, "('queue', 'q'), ('exchange', 'x'), ('exchange_binding', 'x-y'), ('queue_binding', 'x-q'), ('exchange', 'y')", "kind, name")
    return transport.deploy_order(parts).withColumn("step", F.col("step").cast("int"))


@query("SELECT event_id, concat('driftwood.delay.', CAST(1000 * (1 + user_id % 3) AS BIGINT), '.', event_type) AS queue FROM events WHERE event_type = 'error'")
def saga_delay_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select("event_id", transport.delay_queue(1000 * (1 + F.col("user_id") % 3), F.col("event_type")).alias("queue"))


@query(_DISPATCH + f"\nSELECT message_id, 'main.dlx' AS exchange, coalesce(message_type, 'none') AS routing_key FROM (SELECT *, {_SETTLE} AS action FROM t) x WHERE action IN ('Nack', 'Reject') AND endpoint = 'main'")
def dead_letter_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    queues = spark.sql("SELECT * FROM VALUES ('main', 'main.dlx', CAST(NULL AS STRING)), ('audit', '', 'x') AS t(endpoint, dead_letter_exchange, dead_letter_key)")
    rows = _settled(spark, sf_dir).withColumn("routing_key", F.coalesce("message_type", F.lit("none")))
    return transport.dead_lettered(rows, queues).select("message_id", "exchange", "routing_key")


@query("SELECT user_id, bool_and(before IS NULL OR ts >= before) AS ordered FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) x GROUP BY user_id")
def processing_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.in_order(read(spark, sf_dir, "events"), "user_id", "event_id", "ts", "event_id DIV 10000")


@query("""
SELECT c_custkey AS correlation_id, CAST(c_nationkey + CASE WHEN c_acctbal >= 0 AND c_mktsegment <> 'BUILDING' THEN 1 ELSE 0 END AS INTEGER) AS version,
  CASE WHEN c_acctbal >= 0 AND c_mktsegment <> 'BUILDING' THEN 'Next' ELSE 'Old' END AS state,
  CASE WHEN c_acctbal < 0 THEN 'unchanged' WHEN c_mktsegment <> 'BUILDING' THEN 'updated' ELSE 'conflict' END AS outcome FROM customer""")
def saga_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey AS correlation_id", "c_nationkey AS version", "'Old' AS state", "c_acctbal", "c_mktsegment")
    changes = rows.where("c_acctbal >= 0").selectExpr("correlation_id", "IF(c_mktsegment = 'BUILDING', version + 7, version) AS expected", "'Next' AS new_state")
    return stores.update_versions(rows.select("correlation_id", "version", "state"), changes)


@query("SELECT * FROM (VALUES ('b', 'no consumer'), ('b', 'prefetch must be above zero'), ('c', 'no transport'), ('d', 'concurrency must be above zero')) AS t(endpoint, error)")
def endpoint_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.endpoint_errors(_values(spark, "('a', 1, 16, 1, 'queue'), ('b', 0, 0, 1, 'queue'), ('c', 2, 1, 1, ''), ('d', 2, 1, 0, 'queue')", "endpoint, consumers, prefetch, concurrency, transport"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'main' WHEN event_id % 11 <> 0 THEN event_type ELSE 'Handler' END AS consumer FROM events")
def inbox_consumer_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _inbound(spark, sf_dir).withColumn("named", F.expr("IF(message_id % 3 = 0, 'main', '')"))
    return rows.select(F.col("message_id").alias("event_id"), stores.consumer_key(F.col("named"), F.col("message_type"), F.lit("Handler")).alias("consumer"))
