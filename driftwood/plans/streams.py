"""Streaming forms of registered queries: the event table is read as a queue to its end, state and all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.queues import read
from ..streaming import twins
from .catalog import FLOW, ORACLES, query


def _folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or "/tmp/checkpoints"  # one machine, nothing set
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory()


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream, with ts as a time that watermarks take."""
    schema = read(spark, sf_dir, "events").schema
    path = f"{sf_dir}/events.parquet"
    if _is_folder(spark, path):  # all files in one batch: part files are in no order of time
        files = spark.readStream.schema(schema).parquet(path)
    else:  # a stream opens folders only
        files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


@query(ORACLES["saga_emitted"])
def saga_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    twins.state_in_rocksdb(spark)
    events = _queue(spark, sf_dir).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), F.col("event_type").alias("event"))
    out = twins.run_to_end(twins.saga_stream(events, FLOW), _folder(spark))
    return out.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "from_state", "to_state", F.explode("emitted").alias("emitted"))


@query("SELECT DISTINCT event_id AS message_id, event_type AS consumer FROM events")
def inbox_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event arrives twice; one of each pair goes on."""
    twins.state_in_rocksdb(spark)
    rows = _queue(spark, sf_dir).select(F.explode(F.array(F.lit(0), F.lit(10))).alias("later"), F.col("event_id").alias("message_id"), F.col("event_type").alias("consumer"), "ts")
    rows = rows.withColumn("arrived", F.expr("ts + make_dt_interval(0, 0, 0, later)"))
    return twins.run_to_end(twins.first_deliveries_stream(rows.drop("later", "ts")), _folder(spark)).select("message_id", "consumer")


@query("SELECT date_trunc('hour', ts) AS start, event_type AS message_type, CAST(count(*) AS BIGINT) AS messages FROM events GROUP BY 1, 2")
def metrics_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _queue(spark, sf_dir).select(F.col("ts").alias("sent"), F.col("event_type").alias("message_type"))
    out = twins.run_to_end(twins.counters_stream(rows), _folder(spark), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "message_type", "messages")
