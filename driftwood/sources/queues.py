"""Tables as message queues, for batch and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(events: DataFrame) -> DataFrame:
    """The event table as messages: message_id, correlation_id, message_type, sent, amount, body."""
    return events.select(F.col("event_id").alias("message_id"), F.col("user_id").alias("correlation_id"), F.col("event_type").alias("message_type"), F.col("ts").alias("sent"), F.col("value").alias("amount"), F.col("props").alias("body"))


def stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 4) -> DataFrame:
    """A folder of Parquet files as a queue: files are taken in the order of their arrival, each once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deliver(df: DataFrame, path: str) -> None:
    """Appends messages to a queue folder."""
    df.write.mode("append").parquet(path)


def upsert_sink(path: str, key: str):
    """A foreachBatch sink that is idempotent by batch: a batch written twice replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
