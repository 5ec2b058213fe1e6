"""Streaming forms of the stateful operators; on the same input they end as the batch forms do."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.saga import INITIAL, Machine

SAGA_SCHEMA = "key long, id long, event string, from_state string, to_state string, emitted array<string>, finalized boolean"


def saga_processor(machine: Machine) -> StatefulProcessor:
    """Keeps the state and version of each key's saga; gives a row for each event that a step handles."""
    table = machine.table()

    class Saga(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.saga = handle.getValueState("saga", "state string, version int")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            state, version = self.saga.get() if self.saga.exists() else (INITIAL, 0)
            events = pd.concat(list(rows)).sort_values(["ts", "id"])
            out = []
            for row in events.itertuples(index=False):
                step = table.get((state, row.event))
                if step is None:
                    continue
                to = step.to or state
                out.append((key[0], row.id, row.event, state, to, list(step.emits), step.finalize))
                version = 0 if step.finalize or state == INITIAL else version + 1
                state = INITIAL if step.finalize else to
            if state == INITIAL:
                self.saga.clear()
            else:
                self.saga.update((state, version))
            yield pd.DataFrame(out, columns=["key", "id", "event", "from_state", "to_state", "emitted", "finalized"])

        def close(self) -> None:
            pass

    return Saga()


def saga_stream(events: DataFrame, machine: Machine) -> DataFrame:
    """events (key long, ts, id, event) as a stream of handled transitions, exactly once for each event.

    Within a batch a key's events are put in order; across batches they count in the order of arrival.
    """
    return events.groupBy("key").transformWithStateInPandas(statefulProcessor=saga_processor(machine), outputStructType=SAGA_SCHEMA, outputMode="Append", timeMode="None")


def first_deliveries_stream(deliveries: DataFrame, within: str = "1 hour") -> DataFrame:
    """The first delivery of each (message_id, consumer); state is dropped when the watermark has passed."""
    return deliveries.withWatermark("arrived", within).dropDuplicatesWithinWatermark(["message_id", "consumer"])


def counters_stream(messages: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Messages by type and tumbling window of event time."""
    w = F.window("sent", window)
    return messages.withWatermark("sent", late).groupBy(w, "message_type").agg(F.count("*").alias("messages")).select(F.col("window.start").alias("start"), "message_type", "messages")


def run_to_end(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What is there now, run through df and written to a table in folder, which all executors share.

    In append mode the file sink writes every row once; in complete mode each batch replaces the table.
    """
    out = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = out.format("parquet").option("path", f"{folder}/table").start()
    else:
        q = out.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/table")).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/table")


def state_in_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
