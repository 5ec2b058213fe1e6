"""Every query of the catalog against its SQL."""

import pytest
from pyspark.sql import functions as F

from driftwood.plans import catalog, messages, streams, transports  # noqa: F401


def _norm(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_as_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr([_norm(r[c]) for c in columns]) for r in df.collect())
    cur = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted(repr([_norm(r[names.index(c)]) for c in columns]) for r in cur.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("files", [0, 5])
def test_streams_read_a_file_and_a_folder(spark, sf_dir, tmp_path, files):
    """events.parquet as one file and as part files in no order of time, against the batch forms."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if files:
        events.repartition(files, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    else:
        (tmp_path / "events.parquet").symlink_to(f"{sf_dir}/events.parquet")
    rows = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    path = str(tmp_path)
    assert rows(streams.inbox_stream(spark, path)) == rows(events.select("event_id", "event_type").distinct()) != []
    batch = events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type").count()
    assert rows(streams.metrics_stream(spark, path)) == rows(batch)
    saga = catalog.QUERIES["saga_emitted"](spark, sf_dir)
    assert rows(streams.saga_stream(spark, path).select(*saga.columns)) == rows(saga)
