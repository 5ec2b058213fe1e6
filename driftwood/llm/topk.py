"""Exact top-k search with a vector-approximation file.

Every vector is quantised: each dimension's range over all vectors is cut into 256 cells of equal whole width, one byte a
dimension. Blocks of queries scan blocks of these cells; midpoint and half width of a cell bound the inner product from
below and above. A candidate stays while its upper bound reaches the k-th best lower bound, first of its block, then of
all blocks. Exact vectors are read in the order of their bounds: the k best first, then those whose bound reaches the
k-th exact score, after which no other row can be among the k best.

The query set meets all rows block by block: cells are dealt to SALTS * (query blocks) groups, so a task holds one block of either.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

QUERIES, VECTORS, SALTS = 1024, 4096, 48


def _matrix(rows: list[bytes], dtype: str, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows of different length as a matrix padded with zeros, and their lengths."""
    size = np.array([len(r) for r in rows], np.int64) // np.dtype(dtype).itemsize
    out = np.zeros((len(rows), max(width, int(size.max(initial=0)))), dtype)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer(b"".join(rows), dtype)
    return out, size


def _scaled(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype(np.float64)).astype("<i8").tobytes() for v in batch["embedding"]]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(rows, pa.binary())], ["vec_id", "exact"])

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low = high = np.zeros(0, np.int64)
    for batch in batches:
        x, size = _matrix(batch["exact"].to_pylist(), "<i8")
        d, there = x.shape[1], np.arange(x.shape[1]) < size[:, None]
        big = np.iinfo(np.int64)
        lo = np.where(there, x, big.max).min(0, initial=big.max)
        hi = np.where(there, x, big.min).max(0, initial=big.min)
        n = max(d, len(low))
        pad = lambda v, fill: np.r_[v, np.full(n - len(v), fill)]
        low, high = np.minimum(pad(low, big.max), pad(lo, big.max)), np.maximum(pad(high, big.min), pad(hi, big.min))
    if len(low):
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low), dtype=np.int32)), pa.array(low), pa.array(high)], ["d", "lo", "hi"])


def _celled(low: np.ndarray, width: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, size = _matrix(batch["exact"].to_pylist(), "<i8", len(low))
            cells = ((x - low) // width).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array([c[:n].tobytes() for c, n in zip(cells, size)], pa.binary())], ["vec_id", "cells"])

    return run


def _scan(low: np.ndarray, width: np.ndarray, k: int):
    """Rows (queries, vectors) of one block each: (query_id, vec_id, lower, upper) that the block itself leaves possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qs, vs in zip(batch["queries"], batch["vectors"]):
                q_id, v_id = (x.values.field("vec_id").to_numpy() for x in (qs, vs))
                q, _ = _matrix(qs.values.field("exact").to_pylist(), "<i8", len(low))
                c, size = _matrix(vs.values.field("cells").to_pylist(), "u1", len(low))
                q = q.astype(np.float64)
                mid = np.where(np.arange(len(low)) < size[:, None], low + c * width.astype(np.float64) + (width - 1) / 2, 0)
                slack = np.abs(q) @ ((width - 1) / 2) + 1 + 1e-9 * (np.abs(q) @ np.abs(mid).max(0, initial=0))
                near = q @ mid.T
                near[q_id[:, None] == v_id] = -np.inf
                kth = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(q), -np.inf)
                i, j = np.nonzero((near + slack[:, None] >= (kth - slack)[:, None]) & (near > -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(q_id[i]), pa.array(v_id[j]), pa.array(near[i, j] - slack[i]), pa.array(near[i, j] + slack[i])], ["query_id", "vec_id", "lower", "upper"])

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, _ = _matrix(batch["q"].to_pylist(), "<i8")
        b, _ = _matrix(batch["x"].to_pylist(), "<i8")
        n = min(a.shape[1], b.shape[1])
        yield pa.RecordBatch.from_arrays([batch["query_id"], batch["vec_id"], pa.array((a[:, :n] * b[:, :n]).sum(1))], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: Column, *, k: int = 10, scale: float = 1024.0, work: Workspace | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest integer inner product for each row that queries selects.

    Components become floor(scale * x); their products must fit in 64 bits. Ties go to the smaller vec_id, a
    query is no candidate of its own, and fewer than k other rows give fewer ranks. Rows take no part if vec_id or embedding is null or
    a component is null or not finite. Shorter vectors count as if filled up with zeros. Rows repeated under one vec_id are one
    vector, the smallest of them. Other columns are ignored.
    """
    work = work or Workspace(vectors.sparkSession, "topk")
    good = F.expr("embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    rows = vectors.where(good & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    exact = work.save(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).mapInArrow(_scaled(scale), "vec_id long, exact binary"), "exact")
    asked = exact.where(queries)
    n, m = exact.count(), asked.count()
    spans = exact.mapInArrow(_ranges, "d int, lo long, hi long").groupBy("d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("d").collect()
    low = np.array([r["lo"] for r in spans], np.int64)
    width = np.array([-(-(r["hi"] - r["lo"] + 1) // 256) for r in spans], np.int64)
    parts = max(1, ceil(m / QUERIES))
    cells = work.save(exact.mapInArrow(_celled(low, width), "vec_id long, cells binary"), "cells")
    blocks = cells.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, ceil(n / VECTORS)))).alias("block")).agg(F.collect_list(F.struct("vec_id", "cells")).alias("vectors"))
    left = blocks.select(F.pmod("block", F.lit(SALTS)).alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "vectors")
    lists = asked.groupBy(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int").alias("part")).agg(F.collect_list(F.struct("vec_id", "exact")).alias("queries"))
    right = lists.select("part", "queries", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(min(SALTS, max(1, ceil(n / VECTORS))) - 1).cast("long"))).alias("salt"))
    scanned = left.join(right, ["part", "salt"]).select("queries", "vectors").mapInArrow(_scan(low, width, k), "query_id long, vec_id long, lower double, upper double")
    scanned = work.save(scanned, "scanned")
    by = Window.partitionBy("query_id")
    sure = scanned.withColumn("r", F.row_number().over(by.orderBy(F.desc("lower"), "vec_id"))).where(f"r <= {k}").groupBy("query_id").agg(F.min("lower").alias("least"), F.count("*").alias("c"))
    open_ = work.save(scanned.join(sure, "query_id").where(f"c < {k} OR upper >= least").select("query_id", "vec_id", "upper"), "open")
    # windows keep k rows of a query at most, so Spark limits them in each task before the shuffle
    best = work.save(open_.withColumn("r", F.row_number().over(by.orderBy(F.desc("upper"), "vec_id"))).where(f"r <= {k}").drop("r"), "best")
    first = work.save(_read(best, exact), "first")
    kth = first.groupBy("query_id").agg(F.min("score").alias("kth"))
    last = best.groupBy("query_id").agg(F.min(F.struct("upper", F.expr("~vec_id").alias("v"))).alias("last")).join(kth, "query_id")  # ~ turns the order of ids around
    after = "upper >= kth AND (upper < last.upper OR upper = last.upper AND vec_id > ~last.v)"
    rest = work.save(_read(open_.join(last, "query_id").where(after).select("query_id", "vec_id"), exact), "rest")
    work.drop("scanned", "cells", "open", "best")
    rank = F.row_number().over(by.orderBy(F.desc("score"), "vec_id"))
    return first.unionByName(rest).withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def _read(pairs: DataFrame, exact: DataFrame) -> DataFrame:
    met = pairs.join(exact.withColumnRenamed("exact", "x"), "vec_id").join(exact.select(F.col("vec_id").alias("query_id"), F.col("exact").alias("q")), "query_id")
    return met.select("query_id", "vec_id", "q", "x").mapInArrow(_exact, "query_id long, vec_id long, score long")
