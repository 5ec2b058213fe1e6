"""What the operators of this subpackage share: a workspace for tables between stages, and byte-level text kernels.

The kernels run on whole Arrow batches with numpy, inside Spark tasks; nothing here holds more than one batch.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one numpy pass holds; the temporaries are about 60 times as much.
CHUNK_BYTES = 1 << 17
#: A longer document is worked on in pieces of so many bytes.
PIECE_BYTES = 1 << 19
#: What bounds a task's memory while a Workspace saves a table: Arrow batches of so many bytes (or one row), also where a row is
#: a whole group.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: Files of such a table for each core of the cluster at most. A task takes what it gets partition by partition.
FILES_PER_CORE = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Workspace:
    """Tables that cut lineage, as Parquet in the shared folder that the cluster names in spark.checkpoint.dir.

    A table survives lost executors, unlike cached blocks. drop() removes what no later plan reads.
    """

    def __init__(self, spark: SparkSession, what: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = root or "/tmp/checkpoints"  # one machine, nothing set
        self.spark, self.root = spark, f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read back, with SETTINGS meanwhile; the number of files is bounded by the cluster's cores, whatever
        the number of shuffle partitions."""
        path, was = f"{self.root}/{name}", {k: self.spark.conf.get(k) for k in SETTINGS}
        for k, v in SETTINGS.items():
            self.spark.conf.set(k, v)
        try:
            df.coalesce(FILES_PER_CORE * self.spark.sparkContext.defaultParallelism).write.parquet(path)
        finally:
            for k, v in was.items():
                self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def same(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    """Null-safe equality on keys; Spark hashes it like an ordinary equi-join."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def held_out(doc_id: Column | str) -> Column:
    """True for the fold that no classifier learns from."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, and int64 offsets of each (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of documents of about `most` bytes together, one document at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def random64(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=np.uint64)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_WORD = random64(11, 64 * 256)
_STEP = random64(12, 5) | U64(1)
_SHORT = random64(13, 8)


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without white space, A-Z lower-cased), and how many each document has."""
    if len(off) == 2 and len(raw) > PIECE_BYTES:
        blank = np.flatnonzero(SPACE[raw])  # a piece ends where a word does
        ends, out = np.searchsorted(blank, np.arange(PIECE_BYTES, len(raw), PIECE_BYTES)), []
        cuts = np.unique(np.r_[0, blank[ends[ends < len(blank)]], len(raw)])
        for a, b in zip(cuts[:-1], cuts[1:]):
            out.append(_word_hashes(raw[a:b], np.array([0, b - a]))[0])
        words = np.concatenate(out)
        return words, np.array([len(words)])
    return _word_hashes(raw, off)


def _word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[raw]
    inside = ~SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = off[:-1][off[:-1] < off[1:]]
    first[starts] = inside[starts]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, U64), np.zeros(len(off) - 1, np.int64)
    begins = np.flatnonzero(first)
    heads = np.flatnonzero(first[at])
    pos = at - np.repeat(begins, np.diff(np.append(heads, len(at))))
    part = _WORD[((pos & 63) << 8) | low[at]]
    if pos.max() > 63:
        part = part * ((pos >> 6).astype(U64) * U64(2) + U64(1))
    words = mix(np.add.reduceat(part, heads))
    return words, np.diff(np.searchsorted(begins, off))


def shingle_sets(raw: np.ndarray, off: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each document's word shingles; fewer words than size make one shingle."""
    words, count = word_hashes(raw, off)
    ends = np.cumsum(count)
    n = len(words)
    if n >= size:
        sh = np.zeros(n - size + 1, U64)
        for j in range(size):
            sh += words[j : n - size + 1 + j] * _STEP[j]
        sh = mix(sh)
    out = []
    for e, c in zip(ends.tolist(), count.tolist()):
        if c >= size:
            out.append(np.unique(sh[e - c : e - size + 1]))
        elif c:
            out.append(mix((words[e - c : e] * _STEP[:c]).sum(keepdims=True) + _SHORT[c]))
        else:
            out.append(np.zeros(0, U64))
    return out
