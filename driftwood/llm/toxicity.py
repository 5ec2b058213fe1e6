"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is lower-cased and all but letters, digits and bytes above 127 becomes blank. Its subwords are the 3- to 5-byte strings inside
or at the edges of words, hashed to buckets; each bucket has a vector. The vectors of a window of WINDOW bytes are
averaged into a softmax over two classes; a document is as toxic as its worst window, so a few words count in a
long text as well. A misspelt word shares most of its subwords with the word. Once trained, vectors and softmax are linear, so each
bucket is one number and scoring is a table look-up with running sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import LOWER, chunks, held_out, utf8
from .labelled import sample

BUCKETS, DIM, WINDOW, SIZES = 1 << 17, 16, 24, (3, 4, 5)
#: The bounds on the labelled rows of either class that are learned from, and on their bytes.
PER_CLASS, MOST_BYTES = 700, 3 << 20
_PLAIN = LOWER.copy()
_PLAIN[:48] = _PLAIN[58:65] = _PLAIN[91:97] = _PLAIN[123:128] = 32


def subwords(raw: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size: the starts of the subwords in raw, in order, and their buckets."""
    low = _PLAIN[raw]
    blank = np.cumsum(np.r_[0, low == 32], dtype=np.int32)
    code = low.astype(np.uint32)
    ends = np.zeros(len(raw) + 1, np.int32)
    ends[off[1:]] = 1
    seam = np.cumsum(ends, dtype=np.int32)  # a subword lies in one document
    out = []
    for n in SIZES:
        m = len(raw) - n + 1
        if m <= 0:
            out.append((np.zeros(0, np.int32), np.zeros(0, np.uint32)))
            continue
        h = np.full(m, n, np.uint32)
        for j in range(n):
            h = (h ^ code[j : m + j]) * np.uint32(16777619)
            h ^= h >> np.uint32(15)
        at = np.flatnonzero((blank[n - 1 : m + n - 1] == blank[1 : m + 1]) & (seam[:m] == seam[n - 1 : m + n - 1])).astype(np.int32)
        out.append((at, h[at] % np.uint32(BUCKETS)))
    return out


def windows(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, from, to) of overlapping windows; an empty document has none."""
    size = np.diff(off)
    n = np.where(size > 0, np.maximum(1, -(-(size - WINDOW // 2) // (WINDOW // 2))), 0)
    doc = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    a = off[doc] + k * (WINDOW // 2)
    return doc, a, np.minimum(a + WINDOW, off[doc + 1])


def averages(raw: np.ndarray, off: np.ndarray, weight: np.ndarray, parts=None) -> tuple[np.ndarray, ...]:
    """(document, from, to, mean weight of subwords) of each window."""
    doc, a, b = windows(off)
    value, count = np.zeros(len(raw) + 1), np.zeros(len(raw) + 1, np.int32)
    for at, bucket in parts or subwords(raw, off):
        value[at + 1] += weight[bucket]
        count[at + 1] += 1
    np.cumsum(value, out=value)
    np.cumsum(count, out=count)
    return doc, a, b, (value[b] - value[a]) / np.maximum(count[b] - count[a], 1)


def train(texts: list[str], labels: list[int], share: float, *, epochs: int = 60, rate: float = 1.0, seed: int = 5) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias) of the trained vectors and softmax; share is the frequency of label 1 to expect."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    raw, off = utf8(pa.array(texts, pa.string()))
    cuts = [(int(off[i]), subwords(raw[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in chunks(off, 1 << 18)]  # a little at a time, on the driver
    parts = [(np.concatenate([o + c[k][0] for o, c in cuts], dtype=np.int32), np.concatenate([c[k][1] for _, c in cuts])) for k in range(len(SIZES))]
    del cuts
    rng = np.random.default_rng(seed)
    vectors, soft, bias = np.zeros((BUCKETS, DIM)), rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)
    grown, softer, biased = np.full(BUCKETS, 1e-8), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for epoch in range(epochs):
        to_one = soft[:, 1] - soft[:, 0]
        doc, a, b, mean = averages(raw, off, vectors @ to_one, parts)
        if epoch < 3:  # at first, whole documents
            use, a, b = np.flatnonzero(np.diff(off)), off[:-1][np.diff(off) > 0], off[1:][np.diff(off) > 0]
        else:
            top = np.lexsort((-mean, doc))
            top = top[np.r_[True, doc[top][1:] != doc[top][:-1]]]
            use, a, b = doc[top], a[top], b[top]
        x, n = np.zeros((len(use), DIM)), np.zeros(len(use))
        picked = []
        for at, bucket in parts:
            i, j = np.searchsorted(at, a), np.searchsorted(at, b)
            m = j - i
            rows = np.repeat(np.arange(len(use), dtype=np.int32), m)
            shift = (i - (np.cumsum(m) - m)).astype(np.int32)
            picked.append((rows, bucket[np.arange(len(rows), dtype=np.int32) + shift[rows]]))
            n += m
        n = np.maximum(n, 1)
        for d in range(DIM):
            for rows, got in picked:
                x[:, d] += np.bincount(rows, vectors[got, d], len(use))
        x /= n[:, None]
        logit = x @ to_one + bias[1] - bias[0]
        wrong = (1 / (1 + np.exp(-logit)) - y[use]) * balance[use]
        step = np.zeros(BUCKETS)
        for rows, got in picked:
            step += np.bincount(got, (wrong / n)[rows], BUCKETS)
        grad = np.outer(x.T @ wrong, [-1, 1])
        grown += step**2 * (to_one**2).sum()
        vectors -= np.outer(rate * step / np.sqrt(grown), to_one)
        softer += grad**2
        soft -= 0.1 * rate * grad / np.sqrt(softer)
        down = np.array([-wrong.sum(), wrong.sum()])
        biased += down**2
        bias -= 0.1 * rate * down / np.sqrt(biased)
    prior = np.log((share + 1e-3) / (1 - share + 1e-3))
    return (vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0] + 0.25 * prior)


def score(raw: np.ndarray, off: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    n, best, half = len(off) - 1, np.full(len(off) - 1, -np.inf), WINDOW // 2
    step = max(len(raw), 1) if n > 1 else common.PIECE_BYTES // half * half  # a very long document goes piece by piece, in step with its windows
    for k in range(0, max(len(raw), 1), step):
        if n > 1:
            doc, _, _, mean = averages(raw, off, weight)
        elif k and len(raw) - k <= half:
            break  # the last window of the piece before ends here
        else:
            piece, more = raw[k : k + step + half], raw[k : k + step + half + max(SIZES)]  # subwords may end beyond their window
            doc, _, _, mean = averages(more, np.array([0, len(piece)]), weight, subwords(more, np.array([0, len(more)])))
        np.maximum.at(best, doc, mean)
    return 1 / (1 + np.exp(-np.clip(np.where(np.isinf(best), 0, best) + bias, -30, 30)))


def _scored(weight: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch["text"])
            out = [score(raw[off[i] : off[j]], off[i : j + 1] - off[i], weight, bias) for i, j in chunks(off)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs, learned from labels (doc_id, toxic).

    A null or empty text has the score of no evidence. A null doc_id is scored too; its held_out is null. Repeated rows are each scored; other columns
    are ignored. Without labels of both classes every document gets the share of label 1.
    """
    weight, bias = train(*sample(docs, labels, "toxic", per_class, MOST_BYTES))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scored(weight, bias), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
