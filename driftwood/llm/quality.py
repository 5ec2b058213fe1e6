"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes, all of them. A passage is encoded from its bytes: shares of byte kinds,
of hashed byte pairs, and of words that repeat one of the words before them. A hidden layer h = tanh(f A) feeds a gated
attention, softmax over the bag of (tanh(h V) * sigmoid(h U)) w, and the weighted mean of h is scored. The attention is
learned from document labels alone. Weights of a bag are summed in two passes over its passages, so a document may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import SPACE, chunks, held_out, utf8, word_hashes
from .labelled import sample

PASSAGE, PAIRS, HIDDEN, GATE, LAGS = 768, 128, 24, 12, 4
#: The bound on the labelled rows of either class that are learned from.
PER_CLASS = 1500
#: Kinds of bytes: each ASCII byte for itself but capitals, digits and control bytes; the lead and other bytes of longer characters.
_KIND = np.arange(256, dtype=np.int64)
_KIND[:32], _KIND[10], _KIND[48:58], _KIND[65:91], _KIND[128:192], _KIND[192:] = 1, 10, 48, 65, 2, 3
_KIND = np.unique(_KIND, return_inverse=True)[1]
KINDS = int(_KIND.max()) + 1
FEATURES = KINDS + PAIRS + LAGS + 3


def passages(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document of each passage, its features). An empty document is one empty passage."""
    size = np.diff(off)
    n = np.maximum(1, -(-size // PASSAGE))
    first = np.cumsum(n) - n
    total = int(n.sum())
    which = np.repeat(first, size) + (np.arange(len(raw)) - np.repeat(off[:-1], size)) // PASSAGE
    count = np.maximum(np.bincount(which, minlength=total), 1)[:, None]
    kinds = np.bincount(which * KINDS + _KIND[raw], minlength=total * KINDS).reshape(total, KINDS) / count
    pair = np.zeros((total, PAIRS))
    if len(raw) > 1:
        one = which[1:] == which[:-1]
        code = (_KIND[raw[:-1]] * 31 + _KIND[raw[1:]] * 17) % PAIRS
        pair = np.bincount((which[1:] * PAIRS + code)[one], minlength=total * PAIRS).reshape(total, PAIRS) / count
    words, many = word_hashes(raw, off)
    inside = ~SPACE[raw]
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    starts = off[:-1][size > 0]
    head[starts] = inside[starts]
    own = which[np.flatnonzero(head)]
    n_words = np.maximum(np.bincount(own, minlength=total), 1)
    lag = np.zeros((total, LAGS))
    for k in range(1, LAGS + 1):
        if len(words) > k:
            again = (words[k:] == words[:-k]) & (own[k:] == own[:-k])
            lag[:, k - 1] = np.bincount(own[k:][again], minlength=total) / n_words
    shape = np.stack([np.log1p(count[:, 0]) / 7, count[:, 0] / n_words / 20, np.minimum(n_words / 200, 1)], 1)
    return np.repeat(np.arange(len(size)), n), np.concatenate([kinds * 10, pair * 10, lag * 4, shape], 1).astype(np.float32)


def train(texts: list[str], labels: list[int], share: float, *, epochs: int = 60, rate: float = 5e-3, seed: int = 3) -> dict[str, np.ndarray]:
    """The network's weights, by Adam on whole bags; share is the frequency of label 1 to expect."""
    rng = np.random.default_rng(seed)
    net = {"A": rng.normal(0, 0.15, (FEATURES, HIDDEN)), "a": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE), "c": np.zeros(HIDDEN), "b": np.zeros(1)}
    y = np.array(labels, float)
    prior = np.log((share + 1e-3) / (1 - share + 1e-3))
    if not len(y) or y.min() == y.max():
        return net | {"b": np.array([prior])}
    raw, off = utf8(pa.array(texts, pa.string()))
    parts = [(i, passages(raw[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in chunks(off, 1 << 18)]  # a little at a time, on the driver
    bag, feats = np.concatenate([i + p[0] for i, p in parts]), np.concatenate([p[1] for _, p in parts])
    del raw, parts
    mid, wide = feats.mean(0), feats.std(0) + 1e-3
    feats = ((feats - mid) / wide).clip(-8, 8)
    first = np.searchsorted(bag, np.arange(len(y) + 1))
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    m, v, t = {k: 0.0 for k in net}, {k: 0.0 for k in net}, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(y), 128):
            docs = order[s : s + 128]
            n = first[docs + 1] - first[docs]
            own = np.repeat(np.arange(len(docs)), n)
            x = feats[np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[docs], n)]
            x = x * (rng.random(x.shape, np.float32) > 0.1)
            h = np.tanh(x @ net["A"] + net["a"])
            p, q = np.tanh(h @ net["V"]), 1 / (1 + np.exp(-(h @ net["U"])))
            e = np.exp((p * q) @ net["w"])
            heads = np.cumsum(n) - n
            share_of = e / np.add.reduceat(e, heads)[own]
            z = np.add.reduceat(share_of[:, None] * h, heads)
            g = (1 / (1 + np.exp(-(z @ net["c"] + net["b"][0]))) - y[docs]) * balance[docs] / len(docs)
            gz = np.outer(g, net["c"])
            gs = (gz[own] * h).sum(1)
            gs = share_of * (gs - np.add.reduceat(share_of * gs, heads)[own])
            gp, gq = gs[:, None] * net["w"] * q * (1 - p**2), gs[:, None] * net["w"] * p * q * (1 - q)
            gh = (share_of[:, None] * gz[own] + gp @ net["V"].T + gq @ net["U"].T) * (1 - h**2)
            grad = {"A": x.T @ gh + 1e-4 * net["A"], "a": gh.sum(0), "V": h.T @ gp, "U": h.T @ gq, "w": (p * q).T @ gs, "c": z.T @ g + 1e-4 * net["c"], "b": g.sum(keepdims=True)}
            t += 1
            for k, d in grad.items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                net[k] = net[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net["A"], net["a"] = net["A"] / wide[:, None], net["a"] - (mid / wide) @ net["A"]
    return {k: x.astype(np.float32) for k, x in net.items()} | {"b": net["b"] + prior}


def score(raw: np.ndarray, off: np.ndarray, net: dict[str, np.ndarray]) -> np.ndarray:
    n, above, below = len(off) - 1, 0.0, 0.0
    step = len(raw) if n > 1 else common.PIECE_BYTES // PASSAGE * PASSAGE  # a very long document is summed up piece by piece
    for k in range(0, max(len(raw), 1), max(step, 1)):
        piece = raw[k : k + step]
        bag, feats = passages(piece, off if n > 1 else np.array([0, len(piece)]))
        h = np.tanh(feats @ net["A"] + net["a"])
        e = np.exp((np.tanh(h @ net["V"]) / (1 + np.exp(-(h @ net["U"])))) @ net["w"])
        above, below = above + np.bincount(bag, e * (h @ net["c"]), n), below + np.bincount(bag, e, n)
    one = above / below
    return 1 / (1 + np.exp(-np.clip(one + net["b"][0], -30, 30)))


def _scored(net: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch["text"])
            out = [score(raw[off[i] : off[j]], off[i : j + 1] - off[i], net) for i, j in chunks(off)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs, learned from labels (doc_id, quality).

    A null or empty text is a bag of one empty passage. A null doc_id is scored too; its held_out is null. Repeated rows are each scored;
    other columns are ignored. Without labels of both classes every document gets the share of label 1.
    """
    net = train(*sample(docs, labels, "quality", per_class))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scored(net), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, threshold: float = 0.3) -> DataFrame:
    """The rows of docs with a score of threshold at least, all columns as they are; null and empty texts are scored too."""
    net = train(*sample(docs, labels, "quality", per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch["text"])
            out = [score(raw[off[i] : off[j]], off[i : j + 1] - off[i], net) for i, j in chunks(off)]
            yield batch.filter(pa.array(np.concatenate(out) >= threshold)) if out else batch

    return docs.mapInArrow(run, docs.schema)
