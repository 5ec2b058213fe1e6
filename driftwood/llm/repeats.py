"""Exact removal of long repeated byte strings by column-wise construction over many documents at once.

All text is far too long for one suffix order, so windows of `length` bytes are first dealt out by content: each window
names its anchor, the leftmost smallest hash of a GRAM-byte string in it, and successive windows of one anchor make up a
fragment. Equal windows have equal anchors at equal offsets, so they meet in the fragments of one anchor. Fragments
with equal bytes are counted, not compared; the distinct ones of an anchor are lined up at it and sorted
column by column, from right to left: each round inserts one symbol of every fragment, which updates the
Burrows-Wheeler order of the collection (a stable sort of the last order by the new symbol) and the common
prefixes of neighbours (range minima of the last ones). A window repeats where a neighbour's common prefix has `length`.

The order is positional: it only compares suffixes that start at the same column, which are the only ones
that can hold equal windows. A round costs the number of fragments, not the size of the collection so far.
An anchor with more than HOT distinct fragments (one task's share) has its windows counted by digest over all tasks instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64, Workspace, chunks, mix, random64, same, utf8

GRAM, HOT, BUNDLE = 32, 8192, 8192
_POS = (1 << 34) - 1
_BYTE, _BYTE2 = random64(31, 256), random64(32, 256)
_BASE = 0x9E3779B97F4A7C15 | 5
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base modulo 2^64 and of its inverse, n at least."""
    if len(_powers.get("up", ())) < n:
        for k, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, U64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def _sums(raw: np.ndarray, byte: np.ndarray) -> np.ndarray:
    out = np.zeros(len(raw) + 1, U64)
    np.cumsum(byte[raw] * _power(len(raw) + 1)[0][:-1], out=out[1:])
    return out


def _hashes(raw: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the bytes, and the hash of each string of `gram` bytes."""
    total = _sums(raw, _BYTE)
    return total, mix((total[gram:] - total[:-gram]) * _power(len(raw) + 1)[1][: len(raw) - gram + 1])


def fragments(raw: np.ndarray, off: np.ndarray, length: int, gram: int = 0, hashed: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, anchor, anchor's hash, digest of bytes) of each fragment; positions in raw."""
    n, gram = len(raw), gram or min(GRAM, length)
    w = length - gram + 1
    size = np.diff(off)
    fit = np.flatnonzero(size >= length)
    if not len(fit):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U64),) * 2
    down = _power(n + 1)[1]
    total, hashes = hashed or _hashes(raw, gram)
    value = np.full(-(-len(hashes) // w) * w, np.iinfo(np.uint64).max, U64)
    value[: len(hashes)] = (hashes & U64(~_POS & (1 << 64) - 1)) | np.arange(len(hashes), dtype=U64)
    blocks = value.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    valid = np.zeros(n - length + 3, np.int8)
    np.add.at(valid, off[fit] + 1, 1)
    np.add.at(valid, off[fit + 1] - length + 2, -1)
    valid = np.cumsum(valid, dtype=np.int8).astype(bool)  # valid[i + 1]: a window starts at i
    m = n - length + 1
    anchor = (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & U64(_POS)).astype(np.int64)
    turn = np.ones(m + 1, bool)
    turn[1:-1] = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(valid[1 : m + 1] & (turn[:-1] | ~valid[:m]))
    last = np.flatnonzero(valid[1 : m + 1] & (turn[1:] | ~valid[2 : m + 2]))
    at = anchor[first]
    digest = mix(((total[last + length] - total[first]) * down[first]) + (last - first).astype(U64) * U64(0xD6E8FEB86659FD93) + mix((at - first).astype(U64)))
    return np.searchsorted(off, first, "right") - 1, first, last, at, hashes[at], digest


def _pieces(off: np.ndarray, length: int, most: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(i, j, a, b): bytes [a, b) of documents [i, j); of a very long one in pieces, each window in one of them. A piece has
    whole windows of `most` bytes, if that is more, at all its starts."""
    for i, j in chunks(off):
        a, b, step, most = int(off[i]), int(off[j]), common.PIECE_BYTES, max(length, most)
        if j > i + 1 or b - a <= step + most:
            yield i, j, a, b
        else:
            for k in range(a, b - length + 1, step):
                yield i, j, k, min(b, k + step + most - 1)


def _anchored(lengths: tuple[int, ...]):
    """One row for each anchor, with its fragment of every length (null: none). What is an anchor for long windows is one for short ones too."""
    least, most = min(lengths), max(lengths)
    gram, names = min(GRAM, least), [f"{k}{n}" for n in lengths for k in ("first", "last", "digest")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch["text"])
            for i, j, a, b in _pieces(off, least, most):
                ends = off[i : j + 1] - a if j > i + 1 else np.array([0, b - a])
                if np.diff(ends).max() < least:
                    continue
                total, hashes = _hashes(raw[a:b], gram)
                found = []
                for n in lengths:
                    z = min(b - a, common.PIECE_BYTES + n - 1) if b - a < off[j] - off[i] else b - a
                    found.append(fragments(raw[a : a + z], ends if z == b - a else np.array([0, z]), n, gram, (total[: z + 1], hashes[: z - gram + 1])))
                at = np.unique(np.concatenate([x[3] for x in found]))
                doc = np.searchsorted(ends, at, "right") - 1
                head, ids = (off[i:j] - a)[doc], pa.array(doc + i)
                columns = [batch["doc_id"].take(ids), batch["th"].take(ids), pa.array((at - head).astype(np.int32)), pa.array(hashes[at].view(np.int64))]
                for _, first, last, where, _, digest in found:
                    k = np.searchsorted(at, where)
                    none = np.ones(len(at), bool)
                    none[k] = False
                    for x, kind in ((first - head[k], np.int32), (last - head[k], np.int32), (digest.view(np.int64), np.int64)):
                        column = np.zeros(len(at), kind)
                        column[k] = x
                        columns.append(pa.array(column, mask=none))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "at", "anchor", *names])

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = utf8(batch["text"])
        kept: dict[str, list] = {k: [] for k in ("width", "anchor", "digest", "left", "alone", "hot", "twice")}
        content = []
        for o, parts, twice in zip(off.tolist(), batch["parts"], batch["twice"].to_pylist()):
            x = parts.values
            n, a, z, p = (x.field(k).to_numpy() for k in ("width", "first", "last", "at"))
            for k in ("width", "anchor", "digest", "alone", "hot"):
                kept[k].append(x.field(k))
            kept["left"].append(pa.array(p - a))
            kept["twice"].append(pa.repeat(twice, len(a)))
            content += [raw[o + i : o + k].tobytes() for i, k in zip(a.tolist(), (z + n).tolist())]
        if content:
            yield pa.RecordBatch.from_arrays([*map(pa.concat_arrays, kept.values()), pa.array(content, pa.binary())], [*kept, "content"])


def common_windows(group: np.ndarray, left: np.ndarray, content: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fragment, from, to) of bytes, relative to the anchor, covered by windows that another fragment of the group has.

    group is sorted. Column c of a fragment is its byte c after the anchor (before it, if negative).
    """
    n = len(group)
    size = np.array([len(x) for x in content])
    right = size - left
    most_l, most_r = int(left.max()), int(right.max())
    columns = np.full((most_l + most_r, n), 256, np.uint16)
    flat = np.frombuffer(b"".join(content), np.uint8)
    row = np.repeat(np.arange(n), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(most_l - left, size)
    columns[at, row] = flat
    rank = np.cumsum(np.r_[False, group[1:] != group[:-1]]).astype(np.uint16 if n < 65536 else np.int64)
    order = np.arange(n)
    common = np.zeros(n + 1, np.int32)  # common[x]: of order[x - 1] and order[x]; the last is a sentinel
    repeated = np.zeros((most_l + 1, n), bool)
    for c in range(most_l + most_r - 1, -1, -1):
        symbol = columns[c][order]
        by = np.argsort(symbol, kind="stable")
        by = by[np.argsort(rank[order[by]], kind="stable")]
        order, symbol = order[by], symbol[by]
        g = rank[order]
        x = np.flatnonzero((symbol[1:] == symbol[:-1]) & (g[1:] == g[:-1]) & (symbol[1:] != 256))
        new = np.zeros(n + 1, np.int32)
        if len(x):
            spans = np.empty(2 * len(x), np.int64)
            spans[::2], spans[1::2] = by[x] + 1, by[x + 1] + 1
            new[x + 1] = np.minimum(np.minimum.reduceat(common, spans)[::2] + 1, length)
        common = new
        if c <= most_l:
            repeated[c, order] = np.maximum(common[:n], common[1:]) >= length
    edge = np.zeros((n, most_l + 3), np.int8)
    edge[:, 1:-1] = repeated.T
    step = np.diff(edge, axis=1)
    which, begin = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    return which, begin - most_l, end - 1 - most_l + length


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by width and anchor: whole anchors are gathered to bundles of about BUNDLE fragments, and compared.

    Only fragments that stand alone need what comes out; those that occur twice repeat as a whole."""

    def done(width, anchor, digest, left, alone, content):
        which, a, b = common_windows(anchor, left, content, width)
        which, a, b = (x[alone[which]] for x in (which, a, b))
        columns = [np.full(len(which), width, np.int32), anchor[which], digest[which], a.astype(np.int32), b.astype(np.int32)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["width", "anchor", "digest", "a", "b"])

    held: list = []
    width = 0
    for whole in batches:
        widths = whole["width"].to_numpy()
        turns = np.flatnonzero(np.r_[True, widths[1:] != widths[:-1]][: len(widths)])
        for i, j in zip(turns.tolist(), [*turns[1:].tolist(), len(widths)]):
            if held and len(held[0]) and width != widths[i]:
                yield done(width, *held)
                held = []
            width, batch = int(widths[i]), whole.slice(i, j - i)
            new = [batch["anchor"].to_numpy(), batch["digest"].to_numpy(), batch["left"].to_numpy(), batch["alone"].to_numpy(zero_copy_only=False), batch["content"].to_pylist()]
            held = [np.concatenate([x, y]) for x, y in zip(held[:4], new[:4])] + [held[4] + new[4]] if held else new
            while len(held[0]) > BUNDLE:
                cut = int(np.searchsorted(held[0], held[0][BUNDLE - 1]))
                cut = cut or int(np.searchsorted(held[0], held[0][0], "right"))
                if cut == len(held[0]):
                    break  # the anchor may go on in the next batch
                yield done(width, *(x[:cut] for x in held))
                held = [x[cut:] for x in held]
    if held and len(held[0]):
        yield done(width, *held)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(width, anchor, digest, alone, a, w1, w2): the 128-bit digest of each window of each fragment, by its start from the anchor."""
    for whole in batches:
        for k in range(0, len(whole), 64):
            batch = whole.slice(k, 64)
            content = batch["content"].to_pylist()
            width, left = batch["width"].to_numpy(), batch["left"].to_numpy()
            size = np.array([len(x) for x in content])
            raw, n = np.frombuffer(b"".join(content), np.uint8), size - width + 1
            of = np.repeat(np.arange(len(n)), n)
            a = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            first = a + (np.cumsum(size) - size)[of]
            last, down = first + width[of], _power(len(raw) + 1)[1]
            w = [mix((t[last] - t[first]) * down[first]).view(np.int64) for t in (_sums(raw, _BYTE), _sums(raw, _BYTE2))]
            one = pa.array(of)
            yield pa.RecordBatch.from_arrays([*(batch[c].take(one) for c in ("width", "anchor", "digest", "alone")), pa.array((a - left[of]).astype(np.int32)), *map(pa.array, w)], ["width", "anchor", "digest", "alone", "a", "w1", "w2"])


def _merged(lengths: tuple[int, ...]):
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[int, list] = {n: [] for n in lengths}
            for spans in batch["spans"]:
                width, begin, end = (spans.values.field(k).to_numpy() for k in ("width", "a", "b"))
                for n in lengths:
                    a, b = begin[width == n], end[width == n]
                    by = np.argsort(a, kind="stable")
                    a, b = a[by], np.maximum.accumulate(b[by])
                    new = np.r_[True, a[1:] > b[:-1]][: len(a)]
                    out[n].append([{"a": i, "b": j} for i, j in zip(a[new].tolist(), b[np.r_[new[1:], True][: len(a)]].tolist())] or None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], *(pa.array(x, kind) for x in out.values())], ["doc_id", "th", *(f"spans{n}" for n in lengths)])

    return run


def _span_table(text: DataFrame, lengths: tuple[int, ...], hot: int, work: Workspace) -> DataFrame:
    """(doc_id, th, spans of each length) of the rows (doc_id, text, th) that hold a repeated string. What grows with the input is never broadcast.

    Strings of several lengths share the anchors' table and the shuffles; `width` is the length that a row is about."""
    key = text.schema["doc_id"].dataType.simpleString()
    places = f"doc_id {key}, th long, at int, anchor long, " + ", ".join(f"first{n} int, last{n} int, digest{n} long" for n in lengths)
    all_ = work.save(text.mapInArrow(_anchored(lengths), places), "anchors")
    # each table is written before it is joined: joins between plain tables can be split where an anchor is hot
    often = all_.groupBy("anchor").agg(*(f(f"digest{n}").alias(f"{k}{n}") for n in lengths for k, f in (("all", F.count), ("lo", F.min), ("hi", F.max))))
    often = often.where(" OR ".join(f"all{n} > 1" for n in lengths)).select("anchor", *(F.when(F.col(f"all{n}") > 1, F.col(f"lo{n}") != F.col(f"hi{n}")).alias(f"mixed{n}") for n in lengths))
    often = work.save(often, "often")
    wide = work.save(all_.join(often.hint("merge"), "anchor"), "shared")
    work.drop("anchors", "often")
    shared = None
    for n in lengths:
        x = wide.where(f"mixed{n} IS NOT NULL AND digest{n} IS NOT NULL").select("doc_id", "th", "at", "anchor", F.lit(n).alias("width"), *(F.col(f"{k}{n}").alias(k) for k in ("first", "last", "digest", "mixed")))
        shared = shared.unionByName(x) if shared else x
    place = F.struct("doc_id", "th", "first", "last", "at")
    kinds = work.save(shared.groupBy("width", "anchor", "digest").agg(F.count("*").alias("n"), F.max("mixed").alias("mixed"), F.min(place).alias("x")), "kinds")
    met = work.save(shared.join(kinds.select("width", "anchor", "digest", "n").hint("merge"), ["width", "anchor", "digest"]), "met")
    work.drop("shared")
    mixed = kinds.where("mixed")
    crowded = work.save(mixed.groupBy("width", "anchor").agg(F.count("*").alias("size")).where(F.col("size") > hot).select("width", "anchor", F.lit(True).alias("hot")), "crowded")
    part = F.struct("width", "anchor", "digest", "x.first", "x.last", "x.at", (F.col("n") == 1).alias("alone"), F.coalesce("hot", F.lit(False)).alias("hot"))
    one = mixed.join(crowded, ["width", "anchor"], "left").groupBy("x.doc_id", "x.th").agg(F.collect_list(part).alias("parts"))  # a document's own fragments
    again = text.where(F.octet_length("text") >= min(lengths)).groupBy("doc_id", "th").agg(F.count("*").alias("rows")).where("rows > 1")
    one = one.join(again, same(one, again, "doc_id", "th"), "left").select(one["doc_id"], one["th"], one["parts"], F.col("rows").isNotNull().alias("twice"))
    one = work.save(one, "parts")
    texts = text.join(one.hint("merge"), same(text, one, "doc_id", "th")).select(text["text"], "parts", "twice")
    cut = work.save(texts.mapInArrow(_cut_out, "width int, anchor long, digest long, left int, alone boolean, hot boolean, twice boolean, content binary"), "fragments")
    cut = cut.where("NOT twice").unionByName(cut.where("twice").dropDuplicates(["width", "anchor", "digest"]))
    span = "width int, anchor long, digest long, a int, b int"
    compared = cut.where("NOT hot").select("width", "anchor", "digest", "left", "alone", "content").repartition("width", "anchor").sortWithinPartitions("width", "anchor").mapInArrow(_compared, span)
    windows = cut.where("hot").mapInArrow(_windows, "width int, anchor long, digest long, alone boolean, a int, w1 long, w2 long")
    window = ["width", "anchor", "a", "w1", "w2"]
    often = windows.groupBy(*window).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    counted = windows.where("alone").join(often, window, "left_semi").select("width", "anchor", "digest", "a", (F.col("a") + F.col("width")).alias("b"))
    whole = met.where("n > 1").select("doc_id", "th", "width", F.col("first").alias("a"), (F.col("last") + F.col("width")).alias("b"))
    parts = met.where("mixed AND n = 1").join(compared.unionByName(counted), ["width", "anchor", "digest"]).select("doc_id", "th", "width", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b"))
    spans = whole.unionByName(parts).groupBy("doc_id", "th").agg(F.collect_set(F.struct("width", "a", "b")).alias("spans"))  # of one text, however often it is there
    spans = work.save(spans.mapInArrow(_merged(lengths), f"doc_id {key}, th long, " + ", ".join(f"spans{n} array<struct<a:int,b:int>>" for n in lengths)), "spans")
    work.drop("met", "kinds", "crowded", "parts", "fragments")
    return spans


def repeated_spans(docs: DataFrame, *, length: int = 400, work: Workspace | None = None, hot: int = HOT, into: str = "_repeated") -> DataFrame:
    """docs with a column `into`: the maximal runs [a, b) of UTF-8 bytes covered by a repeated string of `length` bytes.

    A string repeats if it starts at another place too, in the same document or another; matches never cross
    documents. Null, empty and short texts have none (null). Rows repeated under one doc_id count as documents of
    their own, so their texts repeat; a null doc_id is an id like any other. Other columns pass through; if one of them
    has the name `into`, it is an error.
    """
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {into}")
    return _spanned(docs, {into: length}, hot, work or Workspace(docs.sparkSession, "repeats"))


def _spanned(docs: DataFrame, lengths: dict[str, int], hot: int, work: Workspace) -> DataFrame:
    """docs with the runs covered by repeated strings of each length in the column of that name."""
    text = F.col("text").cast("string")
    hashed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th"))
    spans = _span_table(hashed, tuple(sorted(set(lengths.values()))), hot, work).withColumnRenamed("doc_id", "key").hint("merge")
    found = docs.join(spans, docs["doc_id"].eqNullSafe(spans["key"]) & (F.xxhash64(docs["text"].cast("string")) == spans["th"]), "left")
    return found.select(*(docs[c] for c in docs.columns), *(spans[f"spans{n}"].alias(into) for into, n in lengths.items()))


def _digested(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch["text"])
            removed, runs, digests, passages = [], [], [], []
            for a, b, spans, more in zip(off[:-1].tolist(), off[1:].tolist(), batch["_repeated"].to_pylist(), batch["_passages"].to_pylist()):
                left, at = sha256(), a
                for s in spans or ():
                    left.update(raw[at : a + s["a"]])
                    at = a + s["b"]
                left.update(raw[at:b])
                removed.append(sum(s["b"] - s["a"] for s in spans or ()))
                runs.append(len(spans or ()))
                digests.append(left.hexdigest())
                passages.append(sum(_has_words(raw[a + s["a"] : a + s["b"]].tobytes(), words) for s in more or ()))
            columns = [pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(passages, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages"])

    return run


def removal_digest(docs: DataFrame, *, length: int = 400, hot: int = HOT, passage: int = 200, words: int = 51) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages) of each row of docs (doc_id, text): what removing the bytes covered
    by repeated strings of `length` bytes leaves, as a digest. A null text is an empty one. Repeated rows are each returned, a null doc_id
    stays null, other columns are ignored.

    n_passages removes nothing: it is the number of maximal runs covered by repeated strings of `passage` bytes that have
    `words` words or more, which is what remove_repeats finds with these values, by the same search.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = _spanned(docs, {"_repeated": length, "_passages": passage}, hot, Workspace(docs.sparkSession, "repeats"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(_digested(words), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long")


def _has_words(run: bytes, words: int) -> bool:
    """Whether it has `words` words at least; those cut at an end count."""
    return len(run.split(None, words)) >= words


def _left_over(text: str, spans: list[dict], words: int, sure: int) -> str:
    """text without the runs of `sure` bytes or `words` words (those cut at an end count); whole characters only."""
    raw, at, kept = text.encode(), 0, []
    for s in spans:
        a, b = s["a"], s["b"]
        if b - a < sure and not _has_words(raw[a:b], words):
            continue
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]).decode() if at else text


def _without(into: str, words: int, sure: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                spans = part[into].to_pylist()
                part = part.drop_columns([into])
                if any(spans):
                    was = part["text"].to_pylist()
                    text = [_left_over(t, s, words, sure) if s else t for t, s in zip(was, spans)]
                    part = part.set_column(part.schema.get_field_index("text"), "text", pa.array(text, part["text"].type))
                    if "n_chars" in part.schema.names:
                        n = [len(t) if t != w else c for t, w, c in zip(text, was, part["n_chars"].to_pylist())]
                        part = part.set_column(part.schema.get_field_index("n_chars"), "n_chars", pa.array(n, part["n_chars"].type))
                    part = part.filter(pa.array([t != "" or w == "" for t, w in zip(text, was)]))
                yield part

    return run


def remove_repeats(docs: DataFrame, *, length: int = 400, words: int = 0, sure: int = 400) -> DataFrame:
    """docs (doc_id, text, a string) without repeated strings: a character goes if all its bytes are covered; documents of
    which nothing is left go too.

    n_chars, a number, follows the text, if docs has it; rows without repeats stay as they are, null and empty texts too. With
    `words`, runs covered by repeats go only if they have that many words or `sure` bytes. Other columns pass through,
    whatever their names.
    """
    into = "_repeated"
    while into in (c.lower() for c in docs.columns):
        into += "_"
    return repeated_spans(docs, length=length, into=into).mapInArrow(_without(into, words, sure), docs.schema)
