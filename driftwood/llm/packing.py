"""Online packing of token sequences into windows by the sum-of-squares rule.

Every task packs the documents of its own partition, in order: no shuffle, no state outside the task, and a retried
task repeats itself. Documents longer than a window first fill whole windows. What is left, a piece of s tokens, goes
to the fill level h whose choice makes the sum of squared counts of partially filled windows smallest: placing on
level h changes it by 2 * (N[h + s] - N[h]) + 2, opening a new window by 2 * N[s] + 1, and a window that gets full drops
out (-2 * N[h] + 1). Only levels in use are looked at, in a level array with the open windows of each.

At most OPEN windows stay open in a task; beyond that, and at its end, the partially filled windows are poured together: pieces
are cut so that all windows but one are full, and the last is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CACHE, RUN = 4096, 500_000, 1 << 22
_BLANKS = "\t\n\r\x0b\x0c"
SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: A full stop or comma that ends a word: a token of its own after a letter or digit, so that the word is kept once.
#: Only after those of Latin-1: others may get marks by the tokenizer's NFC or lower case, and a mark goes with the point.
_POINT = regex.compile(r"(?<=[[\p{L}\p{N}]&&[\x00-\xFF]])([.,])(?= |$)", regex.V1)


def _folded(text: str) -> str:
    """The text in lower case, as the tokenizer puts it, where that is safe: special tokens are matched before, and
    beyond Latin-1 lower case may depend on neighbours."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def _runs(text: str) -> Iterator[str]:
    """A very long text in runs of about RUN characters, cut at blanks."""
    at = 0
    while len(text) - at > RUN:
        cut = text.rfind(" ", at, at + RUN)
        cut = cut if cut > at else text.find(" ", at + RUN)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:] if at else text


class Encoder:
    """Token ids of whole texts. The tokenizer never joins characters across ASCII white space, so ids are kept by word.

    Words are kept in two generations of CACHE words at most; a word of the older one that is met again moves up.
    """

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model, self.end, self.known, self.older = Tokenizer.from_file(path), np.uint32(end).tobytes(), {}, {}

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        known, older, out = self.known, self.older, []
        for t in texts:  # text by text: what the first look-up of a word brings near is there for the second
            parts = []
            for run in _runs(t or ""):
                run = _folded(run)
                for blank in _BLANKS:
                    run = run.replace(blank, " ")
                words = _POINT.sub(r" \1", run).split(" ")
                if new := {w for w in words if w not in known}:
                    if again := new & older.keys():
                        known.update((w, older[w]) for w in again)
                        new -= again
                    part = list(new)
                    known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(part, self.model.encode_batch_fast(part, add_special_tokens=False)))
                parts += map(known.__getitem__, words)
            out.append(np.frombuffer(b"".join(parts) + self.end, "<u4"))
        return out


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end: int) -> Encoder:
    """The worker process's own encoder, which keeps what it has learned from one task to the next."""
    if (path, end) not in _encoders:
        _encoders[path, end] = Encoder(path, end)
    return _encoders[path, end]


class Packer:
    """The sum-of-squares rule over one stream of pieces (document, start, length)."""

    def __init__(self, size: int, most_open: int = OPEN):
        self.size, self.most = size, most_open
        self.count = np.zeros(size + 1, np.int64)  # N[h]: open windows filled to h
        self.open: list[list[list]] = [[] for _ in range(size + 1)]
        self.total = 0

    def place(self, piece: tuple) -> list[list[tuple]]:
        """Puts a piece shorter than a window; returns the windows that got full."""
        s, count = piece[2], self.count
        levels = np.flatnonzero(count[: self.size - s + 1])
        to = levels + s
        cost = np.where(to == self.size, 1 - 2 * count[levels], 2 * (count[to] - count[levels]) + 2)
        if len(levels) and cost.min() <= 2 * count[s] + 1:
            h = int(levels[cost.argmin()])
            window = self.open[h].pop()
            count[h] -= 1
            self.total -= 1
        else:
            h, window = 0, []
        window.append(piece)
        if h + s == self.size:
            return [window]
        self.open[h + s].append(window)
        count[h + s] += 1
        self.total += 1
        return self.pour() if self.total > self.most else []

    def pour(self, end: bool = False) -> list[list[tuple]]:
        """Joins the open windows: full ones by cutting pieces, and at the end the rest as powers of two."""
        out, window, room = [], [], self.size
        for h in range(self.size, 0, -1):
            for w in self.open[h]:
                for doc, start, n in w:
                    while n:
                        k = min(n, room)
                        window.append((doc, start, k))
                        start, n, room = start + k, n - k, room - k
                        if not room:
                            out.append(window)
                            window, room = [], self.size
        self.count[:], self.total, self.open = 0, 0, [[] for _ in range(self.size + 1)]
        fill = self.size - room
        if window and not end:
            self.open[fill].append(window)
            self.count[fill] = self.total = 1
        elif window:
            pieces, sizes = window, [1 << k for k in range(fill.bit_length() - 1, -1, -1) if fill >> k & 1]
            for size in sizes:
                part = []
                while size:
                    doc, start, n = pieces[0]
                    k = min(n, size)
                    part.append((doc, start, k))
                    size -= k
                    pieces = ([(doc, start + k, n - k)] if n > k else []) + pieces[1:]
                out.append(part)
        return out


def _packed(path: str | None, end: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode, pack = encoder(path or public_tokenizers.path("word_bpe_49k.json"), end), Packer(size)
        base, made = TaskContext.get().partitionId() << 40, 0
        held: dict[int, tuple[int, np.ndarray]] = {}  # of documents with a piece in an open window, the ids from there on
        waits: dict[int, int] = {}
        names: dict[int, tuple[object, int]] = {}
        kind, seen = pa.int64(), 0

        def rows(windows: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal made
            cols: list[list] = [[] for _ in range(7)]
            for w in windows:
                at = 0
                for doc, start, n in w:
                    (first, ids), (name, tokens) = held[doc], names[doc]
                    for c, x in zip(cols, (name, start, n, zlib.crc32(ids[start - first : start - first + n].tobytes()), tokens, base + made, at)):
                        c.append(x)
                    at += n
                    waits[doc] -= n
                    if not waits[doc]:
                        del held[doc], waits[doc], names[doc]
                made += 1
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            kind = batch["doc_id"].type
            for i in range(0, len(batch), 512):
                part, done, before = batch.slice(i, 512), [], seen
                for name, ids in zip(part["doc_id"].to_pylist(), encode(part["text"].to_pylist())):
                    doc, seen = seen, seen + 1
                    held[doc], waits[doc], names[doc] = (0, ids), len(ids), (name, len(ids))
                    whole = len(ids) // size * size
                    done += [[(doc, k, size)] for k in range(0, whole, size)]
                    if len(ids) > whole:
                        done += pack.place((doc, whole, len(ids) - whole))
                if done:
                    yield rows(done)
                for doc in held.keys() & range(before, seen):
                    held[doc] = (names[doc][1] - waits[doc], held[doc][1][-waits[doc] :].copy())
        if last := pack.pour(end=True):
            yield rows(last)

    return run


def pack(docs: DataFrame, *, size: int = 4096, end: int = 2, tokenizer: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Rows repeated under one doc_id are packed each for itself; a null doc_id
    stays null. tokenizer is the path of a tokenizers file on every executor, by default public_tokenizers' word_bpe_49k.
    Sequences have `size` ids, or a power of two of them where a partition ends. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_packed(tokenizer, end, size), SCHEMA.format(kind))
