"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is a run of `window` words of a benchmark item (a shorter item is one window). A document contains it only if it
contains each of its words, so by prefix filtering the rarest word of a window is enough to find candidates: words are
ordered by how often all documents have them. A candidate is kept by its length and position (the window must fit
around the word) and by exact comparison with the document's words in place. The rare words and the
windows are broadcast if they are BROADCAST_BYTES at most, which is counted; beyond that the same joins shuffle, with each word's surroundings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: The bound on the bytes of all distinct windows of the benchmark for a broadcast.
BROADCAST_BYTES = 16 << 20
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: As SEPARATOR, but A-Z belong to words; they are lower-cased later, where few words are left.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), _BETWEEN), "")


def _fold(words: Column) -> Column:
    """The words in one string, A-Z lower-cased, a blank between two."""
    return F.translate(F.array_join(words, " "), UPPER, LOWER)


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, win, n): every window of every item, as its words joined by blanks, and how many they are."""
    items = benchmark.select("item_id", raw_words(F.col("text")).alias("words")).where("size(words) > 0")
    first = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1))))
    return items.select("item_id", "words", first.alias("i")).select("item_id", _fold(F.slice("words", F.col("i"), window)).alias("win"), F.least(F.size("words"), F.lit(window)).alias("n")).distinct()


def _key(word: Column) -> Column:
    """What equal words have in common; unequal ones may, too."""
    return F.lower(word)


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, work: Workspace | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs.

    Null and empty texts and items have no words. An item with a null item_id makes words hit but is not counted
    among items. Rows repeated under one doc_id are each returned; those with the same text are judged alike, and
    so is a null doc_id. Other columns are ignored. With an empty benchmark nothing is hit.
    """
    work = work or Workspace(docs.sparkSession, "decontaminate")
    found = work.save(_matches(docs, benchmark, window, work), "matches")
    spans = F.array_sort(F.collect_set(F.struct("a", "b")))
    hit = F.expr("aggregate(spans, named_struct('n', 0L, 'to', 0), (x, s) -> named_struct('n', x.n + greatest(0, s.b - greatest(s.a, x.to)), 'to', greatest(x.to, s.b))).n")
    covered = found.groupBy("doc_id", "th").agg(spans.alias("spans")).select("doc_id", "th", hit.alias("n_hit"))
    windows = benchmark_windows(benchmark, window).select("item_id", "win")
    items = found.select("doc_id", "th", "win").distinct().join(windows, "win").groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    both = covered.withColumnRenamed("doc_id", "d").withColumnRenamed("th", "t").join(items, F.expr("d <=> doc_id AND t = th"), "left").select("d", "t", "n_hit", "items")
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), F.size(raw_words(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(both, F.expr("doc_id <=> d AND th = t"), "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _matches(docs: DataFrame, benchmark: DataFrame, window: int, work: Workspace) -> DataFrame:
    """(doc_id, th, win, a, b): every occurrence of a window, at words [a, b) of a document; th is a hash of its text."""
    windows = work.save(benchmark_windows(benchmark, window).select("win", "n").distinct(), "windows")
    small = (windows.agg(F.sum(F.octet_length("win"))).first()[0] or 0) <= BROADCAST_BYTES
    hint = F.broadcast if small else lambda df: df
    spread = windows.select("win", "n", F.posexplode(F.split("win", " ")).alias("i", "word"))
    vocabulary = spread.select(_key(F.col("word")).alias("key")).distinct()
    words = docs.select("doc_id", F.xxhash64("text").alias("th"), raw_words(F.col("text")).alias("words"))
    seen = words.select(F.explode("words").alias("word")).select(_key(F.col("word")).alias("key"))
    if small:
        counts = seen.join(F.broadcast(vocabulary), "key", "left_semi").groupBy("key").agg(F.count("*").alias("df"))
    else:
        counts = seen.groupBy("key").agg(F.count("*").alias("df")).join(vocabulary, "key", "left_semi")
    counts = work.save(counts, "rarity")
    # a word that no document has cannot lead anywhere, so inner joins keep only windows that may occur
    ranked = spread.withColumn("key", _key(F.col("word"))).join(hint(counts), "key").groupBy("win", "n").agg(F.count("*").alias("known"), F.min(F.struct("df", "key", "i")).alias("x"))
    prefix = work.save(ranked.where("known = n").select("win", "n", "x.key", F.col("x.i").alias("i")), "prefix")
    at = words.select("doc_id", "th", "words", F.size("words").alias("size"), F.posexplode("words").alias("pos", "word")).withColumn("key", _key(F.col("word")))
    if not small:
        # what travels is the word with its surroundings, not the document
        at = at.withColumn("from", F.greatest(F.col("pos") - (window - 1), F.lit(0)))
        at = at.withColumn("words", F.slice("words", F.col("from") + 1, 2 * window - 1))
    else:
        at = at.withColumn("from", F.lit(0))
    met = at.select("doc_id", "th", "words", "size", "pos", "from", "key").join(hint(prefix), "key").withColumn("a", F.col("pos") - F.col("i"))
    fits = met.where("a >= 0 AND a + n <= size")
    return fits.where(_fold(F.slice("words", F.col("a") - F.col("from") + 1, F.col("n"))) == F.col("win")).select("doc_id", "th", "win", "a", (F.col("a") + F.col("n")).alias("b"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """The rows of docs that contain no window of a benchmark item, all columns as they are.

    Whether a document is contaminated depends on its text alone: null and empty texts are clean.
    """
    work = Workspace(docs.sparkSession, "decontaminate")
    found = work.save(_matches(docs, benchmark, window, work).select("doc_id", "th").distinct(), "matches")
    on = docs["doc_id"].eqNullSafe(found["doc_id"]) & (F.xxhash64(docs["text"]) == found["th"])
    return docs.join(found, on, "left_anti")
