"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document is the set of its distinct five-word shingles. Documents with equal sets form one class and one
representative of each goes on. Its sketch has BANDS * ROWS coordinates: round i < t throws every element into a hashed bin,
round t + i throws every element into bin i, and a bin keeps the smallest (round, hash) that it saw, so all
coordinates are filled after 2t rounds at most and agree with the probability of the similarity, with Chernoff bounds.
With 40 bands of 5 coordinates a pair at 0.85 shares no band with a probability of 7e-11.

Candidates never leave a bucket as all pairs. First each member meets its bucket's leader, the member that shares
the most buckets overall (the middle of a star of copies). Links are verified on full sets and joined into
components. Buckets that still hold several components choose another leader, the member that comes first by a hash
of the round, for ROUNDS rounds; buckets of like members share it, so a member meets few of them. What is mixed even then is cut into blocks of BLOCK rows; pairs of blocks are compared inside tasks on the
sketches, each pair of members in the first bucket that they share, and what the concentration bound cannot rule out
is verified on full sets. So no pair of a bucket is left out, and what is emitted are near pairs of components only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Workspace, chunks, mix, random64, same, shingle_sets, utf8
from .components import connected_components

BANDS, ROWS, BLOCK, ROUNDS = 40, 5, 256, 1
#: A pair at 0.85 agrees on fewer than 0.65 of 200 coordinates with a probability under 3e-11 (Chernoff).
SKETCH_SLACK = 0.2
_BAND = random64(21, ROWS) | U64(1)


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """(documents, t) coordinates of the fast similarity sketch; documents with empty sets get no meaningful row."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    items = np.concatenate(sets) if n else np.zeros(0, U64)
    doc = np.repeat(np.arange(n), size)
    out = np.full((n, t), np.iinfo(np.uint64).max, U64)
    flat = out.reshape(-1)
    for i in range(2 * t):
        h = mix(items + U64(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64)))
        bins = ((h >> U64(40)) * U64(t) >> U64(24)).astype(np.int64) if i < t else i - t
        np.minimum.at(flat, doc * t + bins, (U64(i) << U64(40)) | (h & U64((1 << 40) - 1)))
        if i < 40 or not i % 8 or i >= t:
            open_ = (out == np.iinfo(np.uint64).max).any(1)
            keep = open_[doc]
            if not keep.any():
                break
            items, doc = items[keep], doc[keep]
    return mix(out)


def _sketched(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch["text"])
            for i, j in chunks(off):
                sets = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], size)
                n = np.array([len(s) for s in sets], np.int64)
                sums = np.array([[s.sum(), mix(s ^ U64(0x5851F42D4C957F2D)).sum()] for s in sets], U64).view(np.int64)
                s = sketch(sets, bands * rows)
                keys = mix((s.reshape(len(sets), bands, rows) * _BAND).sum(2) + np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)
                keys = pa.ListArray.from_arrays(np.arange(0, bands * len(sets) + 1, bands, dtype=np.int32), pa.array(keys.reshape(-1)))
                low = pa.array([x.tobytes() for x in s.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array(n), pa.array(sums[:, 0]), pa.array(sums[:, 1]), keys, low], ["doc_id", "n_shingles", "s1", "s2", "bands", "low"])

    return run


def _near_blocks(share: float, percent: int):
    """(block, pairs): the pairs of different labels whose sizes and sketches leave the threshold possible, where there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pairs = [], []
            for k, (block, row) in enumerate(zip(batch["block"].to_pylist(), batch["members"])):
                m = row.values
                bands = m.field("bands").flatten().to_numpy().reshape(len(m), -1)
                side, doc, label, n = (m.field(c).to_numpy() for c in ("side", "doc", "label", "n_shingles"))
                low = np.stack([np.frombuffer(x, np.uint8) for x in m.field("low").to_pylist()])
                found = []
                for i in np.flatnonzero(side == side.min()):
                    js = np.flatnonzero((side == side.max()) & (label != label[i]) & ((side != side[i]) | (doc > doc[i])) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
                    if len(js):
                        js = js[bands[i][(bands[js] == bands[i]).argmax(1)] == block["bucket"]]  # else they meet in another bucket
                        js = js[(low[js] == low[i]).mean(1) >= share]
                        found += [{"a": int(doc[i]), "b": int(x)} for x in doc[js]]
                if found:
                    rows.append(k)
                    pairs.append(found)
            yield pa.RecordBatch.from_arrays([batch["block"].take(pa.array(rows, pa.int64())), pa.array(pairs, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], ["block", "pairs"])

    return run


def _checked(size: int, percent: int):
    """The pairs of each block that meet the threshold on full sets, from the texts of its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for pairs, members in zip(batch["pairs"], batch["members"]):
                docs, known = members.values.field("doc").to_pylist(), {}
                raw, off = utf8(members.values.field("text"))
                for i, j in chunks(off):
                    known.update(zip(docs[i:j], shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], size)))
                for x, y in zip(pairs.values.field("a").to_pylist(), pairs.values.field("b").to_pylist()):
                    one, two = known[x], known[y]
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    if 100 * both >= percent * (len(one) + len(two) - both):
                        a.append(x)
                        b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _likely(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).mean() >= share) for x, y in zip(batch["low_a"].to_pylist(), batch["low_b"].to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(size: int, percent: int):
    """Rows (members: a leader's text and up to BLOCK partners'): the pairs that meet the threshold on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for lead, members in zip(batch["a"].to_pylist(), batch["members"]):
                docs = members.values.field("doc").to_pylist()
                raw, off = utf8(members.values.field("text"))
                lead_set, rest = None, []
                for i, j in chunks(off):
                    for d, s in zip(docs[i:j], shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], size)):
                        if d == lead:
                            lead_set = s
                        else:
                            rest.append((d, s))
                for d, s in rest:
                    both = len(np.intersect1d(lead_set, s, assume_unique=True))
                    if 100 * both >= percent * (len(lead_set) + len(s) - both):
                        a.append(lead)
                        b.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _verify(pairs: DataFrame, reps: DataFrame, texts: DataFrame, work: Workspace, name: str, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links; sketches first, then full sets in groups of one leader and BLOCK / 2 others."""
    sides = [reps.select(F.col("doc").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("low").alias(f"low_{x}")) for x in "ab"]
    met = pairs.join(sides[0], "a").join(sides[1], "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    likely = work.save(met.select("a", "b", "low_a", "low_b").mapInArrow(_likely(percent / 100 - SKETCH_SLACK), "a long, b long"), f"{name}-likely")
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / (BLOCK // 2)))
    sizes = work.save(likely.groupBy("a").agg(F.count("*").alias("n")), f"{name}-sizes")
    groups = likely.join(sizes, "a").select("a", part.alias("part"), "b")
    need = groups.select("a", "part", F.col("b").alias("doc")).unionByName(groups.select("a", "part", F.col("a").alias("doc"))).distinct()
    wanted = need.join(texts, "doc").groupBy("a", "part").agg(F.collect_list(F.struct("doc", "text")).alias("members"))
    return work.save(wanted.select("a", "members").mapInArrow(_verified(size, percent), "a long, b long"), f"{name}-links")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, work: Workspace | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id long, text).

    Linked are documents with 100 * intersection >= percent * union of their shingle sets. A null, empty or blank
    text has no shingles and no links. Rows repeated under one doc_id are each returned, with the links of all rows
    of that doc_id whose set is the same; a row with a null doc_id links with nothing and is kept. Any other columns
    of docs are ignored. Sets are compared by 64-bit hashes of their shingles.
    """
    work = work or Workspace(docs.sparkSession, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, low binary"
    rows_ = work.save(docs.mapInArrow(_sketched(shingle, bands, rows), schema), "sketches")
    sets = ["n_shingles", "s1", "s2"]
    known = rows_.where("n_shingles > 0 and doc_id is not null")
    # one text goes on for each set, under the class's smallest id; where an id has several sets, a hash tells them apart
    base = work.save(known.groupBy(*sets).agg(F.min("doc_id").alias("doc_id")), "base")
    twice = base.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1")
    own_key = F.when(F.col("times").isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", *sets))
    classes = work.save(base.join(twice, "doc_id", "left").withColumn("doc", own_key).drop("times"), "classes")
    reps = work.save(known.join(classes, ["doc_id", *sets]).dropDuplicates(["doc"]), "reps")
    texts = docs.join(reps.select("doc_id").distinct(), "doc_id", "left_semi")
    hit = F.explode("bands").alias("bucket")
    members = reps.select("doc", hit)
    # written first, as are leaders and mixed buckets: a join of plain tables can be split where a bucket is hot
    full = work.save(members.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"), "full")
    shared = work.save(members.join(full, "bucket"), "shared")
    weight = shared.groupBy("doc").agg(F.sum("m").alias("weight"))
    found = work.save(_keyed(texts, reps.join(weight, "doc", "left_semi").select("doc", "doc_id", *sets), shingle), "texts")
    leaders = shared.join(weight, "doc").groupBy("bucket").agg(F.max(F.struct("weight", F.col("doc").alias("a"))).alias("x")).select("bucket", "x.a")
    leaders = work.save(leaders, "leaders")
    pairs = shared.join(leaders, "bucket").where("a <> doc").select("a", F.col("doc").alias("b"))
    links = None
    for k in range(ROUNDS + 1):
        new = _verify(work.save(pairs.distinct(), f"pairs-{k}"), reps, found, work, f"round-{k}", shingle, percent)
        links = new if links is None else links.unionByName(new)
        labels = connected_components(links, work, f"round-{k}")
        tagged = shared.select("bucket", "doc").join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
        mixed = tagged.groupBy("bucket").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket", "size")
        mixed = work.save(mixed, f"cut-{k}")
        shared = work.save(tagged.join(mixed, "bucket"), f"mixed-{k}")
        work.drop("shared" if not k else f"mixed-{k - 1}", f"pairs-{k}", f"round-{k}-likely", f"round-{k}-edges")
        if k == ROUNDS or shared.isEmpty():
            break  # if empty, every bucket is of one component
        leaders = shared.groupBy("bucket").agg(F.max(F.struct(F.xxhash64("doc", F.lit(k)), F.col("doc").alias("a"), F.col("label").alias("own"))).alias("x")).select("bucket", "x.a", "x.own")
        leaders = work.save(leaders, f"leaders-{k}")
        pairs = shared.join(leaders, "bucket").where("own <> label").select("a", F.col("doc").alias("b"))
    left = shared.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("doc"), "blocks"))
    dealt = left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    block = F.struct("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    dealt = dealt.select(block.alias("block"), F.col("block").alias("side"), "doc", "label")
    lists = dealt.join(reps.select("doc", "n_shingles", "low", "bands"), "doc").groupBy("block").agg(F.collect_list(F.struct("side", "doc", "label", "n_shingles", "low", "bands")).alias("members"))
    near = lists.where("size(members) > 1").mapInArrow(_near_blocks(percent / 100 - SKETCH_SLACK, percent), "block struct<bucket:long,i:long,j:long>, pairs array<struct<a:long,b:long>>")
    near = work.save(near, "near")
    need = near.select("block", F.explode(F.array_distinct(F.concat("pairs.a", "pairs.b"))).alias("doc"))
    members = need.join(found, "doc").groupBy("block").agg(F.collect_list(F.struct("doc", "text")).alias("members"))
    more = work.save(near.join(members, "block").select("pairs", "members").mapInArrow(_checked(shingle, percent), "a long, b long"), "more")
    labels = connected_components(links.unionByName(more), work, "all")
    named = classes.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    least = work.save(named.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    named = work.save(named.join(least, "label").select(*sets, "component_id"), "named")
    work.drop("base", "classes", "reps", "full", "leaders", "texts", "near", "more", "all-edges", "least", *(f"{x}-{k}" for x in ("cut", "mixed", "leaders") for k in range(ROUNDS + 1)))
    out = rows_.select("doc_id", *sets).join(named, sets, "left")
    own = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def _keyed(texts: DataFrame, cand: DataFrame, shingle: int) -> DataFrame:
    """(doc, text) for the candidates; where several rows share an id, the text whose set is the candidate's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch["text"])
            sums = []
            for i, j in chunks(off):
                sums += [(len(s), int(s.sum().view(np.int64))) for s in shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], shingle)]
            keep = [x == y for x, y in zip(sums, zip(batch["n_shingles"].to_pylist(), batch["s1"].to_pylist()))]
            yield batch.select(["doc", "text"]).filter(pa.array(keep, pa.bool_()))

    return texts.join(cand, "doc_id").select("doc", "n_shingles", "s1", "text").mapInArrow(run, "doc long, text string").dropDuplicates(["doc"])


def keep_one_of_each(docs: DataFrame, *, percent: int = 80) -> DataFrame:
    """One row of docs of each component, all columns as they are: of the smallest doc_id, null ids last.

    Each row takes part for itself, whatever its doc_id: rows are told apart by doc_id and text, and of rows equal in both
    one stays. Rows without words stay.
    """
    work, own = Workspace(docs.sparkSession, "keep"), "_key"
    while own in (c.lower() for c in docs.columns):
        own += "_"
    keyed = docs.withColumn(own, F.xxhash64(F.col("doc_id"), F.col("text").cast("string")))
    near = near_duplicates(keyed.select(F.col(own).alias("doc_id"), "text"), percent=percent).where("n_shingles > 0")
    near = near.groupBy(F.col("doc_id").alias(own)).agg(F.min("component_id").alias("component"), F.count("*").alias("n"))
    ids = keyed.groupBy(own).agg(F.min("doc_id").alias("id"))
    met = work.save(near.join(ids, own), "met")
    best = met.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", own)).alias("best"), F.sum("n").alias("all")).where("all > 1")
    verdict = work.save(met.join(best, "component").select(own, "n", (F.col(own) == F.col(f"best.{own}")).alias("stays")), "verdict")
    work.drop("met")
    gone = verdict.where("NOT stays").select(own)
    again = verdict.where("stays AND n > 1").select(own)
    left = keyed.join(gone.unionByName(again).hint("merge"), own, "left_anti")  # never broadcast, since it grows with the input
    once = keyed.join(again, own, "left_semi").dropDuplicates([own])
    return left.unionByName(once).select(*docs.columns)
