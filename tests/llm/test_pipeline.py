"""The pipeline's stages on the small tables, each judged on its own input."""

import numpy as np

import corpus_pipeline
from driftwood.llm import queries
from driftwood.llm.common import held_out


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.count()
        assert docs.columns == columns or name == "sum_of_squares_packing"
    sizes = list(kept.values())[:4]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 100
    n_docs = kept["benchmark_decontamination"]
    assert docs.select("doc_id").distinct().count() == n_docs


def test_a_document_delivered_again_stays_once(spark, sf_dir):
    """Twice under one id and once under null, then the repeat stage."""
    rng = np.random.default_rng(5)
    text = " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(72))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "another short text")], "doc_id long, text string")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("minhash_near_dedup", "suffix_array_dedup"):
        docs = stages[name](spark, docs, sf_dir)
    assert len(text) > 500 and sorted(map(tuple, docs.collect())) == [(1, text), (2, "another short text")]


def test_a_passage_of_51_words_goes(spark, sf_dir):
    rng = np.random.default_rng(6)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    passage = words(51)
    docs = spark.createDataFrame([(i, f"{words(60)} {passage} {words(60)}") for i in range(2)], "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["suffix_array_dedup"](spark, docs, sf_dir).collect()
    assert len(got) == 2 and len(passage) < 400 and all(passage not in r.text for r in got)


def test_run_is_the_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).select("sequence_id").distinct().count() > 1
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_ten_queries_and_their_sql(spark, sf_dir, duck):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, sf_dir)
        columns = sorted(got.columns)
        cur = duck.execute(sql)
        names = [d[0] for d in cur.description]
        want = sorted(repr([r[names.index(c)] for c in columns]) for r in cur.fetchall())
        assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == want, name


def test_held_out_accuracy(spark, sf_dir):
    """On the fold that is not learned from; few labels at this size, so ranks count more than thresholds."""
    path = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{path}/labels.parquet").where(held_out("doc_id"))
    for name, column, least in (("op1_toxicity", "toxic", 0.95), ("op4_quality_classifier", "quality", 0.95)):
        rows = queries.QUERIES[name](spark, path).join(labels, "doc_id").select("score", column).collect()
        one, zero = (np.array([r.score for r in rows if r[column] == y]) for y in (1, 0))
        assert (one[:, None] > zero).mean() + 0.5 * (one[:, None] == zero).mean() > least, name
