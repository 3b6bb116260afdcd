"""The pipeline's stages against brute force on their own input, and on odd tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from lumenlog.llm import byte_pairs, decontamination, near_copies, quality_classifier, quality_rules

DIR = "/root/testdata/sf0.001"


def texts(df):
    return {(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}


def smallest_ids(docs):
    """The smallest id of each group of documents joined by five-word Jaccard similarities of 0.8, by all pairs."""
    rows = {r.doc_id: set(map(tuple, near_copies.shingles((r.text or "").lower().encode().split()).tolist())) for r in docs.collect()}
    least = {i: i for i in rows}
    ids = sorted(rows)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            x, y = rows[i], rows[j]
            if least[i] != least[j] and len(x & y) >= 0.8 * len(x | y):
                old, new = max(least[i], least[j]), min(least[i], least[j])
                least = {m: new if g == old else g for m, g in least.items()}
    return set(least.values())


def test_stages_keep_what_their_operators_keep(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").unionByName(spark.read.parquet(f"{DIR}/documents.parquet").limit(5))
    labels, bench = spark.read.parquet(f"{DIR}/labels.parquet"), spark.read.parquet(f"{DIR}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)
    wants = {
        "quality classifier": lambda: {r.doc_id for r in quality_classifier.classify(docs, labels).where("predicted = 1").collect()},
        "quality rules": lambda: {r.doc_id for r in quality_rules.apply_rules(docs, labels).where("kept").collect()},
        "near-duplicates": lambda: smallest_ids(docs),
        "decontamination": lambda: {r.doc_id for r in decontamination.decontaminate(docs, bench).where("not contaminated").collect()},
    }
    for name, want in wants.items():
        out = stage[name](spark, docs, DIR)
        assert out.columns == docs.columns
        kept = out.collect()
        assert {r.doc_id for r in kept} == want()
        if name == "near-duplicates":
            assert len(kept) == len({r.doc_id for r in kept})
        assert texts(out) <= texts(docs)
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "encoding"


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, None, None, 1), (None, "x", "en", 1), (1, "", None, 2)], "doc_id long, text string, lang string, kept int")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, DIR)
            assert out.count() <= rows.count()
            assert name == "encoding" or out.columns == docs.columns


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DIR).collect(), docs.schema)
    path = byte_pairs.public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert set(corpus_pipeline.run(spark, DIR).collect()) == set(byte_pairs.round_trip(docs, path).collect())


def test_rows_without_id_and_with_a_repeated_one_are_decided_alone(spark):
    stage = dict(corpus_pipeline.STAGES)
    leak = next(r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect() if len((r.text or "").split()) > 12)
    own = [" ".join(f"{name}{k}" for k in range(60)) for name in ("alpha", "beta", "gamma", "delta", "omega")]
    rows = [(None, own[0]), (None, own[0]), (None, own[1]), (None, own[2]), (5, own[3]), (3, own[4]), (5, own[4]), (5, own[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in stage["near-duplicates"](spark, docs, DIR).collect()]
    assert sorted(kept, key=str) == sorted([(None, own[0]), (None, own[1]), (5, own[2]), (5, own[3]), (3, own[4])], key=str)
    rows = [(None, own[0]), (None, leak), (7, own[1]), (7, leak), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = [tuple(r) for r in stage["decontamination"](spark, docs, DIR).collect()]
    assert sorted(clean, key=str) == sorted([(None, own[0]), (7, own[1]), (None, None)], key=str)


def test_columns_named_like_a_stages_own_and_very_long_texts(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(60)
    long = " ".join(f"word{k % 5000} of a long text" for k in range(60_000))
    row = docs.first().asDict() | {"doc_id": 10**9, "text": long}
    docs = docs.unionByName(spark.createDataFrame([row], docs.schema))
    names = ["__row", "__rows", "__score", "__kept", "__n_words", "___row"]
    marked = docs
    for name in names:
        marked = marked.withColumn(name, F.concat(F.lit(f"mine {name} "), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, marked, DIR)
        assert out.columns == marked.columns
        kept = out.collect()
        assert kept
        assert all(r[n] == f"mine {n} {r.doc_id}" for r in kept for n in names)
        assert {(r.doc_id, r.text) for r in kept} == texts(stage(spark, docs, DIR))
    assert next(r for r in corpus_pipeline.encode(spark, marked, DIR).collect() if r.doc_id == 10**9).n_tokens > 60_000
