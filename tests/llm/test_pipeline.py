"""The corpus pipeline against plain versions of its stages."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from evigraph.llm import bpe_codec, minhash

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark, odd_docs):
    docs = odd_docs.withColumn("n_chars", F.col("n_chars").cast("long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.collect()
    tokens = corpus_pipeline.token_ids(spark, docs, SF).collect()
    assert len(tokens) == docs.count() and all(r["decodes"] and r["n_tokens"] == len(r["ids"]) for r in tokens)
    empty = docs.where("false")
    assert all(stage(spark, empty, SF).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_run_is_the_stages_in_order(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_duplicates", "source_mix", "bpe_encode"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, SF).cache()
    cleaned = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in minhash.duplicate_groups(docs).where("kept").collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    copies = Counter(r["doc_id"] for r in got)
    assert set(copies) <= kept and max(copies.values()) <= 2
    codec = bpe_codec.encoding(bpe_codec.RANK_FILE)
    assert all(r["ids"] == codec.encode_ordinary(cleaned[r["doc_id"]]) and r["decodes"] for r in got)
    docs.unpersist()
