"""Stages of the pipeline on repeated rows and ids, very long texts and extra columns whose names clash."""

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))
SF = "/root/testdata/sf0.001"


def test_repeats_long_texts_and_clashing_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    one = docs.orderBy("doc_id").limit(1)
    long = one.select((F.col("doc_id") + 900_000).alias("doc_id"), F.repeat(F.concat("text", F.lit("\n")), 400).alias("text"), "lang", "source", "n_chars")
    other = one.select("doc_id", F.lit("The second text of the same id is here and it is about the weather of the day").alias("text"), F.lit("en").alias("lang"), "source", "n_chars")
    clashing = ("id", "row", "doc", "lines", "spans", "score", "ids", "lang_pred")
    now = docs.unionAll(one).unionAll(one).unionAll(long).unionAll(other).withColumns({c: F.lit(c) for c in clashing})
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, corpus_pipeline.materialise(stage(spark, now, SF), name)
        assert now.columns == columns and 0 < now.count() <= before.count()
        for c in clashing:
            assert now.filter(F.col(c) != c).count() == 0
        if name in ("line_dedup", "secret_scan"):
            assert now.count() == before.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    whole = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("tokens")).collect()
    held = {r.doc_id: r["count"] for r in now.groupBy("doc_id").count().collect()}
    assert {r.doc_id for r in whole} == set(held)
    assert all(r.n == r.tokens for r in whole if held[r.doc_id] == 1)
