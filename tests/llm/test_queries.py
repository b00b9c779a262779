"""The registered queries on the small tables, the oracle SQL, and the pipeline."""

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from veriglot.llm import queries

sys.path.insert(0, str(Path(__file__).parents[2]))
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    want = db.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist()))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_one_row_each(spark, name):
    got = queries.QUERIES[name](spark, SF)
    if name.startswith("op2"):
        assert got.count() == 25 * 20
    elif name.startswith("op8"):
        assert got.agg(F.count_distinct("doc_id")).first()[0] == 200
    else:
        assert got.count() == 200 == got.select("doc_id").distinct().count()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = queries.QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").filter("held_out").join(docs, "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_quality(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    mean = {r.quality: r.m for r in queries.QUERIES["op5_lm_score"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").groupBy("quality").agg(F.avg("score").alias("m")).collect()}
    assert mean[1] > mean[0] + 1


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(3).selectExpr("doc_id + 100000 as doc_id", "cast(null as string) as text", "lang", "source", "n_chars").unionAll(docs.limit(2).selectExpr("doc_id + 200000 as doc_id", "'12 34' as text", "cast(null as string) as lang", "source", "n_chars"))
    now = docs.unionAll(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, corpus_pipeline.materialise(stage(spark, now, SF), name)
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        assert 0 < now.count() <= before.count()
        if name == "language_id":
            assert now.filter("doc_id >= 100000").count() == 0 and now.count() >= 190
    assert now.filter("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert packed.select("doc_id").distinct().count() == now.count()
    assert corpus_pipeline.run(spark, SF).count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty_out = stage(spark, empty, SF)
        assert empty_out.count() == 0


def test_clean(spark):
    from veriglot.llm.common import clean, materialise, scratch_root

    kept = materialise(spark.range(3).toDF("x"), "t")
    assert kept.count() == 3
    clean(spark)
    assert not list(Path(scratch_root(spark).removeprefix("file:")).glob("*"))
