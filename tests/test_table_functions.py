"""Blocks, votes and detection from plain SQL against the DataFrame forms."""

import pytest
from pyspark.sql import functions as F

from veriglot.operators import detect, fitted, table_functions
from veriglot.plans.queries import QUERIES
from veriglot.plans.text_queries import pages, votes
from veriglot.sources import html

SF = "/root/testdata/sf0.001"


def same(a, b):
    assert a.columns == b.columns
    left, right = sorted(map(str, a.collect())), sorted(map(str, b.collect()))
    assert left == right and left


def test_blocks(spark):
    same(QUERIES["sql_page_blocks"](spark, SF), html.extract_blocks(pages(spark, SF), carry=("url",)).select("page_id", "url", *[c.split()[0] for c in ("block_idx", "text", "xpath", "tag_name", "attributes", "block_type", "offset_start", "offset_end", "html_chars")]))


def test_blocks_of_any_table(spark):
    table_functions.register(spark)
    rows = spark.createDataFrame([("a", "<p>a paragraph of text</p><p>short</p>", 1.5), ("b", None, None), ("c", "", 2.0), (None, "<p>some more text here</p>", None)], "name string, page string, weight double")
    found = spark.sql("SELECT name, weight, block_idx, text, html_chars FROM page_blocks(TABLE(SELECT * FROM {t}), html => 'page')", t=rows)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("a", 1.5, 0, "a paragraph of text", 38), (None, None, 0, "some more text here", 26)], key=str)
    low = spark.sql("SELECT text FROM page_blocks(TABLE(SELECT * FROM {t}), html => 'page', least => 3)", t=rows)
    assert low.filter("text = 'short'").count() == 1
    for wrong, why in (("page_blocks(TABLE(SELECT name FROM {t}))", "lacks html"), ("page_blocks(TABLE(SELECT name AS text, page AS html FROM {t}))", "rename text"), ("page_blocks(TABLE(SELECT page FROM {t}), html => concat('pa', uuid()))", "constant|lacks"), ("vote(TABLE(SELECT name AS lang FROM {t}))", "lacks ord"), ("vote(TABLE(SELECT * FROM {t}), method => 'most')", "method is one of")):
        with pytest.raises(Exception, match=why):
            spark.sql(f"SELECT * FROM {wrong}", t=rows).collect()


@pytest.mark.parametrize("method, form", [("majority", detect.vote_majority), ("best", detect.vote_best), ("weighted", detect.vote_weighted)])
def test_votes(spark, method, form):
    table_functions.register(spark)
    made = votes(spark, SF)
    extra = [(-1, o, d, x, c, [("nl", 0.3), ("fr", 0.2)]) for o, d, x, c in ((1, "fasttext", "en", 0.5), (2, "b", "es", 0.5), (3, "c", "nl", 0.5), (4, "d", "es", 0.25), (5, "e", "en", 0.25))]
    all_ = made.unionByName(spark.createDataFrame(extra, made.select("id", "ord", "detector", "lang", "confidence", "alternatives").schema), allowMissingColumns=True)
    digits = lambda df: df.withColumns({c: F.round(c, 9) for c in ("confidence", "score", "consensus") if c in df.columns} | ({"alternatives": F.transform("alternatives", lambda a: F.struct(a["lang"].alias("lang"), F.round(a["confidence"], 9).alias("confidence")))} if "alternatives" in df.columns else {}))
    want = digits(form(all_))
    same(digits(spark.sql(f"SELECT * FROM vote(TABLE(SELECT * FROM {{v}}) PARTITION BY id, method => '{method}')", v=all_)).select(want.columns), want)


def test_rows_without_language_do_not_vote(spark):
    table_functions.register(spark)
    rows = spark.createDataFrame([(1, 1, "a", None, 0.5), (1, 2, "b", "es", 0.4), (1, 2, "b", "es", 0.4), (2, 1, "a", None, None), (None, 1, "a", "en", 0.9)], "id int, ord int, detector string, lang string, confidence double")
    found = spark.sql("SELECT id, lang, confidence, consensus FROM vote(TABLE(SELECT * FROM {v}) PARTITION BY id)", v=rows)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "es", 0.4, 1.0), (None, "en", 0.9, 1.0)], key=str)
    assert spark.sql("SELECT * FROM vote(TABLE(SELECT * FROM {v}) PARTITION BY id)", v=rows.limit(0)).count() == 0


def test_detection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fitted.fit(docs)
    table_functions.register(spark, model.predict)
    rows = docs.select("doc_id", F.col("text").alias("t")).unionAll(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, t string"))
    found = spark.sql("SELECT doc_id, lang, confidence FROM detect_language(TABLE(SELECT * FROM {d}), text => 't')", d=rows)
    same(found, fitted.label(rows, model, "doc_id", "t"))
    assert found.filter("doc_id < 0 and lang = 'unknown'").count() == 2
