"""Audits of real pages read all of every block, and long blocks take no more than their share of time."""

import random
import time

from pyspark.sql import functions as F

from veriglot.config import AuditConfig
from veriglot.functions import text as T
from veriglot.operators import heuristics, placeholders, report
from veriglot.plans.queries import QUERIES

EN, ES = "The cat and the dog of the house. ", "El gato de la casa y el perro son los de una. "


def test_long_and_nested_blocks(spark, tmp_path):
    """Issues behind 1,000 code points, languages behind 10,000 and strings in more than ten elements are found."""
    bodies = [EN * 60 + "It is,and it was.", EN * 300 + ES * 900, "<span>" * 14 + EN + "It is,and it was." + "</span>" * 14]
    pages = [(i, f"http://a.b/{i}", f"<html><body><main><p>{EN}{body}</p></main></body></html>") for i, body in enumerate(bodies)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {(r.page_id, r.rule_id): r for r in QUERIES["audit_pages"](spark, str(tmp_path)).collect()}
    long, nested = found[0, "MISSING_SPACE_AFTER_PUNCT"], found[2, "MISSING_SPACE_AFTER_PUNCT"]
    assert long.s == len(EN * 61) + 5 and (long.snippet, nested.snippet) == (",a", ",a")
    assert long.context == ("..." + (EN * 61 + "It is,and it was.")[long.s - 50 : long.e + 50])
    leak = found[1, "BLOCK_LANGUAGE"]
    assert "Block is in es" in leak.message and leak.e == len(EN * 301 + ES * 900) - 1
    assert QUERIES["csv_export_rows"](spark, str(tmp_path)).count() == QUERIES["audit_pages"](spark, str(tmp_path)).count() >= len(found)


def test_limits_are_settings(spark):
    blocks = spark.createDataFrame([(1, 0, EN * 60 + "It is,and it was."), (1, 1, EN * 300 + ES * 900)], "page_id long, block_idx int, text string")
    rules = lambda **k: {(r.block_idx, r.rule_id) for r in report.audit(blocks, AuditConfig(**k)).collect()}
    assert rules() == set() and (0, "MISSING_SPACE_AFTER_PUNCT") in rules(max_verify_chars=0) and rules(max_detect_chars=0) == {(1, "BLOCK_LANGUAGE")}


def test_parts_of_long_texts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab\n é😀") for _ in range(n)) for n in (3, T.PIECE, T.PIECE + 1, 3 * T.PIECE, 5000)]
    rows = [(t, a, n) for t in texts for a in (0, 1, T.PIECE - 1, T.PIECE, len(t) - 1, len(t), len(t) + T.PIECE, rng.randrange(len(t))) for n in (-1, 0, 1, 100, T.PIECE, 2000)]
    t, a, n = (F.col(c) for c in "tan")
    df = spark.createDataFrame(rows, "t string, a int, n int").withColumn("cut", T.pieces(t, F.length(t), F.lit(T.FEW + 1)))
    got = df.select("t", "a", "n", F.col("cut").isNotNull().alias("long"), T.part(t, F.col("cut"), a, n).alias("x")).collect()
    assert [r.x for r in got] == [r.t[r.a : max(r.a, r.a + r.n)] for r in got] and {r.long for r in got} == {True, False}


def test_until(spark):
    df = spark.createDataFrame([("a}b}c",), ("}",), ("abc",), ("",), ("{{a}}}é",), (None,)], "t string")
    t = F.col("t")
    assert [tuple(r) for r in df.select(T.until(t, "}"), T.until(t, "}}")).collect()] == [("a}b}", ""), ("}", ""), ("", ""), ("", ""), ("{{a}}}", "{{a}}}"), ("", "")]


def test_headings(spark):
    """A capital somewhere behind a small letter of its line."""
    texts = ["Ab", "aB", "a b C", "A b c", "a\nB", "A\nb c\nd E", "ABC", "é B", "aé ñB", ""]
    df = spark.createDataFrame([(x, tag) for x in texts for tag in ("h2", "p")], "t string, tag string")
    got = df.select("t", "tag", F.size(heuristics.heading_case(F.col("t"), F.col("tag"))).alias("n")).collect()
    assert {r.t for r in got if r.n} == {"aB", "a b C", "A\nb c\nd E", "aé ñB"} and all(r.tag == "h2" for r in got if r.n)


def test_outside(spark):
    span = "array<struct<s: int, e: int, v: string>>"
    df = spark.createDataFrame([([(0, 2, "a"), (2, 3, "b"), (5, 9, "c"), (9, 10, "d")], [(1, 3, "x"), (5, 6, "y"), (8, 9, "z")]), ([(1, 2, "a")], []), ([], [(1, 2, "x")])], f"found {span}, spans {span}")
    got = df.select(placeholders._outside(F.col("found"), F.col("spans")).alias("x")).collect()
    assert [[m.v for m in r.x] for r in got] == [["a", "d"], ["a"], []]


def test_long_blocks_take_linear_time(spark):
    """Open braces, small letters in a heading, numbers and many issues, each as one block."""

    def seconds(n):
        blocks = [(1, i, EN * 5 + x * n, "h1") for i, x in enumerate(("{", "the cat ", "1 ", "the.cat "))]
        df = report.audited(spark.createDataFrame(blocks, "page_id long, block_idx int, text string, tag_name string"), AuditConfig(max_verify_chars=0))
        began = time.perf_counter()
        assert [r.lang for r in df.select("lang", F.size("found")).collect()] == ["en"] * 4
        return time.perf_counter() - began

    seconds(100)
    assert seconds(20_000) < 15 * max(0.1, seconds(1000))
