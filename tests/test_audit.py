"""Audits of whole blocks in one pass, settings, selectors, grammar matches, detectors and requests."""

import random
import time

import pytest
from pyspark.sql import functions as F

from veriglot.config import AuditConfig, ConfigError, load, parse_selector
from veriglot.functions import text as T
from veriglot.operators import detect, grammar, issues, report
from veriglot.sources import html, tables

SELECTORS = [".visually-hidden", ".sr-only", "script", "style", "[aria-hidden='true']", "[style*='display: none']", "[style*='visibility: hidden']"]


def test_arrays_like_tables(spark):
    """De-duplicating and merging a block's array gives what the operators on tables of issues give."""
    rng = random.Random(3)
    rows = [(b, [(rng.choice(["languagetool", "placeholder", "heuristic"]), rng.choice("PK"), f"R{rng.randrange(3)}", rng.choice(["a", "A", "b"]), rng.choice([None, "x", "y"]), s := rng.randrange(0, 90, 3), s + rng.randrange(12), rng.randrange(4) / 4) for _ in range(rng.randrange(25))]) for b in range(60)]
    df = spark.createDataFrame(rows, f"b int, found array<{issues.ISSUE}>").withColumn("found", issues.numbered(F.col("found")))
    flat = df.select("b", F.inline("found"))
    columns = ["b", "s", "e", "type", "source", "rule_id", "message", "suggestion", "confidence", "seq"]
    once = issues.dedup(flat, ["b"])
    for array, tables_ in ((issues.dedup_array(F.col("found")), once), (issues.merge_array(F.col("found")), issues.merge(flat, ["b"])), (issues.merge_array(issues.dedup_array(F.col("found"))), issues.merge(once, ["b"]))):
        got = df.select("b", F.inline(array)).select(columns).collect()
        assert sorted(map(str, got)) == sorted(map(str, tables_.select(columns).collect())) and got


def test_one_pass(spark):
    pages = spark.createDataFrame([(1, "u", "<p>the cat sat on the mat,and it was good for all</p>")], "page_id long, url string, html string")
    for df in (report.audit(html.configured_blocks(pages, AuditConfig()), AuditConfig()), report.score_pages(report.audited(html.configured_blocks(pages, AuditConfig()), AuditConfig()), AuditConfig())):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan
    assert "Exchange" not in report.audit(html.extract_blocks(pages), AuditConfig())._jdf.queryExecution().executedPlan().toString()
    stats = report.score_pages(report.audited(html.extract_blocks(pages), AuditConfig()), AuditConfig()).first()
    assert stats.html_size == len(pages.first().html) and stats.total_blocks == 1 and stats.issues == stats.error + stats.warning + stats.info + stats.critical > 0


def test_grammar_matches_in_an_audit(spark):
    text = "This is a tset of the page and it is good"
    blocks = spark.createDataFrame([(1, 0, text), (1, 1, "")], "page_id long, block_idx int, text string")
    matches = spark.createDataFrame([(1, 0, 10, 4, "TYPOS", "SPELL", "Possible typo", ["test", "set"]), (1, 0, 10, 4, "STYLE", None, "Odd word", [])], "page_id long, block_idx int, offset int, length int, category string, rule_id string, message string, replacements array<string>")
    found = grammar.match_issues(matches, "en")
    assert [(r.type, r.rule_id, r.suggestion, r.s, r.e, r.own_severity, r.confidence, r.seq) for r in found.orderBy("seq").collect()] == [("spelling", "SPELL", "test", 10, 14, "error", 0.9, 0), ("style", "UNKNOWN_RULE", None, 10, 14, "info", 0.6, 1)]
    got = {(r.rule_id, r.snippet, r.severity) for r in report.audit(blocks, AuditConfig(), found).collect()}
    assert got >= {("SPELL", "tset", "error"), ("UNKNOWN_RULE", "tset", "info")}
    assert grammar.facet(found, "spelling").count() == 1 and grammar.match_stats(found).count() == 2 and grammar.code("en") == "en-US"
    with pytest.raises(ValueError):
        grammar.facet(found, "casing")
    assert grammar.match_issues(matches.select("page_id", "block_idx", "category"), "es").first().e == 1


def test_settings_have_effect(spark):
    blocks = spark.createDataFrame([(1, 0, "the of and der"), (1, 1, "the de en het van cat dog")], "page_id long, block_idx int, text string")
    langs = lambda **k: [r.lang for r in report.detected(blocks, AuditConfig(**k)).orderBy("block_idx").collect()]
    assert langs() == ["unknown", "nl"] and langs(min_detect_chars=5) == ["en", "nl"] and langs(min_confidence=0.9) == ["unknown", "unknown"]
    pages = spark.createDataFrame([(1, "u", "<p>short</p><p class='ad'>quite a long text here</p>")], "page_id long, url string, html string")
    count = lambda **k: html.configured_blocks(pages, AuditConfig(**k)).count()
    assert (count(), count(min_block_chars=3), count(ignore_selectors=(".ad",))) == (1, 2, 0)


def test_settings_file(tmp_path):
    path = tmp_path / "a.toml"
    (tmp_path / "w.txt").write_text("# terms\nGoogle\nhola:es\n")
    path.write_text(f'[target]\nlanguage = "en"\nrender_js = false\n[rules]\nleak_threshold = 0.08\nignore_selectors = {SELECTORS}\nwhitelist = "w.txt"\nmax_sample_tokens = 200\n[languagetool]\ntimeout = 30\n[ui]\ntheme = "auto"\n')
    config = load(str(path))
    assert config.ignore_selectors == tuple(SELECTORS) and config.whitelist == ("google", "hola")
    for bad in ("[rules]\nleak_treshold = 1\n", "[target]\nlang = 'en'\n", "[rulez]\nx = 1\n", "[target]\nrender_js = true\n", "[rules]\nignore_selectors = ['[a=']\n", "[rules]\nmin_confidence = 2\n"):
        path.write_text(bad)
        with pytest.raises(ConfigError):
            load(str(path))


@pytest.mark.parametrize(("selector", "markup"), [(s, m) for s, m in zip(SELECTORS, ["<p class='a visually-hidden'>", "<p class='sr-only'>", "<script>", "<style>", "<p aria-hidden='true'>", "<p style='color: red; display: none'>", "<p style='visibility: hidden'>"], strict=True)])
def test_selectors(selector, markup):
    node = next(html.walk(html.Tree(markup).root))
    assert html.ignored(node, (selector,))
    assert not html.ignored(next(html.walk(html.Tree("<p class='b' style='x: y'>").root)), tuple(SELECTORS))
    assert parse_selector("[data-x]") == ("attr", "data-x", "", "") and html.ignored(next(html.walk(html.Tree("<p data-x>").root)), ("[data-x]",))


def test_flat_pages_take_linear_time():
    def seconds(n):
        began = time.perf_counter()
        found = html.page_blocks("<p>some text of a page</p>" * n)
        assert found[-1][2] == f"/html/p[{n}]"
        return time.perf_counter() - began

    seconds(500)
    assert seconds(8000) < 60 * max(0.01, seconds(1000))


def test_many_matches(spark):
    texts = [".a " * n for n in (0, 1, T.CHUNK - 1, T.CHUNK, T.CHUNK + 1, 20_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", T.find_all(F.col("text"), "[.][a-z]").alias("x"))
    for r in df.collect():
        assert [(m.s, m.e) for m in r.x] == [(3 * i, 3 * i + 2) for i in range(len(texts[r.id]) // 3)]


def test_broken_page_stops_no_other(spark):
    pages = spark.createDataFrame([(1, "u", "<p>some text of a page</p>"), (2, "v", "<p>more text of a page</p>")], "page_id long, url string, html string")
    assert html.extract_blocks(pages).count() == 2 and html.parse_failures(pages).count() == 0

    def broken(markup):
        raise AssertionError("unknown status keyword")

    kept, html.Tree = html.Tree, broken
    try:
        assert html.failure("<p>") == "AssertionError: unknown status keyword"
    finally:
        html.Tree = kept


def test_alternatives(spark):
    rows = [(1, 1, "a", "es", 0.5, [("nl", 0.9), ("en", 0.2)]), (1, 2, "b", "en", 0.8, []), (1, 3, "c", "en", 0.4, []), (2, 1, "a", "nl", 0.3, [])]
    votes = spark.createDataFrame(rows, f"id int, ord int, detector string, lang string, confidence double, alternatives {detect.ALTERNATIVES}")
    said = lambda df: {r.id: (r.lang, [(a.lang, round(a.confidence, 6)) for a in r.alternatives]) for r in df.collect()}
    assert said(detect.vote_best(votes)) == {1: ("en", [("nl", 0.9), ("es", 0.5), ("en", 0.4)]), 2: ("nl", [])}
    assert said(detect.vote_majority(votes)) == {1: ("en", [("es", 0.5)]), 2: ("nl", [])}
    weighted = {(r.id, r.lang): round(r.score, 6) for r in detect.vote_weighted(votes, {"a": 1.5}).collect()}
    assert weighted == {(1, "es"): round(0.5 + 0.1 / 3, 6), (1, "en"): round(0.6 + 0.2 / 3, 6), (2, "nl"): 0.4}


def test_model_detector(spark):
    df = spark.createDataFrame([(1, "ein langer Text in einer Sprache"), (2, "short"), (3, None)], "id int, text string")
    predict = lambda text: [("__label__deu", 0.7), ("__label__nld", 0.6), ("__label__eng", 0.1)]
    got = {r.id: (r.lang, r.lang_confidence, [a.lang for a in r.alternatives]) for r in detect.model(df, predict).collect()}
    assert got == {1: ("nl", 0.6, ["nl", "en"]), 2: ("unknown", 0.0, ["nl", "en"]), 3: ("unknown", 0.0, [])}


def test_requests(spark):
    def get(url):
        if url == "bad":
            raise OSError("gone")
        return {"content": "<p>a b\nc", "status": 200, "url": url + "/", "history": ["x"], "encoding": "utf-8", "headers": {"Content-Type": "text/html", "Server": "s", "ETag": "e", "Content-Length": "8"}}

    urls = spark.createDataFrame([("good",), ("bad",)], "url string")
    got = {r.url: r for r in tables.fetch(urls, get, fail_fast=True).collect()}
    r = got["good"]
    assert (r.status, r.final_url, r.redirect_count, r.content_type, r.content_encoding, r.content_length, r.server, r.last_modified, r.etag, r.word_count, r.line_count) == (200, "good/", 1, "text/html", "utf-8", 8, "s", "", "e", 3, 1)
    assert r.response_time_seconds >= 0 and got["bad"].html is None and "gone" in got["bad"].error
    head = {r.url: r for r in tables.probe(urls, get).collect()}
    assert head["good"].is_available and head["good"].content_length == 8 and head["good"].html is None and not head["bad"].is_available


def test_whitelist_terms(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# terms\nThe\nde:nl\n")
    listed = tables.whitelist(spark, str(tmp_path / "w.txt"))
    assert tables.whitelist_terms(listed) == ("de", "the")
    with pytest.raises(ValueError):
        tables.whitelist_terms(listed, 1)
