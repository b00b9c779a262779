"""Rules on small texts with places worked out by hand, and invariants."""

import json
import re
from collections import Counter
from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriglot.config import AuditConfig, ConfigError, load, preset
from veriglot.functions import text as T
from veriglot.operators import grammar, heuristics, issues, placeholders, report
from veriglot.plans.queries import QUERIES

def text():
    return F.col("text")


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("x")).first().x


def places(spark, value, found):
    return [(r.rule_id, r.s, r.e) for r in one(spark, value, found)]


def test_placeholders(spark):
    found = places(spark, "Hi {{name}} and ${x} %s", F.concat(placeholders.syntax(text()), placeholders.mixed_styles(text())))
    assert found == [("INVALID_VARIABLE_NAME", 3, 10), ("MIXED_BRACKET_STYLES", 3, 10), ("MIXED_PLACEHOLDER_STYLES", 0, 23)]
    assert places(spark, "Use { } or {1st} or {}", placeholders.syntax(text())) == [("EMPTY_PLACEHOLDER", 4, 7), ("INVALID_VARIABLE_NAME", 11, 16)]


def test_tags(spark):
    assert places(spark, "<b>x</b> <span>y", placeholders.tag_pairs(text())) == [("UNMATCHED_CLOSING_TAG", 4, 8), ("UNMATCHED_OPENING_TAG", 9, 15)]
    assert places(spark, "<i>x</i> <p><q>y</q></p>", placeholders.tag_pairs(text())) == [("UNMATCHED_CLOSING_TAG", 4, 8)]


@pytest.mark.parametrize(("value", "target", "expected", "better"), [("Price €100 today", "es", (6, 11), "100 €"), ("Precio 100€ hoy", "en", (7, 11), "€100"), ("Kost 5 $ nu", "nl", (5, 8), "$5")])
def test_currency(spark, value, target, expected, better):
    (found,) = one(spark, value, placeholders.currency(text(), target))
    assert (found.s, found.e, found.suggestion.replace("  ", " ")) == (*expected, better)


def test_numbers(spark):
    value = "1.234,56 and 2,345.67"
    assert places(spark, value, placeholders.numbers_mixed(text(), "en")) == []
    assert places(spark, value, placeholders.numbers_foreign(text(), "en")) == [("INCORRECT_NUMBER_FORMAT_EN", 0, 8)]
    assert places(spark, value, placeholders.numbers_foreign(text(), "nl")) == [("INCORRECT_NUMBER_FORMAT_NL", 13, 21)]


def test_spaces(spark):
    assert [(x.s, x.e, x.message) for x in one(spark, "a  b   c", placeholders.spaces(text()))] == [(1, 3, "2 spaces"), (4, 7, "3 spaces")]
    assert [r for r, _, _ in places(spark, "a\tb c\r\nd\ne", placeholders.general(text()))] == ["MIXED_TABS_SPACES", "MIXED_LINE_ENDINGS"]


def test_heuristics(spark):
    assert [p[1:] for p in places(spark, "End.Start here,ok", heuristics.missing_space(text()))] == [(3, 5), (14, 16)]
    assert [(x.s, x.e, x.suggestion) for x in one(spark, "READ THIS NOW please", heuristics.all_caps(text()))] == [(0, 13, "Read This Now")]
    assert places(spark, "Hola. Cómo estás? ¿Qué tal?", heuristics.inverted_marks(text())) == [("MISSING_SPANISH_QUESTION_MARK", 4, 17)]
    assert places(spark, "Bien. Qué bueno!", heuristics.inverted_marks(text())) == [("MISSING_SPANISH_EXCLAMATION_MARK", 4, 16)]


def test_leaks(spark):
    found = one(spark, "De kat zit op de mat en het is niet groot", heuristics.leaks(text(), "en"))
    assert {x.rule_id: round(x.confidence, 6) for x in found} == {"LANGUAGE_LEAK_ES": 0.272727, "LANGUAGE_LEAK_NL": 0.709091}
    assert "De, op, de, en, het (+2 more)" in next(x.message for x in found if x.rule_id.endswith("NL"))


def test_merge(spark):
    made = [(1, 0, 4, "P", 0.8, "a"), (1, 3, 8, "P", 0.9, "b"), (1, 60, 61, "P", 0.7, "c"), (1, 60, 70, "K", 0.7, "d"), (2, 0, 10, "P", 0.5, "x"), (2, 2, 3, "K", 0.5, "y"), (2, 4, 6, "P", 0.5, "z")]
    df = spark.createDataFrame([(*m, i, None, "heuristic", "R") for i, m in enumerate(made)], "id int, s int, e int, type string, confidence double, message string, seq int, suggestion string, source string, rule_id string")
    got = {(r.id, r.s, r.e, r.type, r.message) for r in issues.merge(df, ["id"]).collect()}
    assert got == {(1, 0, 8, "P", "Multiple issues: a; b"), (1, 60, 61, "P", "c"), (1, 60, 70, "K", "d"), (2, 0, 10, "P", "x"), (2, 2, 3, "K", "y"), (2, 4, 6, "P", "z")}
    once = issues.dedup(df, ["id"])
    assert sorted(issues.dedup(once, ["id"]).collect()) == sorted(once.collect())


def test_merge_ties(spark):
    """Of equally sure issues of a chain with the same seq, the first by place stands for it, wherever rows come from."""
    made = [(1, 0, 30, "a", "languagetool"), (1, 10, 40, "b", "placeholder"), (1, 20, 50, "c", "heuristic")]
    df = spark.createDataFrame([(*m, 7, 0.5, "P", None, "R") for m in made], "id int, s int, e int, message string, source string, seq int, confidence double, type string, suggestion string, rule_id string")
    for ordered in (df.coalesce(1), df.orderBy(F.desc("s")).coalesce(1)):
        assert [(r.s, r.e, r.source) for r in issues.merge(ordered, ["id"]).collect()] == [(0, 50, "languagetool")]


@pytest.mark.parametrize(("word", "capital"), [("ßer", "ẞer"), ("étÉ", "Été"), ("ŉx", "ŉx"), ("ﬁx", "ﬁx"), ("ᾀx", "ᾈx"), ("xİB", "Xib"), ("xΑΣ", "Xασ"), ("a", "A"), ("", "")])
def test_capitalized(spark, word, capital):
    assert one(spark, word, T.capitalized(text())) == capital


def test_score(spark):
    assert spark.range(1).select(report.overall(F.lit(0), F.lit(1), F.lit(2), F.lit(4)).alias("x")).first().x == pytest.approx(0.925)


def test_gate_and_grammar(spark):
    assert not one(spark, "https://a.b/c", report.gate(text())) and one(spark, "see https://a.b/c now", report.gate(text())) and not one(spark, None, report.gate(text()))
    got = [spark.range(1).select(grammar.issue_type(F.lit(c)), grammar.severity(F.lit(c), F.lit(60)), grammar.confidence(F.lit(c), F.lit(None).cast("double"))).first() for c in ("TYPOS", "STYLE", "MISC")]
    assert [tuple(r) for r in got] == [("spelling", "error", 0.9), ("style", "info", 0.6), ("grammar", "warning", 0.8)]
    assert one(spark, "A b. C d! e", grammar.sentences(text())) == ["A b.", "C d!", "e"]
    chunks = one(spark, "Aaa aaa. Bbb bbb. Ccc ccc. ", grammar.chunks(text(), 18))
    assert [(c.start, c.text) for c in chunks] == [(0, "Aaa aaa. Bbb bbb."), (18, "Ccc ccc.")]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab \n\t.!?é\U0001f600", max_size=60), min_size=1, max_size=20), st.integers(1, 12))
def test_chunks_are_parts_of_the_text(spark, texts, longest):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "id int, text string").select("id", grammar.chunks(text(), longest).alias("c"))
    for r in df.collect():
        t = [*texts, None][r.id]
        if t is None or len(t) <= longest:
            assert r.c == (None if t is None else [(0, t)])
            continue
        want, held = [], None
        for m in re.finditer(r"[^.!?]*[.!?]+\s*|[^.!?]+$", t):
            bare = m[0].strip()
            if bare:
                begin = m.start() + m[0].index(bare)
                if held and begin + len(bare) - held[0] <= longest:
                    held = (held[0], begin + len(bare))
                else:
                    want += [held] if held else []
                    held = (begin, begin + len(bare))
        want += [held] if held else []
        assert [(c.start, c.text) for c in r.c] == [(a, t[a:b]) for a, b in want]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab {}.!AÉé\n", max_size=30), min_size=1, max_size=20))
def test_places_are_those_of_python(spark, texts):
    for pattern in (r"\{([^}]*)\}", "  +", "[.!?,:;][a-zA-Z]"):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, text string").select("id", T.find_all(text(), pattern).alias("x"))
        got = {r.id: [(m.s, m.e, m.v) for m in r.x] for r in df.collect()}
        assert got == {i: [(*m.span(), m[0]) for m in re.finditer(pattern, x)] for i, x in enumerate(texts)}


def test_audit_invariants(spark):
    texts = ["De kat zit op de mat en het is niet groot.", "the cat  sat on the mat,and it was {} good. fine", "", None, "ok", "x" * 3000]
    blocks = spark.createDataFrame([(1, i, x) for i, x in enumerate(texts)], "page_id long, block_idx int, text string")
    for config in (AuditConfig(), preset("strict"), preset("minimal"), replace(AuditConfig(), target="nl", ignore_rules=("MULTIPLE_SPACES",))):
        found = report.audit(blocks, config).collect()
        for r in found:
            assert 0 <= r.s <= r.e <= len(texts[r.block_idx]) and (r.e - r.s > 100 or r.snippet == texts[r.block_idx][r.s : r.e]) and 0 <= r.confidence <= 1
        again = report.audit(blocks.repartition(3), config).collect()
        assert sorted(map(str, found)) == sorted(map(str, again)) and found
    stats = report.page_stats(blocks, report.audit(blocks, AuditConfig()), AuditConfig()).first()
    assert stats.total_blocks == 4 and 0 <= stats.overall_score <= 1 and 0 <= stats.language_purity <= 1
    empty = blocks.limit(0)
    assert report.audit(empty, AuditConfig()).count() == 0 and report.batch_summary(report.page_stats(empty, report.audit(empty, AuditConfig()), AuditConfig())).first().total_pages == 0


def test_config(tmp_path):
    path = tmp_path / "a.toml"
    path.write_text('[target]\nlanguage = "nl"\n[rules]\nleak_threshold = 0.2\nwhitelist = ["x"]\n')
    config = load(str(path))
    assert (config.target, config.leak_threshold, config.whitelist) == ("nl", 0.2, ("x",))
    for bad in (lambda: AuditConfig(target="fr"), lambda: preset("none"), lambda: load(str(tmp_path / "b.toml"))):
        with pytest.raises(ConfigError):
            bad()


def test_labels_and_probes(spark):
    from veriglot.operators.detect import parse_label
    from veriglot.sources.tables import available

    assert [one(spark, x, parse_label(text())) for x in ("__label__spa", "__label__en", "dut", "__label__xx")] == ["es", "en", "nl", "xx"]
    assert [one(spark, x, available(text().cast("int"))) for x in ("200", "302", "404", None)] == [True, True, False, False]


def test_whitelist_and_position(spark):
    assert one(spark, "the online shop", heuristics.leaks(text(), "es", 0.0, 1, ("the",)))
    assert one(spark, "ab cd ab", T.position(text(), F.lit("ab"), F.lit(1))) == 6 and one(spark, "ab", T.position(text(), F.lit("x"), F.lit(1))) == 1
    assert one(spark, "see www.a.example and me@b.example  now 12", T.preprocess(text(), numbers=True)) == "see and now"


def test_detect_tokens_whole_text(spark, tmp_path):
    texts = ["xx " * 3_400 + "the " * 3_400, "https://the.of/and the"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.lang): r.n for r in QUERIES["detect_tokens"](spark, str(tmp_path)).collect()}
    assert set(got) == {(0, "en"), (1, "en"), (1, "unknown")} and 60 < got[0, "en"] < 140
    assert got[1, "en"] == 3 and got[1, "unknown"] == 1


def test_api_response_whole_audit(spark, tmp_path):
    texts = ["This is the text of the page and it is in {{name}} and ${x} %s for you\nEl perro y la casa de la ciudad con los gatos", "This is the PRICE OF THE page and  it costs 5€ for you.And the rest <b>is here", "It is the one and only text of the page"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: [] for i in range(3)}
    for r in QUERIES["audit_documents"](spark, str(tmp_path)).collect():
        want[r.page_id].append((r.block_idx, r.s, r.e, r.type, r.severity, r.rule_id, r.message))
    assert {"placeholder", "punctuation", "language_leak"} <= {x[3] for x in want[0] + want[1]}
    for r in QUERIES["api_response"](spark, str(tmp_path)).collect():
        got = json.loads(r.response)
        assert sorted(tuple(i[k] for k in ("block_idx", "start", "end", "type", "severity", "rule_id", "message")) for i in got["issues"]) == sorted(want[r.page_id])
        assert got["total_issues"] == len(want[r.page_id]) and got["issues_by_type"] == Counter(x[3] for x in want[r.page_id])
        assert got["by_severity"] == {"critical": 0, "error": 0, "warning": 0, "info": 0} | Counter(x[4] for x in want[r.page_id])
