"""Intervals against all pairs, phrases against a plain search, what phrases silence, metrics of a run."""

import random
import re

import pytest

from veriglot.config import AuditConfig
from veriglot.operators import intervals, report, whitelist


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(3)
    span = lambda: (a := rng.randrange(-50, 3000), a + rng.choice((0, 1, 2, 5, 17, 64, 65, 1000, 100_000, -3)))
    left = [(rng.choice((1, 2, None)), i, *span()) for i in range(150)] + [(1, 999, None, 5)]
    right = [(rng.choice((1, 2, None)), i, *span()) for i in range(150)] + [(1, 7, 1 << 40, (1 << 40) + 9)]
    schema = "k int, i int, s long, e long"
    got = intervals.overlaps(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"])
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    want = sorted((a[1], b[1], max(a[2], b[2]), min(a[3], b[3])) for a in left for b in right if a[0] is not None and a[0] == b[0] and a[2] is not None and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3])
    assert sorted((r.left_row.i, r.right_row.i, r["from"], r["to"]) for r in got.collect()) == want and len(want) > 500


def test_overlaps_of_nothing(spark):
    empty = spark.createDataFrame([], "k int, s long, e long")
    assert intervals.overlaps(empty, empty, ["k"]).count() == 0


def plain_places(text, terms):
    out, at, low = [], 0, text.lower()
    while at < len(text):
        fits = [t for t in terms if low.startswith(t, at) and not (at and re.match(r"\w\w", low[at - 1 : at + 1])) and not re.match(r"\w\w", low[at + len(t) - 1 : at + len(t) + 1])]
        if fits:
            out.append((at, at + max(map(len, fits))))
            at = out[-1][1]
        else:
            at += 1
    return out


def test_phrases_against_plain():
    rng = random.Random(1)
    terms = whitelist.checked_terms(["Of The", "of", "the  cat", "é", "cat of the", "-x", " "])
    assert terms == ["-x", "cat of the", "of", "of the", "the cat", "é"]
    found = whitelist.automaton(terms)
    for _ in range(500):
        text = "".join(rng.choices(["of", "the", "The", "cat", " ", " ", " ", "é", "-x", "s"], k=rng.randint(0, 14)))
        assert whitelist.phrase_places(text, found) == plain_places(text, terms), text
    assert whitelist.lowered("İA") == "İa"


def test_phrases_silence_what_they_cover(spark):
    text = "This is the place that the people of the town call El La De Que and it is good"
    blocks = spark.createDataFrame([(1, 0, text), (1, 1, None)], "page_id long, block_idx int, text string")
    leaks = lambda **k: [r.rule_id for r in report.audit(blocks, AuditConfig(leak_threshold=0.02, **k)).filter("rule_id like 'LANGUAGE_LEAK%'").collect()]
    assert "LANGUAGE_LEAK_ES" in leaks() and "LANGUAGE_LEAK_ES" not in leaks(whitelist=("el la de que", "at"))
    two = spark.createDataFrame([(1, 0, "This is the Brand,name of it all and it is good,really")], "page_id long, block_idx int, text string")
    rules = lambda **k: sum(r.rule_id == "MISSING_SPACE_AFTER_PUNCT" for r in report.audit(two, AuditConfig(merge=False, **k)).collect())
    assert (rules(), rules(whitelist=("the brand,name",))) == (2, 1)
    assert report.audited(blocks, AuditConfig(whitelist=("a b",))).columns == report.audited(blocks, AuditConfig()).columns
    with pytest.raises(ValueError):
        whitelist.checked_terms([f"t{i}" for i in range(whitelist.MOST_TERMS + 1)])
    rows = whitelist.with_phrases(blocks, []).collect()
    assert [(r.phrases, r.masked) for r in rows] == [([], text), ([], None)]


def test_metrics_of_the_pass_itself(spark):
    blocks = spark.createDataFrame([(i, j, "the cat sat on the mat,and it was good" if j % 2 else "It is the good one of all.") for i in range(5) for j in range(6)], "page_id long, block_idx int, text string")
    kept = []
    metrics = report.run_metrics(report.audited(blocks, AuditConfig()), lambda df: kept.extend(df.select("found").collect()))
    issues = [i for r in kept for i in r.found]
    assert metrics["blocks"] == 30 and metrics["issues"] == len(issues) > 0 and metrics["seconds"] > 0
    assert metrics["warning"] == sum(i.severity == "warning" for i in issues) and metrics["by_heuristic"] == sum(i.source == "heuristic" for i in issues)
    assert metrics["checked"] == sum(bool(r.found) for r in kept)
