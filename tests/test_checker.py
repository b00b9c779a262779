"""Checkers over blocks: isolation, pieces of long texts, bounded requests, statistics."""

import random
import threading
import time

import pytest

from veriglot.config import AuditConfig
from veriglot.operators import checker, report

RULES = (("DIGIT", "TYPOS", "([0-9])([a-z])", r"\1 \2"),)


def rows(spark, texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "page_id long, block_idx int, text string")


def test_one_bad_block_costs_itself(spark):
    texts = [f"block {i} has 7up" if i % 13 else f"bad | {i} 7up" for i in range(100)] + [None, ""]
    out = {r.block_idx: r for r in checker.run(rows(spark, texts), {"p": checker.Checker(lambda: checker.Patterns(RULES, "[|]"), batch=16)}).collect()}
    for i, t in enumerate(texts):
        if not t:
            assert (out[i].matches, out[i].error, out[i].checks) == ([], None, 0)
        elif "|" in t:
            assert (out[i].matches, out[i].error, out[i].checks) == ([], "ValueError: refused", 1)
        else:
            assert [(m.offset, m.length, m.replacements) for m in out[i].matches] == [(t.index("7u"), 2, ["7 u"])] and out[i].error is None


def test_broken_checkers_leave_others_alone(spark):
    class Broken:
        def check(self, texts):
            return [] if len(texts) > 1 else [[{"offset": "x"}]]

    def unreachable():
        raise ConnectionError("no server")

    out = checker.run(rows(spark, ["a 7up", "b 7up"]), {"broken": checker.Checker(Broken), "gone": checker.Checker(unreachable), "good": checker.Checker(lambda: checker.Patterns(RULES))})
    got = {(r.verifier, r.block_idx): r for r in out.collect()}
    assert all(got["good", i].error is None and len(got["good", i].matches) == 1 for i in (0, 1))
    assert all(got["gone", i].error == "ConnectionError: no server" and got["gone", i].checks == 0 for i in (0, 1))
    assert all(got["broken", i].error.startswith("ValueError") and not got["broken", i].matches for i in (0, 1))
    stats = {r.verifier: r for r in checker.stats(out).collect()}
    assert (stats["good"].checks, stats["good"].issues, stats["good"].failures) == (2, 2, 0) and stats["gone"].failures == 2 and stats["gone"].average_seconds == 0
    assert checker.failures(out).count() == 4
    found = report.audit(rows(spark, ["Hello to the world with 7up of it."] * 2), AuditConfig(), checker.issues_of(out, "en"))
    assert found.filter("rule_id = 'DIGIT' and severity = 'error'").count() == 2


def test_pieces():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices(["word", ". ", "! \n", " ", "x", "é"], k=rng.randint(0, 60)))
        longest = rng.randint(1, 30)
        cut = checker.pieces(text, longest)
        assert "".join(text[a:b] for a, b in cut) == text and all(0 < b - a <= longest for a, b in cut if text)
        assert all(p[1] == q[0] for p, q in zip(cut, cut[1:], strict=False))
    assert checker.pieces("One two. Three four", 12) == [(0, 9), (9, 19)] and checker.pieces("aaaa bbbb cccc", 6) == [(0, 5), (5, 10), (10, 14)]
    began = time.perf_counter()
    assert len(checker.pieces("a. " * 200_000, 100)) > 6000 and time.perf_counter() - began < 2


def test_requests_in_flight_are_bounded():
    now, most, lock = 0, 0, threading.Lock()

    class Slow:
        def check(self, texts):
            nonlocal now, most
            with lock:
                now += 1
                most = max(most, now)
            time.sleep(0.01)
            with lock:
                now -= 1
            return [[] for _ in texts]

    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        done = checker._checked(["t"] * 100, checker.Checker(Slow, batch=5, in_flight=3), Slow(), None, pool)
    assert most <= 3 and sum(r.checks for r in done) == 100


def test_second_attempt():
    class Flaky:
        tries = 0

        def check(self, texts):
            Flaky.tries += 1
            if Flaky.tries == 1:
                raise TimeoutError("slow")
            return [[{"offset": 1}] for _ in texts]

    row = checker._Row()
    checker._ask(Flaky(), [(row, 10, "text")], 2)
    assert row.error is None and row.matches[0]["offset"] == 11


@pytest.mark.parametrize("longest", [7, 1000])
def test_long_texts_shift_offsets(spark, longest):
    text = "One 1a two. " * 20 + "\n\n é 2b"
    out = checker.run(rows(spark, [text]), {"p": checker.Checker(lambda: checker.Patterns(RULES), longest=longest)}).first()
    assert [text[m.offset : m.offset + m.length] for m in out.matches] == ["1a"] * 20 + ["2b"]
