"""Magnitudes that single precision can't hold, and secret windows against all windows."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriglot.llm import ann, secrets

RNG = np.random.default_rng(8)
ROWS = RNG.normal(size=(600, 16))


def scaled(kind):
    x = ROWS.copy()
    if kind == "one huge row":
        x[7] *= 1e200
    elif kind == "all tiny":
        x *= 1e-25
    elif kind == "mixed":
        x *= 10.0 ** RNG.integers(-9, 10, (600, 1))
    elif kind == "subnormal":
        x *= 1e-310
    elif kind == "largest doubles":
        x[::3] *= 1e307
    return x


@pytest.mark.parametrize("kind", ["one huge row", "all tiny", "mixed", "subnormal", "largest doubles"])
def test_any_magnitude(spark, kind):
    x = scaled(kind)
    got = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect()
    with np.errstate(all="ignore"):
        exact = np.einsum("qd,rd->qr", x[::20], x)
    hits = 0
    for q in range(30):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q * 20)
        assert [r for r, _, _ in mine] == list(range(1, 21))
        for _, i, score in mine:
            assert score == exact[q, i] or score == pytest.approx(exact[q, i], rel=1e-12) or np.isnan(score) and np.isnan(exact[q, i])
        others = [i for i in range(600) if i != q * 20]
        best = sorted(others, key=lambda i: (np.isnan(exact[q, i]), -exact[q, i] if not np.isnan(exact[q, i]) else 0, i))[:20]
        if kind == "largest doubles":  # infinite scores are ties among more rows than a list of 20 takes
            hits += sum(bool(np.isinf(s)) or i in best for _, i, s in mine)
        elif kind == "subnormal":  # products vanish, so that all are ties
            hits += 20
        else:
            hits += len({i for _, i, _ in mine} & set(best))
    assert hits / 600 >= 0.9


def test_many_spans_in_linear_time():
    text = " ".join(f"AKIA{i:016d}" for i in range(8000))
    base = secrets.base_spans(text)
    began = time.perf_counter()
    assert secrets.candidates(text, base) == [] and time.perf_counter() - began < 0.5


def slow_candidates(text, base):
    out = []
    for m in secrets.CANDIDATE.finditer(text):
        free = [not any(a <= i < b for _, a, b in base) for i in range(m.start(), m.end())]
        at = 0
        while at < len(free):
            end = at
            while end < len(free) and free[end]:
                end += 1
            if end - at >= secrets.LEAST:
                out.append((m.start() + at, m.start() + end))
            at = end + 1
    return out


def test_candidates_against_every_character():
    rng = random.Random(4)
    parts = ["AKIA" + "A1" * 8, "0a" * 12, "token=abcdef", "x" * 5, " ", "=", "/", "Zq9" * 6, "secret: ", "0123456789abcdef" * 2]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert secrets.candidates(text, secrets.base_spans(text)) == slow_candidates(text, secrets.base_spans(text)), text


def test_windows_against_all_windows():
    rng, least = random.Random(9), secrets.LEAST
    for _ in range(300):
        n = rng.randint(1, 90)
        value = "".join(rng.choices("ab/", weights=(6, 6, 1), k=n))
        each = np.array([rng.choice((-1.0, 0.0, 1.0, 3.0)) for _ in range(n)])
        found = secrets.windows(value, each, 1.5)
        total = np.concatenate(([0.0], np.cumsum(each)))
        good = [(a, b) for a in range(n) for b in range(a + least, n + 1) if total[b] - total[a] >= 1.5 * (b - a)]
        for a, b in good:  # each good window touches a span
            assert any(x < b and a < y for x, y in found)
        for x, y in found:  # each span holds a good window
            assert any(x <= a and b <= y for a, b in good)
        assert all(p[1] <= q[0] for p, q in zip(sorted(found), sorted(found)[1:], strict=False))
        assert bool(good) == bool(found)


def test_words_of_whole_texts_are_drawn(spark):
    docs = spark.createDataFrame([(1, "a 1 " * 3000 + "zebraword " * 2000)], "doc_id long, text string")
    seen = []
    original = secrets.identifiers
    try:
        secrets.identifiers = lambda words, n, rng: seen.extend(words) or original(words, n, rng)
        secrets.train(docs, strings=50)
    finally:
        secrets.identifiers = original
    assert seen == ["zebraword"] * 2000
