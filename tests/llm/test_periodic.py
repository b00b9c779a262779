"""Runs of repetition against a plain search, on words, edge cases and the registered query."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from veriglot.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def plain(words, shortest=12):
    """All runs: for each period the maximal stretches, unless a smaller period has the same stretch."""
    seen, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            e = i
            while e + p < n and words[e] == words[e + p]:
                e += 1
            if e + p - i >= max(shortest, 2 * p):
                seen.setdefault((i, e + p), p)
            i = e
    return sorted((s, e - s, p) for (s, e), p in seen.items())


def collapsed(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_many_small():
    rng = random.Random(5)
    texts = [[rng.randint(1, k) for _ in range(rng.randint(0, 90))] for k in (1, 2, 2, 3, 5) for _ in range(60)]
    for _ in range(80):
        block = [rng.randint(1, 9) for _ in range(rng.randint(1, 30))]
        texts.append([rng.randint(1, 9) for _ in range(20)] + (block * 9)[: rng.randint(12, 200)] + [rng.randint(1, 9) for _ in range(20)])
    fib = [[1], [1, 2]]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    texts += [fib[-1], [1] * 5000, [1, 2] * 12 + [1] * 30, list(range(1, 200)) * 2]
    for shortest in (12, 2):
        got = periodic.find_runs([np.array(t, np.int64) for t in texts], shortest)
        assert [list(map(tuple, g.tolist())) for g in got] == [plain(t, shortest) for t in texts]


def test_long_texts():
    rng = np.random.default_rng(3)
    words = rng.integers(1, 30_000, 60_000)
    words[1000:31_000] = np.resize(words[1000:8000], 30_000)
    got = periodic.find_runs([words, np.ones(200_000, np.int64)])
    assert [1000, 30_000, 7000] in got[0].tolist() and got[1].tolist() == [[0, 200_000, 1]]


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, "a " * 11, "x"), (5, "a\tb\n" * 6, "x"), (5, "a\tb\n" * 6, "x"), (None, "é\xa0 " * 20, "x"), (7, "a b c " * 4 + "d " * 13, "x")]
    docs = spark.createDataFrame(rows, "id long, body string, runs string")
    out = sorted((tuple(r) for r in periodic.periodic_runs(docs, "id", "body").collect()), key=str)
    assert len(out) == len(rows)
    for i, n_words, runs, text in out:
        words = re.findall("[^\x20\x09-\x0d]+", next(b for a, b, _ in rows if a == i) or "")
        want = plain(words)
        assert n_words == len(words) and [tuple(r) for r in runs] == want and text == collapsed(words, want)
    assert periodic.periodic_runs(docs.limit(0), "id", "body").count() == 0


def test_query(spark):
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.length("text") < 9000).collect()
    planted = 0
    for d in docs:
        words = re.findall("[^\x20\x09-\x0d]+", d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs, r = plain(words), got[d.doc_id]
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r.n_runs == len(runs) and (r.start, r.length, r.period) == (top or (None,) * 3)
        assert r.exponent_milli == (top and 1000 * top[1] // top[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert planted > 10 and sum(r.n_runs > 0 for r in got.values()) > planted / 2
