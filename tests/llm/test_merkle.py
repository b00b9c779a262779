"""Manifests and proofs against a plain recursive version."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veriglot.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """The root of nodes, and for each node the (left, right) strings of its proof."""
    proofs, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for a in range(0, len(nodes), 3):
            three = nodes[a : a + 3]
            for k in range(len(three)):
                for i in owners[a + k]:
                    proofs[i].append(("".join(three[:k]), "".join(three[k + 1 :])))
            up.append(h(*three))
            held.append([i for x in owners[a : a + 3] for i in x])
        nodes, owners = up, held
    return nodes[0], proofs


def plain(rows):
    """rows of (id, group, text): sorted (id, leaf, subroot, root, steps)."""
    groups = defaultdict(list)
    for i, g, t in rows:
        groups[g].append((i is not None, i or 0, h(encoded(i), encoded(t)), i))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {g: climb([x[2] for x in sorted(groups[g])]) for g in order}
    root, upper = climb([tops[g][0] for g in order])
    return sorted(((x[3], x[2], tops[g][0], root, below + above) for g, above in zip(order, upper, strict=True) for x, below in zip(sorted(groups[g]), tops[g][1], strict=True)), key=str)


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"g": F.lit(1), "idx": F.lit(2), "leaf": F.lit("x")})
    out = merkle.manifest(docs.repartition(7), merkle.leaf(F.col("doc_id"), F.col("text")), carried={"text": F.col("text")})
    proved = out.withColumns({"folded": merkle.fold(F.col("leaf"), F.col("steps")), "proof": merkle.proof_digest(F.col("steps"))}).collect()
    for r in proved:
        assert r.folded == r.root and r.proof == h(*[a + b for a, b in r.steps]) and r.leaf == h(encoded(r.doc_id), encoded(r.text))
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.steps]) for r in proved), key=str)


CASES = {
    "one row": [(1, "a", "t")],
    "lone groups": [(i, f"s{i}", "t") for i in range(5)],
    "one group of a power of three": [(i, "a", f"t{i}") for i in range(243)],
    "past a block": [(i, "a", f"t{i}") for i in range(244)] + [(1, None, "n"), (2, "é", None), (3, "", "")],
    "a hot group and small ones": [(i, "hot" if i % 3 else f"s{i % 31}", f"t{i}") for i in range(2300)],
    "nulls and repeats": [(None, None, None)] * 5 + [(7, "a", "same")] * 30 + [(7, "a", "other"), (None, "a", "x" * 200_000)],
    "many groups": [(i, f"s{i // 2}", "t") for i in range(700)],
}


@pytest.mark.parametrize("case", CASES)
def test_against_plain(spark, case):
    assert found(spark, CASES[case]) == plain(CASES[case])


def test_empty(spark):
    assert found(spark, []) == []


def test_tampering_shows(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], f"t{i}") for i in range(20)], "doc_id long, source string, text string")
    out = merkle.manifest(docs, merkle.leaf(F.col("doc_id"), F.col("text")), carried={"claimed": merkle.leaf(F.col("doc_id"), F.concat("text", F.when(F.col("doc_id") == 5, "!").otherwise("")))})
    assert out.filter(merkle.fold(F.col("claimed"), F.col("steps")) != F.col("root")).select("doc_id").collect() == [(5,)]
