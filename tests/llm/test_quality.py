"""The ledger of quality rules against plain Python, its policies and ablations."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from veriglot.llm import quality

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = SPACE.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def measured(spark, texts):
    df = quality.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return [tuple(r)[1:6] for r in df.orderBy("doc_id").collect()]


EDGES = [None, "", " \n\t", "a", "a b c d e f g h", "a b c d e f g h i " * 2, "x " * 40, "# $ é𝄞 <b>\n\n# $ é𝄞 <b>\r\n", "a\x0bb\x0cc\xa0d e", "one\ntwo\none\n one\n\n\n", ("w%d " * 300) % tuple(range(300)) * 3, "long " * 50_000]


def test_measurements(spark):
    assert measured(spark, EDGES[:-1]) == [plain(t) for t in EDGES[:-1]]
    assert measured(spark, EDGES[-1:]) == [(50_000, 200_000, 0, 0, 50_000)]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a", "b", " ", "\n", "%", "ü", "  "]), max_size=120).map(" ".join), min_size=1, max_size=30))
def test_measurements_of_any(spark, texts):
    assert measured(spark, texts) == [plain(t) for t in texts]


def test_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1), (1, "a b", "x", 2), (None, None, "y", 3)], "id long, body string, failed string, n_words int")
    out = quality.ledger(docs, "id", "body")
    assert out.columns == ["id", *quality.MEASURES, "failed"] and sorted(r.n_words for r in out.collect()) == [0, 2, 2]
    empty = quality.ledger(docs.limit(0), "id", "body")
    assert empty.count() == 0 and quality.ablations(empty).count() == 0


def test_policies_and_ablations(spark):
    prose = "the cat of the house and a dog that is in it " + " ".join(f"w{i}" for i in range(30))
    texts = [prose, "few words", "the same eight words come again and again " * 9, "### $$$ the %%% " * 8 + prose, "of of of", "12 34 " + "the 56 " * 20]
    entries = quality.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    rows = {r.doc_id: r.failed for r in entries.collect()}
    for version, names in quality.POLICIES.items():
        held = quality.mask(version)
        kept = {r.doc_id: r.kept for r in quality.apply_policy(entries, version).collect()}
        assert kept == {i: bits & held == 0 for i, bits in rows.items()}
        found = {r.rule: r for r in quality.ablations(entries).filter(f"policy = {version}").collect()}
        assert set(found) == set(names)
        for name, r in found.items():
            bit = quality.mask(0, policies={0: (name,)})
            counted = [b & held for b in rows.values()]
            assert (r.n_docs, r.n_failed, r.n_dropped) == (len(texts), sum(b & bit > 0 for b in counted), sum(b > 0 for b in counted))
            assert r.n_only == sum(b == bit for b in counted) and r.n_kept_without == sum(b & ~bit == 0 for b in counted)
            shared = 0
            for b in counted:
                shared |= (b & ~bit) if b & bit else 0
            assert r.shared == shared
    named = entries.select("doc_id", quality.failed_names(entries.failed).alias("names")).collect()
    assert {r.doc_id: r.names for r in named}[0] == [] and "few_words" in {r.doc_id: r.names for r in named}[1]


def test_native(spark):
    plan = quality.apply_policy(quality.ledger(spark.createDataFrame([(1, "a")], "doc_id long, text string")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
