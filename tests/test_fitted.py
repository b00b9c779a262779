"""The fitted detector against plain naive Bayes, its features against plain information gain, and held-out accuracy."""

import math
from collections import Counter

import numpy as np
import pytest

from veriglot.operators import detect, fitted
from veriglot.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TEXTS = {
    "en": ["the cat and the dog", "this is the thing that they think", "with the other brother", "nothing there", "both of them", "the weather"],
    "nl": ["de kat en de hond", "dit is het ding dat zij zien", "met zijn andere broer", "niets is daar", "zij zijn er bij", "het weer is mooi"],
    "é": ["ñandú año niño", "mañana señor", "él está aquí", "año nuevo", "niña pequeña", "sueño"],
}


def grams(text):
    raw = text.lower().encode()
    return [raw[i : i + n] for n in range(1, 5) for i in range(len(raw) - n + 1)]


def entropy(counts):
    n = sum(counts)
    return -sum(c / n * math.log(c / n) for c in counts if c) if n else 0


@pytest.fixture(scope="module")
def model(spark):
    rows = [(t, lang) for lang, texts in TEXTS.items() for t in texts] + [(None, "en"), ("text", None)]
    return fitted.fit(spark.createDataFrame(rows, "text string, lang string").repartition(3), features=40, least=2)


def test_features_by_information_gain(model):
    langs = sorted(TEXTS)
    held = {lang: Counter(g for t in TEXTS[lang] for g in set(grams(t))) for lang in langs}
    times = {lang: Counter(g for t in TEXTS[lang] for g in grams(t)) for lang in langs}
    sizes = [len(TEXTS[lang]) for lang in langs]
    total, gains = sum(sizes), {}
    for g in set().union(*held.values()):
        d = [held[lang][g] for lang in langs]
        if sum(d) >= 2:
            rest = [n - x for n, x in zip(sizes, d, strict=True)]
            gains[g] = entropy(sizes) - sum(d) / total * entropy(d) - sum(rest) / total * entropy(rest)
    least = sorted(gains.values(), reverse=True)[39]
    chosen = {fitted.gram(c) for c in model.codes.tolist()}
    assert len(chosen) == 40 and all(gains[g] >= least - 1e-9 for g in chosen) and all(g in chosen for g, v in gains.items() if v > least + 1e-9)
    for code, row in zip(model.codes.tolist(), model.weights, strict=True):
        for lang, w in zip(langs, row, strict=True):
            assert w == pytest.approx(math.log((times[lang][fitted.gram(code)] + 1) / sum(times[lang][g] + 1 for g in chosen)))


def test_predictions_against_plain(model):
    chosen = {fitted.gram(c): i for i, c in enumerate(model.codes.tolist())}
    for text in ["the brother thinks", "het is niet daar", "El niño está", "", "zzz", "ß", "a"]:
        seen = [chosen[g] for g in grams(text) if g in chosen]
        got = model.predict(text)
        if not seen:
            assert got == []
            continue
        logs = [sum(model.weights[i][k] for i in seen) for k in range(3)]
        p = [math.exp(x - max(logs)) for x in logs]
        assert dict(got) == pytest.approx({lang: x / sum(p) for lang, x in zip(model.languages, p, strict=True)})
        assert [x for _, x in got] == sorted((x for _, x in got), reverse=True)


def test_no_labels(spark):
    none = fitted.fit(spark.createDataFrame([], "text string, lang string"))
    assert none.predict("anything") == []
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, text string")
    assert [(r.lang, r.confidence) for r in fitted.label(df, none, "id").collect()] == [("unknown", 0.0)] * 2


def test_a_few_rows_of_each(spark):
    rows = [("the cat", "en")] * 400 + [("de kat", "nl")] * 3
    small = fitted.fit(spark.createDataFrame(rows, "text string, lang string"), rows=50, least=1)
    assert small.languages == ("en", "nl") and small.predict("de kat")[0][0] == "nl"


def test_held_out_accuracy(spark):
    rows = QUERIES["fitted_benchmark"](spark, "/root/testdata/sf0.01").collect()
    right = {d: sum(r.correct for r in rows if r.detector == d) / sum(r.n for r in rows if r.detector == d) for d in ("fitted", "stopwords")}
    assert right["fitted"] > 0.97 and right["fitted"] >= right["stopwords"]
    assert len({r.expected for r in rows}) >= 4


def test_hints_beside_the_model(spark):
    df = spark.createDataFrame([(1, "the and of to in el la los que casa grande y bonita", "en", 0.7), (2, "the and of to", "en", 0.95), (3, "x", "unknown", 0.0)], "id long, text string, lang string, lang_confidence double")
    from pyspark.sql import functions as F

    out = df.select("id", detect.hint_alternatives(F.col("text"), F.col("lang"), F.col("lang_confidence")).alias("a"), detect.hint_distribution(F.col("text"), F.col("lang"), F.col("lang_confidence")).alias("d"))
    got = {r.id: r for r in out.collect()}
    assert [a.lang for a in got[1].a] == ["es"] and got[1].a[0].confidence <= 0.56 and got[2].a == [] == got[3].a == got[3].d
    assert (got[1].d[0].lang, got[1].d[0].confidence) == ("en", 0.7) and got[1].d[1].lang == "es" and got[2].d[0].confidence == 0.95
    fixed = {r.lang for r in QUERIES["fitted_distribution"](spark, SF).collect()}
    assert fixed <= {"es", "en", "nl", "de", "fr"} and np.isfinite([r.confidence for r in QUERIES["fitted_alternatives"](spark, SF).collect()]).all()
