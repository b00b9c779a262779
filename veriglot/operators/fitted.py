"""A language detector that is fitted on labelled texts: naive Bayes over the byte n-grams that tell languages apart.

Tasks count n-grams of one to four bytes in their texts with numpy and hand on one row for each n-gram, language and batch;
sums, information gain and the choice of features are DataFrame operations. Only the chosen features, a bounded number,
come to the driver and travel to executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import slices

#: Labelled texts to fit on, of each language; features; bytes of the longest n-gram; texts that a feature is in, at least.
ROWS, FEATURES, LONGEST, LEAST = 4_000, 3_000, 4, 5
#: More languages than that are refused, as each is a column of the counts.
LANGUAGES = 200
#: Bytes of texts that are counted at once, at about 100 bytes of memory each.
COUNTED = 2 << 20
_COUNTS = "lang string, code long, texts long, times long"


def ngrams(text: str, longest: int = LONGEST) -> np.ndarray:
    """The code of each n-gram of 1 to `longest` bytes of the lower-cased text: its length above 32 bits of its bytes."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.int64)
    out, code = [], np.zeros(len(raw), np.int64)
    for n in range(1, min(longest, len(raw)) + 1):
        code = (code[: len(raw) - n + 1] << 8) | raw[n - 1 :]
        out.append(code | (n << 32))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def gram(code: int) -> bytes:
    """The bytes that a code stands for."""
    return (code & 0xFFFFFFFF).to_bytes(4, "big")[4 - (code >> 32) :]


@dataclass(frozen=True)
class Fitted:
    """languages in order; codes of features, ascending; weights (features x languages): log of each feature's share among
    a language's features."""

    languages: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray
    longest: int = LONGEST

    def scores(self, text: str) -> np.ndarray | None:
        """A logarithm for each language, up to a constant; None for a text without any feature."""
        seen = ngrams(text, self.longest)
        at = np.minimum(np.searchsorted(self.codes, seen), len(self.codes) - 1) if len(self.codes) else np.zeros(0, np.int64)
        at = at[self.codes[at] == seen] if len(at) else at
        return np.bincount(at, minlength=len(self.codes)) @ self.weights if len(at) else None

    def predict(self, text: str) -> list[tuple[str, float]]:
        """Languages with their probability, the likeliest first (ties by name); nothing for a text without features.
        For detect.model()."""
        scores = self.scores(text)
        if scores is None:
            return []
        p = np.exp(scores - scores.max())
        return sorted(zip(self.languages, (p / p.sum()).tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def _counts(labelled: DataFrame, longest: int) -> DataFrame:
    """lang, code, texts that hold it, times: a row for each slice of texts, language and n-gram; code 0 counts the texts."""

    def run(batches):
        for batch in slices(batches, most=COUNTED):
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(ngrams(text, longest))
            for lang, texts in by_lang.items():
                codes, times = np.unique(np.concatenate(texts), return_counts=True)
                _, held = np.unique(np.concatenate([np.unique(t) for t in texts]), return_counts=True)
                columns = [[lang] * (len(codes) + 1), np.append(codes, 0), np.append(held, len(texts)), np.append(times, len(texts))]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *map(pa.array, columns[1:])], ["lang", "code", "texts", "times"])

    return labelled.mapInArrow(run, _COUNTS)


def _plogp(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x)).otherwise(0.0)


def information_gain(texts: dict[str, Column], totals: dict[str, int]) -> Column:
    """What knowing whether a text holds an n-gram tells of its language, in nats; texts: how many hold it, by language."""
    total = float(sum(totals.values()))
    held = sum(texts.values(), F.lit(0.0))
    known = sum((_plogp(c) + _plogp(totals[lang] - c) for lang, c in texts.items()), F.lit(0.0))
    prior = sum(n * np.log(n) for n in totals.values() if n) - total * np.log(total)
    return (known - _plogp(held) - _plogp(total - held) - F.lit(float(prior))) / total


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = ROWS, features: int = FEATURES, longest: int = LONGEST, least: int = LEAST, seed: int = 5) -> Fitted:
    """Fits on about `rows` texts of each language (all, if there are fewer), drawn inside each partition; texts are read
    whole, rows without text or label are left out. Without any row the detector knows no language."""
    known = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return Fitted((), np.zeros(0, np.int64), np.zeros((0, 0)), longest)
    languages = tuple(sorted(sizes))
    drawn = known.sampleBy("lang", {lang: min(1.0, rows / n) for lang, n in sizes.items()}, seed)
    of = lambda c, lang: F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col(c))), F.lit(0))
    counted = _counts(drawn, longest).groupBy("code").agg(*[of(c, lang).alias(f"{c}_{i}") for c in ("texts", "times") for i, lang in enumerate(languages)]).persist()
    try:
        whole = counted.filter("code = 0").first()
        totals = {lang: whole[f"texts_{i}"] if whole else 0 for i, lang in enumerate(languages)}
        gain = information_gain({lang: F.col(f"texts_{i}").cast("double") for i, lang in enumerate(languages)}, totals)
        often = sum((F.col(f"texts_{i}") for i in range(len(languages))), F.lit(0)) >= least
        chosen = counted.filter((F.col("code") != 0) & often).withColumn("gain", F.round(gain, 12)).orderBy(F.desc("gain"), "code").limit(features).collect()
    finally:
        counted.unpersist()
    chosen.sort(key=lambda r: r.code)
    times = np.array([[r[f"times_{i}"] for i in range(len(languages))] for r in chosen], np.float64).reshape(len(chosen), len(languages)) + 1
    return Fitted(languages, np.array([r.code for r in chosen], np.int64), np.log(times / times.sum(0)), longest)


def label(df: DataFrame, model: Fitted, id_col: str, text_col: str = "text") -> DataFrame:
    """id, lang and confidence of each row by the model, whatever its language; `unknown` with 0 where it knows none."""

    def run(batches):
        for batch in slices(batches):
            best = [next(iter(model.predict(t or "")), ("unknown", 0.0)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64())], [id_col, "lang", "confidence"])

    rows = df.select(id_col, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, lang string, confidence double")
