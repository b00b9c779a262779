"""Language identification of texts that may mix languages.

A word's script narrows the candidate languages to those seen in that script; hashed character n-grams score the word
under each candidate; Viterbi with a penalty for switching labels the words, and runs of one label are spans.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import REMEMBERED, map_slices, packed_rows, text_or_empty, with_id

WORD = re.compile(r"[^\W\d_]+")
#: First code points of script ranges (Unicode blocks) and the script of each range.
SCRIPTS = [(0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "other"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other")]
STARTS, NAMES = np.array([s for s, _ in SCRIPTS]), sorted({n for _, n in SCRIPTS})
SCRIPT_OF = np.array([NAMES.index(n) for _, n in SCRIPTS])

BUCKETS, ORDERS = 1 << 15, (1, 2, 3, 4)
#: Rows the classifier is fitted on at most, about; the switching penalty in nats; bytes of text whose
#: words are labelled together.
TRAIN_ROWS, PENALTY, SLICE = 20_000, 12.0, 4_000_000
#: Rows that the sample holds of each label at least, where there are so many.
LEAST = 200
#: A script belongs to a language from this share of its letters.
SCRIPT_SHARE = 0.02


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of all character n-grams of the words (each between two boundary signs), the word each belongs
    to, and each word's script."""
    joined = "\n".join(["", *words, ""])
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    edge = codes == 10
    word = np.cumsum(edge) - 1
    script = SCRIPT_OF[np.searchsorted(STARTS, codes[np.flatnonzero(edge)[:-1] + 1], side="right") - 1]
    buckets, owners, inner = [], [], np.cumsum(edge)
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h ^ codes[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        last = inner[n - 1 : n - 1 + m] - edge[n - 1 : n - 1 + m]  # boundaries before the last sign
        whole = (last == inner[:m]) & ~(edge[:m] & (n == 1))  # no boundary inside, except at either end
        buckets.append((h[whole] % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(word[:m][whole])
    return np.concatenate(buckets), np.concatenate(owners), script


class Model:
    def __init__(self, languages: list[str], scores: np.ndarray, scripts: np.ndarray):
        """scores: log-probabilities by bucket and language; scripts: by script and language, whether it is used."""
        self.languages, self.scores, self.scripts = languages, scores.astype(np.float32), scripts

    def word_scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        bucket, owner, script = features(words)
        order = np.argsort(owner, kind="stable")
        out = np.add.reduceat(self.scores[bucket[order]], np.searchsorted(owner[order], np.arange(len(words))))
        out -= out.max(1, keepdims=True)
        used = self.scripts[script]
        out = np.where(used, np.maximum(out, -30), -60)
        out[~used.any(1)] = 0  # in a script no language was seen in
        return out.astype(np.float32)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Counts features by language over labelled rows, about `rows` of them, drawn at random; of a rare label about LEAST
    rows, or all if there are fewer, so that it is learned (together no more than about `rows` again).
    Rows without a label or text are passed over; without any labelled row the model has no language."""
    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each label
    total = sum(counts.values())
    least = min(LEAST, max(1, rows // max(1, len(counts))))
    if total > rows:
        rare = {lang: least / n for lang, n in counts.items() if n * rows < least * total}
        share = F.lit(rows / total)
        if rare:
            share = F.coalesce(F.create_map(*[F.lit(x) for pair in rare.items() for x in pair])[F.col("lang")], share)
        labelled = labelled.filter(F.rand(7) < share)

    def start():
        def columns(batch: pa.RecordBatch) -> list:
            out: tuple[list, list, list] = ([], [], [])
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).extend(WORD.findall(text.lower()))
            for lang, words in by.items():
                if words:
                    bucket, _, script = features(words)
                    letters = np.bincount(script, np.array([len(w) for w in words]), len(NAMES)).astype(np.int64)
                    count = np.append(np.bincount(bucket, minlength=BUCKETS), letters)
                    for x, y in zip(out, ([lang] * np.count_nonzero(count), np.flatnonzero(count).tolist(), count[count > 0].tolist()), strict=True):
                        x += y
            return list(out)

        return columns

    sums = map_slices(labelled, StructType.fromDDL("lang string, cell int, n bigint"), 1, start).groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums.lang.unique())
    count = np.zeros((BUCKETS + len(NAMES), len(languages)))
    for lang, cell, n in zip(sums.lang, sums.cell, sums.n, strict=True):
        count[cell, languages.index(lang)] = n
    letters = count[BUCKETS:]
    scores = np.log((count[:BUCKETS] + 0.1) / (count[:BUCKETS] + 0.1).sum(0))
    return Model(languages, scores, letters > SCRIPT_SHARE * letters.sum(0))


def viterbi(scores: np.ndarray, begin: np.ndarray, length: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word. All sequences advance together; begin and length are sorted by falling length."""
    labels = np.zeros(len(scores), np.int16)
    if not len(begin) or not scores.shape[1]:
        return labels
    stay = np.zeros(scores.shape, bool)
    source = np.zeros(len(scores), np.int16)
    active = np.searchsorted(-length, -np.arange(int(length[0])), side="left")  # sequences longer than t
    value = scores[begin].copy()
    for t in range(1, int(length[0])):
        k = active[t]
        at, v = begin[:k] + t, value[:k]
        best = v.argmax(1)
        top = v[np.arange(k), best][:, None] - penalty
        held = v >= top
        stay[at], source[at] = held, best
        value[:k] = np.where(held, v, top) + scores[at]
    state = value.argmax(1)
    for t in range(int(length[0]) - 1, -1, -1):
        k = active[t]
        at, s = begin[:k] + t, state[:k]
        labels[at] = s
        if t:
            state[:k] = np.where(stay[at, s], s, source[at])
    return labels


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and spans (start:end:language in code points, comma-joined) of each whole text. lang_pred
    is the language with most letters in its spans (ties: first by name) and score their share of all letters; texts
    that are null or without a letter get `und` and 0, as does every text when no language was learned. Repeated rows and ids are
    identified one by one, texts read whole, however long; an empty table gives no rows, and other columns stay behind,
    whatever their names (see identify_rows())."""

    def start():
        known: dict[str, int] = {}
        table = np.zeros((0, len(model.languages)), np.float32)

        def columns(batch: pa.RecordBatch) -> list:
            nonlocal known, table
            texts = batch.column(1).to_pylist()
            words = [WORD.findall(t.lower()) for t in texts]
            wanted = set().union(*words)
            if signs := {w for w in wanted if not any(map(str.isalpha, w))}:  # such as superscript digits
                words = [[w for w in ws if w not in signs] for ws in words]
                wanted -= signs
            if len(known) + len(wanted) > 2 * REMEMBERED:  # keep what is wanted just now
                kept = [w for w in known if w in wanted]
                table = table[[known[w] for w in kept]]
                known = dict(zip(kept, range(len(kept)), strict=True))
            new = sorted(wanted.difference(known))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            table = np.concatenate([table, model.word_scores(new)]) if model.languages else np.zeros((len(known), 0), np.float32)
            length = np.array([len(w) for w in words], np.int64)
            get, order = known.__getitem__, np.argsort(-length, kind="stable")
            flat = np.fromiter((i for d in order for i in map(get, words[d])), np.int64, int(length.sum()))
            size = np.fromiter((len(x) for d in order for x in words[d]), np.int64, len(flat))
            begin = np.concatenate([[0], np.cumsum(length[order])[:-1]]).astype(np.int64)
            labels = viterbi(table[flat], begin[: np.count_nonzero(length)], length[order][: np.count_nonzero(length)], penalty)
            pred, score, spans = ["und"] * len(texts), [0.0] * len(texts), [""] * len(texts)
            for d, a, n in zip(order.tolist(), begin.tolist(), length[order].tolist(), strict=True):
                if n and model.languages:
                    own = labels[a : a + n]
                    letters = np.bincount(own, size[a : a + n], len(model.languages))
                    pred[d], score[d] = model.languages[int(letters.argmax())], float(letters.max() / letters.sum())
                    spans[d] = _spans(texts[d], words[d], own, model.languages)
            return [batch.column(0), pred, score, spans]

        return columns

    return map_slices(docs.select(F.col(id_col), text_or_empty(text_col)), with_id(docs, id_col, "lang_pred string, score double, spans string"), 1, start, SLICE)


def identify_rows(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """identify(), with all columns of docs in the struct doc."""
    return identify(packed_rows(docs, text_col), model, id_col="doc", text_col=text_col)


def _spans(text: str, words: list[str], labels: np.ndarray, languages: list[str]) -> str:
    cuts = np.flatnonzero(np.diff(labels)) + 1
    if not len(cuts):
        first, last = 0, len(text)
        while not text[last - 1].isalpha():
            last -= 1
        while not text[first].isalpha():
            first += 1
        return f"{first}:{last}:{languages[labels[0]]}"
    at = [m.span() for m in WORD.finditer(text) if any(map(str.isalpha, m[0]))]
    if len(at) != len(words):  # lower-casing changed the number of words
        at = [m.span() for m in WORD.finditer(text.lower()) if any(map(str.isalpha, m[0]))]
    edges = [0, *cuts.tolist(), len(words)]
    return ",".join(f"{at[a][0]}:{at[b - 1][1]}:{languages[labels[a]]}" for a, b in zip(edges, edges[1:], strict=False))
