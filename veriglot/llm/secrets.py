"""Secret scans: three fixed patterns, and character Markov models of random strings and of ordinary identifiers.

A candidate is a run of characters that keys are made of. Its score is the mean log-likelihood ratio of each character
given the two before it, under a model of random strings against a model of identifiers; both are trained here from
labelled samples. In a run whose own score is low, as it joins names and paths to a value, windows are judged.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, map_slices, packed_rows, text_or_empty, with_id

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: The shortest string that the models judge.
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
HINTS = ("password", "passwd", "secret", "token", "api")
#: No key holds "=" but at its end, so that it parts names from values.
VALUE, SEGMENT = (re.compile(rf"[^{c}]{{{LEAST},}}") for c in ("=", "=/"))
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Ordinary words of identifiers, which join those of the documents.
ORDINARY = """access action active admin agent async author batch block button cache category center char check close cluster column command commit config content context counter create customer data default delete device display domain download email engine event example factory field filter folder frame function group handle height history image import input instance item label last layout level library line list location logger matrix member method model monitor name number object option order owner package panel parameter password path payment period platform player policy position price process profile project provider public queue range region remote request resource result return root route schema score script search select sequence service session shape size stack state status storage string style system table task template text thread title total transaction type update upload value vector video view weight widget window worker""".split()
#: Rows of documents and words of theirs that make identifiers for the sample, and strings of each label.
SAMPLE_ROWS, SAMPLE_WORDS, SAMPLE_STRINGS = 500, 100_000, 20_000
THRESHOLD = 1.0
#: A window is the best of many, so that its mean must be so many times the threshold.
WINDOW = 2.0


def random_strings(n: int, rng: random.Random) -> list[str]:
    """Labelled secret: strings drawn evenly from alphabets that keys use."""
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-"]
    return ["".join(rng.choices(a, k=rng.randint(16, 64))) for a in rng.choices(alphabets, k=n)]


def identifiers(words: list[str], n: int, rng: random.Random) -> list[str]:
    """Labelled ordinary: words joined the ways identifiers are, numbers and repeated characters."""
    out = []
    for _ in range(n):
        picked = [rng.choice(rng.choice((words or ORDINARY, ORDINARY))) for _ in range(rng.randint(1, 4))]
        kind = rng.randrange(8)
        if kind == 6:
            out.append("".join(rng.choices("0123456789", k=rng.randint(12, 20))))
        elif kind == 7:
            out.append(rng.choice("=-_/+x") * rng.randint(16, 40))
        else:
            out.append((str.lower, str.upper, str.title, str, str.lower, str.lower)[kind](("_", "_", "", "", "-", "/")[kind].join(picked)) + (str(rng.randrange(10_000)) if rng.random() < 0.2 else ""))
    return out


class MarkovRatio:
    """Order-2 models over ALPHABET and a start symbol. An order's counts are mixed with PRIOR times the estimate of
    the order below, so that characters which are rare anywhere stay improbable in contexts never seen."""

    PRIOR = 2.0

    def __init__(self, secret: list[str], ordinary: list[str]):
        self.code = np.full(128, 0, np.int64)
        self.code[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)
        self.size = len(ALPHABET) + 1
        self.ratio = self._model(secret) - self._model(ordinary)

    def _model(self, strings: list[str]) -> np.ndarray:
        codes, _ = self._codes(strings)
        cells = (codes[:-2] * self.size + codes[1:-1]) * self.size + codes[2:]
        count = np.bincount(cells[codes[2:] > 0], minlength=self.size**3).reshape(self.size, self.size, self.size)
        below = np.full(self.size, 1 / self.size)
        for order in (count.sum((0, 1)), count.sum(0), count):
            below = (order + self.PRIOR * below) / (order.sum(-1, keepdims=True) + self.PRIOR)
        return np.log(below).ravel().astype(np.float32)

    def _codes(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all strings, each after two start symbols, and where each begins."""
        joined = "".join(["\0\0" + s for s in strings]).encode("ascii")
        return self.code[np.frombuffer(joined, np.uint8)], np.cumsum([0] + [len(s) + 2 for s in strings[:-1]])

    def score(self, strings: list[str]) -> np.ndarray:
        if not strings:
            return np.zeros(0)
        each, begin = self._each(strings)
        return np.add.reduceat(each, begin) / np.array([len(s) for s in strings])

    def _each(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ratios of all strings' characters, each string's followed by two zeros, and where each begins."""
        codes, begin = self._codes(strings)
        codes = np.append(codes, [0, 0])
        cells = (codes[:-2] * self.size + codes[1:-1]) * self.size + codes[2:]
        return np.where(codes[2:] > 0, self.ratio[cells], 0), begin

    def places(self, strings: list[str], threshold: float) -> list[list[tuple[int, int]]]:
        """Where each string is random: all of it if its score is at least threshold, else the windows() of the values
        between its "=", and segments between "=" and "/" whose own score is at least threshold."""
        out = [[(0, len(s))] if x >= threshold else [] for s, x in zip(strings, self.score(strings).tolist(), strict=True)]
        values = [(i, m.start(), m[0]) for i, s in enumerate(strings) if not out[i] for m in VALUE.finditer(s)]
        if values:
            each, begin = self._each([v for _, _, v in values])
            for (i, at, v), b in zip(values, begin.tolist(), strict=True):
                out[i] += [(at + lo, at + hi) for lo, hi in windows(v, each[b : b + len(v)].astype(np.float64), WINDOW * threshold)]
        segments = [(i, *m.span()) for i, s in enumerate(strings) for m in _apart_from(SEGMENT.finditer(s), sorted(out[i]))]
        for (i, a, b), x in zip(segments, self.score([strings[i][a:b] for i, a, b in segments]).tolist(), strict=True):
            if x >= threshold:
                out[i].append((a, b))
        return out


def _apart_from(found: Iterable[re.Match], spans: list[tuple[int, int]]) -> Iterator[re.Match]:
    """Matches that overlap none of the spans; both are in order, and spans don't overlap."""
    k = 0
    for m in found:
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if k == len(spans) or spans[k][0] >= m.end():
            yield m


def windows(value: str, each: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Where windows of at least LEAST characters have a mean of threshold or more: that with the largest sum above it,
    with what beside it is rather random, out to the next "/"; then those in the rest. None is missed, as a window of
    that mean has no negative sum."""
    out, todo = [], [(0, len(value))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < LEAST:
            continue
        total = np.concatenate(([0.0], np.cumsum(each[lo:hi] - threshold)))
        gain = total[LEAST:] - np.minimum.accumulate(total[:-LEAST])
        end = int(gain.argmax())
        if gain[end] < 0:
            continue
        a, b = lo + int(total[: end + 1].argmin()), lo + end + LEAST
        left, right = np.cumsum(each[lo:a][::-1]), np.cumsum(each[b:hi])
        a -= int(left.argmax()) + 1 if left.max(initial=0) > 0 else 0
        b += int(right.argmax()) + 1 if right.max(initial=0) > 0 else 0
        a, stop = max(lo, value.rfind("/", lo, a) + 1), value.find("/", b, hi)
        b = hi if stop < 0 else stop
        out.append((a, b))
        todo += [(lo, a), (b, hi)]
    return out


def train(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS, words: int = SAMPLE_WORDS, strings: int = SAMPLE_STRINGS, seed: int = 11) -> MarkovRatio:
    """Fits both models on labelled samples of bounded size: `strings` random strings, and as many identifiers made of
    about `words` words drawn from the whole texts of about `rows` documents."""
    found = F.filter(F.regexp_extract_all(text_or_empty(text_col), F.lit(r"(\b[A-Za-z]{3,16}\b)")), lambda w: F.length(w) > 2)
    picked = drawn(docs.select(text_or_empty(text_col).alias(text_col)), docs.count(), rows).select(F.explode(found).alias("word"))
    picked = drawn(picked, picked.count(), words, seed).limit(2 * words).collect()
    rng = random.Random(seed)
    return MarkovRatio(random_strings(strings, rng), identifiers(sorted(r.word for r in picked), strings, rng))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three fixed patterns, sorted by start and then kind."""
    out = []
    low = text.lower() if ":" in text or "=" in text else ""
    if any(h in low for h in HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What base spans leave of each candidate run, where that is at least LEAST characters. Runs and spans are walked
    once, side by side."""
    apart: list[list[int]] = []
    for _, a, b in base:
        if apart and a <= apart[-1][1]:
            apart[-1][1] = max(apart[-1][1], b)
        else:
            apart.append([a, b])
    out, i = [], 0
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while i < len(apart) and apart[i][1] <= at:
            i += 1
        k = i
        while k < len(apart) and apart[k][0] < end:
            out.append((at, apart[k][0]))
            at, k = apart[k][1], k + 1
        out.append((at, end))
        i = max(i, k - 1)
    return [(a, b) for a, b in out if b - a >= LEAST]


def coded(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, model: MarkovRatio, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base (spans of the patterns), spans (those and the model's, kind random, which
    overlap none of them) and redacted (the text with each span's characters replaced by [secret]). Null and empty
    texts have no span; rows are scanned one by one, whatever their ids, texts whole, in time in proportion to their length
    but for windows(). An empty table gives no rows; other columns stay behind, see scan_rows()."""

    def start():
        def columns(batch: pa.RecordBatch) -> list:
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            found = [(i, a, b) for i, t in enumerate(texts) for a, b in candidates(t, base[i])]
            spans = [list(b) for b in base]
            for (i, a, b), places in zip(found, model.places([texts[i][a:b] for i, a, b in found], threshold), strict=True):
                spans[i] += [("random", a + lo, a + hi) for lo, hi in places]
            spans = [sorted(s, key=lambda x: (x[1], KINDS.index(x[0]))) for s in spans]
            n = [[sum(k == kind for k, _, _ in b) for b in base] for kind in KINDS[:3]]
            return [batch.column(0), *n, [coded(b) for b in base], [coded(s) for s in spans], [redact(t, s) for t, s in zip(texts, spans, strict=True)]]

        return columns

    return map_slices(docs.select(F.col(id_col), text_or_empty(text_col)), with_id(docs, id_col, "n_assign bigint, n_access bigint, n_hex bigint, base string, spans string, redacted string"), 1, start)


def scan_rows(docs: DataFrame, model: MarkovRatio, text_col: str = "text") -> DataFrame:
    """scan(), with all columns of docs in the struct doc."""
    return scan(packed_rows(docs, text_col), model, id_col="doc", text_col=text_col)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join(out) + text[at:]
