"""Table functions for SQL: blocks of pages, detected languages, votes. Their columns follow those of the table they get.

    SELECT * FROM page_blocks(TABLE(SELECT page_id, url, html FROM pages))
    SELECT * FROM vote(TABLE(votes) PARTITION BY id, method => 'majority')
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..sources import html as pages
from . import detect

def columns(**kinds: DataType) -> list[StructField]:
    return [StructField(name, kind) for name, kind in kinds.items()]


# analyze() has no session that could read these from DDL
_TEXT, _INT, _DOUBLE = StringType(), IntegerType(), DoubleType()
_LANGS = ArrayType(StructType(columns(lang=_TEXT, confidence=_DOUBLE)))
BLOCK = columns(block_idx=_INT, text=_TEXT, xpath=_TEXT, tag_name=_TEXT, attributes=MapType(_TEXT, _TEXT), block_type=_TEXT, offset_start=_INT, offset_end=_INT, html_chars=LongType())
DETECTED = columns(lang=_TEXT, confidence=_DOUBLE)


def told(argument: AnalyzeArgument | None, default: object, what: str, kind: type) -> object:
    """The value of an argument that has to be constant."""
    if argument is None:
        return default
    if argument.isTable or not isinstance(argument.value, kind):
        raise ValueError(f"{what} has to be a constant {kind.__name__}")
    return argument.value


def fields(table: AnalyzeArgument, needed: list[str]) -> list[StructField]:
    """The columns of a table argument, which has to have those that are needed, by their exact names."""
    if not table.isTable:
        raise ValueError("the first argument has to be a TABLE")
    names = table.dataType.names
    if missing := [n for n in needed if n not in names]:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    return table.dataType.fields


def joined(carried: list[StructField], own: list[StructField]) -> AnalyzeResult:
    if clash := {f.name.lower() for f in carried} & {f.name.lower() for f in own}:
        raise ValueError(f"rename {', '.join(sorted(clash))} of the table, as the result has columns of that name")
    return AnalyzeResult(StructType([*carried, *own]))


class PageBlocks:
    """page_blocks(TABLE, html => 'html', least => 10): every column of the table but the page's markup, and BLOCK. Pages that
    can't be parsed, like those without blocks, give no row; parse_failures() lists them."""

    @staticmethod
    def analyze(table: AnalyzeArgument, html: AnalyzeArgument | None = None, least: AnalyzeArgument | None = None) -> AnalyzeResult:
        name = told(html, "html", "html", str)
        told(least, 10, "least", int)
        return joined([f for f in fields(table, [name]) if f.name != name], BLOCK)

    def eval(self, table: Row, html: str = "html", least: int = 10) -> Iterator[tuple]:
        page = table[html]
        carried = [v for n, v in zip(table.__fields__, table, strict=True) if n != html]
        try:
            blocks = pages.page_blocks(page, least)
        except (AssertionError, ValueError, RecursionError):
            if pages.failure(page) is None:  # not the markup's fault
                raise
            return
        for i, text, xpath, tag, attributes, kind, start, end in blocks:
            yield (*carried, i, text, xpath, tag, dict(attributes), kind, start, end, len(page or ""))


VOTE = {"majority": columns(lang=_TEXT, confidence=_DOUBLE, consensus=_DOUBLE, alternatives=_LANGS), "weighted": columns(lang=_TEXT, score=_DOUBLE, rank=_INT), "best": columns(lang=_TEXT, confidence=_DOUBLE, alternatives=_LANGS)}
VOTED = ["ord", "detector", "lang", "confidence", "alternatives"]


class Vote:
    """vote(TABLE PARTITION BY keys, method => 'majority'): the outcome of the votes (ord, detector, lang, confidence; for
    `best` also alternatives) that have the same keys, as detect.vote_majority(), vote_weighted() or vote_best() give it,
    beside the table's other columns, which are taken from the first vote. A key's votes stream through one task; it holds a
    row for each detector and language, not for each vote, so that a key of many votes needs no more memory. Rows without
    a language don't vote."""

    def __init__(self) -> None:
        self.method, self.carried = "majority", None
        self.langs: dict[str, list] = {}  # votes, sum of confidence, sum by weight, weights, smallest ord
        self.said: dict[tuple[int, str], float] = {}  # ord and language: best confidence
        self.beside: dict[str, float] = {}  # alternatives: best confidence

    @staticmethod
    def analyze(table: AnalyzeArgument, method: AnalyzeArgument | None = None) -> AnalyzeResult:
        kind = told(method, "majority", "method", str)
        if kind not in VOTE:
            raise ValueError(f"method is one of {', '.join(VOTE)}")
        needed = VOTED if kind == "best" else VOTED[:-1]
        return joined([f for f in fields(table, needed) if f.name not in VOTED], VOTE[kind])

    def eval(self, table: Row, method: str = "majority") -> None:
        self.method = method
        if self.carried is None:
            self.carried = tuple(v for n, v in zip(table.__fields__, table, strict=True) if n not in VOTED)
        lang, sure, ord_ = table["lang"], table["confidence"], table["ord"]
        if lang is None or sure is None or ord_ is None:
            return
        weight = detect.WEIGHTS.get(table["detector"], 1.0)
        seen = self.langs.setdefault(lang, [0, 0.0, 0.0, 0.0, ord_])
        seen[:] = seen[0] + 1, seen[1] + sure, seen[2] + sure * weight, seen[3] + weight, min(seen[4], ord_)
        if method == "best":
            self.said[ord_, lang] = max(sure, self.said.get((ord_, lang), sure))
            for other in table["alternatives"] or ():
                self.beside[other["lang"]] = max(other["confidence"], self.beside.get(other["lang"], other["confidence"]))

    def terminate(self) -> Iterator[tuple]:
        if self.langs:
            for row in getattr(self, f"_{self.method}")():
                yield (*self.carried, *row)

    def _majority(self) -> list[tuple]:
        best = max(self.langs, key=lambda x: (self.langs[x][0], self.langs[x][1] / self.langs[x][0], -self.langs[x][4]))
        others = {x: v[1] / v[0] for x, v in self.langs.items() if x != best}
        n, sure = self.langs[best][:2]
        return [(best, sure / n, n / sum(v[0] for v in self.langs.values()), surest(others))]

    def _weighted(self) -> list[tuple]:
        votes = sum(v[0] for v in self.langs.values())
        scores = {x: min(1.0, v[2] / v[3] + 0.1 * min(1.0, v[0] / votes)) for x, v in self.langs.items()}
        order = sorted(scores, key=lambda x: (-scores[x], self.langs[x][4]))
        return [(x, scores[x], i + 1) for i, x in enumerate(order)]

    def _best(self) -> list[tuple]:
        ord_, lang = max(self.said, key=lambda k: (self.said[k], -k[0]))
        others = dict(self.beside)
        for (o, x), sure in self.said.items():
            if o != ord_:
                others[x] = max(sure, others.get(x, sure))
        return [(lang, self.said[ord_, lang], surest(others))]


def surest(langs: dict[str, float], most: int = 3) -> list[Row]:
    order = sorted(langs, key=lambda x: (-langs[x], x))[:most]
    return [Row(lang=x, confidence=langs[x]) for x in order]


def detector(predict: Callable[[str], list[tuple[str, float]]]) -> type:
    """The class of detect_language(TABLE, text => 'text'): every column of the table, and lang and confidence by predict(),
    which gives labels with their probability, the likeliest first; `unknown` with 0 where it gives none or the text is null."""

    class DetectLanguage:
        @staticmethod
        def analyze(table: AnalyzeArgument, text: AnalyzeArgument | None = None) -> AnalyzeResult:
            name = told(text, "text", "text", str)
            return joined(fields(table, [name]), DETECTED)

        def eval(self, table: Row, text: str = "text") -> Iterator[tuple]:
            lang, sure = next(iter(predict(table[text] or "")), ("unknown", 0.0))
            yield (*table, lang, float(sure))

    return DetectLanguage


def register(spark: SparkSession, predict: Callable[[str], list[tuple[str, float]]] | None = None) -> None:
    """Makes page_blocks() and vote() known to the session's SQL, and detect_language() if there is a detector for it."""
    spark.udtf.register("page_blocks", udtf(PageBlocks))
    spark.udtf.register("vote", udtf(Vote))
    if predict is not None:
        spark.udtf.register("detect_language", udtf(detector(predict)))
