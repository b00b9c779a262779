"""Runs checkers over blocks: any client that takes texts and returns matches, each checker apart from the others.

A task connects to each checker once and keeps a bounded number of requests in flight. A request holds several texts; one
that fails is cut in halves until the text that fails is alone, whose error becomes part of its row. Texts longer than a
checker takes are cut into successive pieces of the text itself, so that places only have to be shifted. A checker that
can't be reached is an error of each of the task's rows: no failure of a checker stops a page, another checker or the job.
"""

from __future__ import annotations

import re
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import grammar

KEYS = ["page_id", "block_idx"]
MATCH = "offset: int, length: int, category: string, rule_id: string, message: string, replacements: array<string>, priority: int, confidence: double"
FIELDS = [f.split(":")[0] for f in MATCH.split(", ")]
SENTENCE_END, SPACE = re.compile(r"[.!?]+\s+"), re.compile(r"\s+")


class Client(Protocol):
    def check(self, texts: list[str]) -> list[list[dict]]:
        """For each text its matches: dicts with some of FIELDS."""


@dataclass(frozen=True)
class Checker:
    """connect() makes the client, on executors; longest is in code points, a request holds `batch` texts of `most` code
    points together at most, attempts counts the tries of a text that fails alone."""

    connect: Callable[[], Client]
    longest: int = 20_000
    batch: int = 32
    most: int = 200_000
    in_flight: int = 4
    attempts: int = 1


@dataclass
class Patterns:
    """A client for rules that are regular expressions: (rule_id, category, pattern, replacement or None). A text that
    `refuses` matches is an error."""

    rules: tuple[tuple[str, str, str, str | None], ...]
    refuses: str | None = None
    compiled: list = field(default_factory=list)

    def check(self, texts: list[str]) -> list[list[dict]]:
        self.compiled = self.compiled or [re.compile(r[2]) for r in self.rules]
        return [self._matches(t) for t in texts]

    def _matches(self, text: str) -> list[dict]:
        if self.refuses and re.search(self.refuses, text):
            raise ValueError("refused")
        return [
            {"offset": m.start(), "length": m.end() - m.start(), "category": category, "rule_id": rule, "message": f"{rule}: {m[0]}", "replacements": [] if to is None else [m.expand(to)]}
            for (rule, category, _, to), pattern in zip(self.rules, self.compiled, strict=True)
            for m in pattern.finditer(text)
        ]


def pieces(text: str, longest: int) -> list[tuple[int, int]]:
    """Successive (start, end) of at most `longest` code points: cut after a sentence, else after white space, else
    anywhere."""
    if len(text) <= longest:
        return [(0, len(text))]
    out, at, ends = [], 0, {}
    for kind, pattern in ((0, SENTENCE_END), (1, SPACE)):
        ends[kind] = [m.end() for m in pattern.finditer(text)]
    next_ = [0, 0]
    while len(text) - at > longest:
        cut = at + longest
        for kind in (0, 1):
            places, i = ends[kind], next_[kind]
            while i < len(places) and places[i] <= at + longest:
                i += 1
            next_[kind] = i
            if i and places[i - 1] > at:
                cut = places[i - 1]
                break
        out.append((at, cut))
        at = cut
    return [*out, (at, len(text))]


@dataclass
class _Row:
    """A block's state while its pieces are checked."""

    matches: list[dict] = field(default_factory=list)
    error: str | None = None
    checks: int = 0
    seconds: float = 0.0


def _ask(client: Client, part: list[tuple[_Row, int, str]], attempts: int) -> None:
    """Checks (row, shift, text) together; halves what fails."""
    began = time.perf_counter()
    try:
        answers = client.check([t for _, _, t in part])
        if len(answers) != len(part):
            raise RuntimeError(f"{len(answers)} answers to {len(part)} texts")
        # read whole before anything is kept, so that a bad answer leaves nothing behind
        found = [[{**dict.fromkeys(FIELDS), **m, "offset": int(m.get("offset") or 0) + shift} for m in answer] for (_, shift, _), answer in zip(part, answers, strict=True)]
    except Exception as error:  # whatever a foreign client raises is the text's error
        if len(part) > 1:
            _ask(client, part[: len(part) // 2], attempts)
            _ask(client, part[len(part) // 2 :], attempts)
        elif attempts > 1:
            _ask(client, part, attempts - 1)
        else:
            row = part[0][0]
            row.error, row.checks = row.error or f"{type(error).__name__}: {error}", row.checks + 1
            row.seconds += time.perf_counter() - began
        return
    share = (time.perf_counter() - began) / len(part)
    for (row, _, _), matches in zip(part, found, strict=True):
        row.checks, row.seconds = row.checks + 1, row.seconds + share
        row.matches += [{k: m[k] for k in FIELDS} for m in matches]


def _requests(rows: list[_Row], texts: list[str | None], checker: Checker) -> Iterator[list[tuple[_Row, int, str]]]:
    part, held = [], 0
    for row, text in zip(rows, texts, strict=True):
        for a, b in pieces(text or "", checker.longest):
            if a == b:
                continue
            if part and (len(part) == checker.batch or held + b - a > checker.most):
                yield part
                part, held = [], 0
            part.append((row, a, text[a:b]))
            held += b - a
    if part:
        yield part


def _checked(texts: list[str | None], checker: Checker, client: Client | None, unreached: str | None, pool: ThreadPoolExecutor) -> list[_Row]:
    rows = [_Row(error=unreached if t else None) for t in texts]
    if client is None:
        return rows
    waiting: deque[Future] = deque()
    for part in _requests(rows, texts, checker):
        if len(waiting) == checker.in_flight:
            waiting.popleft().result()
        waiting.append(pool.submit(_ask, client, part, checker.attempts))
    for future in waiting:
        future.result()
    for row in rows:
        row.matches.sort(key=lambda m: (m["offset"], m["length"] or 0, m["rule_id"] or ""))
        if row.error is not None:
            row.matches = []  # a text is checked whole or not at all
    return rows


def run(blocks: DataFrame, checkers: dict[str, Checker], keys: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """keys, verifier, matches, error, checks (pieces of the text that were sent) and seconds: a row for each block and checker. Null and empty
    texts aren't sent. Where a text or one of its pieces fails, error says why and matches is empty."""
    keys = keys or KEYS
    rows = blocks.select(*keys, F.col(text_col).alias("_text"))
    schema = StructType([*[rows.schema[k] for k in keys], *StructType.fromDDL(f"verifier string, matches array<struct<{MATCH}>>, error string, checks long, seconds double").fields])
    arrow = to_arrow_schema(schema)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clients: dict[str, tuple[Client | None, str | None]] = {}
        with ThreadPoolExecutor(max(c.in_flight for c in checkers.values())) as pool:
            for batch in batches:
                texts = batch.column(len(keys)).to_pylist()
                for name, checker in checkers.items():
                    if name not in clients:
                        try:
                            clients[name] = checker.connect(), None
                        except Exception as error:  # the checker's failure, not the job's
                            clients[name] = None, f"{type(error).__name__}: {error}"
                    done = _checked(texts, checker, *clients[name], pool)
                    made = [[name] * len(done), [r.matches for r in done], [r.error for r in done], [r.checks for r in done], [r.seconds for r in done]]
                    yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *[pa.array(x, f.type) for x, f in zip(made, list(arrow)[len(keys) :], strict=True)]], schema=arrow)

    return rows.mapInArrow(check, schema)


def issues_of(checked: DataFrame, target: str) -> DataFrame:
    """The issues of all checkers' matches, for audit(grammar=...). Checkers share the seq of a block."""
    return grammar.match_issues(checked.select(*KEYS, F.inline("matches")), target)


def failures(checked: DataFrame) -> DataFrame:
    """keys, verifier and error of what could not be checked."""
    return checked.filter("error is not null").drop("matches", "checks", "seconds")


def stats(checked: DataFrame) -> DataFrame:
    """For each verifier: blocks, checks (blocks that were sent, in however many pieces), issues, failures, total and
    average seconds of a check."""
    total, sent = F.sum("seconds"), F.count_if(F.col("checks") > 0)
    return checked.groupBy("verifier").agg(F.count(F.lit(1)).alias("blocks"), sent.alias("checks"), F.sum(F.size("matches")).cast("long").alias("issues"), F.count("error").alias("failures"), total.alias("seconds"), F.coalesce(F.try_divide(total, sent), F.lit(0.0)).alias("average_seconds"))
