"""Whitelists: phrases found in texts, what they silence, and lists that change over time."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions.batches import slices

SPANS = "array<struct<s: int, e: int, v: string>>"
#: A list is a part of every task: more terms or characters than that are refused.
MOST_TERMS, MOST_CHARS = 100_000, 4_000_000


def lowered(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def checked_terms(terms: tuple[str, ...] | list[str]) -> list[str]:
    """Distinct terms in lower case with single spaces; blank ones go."""
    kept = sorted({lowered(" ".join(t.split())) for t in terms if t and t.strip()})
    if len(kept) > MOST_TERMS or sum(map(len, kept)) > MOST_CHARS:
        raise ValueError(f"a whitelist has {MOST_TERMS} terms and {MOST_CHARS} characters at most")
    return kept


def automaton(terms: list[str]):
    """An Aho-Corasick automaton of the terms."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for t in terms:
        made.add_word(t, len(t))
    made.make_automaton()
    return made


def phrase_places(text: str, found) -> list[tuple[int, int]]:
    """(start, end) of terms that stand as whole words, leftmost first and the longest of those that begin there, none
    inside another. found: an automaton of the terms."""
    low = lowered(text)
    word = lambda i: 0 <= i < len(low) and (low[i].isalnum() or low[i] == "_")
    longest: dict[int, int] = {}
    for last, n in found.iter(low):
        a, b = last + 1 - n, last + 1
        if not (word(a - 1) and word(a)) and not (word(b - 1) and word(b)):
            longest[a] = max(b, longest.get(a, 0))
    out, at = [], 0
    for a in sorted(longest):
        if a >= at:
            out.append((a, longest[a]))
            at = longest[a]
    return out


def with_phrases(blocks: DataFrame, terms: tuple[str, ...] | list[str], text_col: str = "text") -> DataFrame:
    """blocks with phrases (array of s, e, v: places of the terms, whatever their case) and masked (the text with them
    blanked). A term of several words matches them with single spaces between. Null texts have no phrase."""
    kept = checked_terms(terms)
    rows = blocks.select(F.struct(*[F.col(f"`{c}`") for c in blocks.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    spans = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("v", pa.string())]))

    def run(batches):
        found = automaton(kept) if kept else None
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            places = [phrase_places(t, found) if t and found else [] for t in texts]
            masked = [_blanked(t, at) if at else t for t, at in zip(texts, places, strict=True)]
            listed = [[{"s": a, "e": b, "v": t[a:b]} for a, b in at] for t, at in zip(texts, places, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(listed, spans), pa.array(masked, pa.string())], ["row", "phrases", "masked"])

    schema = StructType([rows.schema["row"], *StructType.fromDDL(f"phrases {SPANS}, masked string").fields])
    return rows.mapInArrow(run, schema).select("row.*", "phrases", "masked")


def _blanked(text: str, places: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in places:
        out += [text[at:a], " " * (b - a)]
        at = b
    return "".join(out) + text[at:]


def unsilenced(found: Column, phrases: Column) -> Column:
    """Issues (an array of structs with s and e) that no phrase covers whole."""
    return F.filter(found, lambda i: ~F.exists(phrases, lambda p: (p["s"] <= i["s"]) & (i["e"] <= p["e"])))


def as_of(changes: DataFrame, version: int | None = None) -> DataFrame:
    """term and lang (null: every language) of the list at a version (default: the latest), from a log of changes: term,
    lang, op (add or remove), version. Terms count in lower case; of changes of one version the last in `seq`, if there is
    such a column, holds, else removal."""
    log = changes.filter(F.col("version") <= version) if version is not None else changes
    log = log.withColumn("term", F.lower(T.squeeze(F.col("term"))))
    last = F.struct("version", *([F.col("seq")] if "seq" in changes.columns else []), (F.col("op") == "remove").cast("int").alias("r"))
    return log.groupBy("term", "lang").agg(F.max_by("op", last).alias("op")).filter("op = 'add'").select("term", "lang")


def history(changes: DataFrame) -> DataFrame:
    """term, lang, since and until (null: still): the versions over which each term was listed, compacted: additions of
    what is listed and removals of what isn't change nothing."""
    log = changes.withColumn("term", F.lower(T.squeeze(F.col("term"))))
    order = [F.col("version"), *([F.col("seq")] if "seq" in changes.columns else []), (F.col("op") == "remove").cast("int")]
    of = Window.partitionBy("term", "lang").orderBy(*order)
    turns = log.withColumn("before", F.lag("op").over(of)).filter(~F.col("op").eqNullSafe(F.col("before")) & ~(F.col("before").isNull() & (F.col("op") == "remove")))
    return turns.withColumn("until", F.lead("version").over(of)).filter("op = 'add'").select("term", "lang", F.col("version").alias("since"), "until").filter("until is null or until > since")


def is_listed(terms: DataFrame, listed: DataFrame) -> DataFrame:
    """terms (term, lang) with listed: whether the list holds them for their language or for every one."""
    each = terms.withColumn("_low", F.lower(T.squeeze(F.col("term"))))
    held = listed.groupBy(F.col("term").alias("_low")).agg(F.collect_set(F.coalesce("lang", F.lit("*"))).alias("_langs"))
    joined = each.join(held.hint("merge"), "_low", "left")
    return joined.withColumn("listed", F.coalesce(F.array_contains("_langs", "*") | F.array_contains("_langs", F.col("lang")), F.lit(False))).drop("_low", "_langs")
