"""Issues from the matches of an external grammar checker, and texts cut for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon
from ..functions import text as T


def issue_type(category: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in lexicon.GRAMMAR_TYPES.items() for x in p])[category], F.lit("grammar"))


def severity(category: Column, priority: Column) -> Column:
    """By category; for others by the checker's own priority."""
    own = F.when(priority >= 100, "error").when(priority >= 50, "warning").otherwise("info")
    return F.when(category == "TYPOS", "error").when(category.isin("GRAMMAR", "PUNCTUATION", "CASING"), "warning").when(category.isin("STYLE", "TYPOGRAPHY", "REPETITION", "REDUNDANCY"), "info").otherwise(own)


def confidence(category: Column, match: Column) -> Column:
    """A base by category, averaged with the match's own confidence where it has one."""
    base = F.when(category == "TYPOS", 0.9).when(category.isin("STYLE", "TYPOGRAPHY"), 0.6).otherwise(0.8)
    return F.least(F.lit(1.0), F.when(match.isNull(), base).otherwise((base + match) / 2))


def code(lang: str) -> str:
    """The code that a checker calls a target language by."""
    return lexicon.GRAMMAR_CODES[lang]


def match_issues(matches: DataFrame, target: str) -> DataFrame:
    """Issues of a checker's matches, for audit(grammar=...): page_id, block_idx, seq and the columns of the rules'
    issues. matches: page_id, block_idx, offset, length, category, rule_id, message, replacements, and priority and
    confidence where there are any. The first replacement is the suggestion. What a match leaves out is category MISC,
    rule UNKNOWN_RULE, offset 0, length 1; severity follows later from the type, as for all rules, own_severity is the
    checker's. seq counts a block's matches by place and rule."""
    code(target)
    c = F.coalesce("category", F.lit("MISC"))
    own = lambda name, kind, other=None: F.col(name).cast(kind) if name in matches.columns else F.lit(other).cast(kind)
    s = F.coalesce(own("offset", "int"), F.lit(0))
    e = s + F.coalesce(own("length", "int"), F.lit(1))
    rule, said = F.coalesce(own("rule_id", "string"), F.lit("UNKNOWN_RULE")), F.coalesce(own("message", "string"), F.lit("Grammar issue"))
    suggestion = F.get("replacements", F.lit(0)) if "replacements" in matches.columns else F.lit(None).cast("string")
    made = matches.select("page_id", "block_idx", F.lit("languagetool").alias("source"), issue_type(c).alias("type"), rule.alias("rule_id"), said.alias("message"), suggestion.alias("suggestion"), s.alias("s"), e.alias("e"), confidence(c, own("confidence", "double")).cast("double").alias("confidence"), severity(c, F.coalesce(own("priority", "int"), F.lit(0))).alias("own_severity"))
    order = Window.partitionBy("page_id", "block_idx").orderBy("s", "e", "rule_id", "message")
    return made.withColumn("seq", F.row_number().over(order) - 1)


def facet(issues: DataFrame, kind: str) -> DataFrame:
    """Only the grammar, spelling or style issues of match_issues()."""
    if kind not in ("grammar", "spelling", "style"):
        raise ValueError(f"no such facet: {kind}")
    return issues.filter(F.col("type") == kind)


def match_stats(issues: DataFrame) -> DataFrame:
    """Per type and the checker's severity: issues, rules and mean confidence."""
    return issues.groupBy("type", "own_severity").agg(F.count(F.lit(1)).alias("issues"), F.count_distinct("rule_id").alias("rules"), F.avg("confidence").alias("confidence"))


#: A sentence with its closing signs and the white space behind it, or what is left.
SENTENCE = r"(?U)[^.!?]*[.!?]+\s*|[^.!?]+$"


def sentences(t: Column) -> Column:
    """Sentences with their closing signs, stripped; what has no closing sign comes last."""
    return F.filter(F.transform(F.regexp_extract_all(t, F.lit(SENTENCE), F.lit(0)), T.strip), lambda s: s != "")


def chunks(t: Column, longest: int = 20_000) -> Column:
    """array<struct<start, text>>: successive sentences while they fit, as the part of the text from the first one's begin to
    the last one's end, so that a place in a chunk is its start further in the text, whatever white space lies between
    sentences. A sentence that is longer is a chunk by itself. A text that fits is one chunk as it is; null gives null."""
    span = "struct<start: int, stop: int>"
    start = F.struct(F.expr(f"cast(array() as array<{span}>)").alias("out"), F.lit(0).alias("at"), F.lit(None).cast(span).alias("held"))

    def step(acc: Column, s: Column) -> Column:
        def found(bare: Column) -> Column:
            begin = acc["at"] + F.position(bare, s) - 1
            stop = begin + F.length(bare)
            fits = acc["held"].isNull() | (stop - acc["held"]["start"] <= longest)
            own = F.struct(F.when(fits, F.coalesce(acc["held"]["start"], begin)).otherwise(begin).alias("start"), stop.alias("stop"))
            out = F.when(fits, acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["held"])))
            blank = F.length(bare) == 0
            return F.struct(F.when(blank, acc["out"]).otherwise(out).alias("out"), (acc["at"] + F.length(s)).alias("at"), F.when(blank, acc["held"]).otherwise(own).alias("held"))

        return T.bind(T.strip(s), found)

    last = lambda acc: F.when(acc["held"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["held"])))
    # a text that doesn't fit is cut into its sentences with the white space around them, which leaves nothing out
    whole = F.regexp_extract_all(t, F.lit(SENTENCE), F.lit(0))
    spans = F.aggregate(whole, start, step, last)
    cut = F.transform(spans, lambda p: F.struct(p["start"].alias("start"), F.substring(t, p["start"] + 1, p["stop"] - p["start"]).alias("text")))
    return F.when(F.length(t) <= longest, F.array(F.struct(F.lit(0).alias("start"), t.alias("text")))).when(t.isNotNull(), cut)
