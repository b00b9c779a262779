"""Queries that run checkers over blocks. The checkers are sets of patterns, so that SQL can say what they find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checker, grammar, report
from . import duck
from .issue_queries import BLOCKS, EN, blocks
from .registry import query
from .text_queries import docs, long

DIGITS = (("DIGIT_AND_LETTER", "TYPOS", "([0-9])([A-Za-z])", r"\1 \2"), ("LONG_WORD", "STYLE", "[A-Za-z]{14,}", None))
SIGNS = (("DOUBLED_SIGN", "PUNCTUATION", "([,;])[,;]", r"\1"),)
CHECKERS = {
    "digits": checker.Checker(lambda: checker.Patterns(DIGITS, "[|]"), batch=8),
    "signs": checker.Checker(lambda: checker.Patterns(SIGNS), batch=64),
}
#: What `digits` refuses, and what each pattern finds in the other texts.
REFUSED = "contains(text, '|')"
KINDS = {"DIGIT_AND_LETTER": ("spelling", "error"), "LONG_WORD": ("style", "info"), "DOUBLED_SIGN": ("punctuation", "warning")}


def found_sql(source: str, keys: str) -> str:
    parts = []
    for rules, where in ((DIGITS, f"NOT {REFUSED}"), (SIGNS, "TRUE")):
        for rule, _, pattern, to in rules:
            suggestion = "NULL" if to is None else f"regexp_replace(v, {duck.quoted(pattern)}, {duck.quoted(to)})"
            parts.append(f"SELECT {keys}, '{KINDS[rule][0]}' AS type, '{rule}' AS rule_id, s, e, {suggestion} AS suggestion, '{KINDS[rule][1]}' AS severity FROM ({duck.find(f'SELECT * FROM ({source}) WHERE {where}', keys, 'text', pattern)})")
    return " UNION ALL ".join(parts)


def checked(spark, sf_dir) -> DataFrame:
    return checker.run(blocks(spark, sf_dir), CHECKERS)


@query("checker_issues", found_sql(BLOCKS, "page_id, block_idx"))
def checker_issues(spark, sf_dir):
    """Two checkers over all lines, in requests of 8 and 64 texts; a line that one of them refuses costs only itself."""
    found = checker.issues_of(checked(spark, sf_dir), "en")
    return found.select("page_id", long("block_idx").alias("block_idx"), "type", "rule_id", long("s").alias("s"), long("e").alias("e"), "suggestion", F.col("own_severity").alias("severity"))


@query("checker_failures", f"SELECT page_id, block_idx, 'digits' AS verifier, 'ValueError: refused' AS error FROM ({BLOCKS}) WHERE {REFUSED}")
def checker_failures(spark, sf_dir):
    return checker.failures(checked(spark, sf_dir)).select("page_id", long("block_idx").alias("block_idx"), "verifier", "error")


@query("checker_stats", f"""WITH f AS ({found_sql(BLOCKS, "page_id, block_idx")}), b AS (SELECT count(*) AS blocks, count(*) FILTER (text <> '') AS checks, count(*) FILTER ({REFUSED}) AS refused FROM ({BLOCKS}))
    SELECT 'digits' AS verifier, blocks, checks, (SELECT count(*) FROM f WHERE rule_id <> 'DOUBLED_SIGN') AS issues, refused AS failures FROM b
    UNION ALL SELECT 'signs', blocks, checks, (SELECT count(*) FROM f WHERE rule_id = 'DOUBLED_SIGN'), 0 FROM b""")
def checker_stats(spark, sf_dir):
    """Checks, issues and failures of each checker; the seconds that stats() has too differ from run to run."""
    return checker.stats(checked(spark, sf_dir)).drop("seconds", "average_seconds")


WHOLE = "SELECT doc_id AS page_id, 0 AS block_idx, text FROM documents"


@query("checker_long_texts", f"SELECT page_id, rule_id, s, e FROM ({found_sql(WHOLE, 'page_id, block_idx')}) WHERE rule_id <> 'DOUBLED_SIGN'".replace(f"NOT {REFUSED}", "TRUE"))
def checker_long_texts(spark, sf_dir):
    """Whole documents as blocks, for a checker that takes 500 code points: pieces end between words, so nothing is lost."""
    whole = docs(spark, sf_dir).select(F.col("doc_id").alias("page_id"), F.lit(0).alias("block_idx"), "text")
    found = checker.run(whole, {"digits": checker.Checker(lambda: checker.Patterns(DIGITS), longest=500, batch=16)})
    return grammar.match_issues(found.select("page_id", "block_idx", F.inline("matches")), "en").select("page_id", "rule_id", long("s").alias("s"), long("e").alias("e"))


@query("audit_with_checkers")
def audit_with_checkers(spark, sf_dir):
    """The whole audit with both checkers' issues among those of the rules, de-duplicated and merged with them."""
    lines = blocks(spark, sf_dir)
    return report.audit(lines, EN, checker.issues_of(checker.run(lines, CHECKERS), "en")).drop("seq")
