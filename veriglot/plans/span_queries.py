"""Queries on intervals, whitelisted phrases and whitelists that change."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import AuditConfig
from ..operators import intervals, report, whitelist
from . import duck
from .issue_queries import MADE, blocks, made
from .registry import query
from .text_queries import docs, long, table

#: Spans of blocks made of orders: most are short, one in nine is very long, some are empty.
SPAN_ROWS = "SELECT o_orderkey AS id, o_custkey AS span, CAST(o_custkey % 50 AS BIGINT) AS s, CAST(o_custkey % 50 + CASE WHEN o_custkey % 9 = 0 THEN 100000 ELSE o_custkey % 23 END AS BIGINT) AS e FROM orders"
COVERED = f"SELECT m.id, m.seq FROM ({MADE}) m JOIN ({SPAN_ROWS}) p ON m.id = p.id AND p.s <= m.s AND m.e <= p.e AND m.s < m.e"


def spans(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(SPAN_ROWS)


@query("interval_overlaps", f"SELECT m.id, m.seq, p.span, greatest(m.s, p.s) AS a, least(m.e, p.e) AS b FROM ({MADE}) m JOIN ({SPAN_ROWS}) p ON m.id = p.id AND m.s < p.e AND p.s < m.e AND m.s < m.e AND p.s < p.e")
def interval_overlaps(spark, sf_dir):
    met = intervals.overlaps(made(spark, sf_dir), spans(spark, sf_dir), ["id"])
    return met.select(F.col("left_row.id").alias("id"), F.col("left_row.seq").alias("seq"), F.col("right_row.span").alias("span"), F.col("from").alias("a"), F.col("to").alias("b"))


@query("issues_outside_spans", f"SELECT id, seq, s, e FROM ({MADE}) o WHERE NOT EXISTS (SELECT 1 FROM ({COVERED}) c WHERE c.id = o.id AND c.seq = o.seq)")
def issues_outside_spans(spark, sf_dir):
    left = intervals.outside(made(spark, sf_dir), spans(spark, sf_dir), ["id"], ["id", "seq"])
    return left.select("id", "seq", long("s").alias("s"), long("e").alias("e"))


TERMS = ("of the", "de la", "that is", "in", "la de", "with the", "de")
_PATTERN = "(?i)\\b(" + "|".join(sorted(TERMS, key=len, reverse=True)) + ")\\b"
_WORD = r"[\p{L}\p{N}_]"
#: `\\b` knows ASCII only there: a match beside another letter isn't one, and a run of letters is first made ASCII.
_PLAIN = f"SELECT doc_id, text AS whole, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') AS text FROM documents"


@query("whitelisted_phrases", f"SELECT doc_id, s, e, substring(whole, s + 1, e - s) AS v FROM ({duck.find(_PLAIN, 'doc_id, whole', 'text', _PATTERN)})")
def whitelisted_phrases(spark, sf_dir):
    """Places of terms of one word and of several; other characters than ASCII in the documents are letters."""
    found = whitelist.with_phrases(docs(spark, sf_dir), TERMS)
    return found.select("doc_id", F.inline("phrases")).select("doc_id", long("s").alias("s"), long("e").alias("e"), "v")


@query("audit_with_phrases")
def audit_with_phrases(spark, sf_dir):
    """The whole audit with a whitelist of words and phrases."""
    return report.audit(blocks(spark, sf_dir), AuditConfig(target="en", whitelist=TERMS)).drop("seq")


LOG = "SELECT concat(CASE WHEN l_partkey % 2 = 0 THEN 'Term ' ELSE 'term  ' END, l_suppkey) AS term, CASE l_partkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'es' END AS lang, CASE WHEN l_quantity % 3 = 0 THEN 'remove' ELSE 'add' END AS op, CAST(l_orderkey AS BIGINT) AS version, CAST(l_linenumber AS BIGINT) AS seq FROM lineitem"
LOW = f"SELECT lower(regexp_replace(term, ' +', ' ')) AS term, lang, op, version, seq FROM ({LOG})"


def log(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(LOG)


def listed_sql(most: str) -> str:
    return f"SELECT term, lang FROM (SELECT term, lang, arg_max(op, struct_pack(v := version, q := seq, r := (op = 'remove')::INT)) AS op FROM ({LOW}) WHERE {most} GROUP BY term, lang) WHERE op = 'add'"


@query("whitelist_as_of", f"SELECT 'early' AS at, * FROM ({listed_sql('version <= 3000')}) UNION ALL SELECT 'now', * FROM ({listed_sql('TRUE')})")
def whitelist_as_of(spark, sf_dir):
    changes = log(spark, sf_dir)
    early = whitelist.as_of(changes, 3000).select(F.lit("early").alias("at"), "term", "lang")
    return early.unionAll(whitelist.as_of(changes).select(F.lit("now").alias("at"), "term", "lang"))


@query("whitelist_history", f"""WITH t AS (SELECT *, lag(op) OVER w AS before FROM ({LOW}) WINDOW w AS (PARTITION BY term, lang ORDER BY version, seq, (op = 'remove')::INT)),
    k AS (SELECT *, lead(version) OVER (PARTITION BY term, lang ORDER BY version, seq, (op = 'remove')::INT) AS until FROM t WHERE op IS DISTINCT FROM before AND NOT (before IS NULL AND op = 'remove'))
    SELECT term, lang, version AS since, coalesce(until, -1) AS until FROM k WHERE op = 'add' AND (until IS NULL OR until > version)""")
def whitelist_history(spark, sf_dir):
    """Until -1: still listed."""
    return whitelist.history(log(spark, sf_dir)).withColumn("until", F.coalesce("until", F.lit(-1).cast("long")))


@query("whitelist_membership", f"SELECT s_suppkey, lang, EXISTS (SELECT 1 FROM ({listed_sql('TRUE')}) k WHERE k.term = concat('term ', s_suppkey) AND (k.lang IS NULL OR k.lang = a.lang)) AS listed FROM (SELECT s_suppkey, unnest(['en', 'es', 'nl']) AS lang FROM supplier) a")
def whitelist_membership(spark, sf_dir):
    asked = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Term "), F.col("s_suppkey").cast("string")).alias("term"), F.explode(F.array(*map(F.lit, ("en", "es", "nl")))).alias("lang"))
    return whitelist.is_listed(asked, whitelist.as_of(log(spark, sf_dir))).select("s_suppkey", "lang", "listed")
