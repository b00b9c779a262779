"""Queries on sets of issues, page statistics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicon
from ..config import AuditConfig
from ..functions import text as T
from ..operators import heuristics, issues, report
from ..sources import html
from . import duck
from .registry import query
from .text_queries import docs, lines, long, pages, table, text

EN = AuditConfig(target="en")
#: Audits of real pages read all of every block, however long or nested: most of their text is in blocks of over 1,000.
WHOLE = AuditConfig(target="en", max_verify_chars=0, max_detect_chars=0, max_nesting=0)

# issues of a checker, made of lineitem: two verifiers often say the same of one place

MADE = """SELECT l_orderkey AS id, CAST(l_linenumber * 1000000 + l_partkey AS BIGINT) AS seq, CASE l_suppkey % 3 WHEN 0 THEN 'languagetool' WHEN 1 THEN 'placeholder' ELSE 'heuristic' END AS source,
    CASE l_partkey % 3 WHEN 0 THEN 'punctuation' WHEN 1 THEN 'spelling' ELSE 'style' END AS type, CASE WHEN l_suppkey % 5 = 0 THEN 'RULE_A' WHEN l_suppkey % 5 = 1 THEN 'RULE_B' ELSE 'RULE_C' END AS rule_id,
    CASE l_linenumber % 2 WHEN 0 THEN 'Same Place' ELSE 'same place' END AS message, concat('fix ', l_suppkey % 4) AS suggestion, CAST(l_quantity AS BIGINT) % 7 * 9 AS s, CAST(l_quantity AS BIGINT) % 7 * 9 + 4 + CAST(l_quantity AS BIGINT) % 3 * 6 AS e, CAST(l_quantity AS BIGINT) % 4 / 4.0 AS confidence FROM lineitem"""


def made(spark, sf_dir) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    df = spark.sql(MADE)
    return df.withColumns({"confidence": F.col("confidence").cast("double")})


def flat(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).withColumns({c: long(c) for c in ("s", "e", "seq") if c in columns})


@query("rule_filter", f"SELECT id, seq, rule_id FROM ({MADE}) WHERE rule_id <> 'RULE_A' AND rule_id IN ('RULE_A', 'RULE_B')")
def rule_filter(spark, sf_dir):
    return flat(made(spark, sf_dir).filter(issues.allowed(F.col("rule_id"), ("RULE_A",), ("RULE_A", "RULE_B"))), "id", "seq", "rule_id")


KINDS = f"CASE type {' '.join(f'WHEN {duck.quoted(k)} THEN {duck.quoted(v)}' for k, v in lexicon.SEVERITY.items())} ELSE 'warning' END"


@query("severity_effective", f"SELECT id, seq, CASE WHEN rule_id = 'RULE_B' THEN 'critical' WHEN type = 'style' THEN 'warning' ELSE {KINDS} END AS severity FROM ({MADE})")
def severity_effective(spark, sf_dir):
    return flat(made(spark, sf_dir).withColumn("severity", issues.severity(F.col("type"), F.col("rule_id"), {"RULE_B": "critical", "style": "warning"})), "id", "seq", "severity")


PRIORITY = f"CASE source {' '.join(f'WHEN {duck.quoted(k)} THEN {v}' for k, v in lexicon.VERIFIER_PRIORITY.items())} ELSE {lexicon.DEFAULT_PRIORITY} END"
DEDUP = f"""SELECT id, s, e, type, arg_max(struct_pack(seq, source, rule_id, message, suggestion, confidence), struct_pack(c := confidence, p := {PRIORITY}, q := -seq)) AS b, list_sort(list_distinct(list(suggestion))) AS a FROM ({MADE}) GROUP BY id, s, e, type, lower(message)"""
DEDUPED = f"SELECT id, s, e, type, b.seq AS seq, b.source AS source, b.rule_id AS rule_id, b.message AS message, CASE WHEN len(a) > 1 THEN array_to_string(a, '; ') ELSE b.suggestion END AS suggestion, b.confidence AS confidence FROM ({DEDUP})"


@query("issues_dedup", f"SELECT id, s, e, type, seq, source, message, suggestion, confidence::DOUBLE AS confidence FROM ({DEDUPED})")
def issues_dedup(spark, sf_dir):
    return flat(issues.dedup(made(spark, sf_dir), ["id"]), "id", "s", "e", "type", "seq", "source", "message", "suggestion", "confidence")


@query("issues_merge", f"""WITH f AS (SELECT *, coalesce(s <= lag(e) OVER w AND type = lag(type) OVER w AND s - lag(s) OVER w < 50, FALSE) AS goes FROM ({DEDUPED}) WINDOW w AS (PARTITION BY id ORDER BY s, e, seq)),
    c AS (SELECT *, sum((NOT goes)::INT) OVER (PARTITION BY id ORDER BY s, e, seq) AS chain FROM f)
    SELECT id, min(s) AS s, max(e) AS e, type, count(*) AS n_merged, arg_max(source, struct_pack(c := confidence, q := -seq)) AS source, CASE WHEN count(DISTINCT message) > 1 THEN 'Multiple issues: ' || array_to_string(list_sort(list_distinct(list(message))), '; ') ELSE any_value(message) END AS message,
        CASE WHEN count(*) > 1 THEN array_to_string(list_sort(list_distinct(list(suggestion))), '; ') ELSE any_value(suggestion) END AS suggestion FROM c GROUP BY id, chain, type""")
def issues_merge(spark, sf_dir):
    merged = issues.merge(issues.dedup(made(spark, sf_dir), ["id"]), ["id"])
    return flat(merged, "id", "s", "e", "type", "n_merged", "source", "message", "suggestion")


@query("issues_union", f"SELECT source, type, count(*) AS n, round(avg(confidence), 6) AS confidence FROM ({MADE}) GROUP BY source, type")
def issues_union(spark, sf_dir):
    """The verifiers' issues as one set, counted by source and type."""
    df = made(spark, sf_dir)
    parts = [df.filter(F.col("source") == s) for s in lexicon.VERIFIER_PRIORITY]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("source", "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("verifier_stats", f"SELECT source, count(*) AS issues, count(DISTINCT id) AS blocks FROM ({MADE}) GROUP BY source")
def verifier_stats(spark, sf_dir):
    return made(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("issues"), F.count_distinct("id").alias("blocks"))


@query("issues_by_facet", f"SELECT CASE type WHEN 'spelling' THEN 'spelling' WHEN 'style' THEN 'style' ELSE 'grammar' END AS facet, count(*) AS n FROM ({DEDUPED}) GROUP BY facet")
def issues_by_facet(spark, sf_dir):
    facet = F.when(F.col("type").isin("spelling", "style"), F.col("type")).otherwise("grammar")
    return issues.dedup(made(spark, sf_dir), ["id"]).groupBy(facet.alias("facet")).agg(F.count(F.lit(1)).alias("n"))


CAPS = duck.find("SELECT doc_id, text FROM documents", "doc_id, text", "text", "[.!?,:;][a-zA-Z]")


@query("issue_context", f"SELECT doc_id, s, concat(CASE WHEN a > 0 THEN '...' ELSE '' END, substring(text, a + 1, b - a), CASE WHEN b < length(text) THEN '...' ELSE '' END) AS context FROM (SELECT *, greatest(0, s - 50) AS a, least(length(text), e + 50) AS b FROM ({CAPS}))")
def issue_context(spark, sf_dir):
    found = issues.unnest(docs(spark, sf_dir), heuristics.missing_space(text()), "doc_id", "text")
    return found.select("doc_id", long("s").alias("s"), T.context_window(text(), F.col("s"), F.col("e")).alias("context"))


# documents as pages, their lines as blocks


def blocks(spark, sf_dir) -> DataFrame:
    return lines(spark, sf_dir).withColumnRenamed("doc_id", "page_id")


BLOCKS = f"SELECT doc_id AS page_id, block_idx, text FROM ({duck.LINES})"
DETECTED = duck.detect(BLOCKS, "page_id, block_idx")
GATED = "lang <> 'unknown' AND (lang = 'en' OR lang_confidence < 0.7) AND length(text) < 1000"


@query("verify_eligible", f"SELECT page_id, block_idx FROM ({DETECTED}) WHERE {GATED}")
def verify_eligible(spark, sf_dir):
    return report.detected(blocks(spark, sf_dir)).filter(report.eligible(EN)).select("page_id", long("block_idx").alias("block_idx"))


@query("page_language_tokens", f"SELECT page_id, lang, sum(tokens)::BIGINT AS tokens FROM ({DETECTED}) GROUP BY page_id, lang")
def page_language_tokens(spark, sf_dir):
    return report.page_languages(blocks(spark, sf_dir)).select("page_id", "lang", "tokens")


@query("page_language_pct", f"SELECT page_id, lang, round(sum(tokens) * 100.0 / sum(sum(tokens)) OVER (PARTITION BY page_id), 6)::DOUBLE AS pct FROM ({DETECTED}) GROUP BY page_id, lang")
def page_language_pct(spark, sf_dir):
    return report.page_languages(blocks(spark, sf_dir)).select("page_id", "lang", F.round("pct", 6).alias("pct"))


@query("language_ranking", f"SELECT page_id, lang, row_number() OVER (PARTITION BY page_id ORDER BY sum(tokens) DESC, lang) AS rank FROM ({DETECTED}) GROUP BY page_id, lang")
def language_ranking(spark, sf_dir):
    return report.page_languages(blocks(spark, sf_dir)).select("page_id", "lang", long("rank").alias("rank"))


LEAKS = f"SELECT page_id, block_idx, 0 AS s, length(text) AS e, lang, lang_confidence AS confidence, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS snippet FROM ({DETECTED}) WHERE lang NOT IN ('en', 'unknown')"


@query("page_language_leaks", f"SELECT page_id, block_idx, lang, round(confidence, 6) AS confidence, snippet FROM ({LEAKS})")
def page_language_leaks(spark, sf_dir):
    found = report.detected(blocks(spark, sf_dir)).filter(~F.col("lang").isin("unknown", "en"))
    snippet = F.when(F.length(text()) > 100, F.concat(F.substring(text(), 1, 100), F.lit("..."))).otherwise(text())
    return found.select("page_id", long("block_idx").alias("block_idx"), "lang", F.round("lang_confidence", 6).alias("confidence"), snippet.alias("snippet"))


#: The basic queries count issues of three kinds, of which SQL can say the numbers too: other languages, missing spaces
#: and several spaces. Those of the same names without `basic` take the whole audit.
FOUND = f"""SELECT page_id, block_idx, 'language_leak' AS type, 'error' AS severity FROM ({LEAKS})
    UNION ALL SELECT page_id, block_idx, 'punctuation', 'warning' FROM ({duck.find(f"SELECT * FROM ({DETECTED}) WHERE {GATED}", 'page_id, block_idx', 'text', '[.!?,:;][a-zA-Z]')})
    UNION ALL SELECT page_id, block_idx, 'punctuation', 'warning' FROM ({duck.find(f"SELECT * FROM ({DETECTED}) WHERE {GATED}", 'page_id, block_idx', 'text', '  +')})"""


def simple(spark, sf_dir) -> DataFrame:
    """Blocks with issues of these three kinds."""
    from ..operators import placeholders

    rules = F.when(report.eligible(EN), F.concat(heuristics.missing_space(text()), placeholders.spaces(text()))).otherwise(issues.none())
    return report.audited(blocks(spark, sf_dir), EN, rules=F.concat(report.block_leak(EN), rules))


def simple_issues(spark, sf_dir) -> DataFrame:
    return simple(spark, sf_dir).select("page_id", "block_idx", F.inline("found"))


@query("basic_issues_by_type", f"SELECT page_id, type, count(*) AS n FROM ({FOUND}) GROUP BY page_id, type")
def basic_issues_by_type(spark, sf_dir):
    return simple_issues(spark, sf_dir).groupBy("page_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query("basic_issues_by_severity", f"SELECT page_id, severity, count(*) AS n FROM ({FOUND}) GROUP BY page_id, severity")
def basic_issues_by_severity(spark, sf_dir):
    return simple_issues(spark, sf_dir).groupBy("page_id", "severity").agg(F.count(F.lit(1)).alias("n"))


STATS = f"""SELECT page_id, total_blocks, total_tokens, total_chars, coalesce(issues, 0) AS issues, 0::BIGINT AS critical, coalesce(error, 0) AS error, coalesce(warning, 0) AS warning,
        greatest(0, 1 - least((coalesce(error, 0) * 0.2::DOUBLE + coalesce(warning, 0) * 0.05::DOUBLE) / greatest(1, total_blocks), 1)) AS overall_score, coalesce(target_tokens / nullif(total_tokens, 0)::DOUBLE, 0) AS language_purity
    FROM (SELECT page_id, count(*) AS total_blocks, sum(tokens)::BIGINT AS total_tokens, (sum(length(text) + 2) - 2)::BIGINT AS total_chars, coalesce(sum(tokens) FILTER (lang = 'en'), 0)::BIGINT AS target_tokens FROM ({DETECTED}) GROUP BY page_id)
    LEFT JOIN (SELECT page_id, count(*) AS issues, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning FROM ({FOUND}) GROUP BY page_id) USING (page_id)"""


def stats(spark, sf_dir) -> DataFrame:
    return report.score_pages(simple(spark, sf_dir), EN)


@query("basic_page_scores", f"SELECT page_id, issues, error, warning, round(overall_score, 6) AS overall_score, round(language_purity, 6) AS language_purity FROM ({STATS})")
def basic_page_scores(spark, sf_dir):
    return stats(spark, sf_dir).select("page_id", "issues", "error", "warning", F.round("overall_score", 6).alias("overall_score"), F.round("language_purity", 6).alias("language_purity"))


@query("page_totals", f"SELECT page_id, total_blocks, total_tokens, total_chars FROM ({STATS})")
def page_totals(spark, sf_dir):
    return stats(spark, sf_dir).select("page_id", "total_blocks", "total_tokens", "total_chars")


@query("basic_batch_summary", f"SELECT count(*) AS total_pages, sum(issues)::BIGINT AS total_issues, sum(critical)::BIGINT AS total_critical, sum(error)::BIGINT AS total_errors, sum(warning)::BIGINT AS total_warnings, round(avg(overall_score), 6) AS average_score FROM ({STATS})")
def basic_batch_summary(spark, sf_dir):
    return report.batch_summary(stats(spark, sf_dir)).withColumn("average_score", F.round("average_score", 6))


@query("basic_worst_pages", f"SELECT page_id, issues, round(overall_score, 6) AS overall_score FROM ({STATS}) ORDER BY issues DESC, overall_score, page_id LIMIT 3")
def basic_worst_pages(spark, sf_dir):
    return report.worst_pages(stats(spark, sf_dir)).select("page_id", "issues", F.round("overall_score", 6).alias("overall_score"))


@query("basic_max_errors_gate", f"SELECT sum(error)::BIGINT AS n_errors, CASE WHEN sum(error) > 10 THEN 2 ELSE 0 END::BIGINT AS exit_code FROM ({STATS})")
def basic_max_errors_gate(spark, sf_dir):
    return report.exit_code(stats(spark, sf_dir), 10).select(long("n_errors").alias("n_errors"), long("exit_code").alias("exit_code"))


@query("basic_csv_rows", f"SELECT concat('doc:', page_id) AS url, 'en' AS target_lang, 'language_leak' AS issue_type, 'error' AS severity, concat('Block is in ', lang) AS message, 'Translate to en' AS suggestion, snippet, concat('/block[', block_idx, ']') AS xpath, round(confidence, 6) AS confidence FROM ({LEAKS})")
def basic_csv_rows(spark, sf_dir):
    found = issues.unnest(report.detected(blocks(spark, sf_dir)), report.block_leak(EN), "page_id", "block_idx", "text").withColumn("severity", issues.severity(F.col("type"), F.col("rule_id")))
    snippet = F.when(F.length(text()) > 100, F.concat(F.substring(text(), 1, 100), F.lit("..."))).otherwise(text())
    found = found.withColumns({"snippet": snippet, "url": F.concat(F.lit("doc:"), F.col("page_id").cast("string")), "xpath": F.concat(F.lit("/block["), F.col("block_idx").cast("string"), F.lit("]")), "confidence": F.round("confidence", 6)})
    return report.csv_rows(found, "en")


ERRORS = "SELECT page_id, CASE WHEN page_id % 10 = 0 THEN '' ELSE html END AS html, CASE WHEN page_id % 7 = 0 THEN 'timeout' END AS error FROM pages"


@query("page_errors", f"SELECT page_id, 'critical' AS severity, concat('Page failed: ', coalesce(error, 'no content')) AS message, '/' AS xpath FROM ({ERRORS}) WHERE error IS NOT NULL OR html = ''")
def page_errors(spark, sf_dir):
    pages(spark, sf_dir).createOrReplaceTempView("pages")
    return report.page_error(spark.sql(ERRORS)).drop("type")


# whole audits: every rule, on documents' lines and on the blocks of real pages


@query("audit_documents")
def audit_documents(spark, sf_dir):
    return report.audit(blocks(spark, sf_dir), EN).drop("seq")


@query("audit_pages")
def audit_pages(spark, sf_dir):
    return report.audit(html.configured_blocks(pages(spark, sf_dir), WHOLE), WHOLE).drop("seq")


@query("audit_page_scores")
def audit_page_scores(spark, sf_dir):
    return report.score_pages(report.audited(html.extract_blocks(pages(spark, sf_dir)), EN), EN)


def whole(spark, sf_dir) -> DataFrame:
    """Documents' lines with type and severity of the issues of all rules."""
    return report.audited(blocks(spark, sf_dir), EN, said=report.COUNTED)


def whole_stats(spark, sf_dir) -> DataFrame:
    return report.score_pages(whole(spark, sf_dir), EN)


@query("issues_by_type")
def issues_by_type(spark, sf_dir):
    return whole(spark, sf_dir).select("page_id", F.inline("found")).groupBy("page_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query("issues_by_severity")
def issues_by_severity(spark, sf_dir):
    return whole(spark, sf_dir).select("page_id", F.inline("found")).groupBy("page_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("issues_by_type_and_severity")
def issues_by_type_and_severity(spark, sf_dir):
    return report.type_by_severity(whole(spark, sf_dir))


@query("basic_issues_by_type_and_severity", f"SELECT CASE grouping(type, severity) WHEN 0 THEN 'type+severity' WHEN 1 THEN 'type' WHEN 2 THEN 'severity' ELSE 'all' END AS level, type, severity, count(*) AS n FROM ({FOUND}) GROUP BY GROUPING SETS ((type, severity), (type), (severity), ())")
def basic_issues_by_type_and_severity(spark, sf_dir):
    return report.type_by_severity(simple(spark, sf_dir))


@query("page_scores")
def page_scores(spark, sf_dir):
    return whole_stats(spark, sf_dir).select("page_id", "issues", "critical", "error", "warning", "info", F.round("overall_score", 6).alias("overall_score"), F.round("language_purity", 6).alias("language_purity"))


@query("batch_summary")
def batch_summary(spark, sf_dir):
    return report.batch_summary(whole_stats(spark, sf_dir)).withColumn("average_score", F.round("average_score", 6))


@query("worst_pages")
def worst_pages(spark, sf_dir):
    return report.worst_pages(whole_stats(spark, sf_dir)).select("page_id", "issues", F.round("overall_score", 6).alias("overall_score"))


@query("max_errors_gate")
def max_errors_gate(spark, sf_dir):
    return report.exit_code(whole_stats(spark, sf_dir), 10).select(long("n_errors").alias("n_errors"), long("exit_code").alias("exit_code"))


@query("csv_export_rows")
def csv_export_rows(spark, sf_dir):
    """Every issue of every rule on real pages, with the page's url and the block's xpath."""
    found = report.audit(html.configured_blocks(pages(spark, sf_dir), WHOLE, ("url",)), WHOLE, carry=("url", "xpath"))
    return report.csv_rows(found.withColumn("confidence", F.round("confidence", 6)), "en")


@query("api_response")
def api_response(spark, sf_dir):
    return report.api_response(report.audited(blocks(spark, sf_dir), EN, said=report.ANSWERED), EN)
