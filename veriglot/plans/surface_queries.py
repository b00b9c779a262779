"""The same work through plain SQL, lines of reports, and scores of blocks that come in versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report, table_functions
from ..sources import html, tables
from ..streaming import scores
from . import fitted_queries, issue_queries, text_queries
from .registry import ORACLE_SQL, query
from .text_queries import pages, table


@query("sql_page_blocks")
def sql_page_blocks(spark, sf_dir):
    """extract_blocks() of all pages, called from SQL."""
    table_functions.register(spark)
    return spark.sql("SELECT * FROM page_blocks(TABLE(SELECT page_id, url, html FROM {pages}))", pages=pages(spark, sf_dir))


def voted(spark, sf_dir, method: str, columns: str):
    table_functions.register(spark)
    votes = text_queries.votes(spark, sf_dir)
    return spark.sql(f"SELECT {columns} FROM vote(TABLE(SELECT * FROM {{votes}}) PARTITION BY id, method => '{method}')", votes=votes)


@query("sql_vote_majority", ORACLE_SQL["vote_majority"])
def sql_vote_majority(spark, sf_dir):
    return voted(spark, sf_dir, "majority", "id, lang, round(confidence, 6) AS confidence")


@query("sql_vote_weighted", ORACLE_SQL["vote_weighted"])
def sql_vote_weighted(spark, sf_dir):
    return voted(spark, sf_dir, "weighted", "id, lang, round(score, 6) AS score")


@query("sql_vote_best_alternatives", ORACLE_SQL["vote_best_alternatives"])
def sql_vote_best_alternatives(spark, sf_dir):
    return voted(spark, sf_dir, "best", "id, alternatives").selectExpr("id", "posexplode(alternatives) AS (p, a)").selectExpr("id", "p + 1L AS rank", "a.lang AS lang", "round(a.confidence, 6) AS confidence")


@query("sql_fitted_detection")
def sql_fitted_detection(spark, sf_dir):
    """Every document's language by the fitted detector, called from SQL."""
    table_functions.register(spark, fitted_queries.model(spark, sf_dir).predict)
    return spark.sql("SELECT doc_id, detected.lang, round(confidence, 6) AS confidence FROM detect_language(TABLE(SELECT doc_id, text FROM {docs})) AS detected", docs=text_queries.docs(spark, sf_dir))


@query("basic_html_sections", f"SELECT page_id, concat('<h2>', page_id, '</h2><p>', total_blocks, ' blocks, ', issues, ' issues, score ', floor(overall_score * 100)::BIGINT, '</p>') AS value FROM ({issue_queries.STATS})")
def basic_html_sections(spark, sf_dir):
    """Headings of the HTML report, on issues of three kinds."""
    return report.html_sections(issue_queries.stats(spark, sf_dir)).select("page_id", "value")


@query("html_report_lines")
def html_report_lines(spark, sf_dir):
    """All lines of the HTML report on real pages."""
    found = report.audited(html.extract_blocks(pages(spark, sf_dir), carry=("url",)), issue_queries.EN)
    return report.html_lines(found, issue_queries.EN)


def turns(spark, sf_dir):
    """Turns of conversations as blocks of pages."""
    return tables.spread(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").cast("int").alias("block_idx"), "text"))


@query("conversation_scores")
def conversation_scores(spark, sf_dir):
    """What the running scores of conversations come to after their last turn."""
    return scores.scores(turns(spark, sf_dir), issue_queries.EN).withColumns({c: F.round(c, 6) for c in ("overall_score", "language_purity")})
