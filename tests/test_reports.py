"""Reports of whole audits against a recount in Python, keys that reach the scan, batches that repeat."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veriglot.config import AuditConfig
from veriglot.operators import report
from veriglot.plans import issue_queries
from veriglot.plans.queries import QUERIES
from veriglot.streaming import audit

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def found(spark):
    return report.audit(issue_queries.blocks(spark, SF), issue_queries.EN).select("page_id", "type", "severity").collect()


@pytest.fixture(scope="module")
def recounted(spark, found):
    """page_id: (issues, critical, error, warning, info, score, purity)."""
    blocks, tokens, own = Counter(), Counter(), Counter()
    for r in report.detected(issue_queries.blocks(spark, SF)).select("page_id", "lang", "tokens").collect():
        blocks[r.page_id] += 1
        tokens[r.page_id] += r.tokens
        own[r.page_id] += r.tokens if r.lang == "en" else 0
    kinds = defaultdict(Counter)
    for r in found:
        kinds[r.page_id][r.severity] += 1
    out = {}
    for page, n in blocks.items():
        k = kinds[page]
        score = max(0.0, 1 - min((k["critical"] * 0.5 + k["error"] * 0.2 + k["warning"] * 0.05) / max(1, n), 1))
        out[page] = (sum(k.values()), k["critical"], k["error"], k["warning"], k["info"], round(score, 6), round(own[page] / tokens[page] if tokens[page] else 0, 6))
    return out


def test_page_scores(spark, recounted):
    got = {r[0]: tuple(r)[1:] for r in QUERIES["page_scores"](spark, SF).collect()}
    assert got.keys() == recounted.keys()
    for page, row in got.items():
        assert row == pytest.approx(recounted[page], abs=2e-6)


def test_batch_reports(spark, recounted):
    every = recounted.values()
    b = QUERIES["batch_summary"](spark, SF).first()
    assert (b.total_pages, b.total_issues, b.total_critical, b.total_errors, b.total_warnings) == (len(every), *(sum(x[i] for x in every) for i in range(4)))
    assert b.average_score == pytest.approx(sum(x[5] for x in every) / len(every), abs=1e-5)
    worst = sorted(recounted, key=lambda p: (-recounted[p][0], recounted[p][5], p))[:3]
    assert [r.page_id for r in QUERIES["worst_pages"](spark, SF).collect()] == worst
    errors = sum(x[1] + x[2] for x in every)
    assert tuple(QUERIES["max_errors_gate"](spark, SF).first()) == (errors, 2 if errors > 10 else 0)


def test_counts(spark, found):
    assert {(r.page_id, r.type): r.n for r in QUERIES["issues_by_type"](spark, SF).collect()} == Counter((r.page_id, r.type) for r in found)
    assert {(r.page_id, r.severity): r.n for r in QUERIES["issues_by_severity"](spark, SF).collect()} == Counter((r.page_id, r.severity) for r in found)
    want = Counter(("type+severity", r.type, r.severity) for r in found) + Counter(("type", r.type, None) for r in found) + Counter(("severity", None, r.severity) for r in found) + Counter(("all", None, None) for r in found)
    df = QUERIES["issues_by_type_and_severity"](spark, SF)
    assert {(r.level, r.type, r.severity): r.n for r in df.collect()} == want and len({k[1] for k in want}) > 3
    assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()


def test_csv_of_real_pages(spark, tmp_path):
    rows = QUERIES["csv_export_rows"](spark, SF)
    assert rows.columns == report.CSV_COLUMNS and "Join" not in rows._jdf.queryExecution().executedPlan().toString()
    report.write_csv(rows, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "c"))
    assert back.count() == QUERIES["audit_pages"](spark, SF).count() > 0
    assert back.filter("url not like 'http%' or xpath not like '/html%'").count() == 0 and back.select("issue_type").distinct().count() >= 2


def test_main_content_by_density(spark):
    """Pages with some prose give the blocks of their article; of the others the document may be the root."""
    told, found = defaultdict(list), defaultdict(list)
    for name, out in (("extract_blocks", told), ("main_content_blocks", found)):
        for r in QUERIES[name](spark, SF).orderBy("page_id", "block_idx").collect():
            out[r.page_id].append(r.text)
    prose = [p for p, blocks in told.items() if sum(map(len, blocks)) >= 200]
    assert len(prose) > len(told) / 2 and [p for p in prose if told[p] != found[p]] == []


def test_keys_reach_the_scan(spark):
    blocks = issue_queries.blocks(spark, SF)
    df = report.audit(blocks, AuditConfig(), only=F.col("page_id") == 5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,5)" in plan
    assert sorted(map(str, df.collect())) == sorted(map(str, report.audit(blocks, AuditConfig()).filter("page_id = 5").collect()))


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    blocks = spark.createDataFrame([(1, 0, "the cat sat on the mat,and it was good and fine")], "page_id long, block_idx int, text string")
    write, out = audit.batch_writer(AuditConfig(), str(tmp_path / "out")), str(tmp_path / "out")
    write(blocks, 0)
    first = sorted(map(str, spark.read.parquet(out).collect()))
    write(blocks, 0)
    assert sorted(map(str, spark.read.parquet(out).collect())) == first and first
    write(blocks.withColumn("page_id", F.lit(2).cast("long")), 1)
    assert spark.read.parquet(out).select("batch").distinct().count() == 2
