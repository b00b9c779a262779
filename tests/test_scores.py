"""Running scores of blocks that arrive over time against the batch and a recount in Python."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veriglot.config import AuditConfig
from veriglot.operators import report
from veriglot.plans import issue_queries
from veriglot.plans.queries import QUERIES
from veriglot.plans.surface_queries import turns
from veriglot.streaming import scores

SF = "/root/testdata/sf0.001"
EN = issue_queries.EN
BLOCK = "page_id long, block_idx int, text string, version long"


@pytest.fixture(scope="module")
def rocks(spark):
    pytest.importorskip("google.protobuf", reason="transformWithState talks to its state in protobuf")
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, scores.ROCKSDB)
    yield spark
    spark.conf.unset(key)


def stream(spark, tmp_path, batches, quiet=None, late="0 seconds"):
    """Runs each batch by itself, going on from what the one before left; gives all rows written."""
    folder = str(tmp_path / "in")
    for df in batches:
        df.coalesce(1).write.mode("append").parquet(folder)
        arriving = spark.readStream.schema(df.schema).parquet(folder)
        assert scores.scores_stream(arriving, EN, str(tmp_path / "out"), str(tmp_path / "cp"), quiet, late).awaitTermination(180)
    return spark.read.parquet(str(tmp_path / "out"))


def plain(df):
    return sorted(str(r.asDict()) for r in df.select("page_id", "version", *scores.COUNTS, F.round("overall_score", 9).alias("s"), F.round("language_purity", 9).alias("p")).collect())


def test_batch_equals_score_pages(spark):
    want = {r.page_id: r for r in report.score_pages(report.audited(turns(spark, SF), EN), EN).collect()}
    got = QUERIES["conversation_scores"](spark, SF).collect()
    assert {r.page_id for r in got} == set(want)
    for r in got:
        for c in scores.COUNTS:
            assert r[c] == want[r.page_id][c]
        assert r.overall_score == pytest.approx(want[r.page_id].overall_score, abs=1e-6) and r.language_purity == pytest.approx(want[r.page_id].language_purity, abs=1e-6)


def test_stream_equals_batch_however_it_is_cut(rocks, tmp_path):
    every = turns(rocks, SF).withColumn("version", F.lit(None).cast("long"))
    cut = [every.filter(f"(page_id * 7 + block_idx * 3) % 3 = {i}") for i in range(3)]
    found = stream(rocks, tmp_path, [*cut, cut[0]])  # a batch that comes twice adds nothing
    assert plain(scores.latest(found)) == plain(scores.scores(every, EN))
    assert found.select("batch").distinct().count() == 4


def test_versions_replace(rocks, tmp_path):
    good, bad, spaced = "the cat sat on the mat and it was good and fine", "the cat sat on the mat,and it was good  and fine", "the cat sat on the mat  and it was good and fine"
    rows = [[(1, 0, bad, 1), (1, 1, bad, 1), (2, 0, good, None), (None, 0, bad, 1), (3, None, bad, 1)], [(1, 0, good, 2), (1, 1, bad, 1), (2, 0, spaced, 0), (2, 0, good, 0)], [(1, 5, bad, 1), (4, 0, None, 1), (4, 1, " ", 1)]]
    made = [rocks.createDataFrame(r, BLOCK) for r in rows]
    found = stream(rocks, tmp_path, made)
    last = {r.page_id: r for r in scores.latest(found).collect()}
    assert set(last) == {1, 2}
    assert (last[1].version, last[1].total_blocks, last[1].issues) == (2, 1, 0) and last[1].overall_score == 1.0
    assert (last[2].version, last[2].total_blocks) == (0, 1) and last[2].issues > 0  # of equal versions the greater counts
    whole = made[0].unionAll(made[1]).unionAll(made[2])
    assert plain(scores.latest(found)) == plain(scores.scores(whole, EN))


def test_quiet_pages_become_final(rocks, tmp_path):
    day = datetime(2024, 5, 1, 12)
    text = "the cat sat on the mat,and it was good and fine"
    at = lambda rows: rocks.createDataFrame([(p, i, text, day + timedelta(minutes=m)) for p, i, m in rows], "page_id long, block_idx int, text string, ts timestamp")
    found = stream(rocks, tmp_path, [at([(1, 0, 0), (2, 0, 0)]), at([(2, 1, 25)]), at([(3, 0, 45)]), at([(3, 1, 46)])], timedelta(minutes=30))
    final = {r.page_id: r.total_blocks for r in found.filter("final").collect()}
    assert final == {1: 1}
    running = {r.page_id: r.total_blocks for r in found.filter("not final").groupBy("page_id").agg(F.max("total_blocks").alias("total_blocks")).collect()}
    assert running == {1: 1, 2: 2, 3: 2}  # the row of minute 25 put page 2's end off


def test_empty_batch_and_settings(spark):
    assert scores.scores(spark.createDataFrame([], BLOCK), AuditConfig()).count() == 0
