"""HTML extraction, line-based sources, fetching, sinks and streams."""

import pytest

from veriglot.config import AuditConfig
from veriglot.operators import report
from veriglot.sources import html, tables
from veriglot.streaming import audit

PAGE = """<html lang="es"><head><title>A &amp; B</title><meta name="description" content="about"><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Link to x</a></li></ul></nav>
<div style="display: none">hidden text here</div><h1>A heading here</h1><p id="p1">First <b>bold</b> paragraph<!-- a comment --> text.<p>Second paragraph nested<br></p><p aria-hidden="true">not this one</p><img src="i.png" alt="An image"></body></html>"""


def test_blocks():
    found = [(b[3], b[5], b[1]) for b in html.page_blocks(PAGE)]
    assert found == [("h1", "heading", "A heading here"), ("p", "paragraph", "First bold paragraph a comment text. Second paragraph nested")]
    offsets = [(b[6], b[7]) for b in html.page_blocks(PAGE)]
    joined = "\n\n".join(b[1] for b in html.page_blocks(PAGE))
    assert [joined[a:b] for a, b in offsets] == [b[1] for b in html.page_blocks(PAGE)]
    assert html.page_blocks(PAGE)[1][2] == "/html/html/body/p[@id='p1']" and html.page_blocks(PAGE)[1][4] == [("id", "p1")]
    assert html.page_meta(PAGE) == ("A & B", "about", "es") and html.page_links(PAGE)[0][:2] == ("/x", "Link to x") and html.page_images(PAGE)[0][:2] == ("i.png", "An image")
    assert html.page_blocks(None) == [] and html.page_meta("") == (None, None, None)


def test_generators(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "v", None), (3, "w", "")], "page_id long, url string, html string")
    assert html.extract_blocks(pages).count() == 2 and html.extract_meta(pages).count() == 3 and html.extract_links(pages).count() == 1 and html.extract_images(pages).count() == 1
    assert html.extract_blocks(pages.limit(0)).count() == 0


def test_lists(spark, tmp_path):
    (tmp_path / "u.txt").write_text("# urls\nhttps://a.example/x\n\n  https://b.example \n")
    assert [r.url for r in tables.url_list(spark, str(tmp_path / "u.txt")).collect()] == ["https://a.example/x", "https://b.example"]
    (tmp_path / "w.txt").write_text("# terms\nGoogle\nhola:es\n")
    assert {(r.term, r.lang) for r in tables.whitelist(spark, str(tmp_path / "w.txt")).collect()} == {("google", None), ("hola", "es")}


def test_fetch(spark):
    def get(url):
        if "bad" in url:
            error = OSError("gone")
            error.status = 404
            raise error
        return {"content": "<p>" + url, "status": 200}

    got = {r.url: (r.status, r.error) for r in tables.fetch(spark.createDataFrame([("x",), ("bad",)], "url string"), get).collect()}
    assert got["x"] == (200, None) and "gone" in got["bad"][1]
    waits, tries = [], []

    def flaky(url):
        tries.append(url)
        raise OSError("later")

    with pytest.raises(tables.FetchError):
        tables.get_with_retries(flaky, "u", sleep=waits.append)
    assert waits == [1, 2, 3] and len(tries) == 4
    assert {r.component for r in tables.capabilities(spark).filter("available").collect()} >= {"html", "native", "placeholder", "heuristic"}


def test_sinks(spark, tmp_path):
    blocks = spark.createDataFrame([(1, 0, "the cat sat on the mat,and it was good")], "page_id long, block_idx int, text string")
    found = report.audit(blocks, AuditConfig())
    from pyspark.sql import functions as F

    rows = report.csv_rows(found.withColumns({"url": F.lit("u"), "xpath": F.lit("/")}), "en")
    report.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == report.CSV_COLUMNS
    report.write_json(found, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == found.count() > 0
    report.write_html(report.page_stats(blocks, found, AuditConfig()), str(tmp_path / "h"))
    assert "<td>1</td>" in "".join(r.value for r in spark.read.text(str(tmp_path / "h")).collect())


def test_streams(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>the cat sat on the mat,and it was good and fine</p>")], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "in"))
    query = audit.audit_stream(audit.page_stream(spark, str(tmp_path / "in")), AuditConfig(), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert query.awaitTermination(120)
    assert {r.rule_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} >= {"MISSING_SPACE_AFTER_PUNCT"}
    events = spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").parquet("/root/testdata/sf0.001/events.parquet*")
    for name, df in (("w", audit.event_counts(events, "1 hour", "30 minutes")), ("s", audit.user_sessions(events))):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        assert query.awaitTermination(120) and spark.table(name).count() > 0
