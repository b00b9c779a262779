"""The sink of one ordered file, and the reports that it writes."""

import csv
import html
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veriglot.config import AuditConfig
from veriglot.operators import report
from veriglot.plans import issue_queries
from veriglot.sources import html as pages
from veriglot.sources import sink

SF = "/root/testdata/sf0.001"


def test_many_tasks_one_file_in_order(spark, tmp_path):
    n, out = 50_000, tmp_path / "a.txt"
    lines = spark.range(n).select((F.lit(n - 1) - F.col("id")).alias("k"), F.concat(F.lit("ü"), F.lit(n - 1) - F.col("id")).alias("value")).repartition(7)
    sink.write_ordered(lines, str(out))
    assert out.read_text(encoding="utf-8").split("\n") == [f"ü{i}" for i in range(n)] + [""]
    sink.write_ordered(lines.filter("k < 3"), out.as_uri())
    assert out.read_text(encoding="utf-8") == "ü0\nü1\nü2\n" and [p.name for p in tmp_path.iterdir()] == ["a.txt"]


def test_keys_of_several_columns_nulls_and_ties(spark, tmp_path):
    rows = [(2, "b", "x"), (None, "z", "first"), (1, None, "second"), (1, "a", "third"), (2, "b", "x"), (3, "c", None)]
    sink.write_ordered(spark.createDataFrame(rows, "k int, s string, value string").repartition(3), str(tmp_path / "a"))
    assert (tmp_path / "a").read_text() == "first\nsecond\nthird\nx\nx\n\n"


def test_empty_table_and_refusals(spark, tmp_path):
    empty = spark.createDataFrame([], "k int, value string")
    sink.write_ordered(empty, str(tmp_path / "e"))
    assert (tmp_path / "e").read_text() == ""
    with pytest.raises(Exception, match="string column value"):
        sink.write_ordered(spark.range(3), str(tmp_path / "n"))
    with pytest.raises(Exception, match="is there already"):
        empty.write.format("ordered_file").mode("append").save(str(tmp_path / "e"))
    (tmp_path / "folder").mkdir()
    with pytest.raises(Exception, match="is there already"):
        sink.write_ordered(empty, str(tmp_path / "folder"))


def test_what_fails_leaves_nothing(spark, tmp_path):
    out = tmp_path / "a"
    out.write_text("before")
    lines = spark.range(0, 1000, 1, 4).select(F.col("id").alias("k"), F.when(F.col("id") == 900, F.raise_error(F.lit("a row fails"))).otherwise(F.col("id").cast("string")).alias("value"))
    spark.dataSource.register(sink.OrderedFile)
    with pytest.raises(Exception, match="a row fails"):
        lines.write.format("ordered_file").mode("overwrite").save(str(out))
    unsorted = spark.range(0, 1000, 1, 4).select((-F.col("id")).alias("k"), F.lit("x").alias("value"))
    for wrong in (unsorted, unsorted.sortWithinPartitions("k")):
        with pytest.raises(Exception, match="must be sorted"):
            wrong.write.format("ordered_file").mode("overwrite").save(str(out))
    assert out.read_text() == "before" and [p.name for p in tmp_path.iterdir()] == ["a"]


@pytest.fixture(scope="module")
def checked(spark):
    return report.audited(pages.extract_blocks(issue_queries.pages(spark, SF), carry=("url",)), issue_queries.EN)


def test_html_report(spark, checked, tmp_path):
    report.write_html_report(checked, issue_queries.EN, str(tmp_path / "report.html"))
    lines = (tmp_path / "report.html").read_text(encoding="utf-8").splitlines()
    found = checked.select("page_id", "url", "block_idx", F.inline("found")).orderBy("page_id", "block_idx", "seq").collect()
    urls = {r.page_id: r.url for r in checked.select("page_id", "url").distinct().collect()}
    assert lines[0] == f"{report.HTML_HEAD}<p>{len(urls)} pages, {len(found)} issues</p>" and lines[-1] == "</body></html>"
    heads = [x for x in lines if x.startswith("<h2>")]
    assert [html.unescape(re.match("<h2>(.*?)</h2>", x)[1]) for x in heads] == [urls[p] for p in sorted(urls)]
    per = Counter(r.page_id for r in found)
    assert [int(re.search(r"(\d+) issues", x)[1]) for x in heads] == [per[p] for p in sorted(urls)]
    issues = [x for x in lines if x.startswith("<div")]
    assert [html.unescape(re.search("<code>(.*)</code>", x)[1]) for x in issues] == [re.sub("[\r\n]+", " ", r.snippet) for r in found]
    at, want = {x: i for i, x in enumerate(lines)}, [p for p in sorted(urls)]
    for head, after, page in zip(heads, [*heads[1:], lines[-1]], want, strict=True):
        assert at[after] - at[head] - 1 == per[page]


def test_markup_in_texts_is_escaped(spark):
    blocks = spark.createDataFrame([(1, 0, 'the cat,and the dog are <b class="x">good</b> & fine.\nSo it is', "http://a/<i>")], "page_id long, block_idx int, text string, url string")
    rows = [r.value for r in report.html_lines(report.audited(blocks, AuditConfig()), AuditConfig()).orderBy("at", "page_id", "block_idx", "seq").collect()]
    assert "http://a/&lt;i&gt;" in rows[1] and len(rows) > 3
    for row in rows[2:-1]:
        assert re.fullmatch(r"<div class='\w+'><b>\w+</b> \(\w+\) [^<>\"\n]* <code>[^<>\"\n]*</code>( <i>[^<>\"\n]*</i>)?</div>", row), row


def test_csv_of_one_file(spark, checked, tmp_path):
    found = checked.select("page_id", "url", "block_idx", "xpath", F.inline("found"))
    odd = found.limit(1).select("*").withColumns({"page_id": F.lit(-1).cast("long"), "message": F.lit('say "no", \\"twice\\"\nand go')})
    rows = found.unionByName(odd)
    sink.write_ordered(report.csv_lines(rows, "en"), str(tmp_path / "r.csv"))
    with open(tmp_path / "r.csv", newline="", encoding="utf-8") as f:
        read = list(csv.DictReader(f))
    want = rows.orderBy("page_id", "block_idx", "seq").collect()
    assert list(read[0]) == report.CSV_COLUMNS and len(read) == len(want)
    assert [(r["url"], r["message"], r["snippet"], r["xpath"]) for r in read] == [(w.url, w.message, w.snippet, w.xpath) for w in want]
