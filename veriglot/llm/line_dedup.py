"""Line dedup with DataFrame functions only.

Line hashes are range-partitioned together with a salt of the document and sorted by document and position inside a
partition; streaming over that order finds each hash's first occurrence and counts its documents. The salt keeps a
line that a third of all documents share from landing in one task. The result is a run-length coded keep bitmap for
each document; texts only meet the bitmaps when apply_bitmaps() is called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, materialise, text_or_empty

MIN_CHARS, MIN_DOCS, SALTS = 40, 5, 32


def _lines(text_col: str) -> Column:
    return F.split(text_or_empty(text_col), "\n", -1)


def _row_key(text_col: str) -> Column:
    return F.xxhash64(text_or_empty(text_col))


def _line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """id, row (hash of the text, for ids that repeat), pos, and a 128-bit hash of each key that is long enough."""
    numbered = F.transform(F.split(ascii_lower(text_or_empty(text_col)), "\n", -1), lambda line, pos: F.struct(pos.alias("pos"), F.btrim(line, F.lit(SPACE)).alias("key")))
    hashed = F.transform(F.filter(numbered, lambda x: F.length(x["key"]) >= min_chars), lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(7919), x["key"]).alias("h2")))
    return docs.select(F.col(id_col).alias("id"), _row_key(text_col).alias("row"), F.inline(hashed))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """id, row, dropped (sorted positions of dropped lines) for each document that loses lines; see bitmap(). A line
    repeated inside one document counts that document once and, where the document is the largest that holds it, all
    its occurrences stay. Null ids are one smallest id. Very long texts are arrays of lines in their row; an empty table
    gives no rows; other columns stay behind."""
    lines = materialise(_line_rows(docs, id_col, text_col, min_chars), "lines")
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("id", "row"), F.lit(SALTS))).repartitionByRange("h1", "h2", "salt")
    order = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc_nulls_last("id"), "row", "pos")
    before = F.lag(F.struct("id", "row")).over(order)
    first = (before.isNull() | ~before.eqNullSafe(F.struct("id", "row"))).cast("long")
    streamed = salted.withColumn("first", first).groupBy("h1", "h2", "salt").agg(F.sum("first").alias("n"), F.max("id").alias("keeper"))
    repeated = streamed.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper")).filter(F.col("n") >= min_docs).drop("n")
    repeated = materialise(repeated, "repeated")  # as a table of its own, so that a hot hash's partition can be split
    lost = lines.join(repeated.hint("merge"), ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("id", "row").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def keep_runs(dropped: Column, n: Column) -> Column:
    """The bitmap's runs of ones: an array of (start, length), from the sorted positions of its zeros."""
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda x: x + 1))
    ends = F.concat(dropped, F.array(n))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (a struct of the input's columns, whatever their names), n_lines, n_dropped, keep_bitmap (runs as
    start+length, comma-joined) and kept_text. Null and empty texts are one empty line."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("doc_key"), _row_key(text_col).alias("doc_row"))
    joined = packed.join(bitmaps.hint("merge"), F.col("doc_key").eqNullSafe(F.col("id")) & (F.col("doc_row") == F.col("row")), "left").withColumn("lines", _lines(f"doc.`{text_col}`"))
    joined = joined.withColumn("runs", keep_runs(F.coalesce("dropped", F.expr("cast(array() as array<int>)")), F.size("lines")))
    kept = F.array_join(F.flatten(F.transform("runs", lambda r: F.slice("lines", r["start"] + 1, r["length"]))), "\n")
    coded = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit("+"), r["length"].cast("string"))), ",")
    return joined.select("doc", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), coded.alias("keep_bitmap"), F.when(F.col("dropped").isNull(), F.array_join("lines", "\n")).otherwise(kept).alias("kept_text"))
