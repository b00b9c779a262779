"""What is made once, in slices or not at all gives what it gave before."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veriglot import lexicon
from veriglot.config import AuditConfig
from veriglot.functions import text as T
from veriglot.functions.batches import slices
from veriglot.operators import detect, report
from veriglot.plans import fitted_queries, rule_queries
from veriglot.sources import tables

TEXTS = ["", " ", "a", " a ", " \tab\n", "x" * 19, "x" * 20, "a" + " " * 17 + "b", "a" + " " * 18 + "b", " " * 40, "\n" * 30 + "é", "😀" * 20, None]


@pytest.mark.parametrize("least", [0, 1, 2, 20])
def test_reaches(spark, least):
    t = F.col("text")
    df = spark.createDataFrame([(x,) for x in TEXTS], "text string").select("text", T.reaches(t, least).alias("got"), (F.length(T.strip(t)) >= least).alias("want"))
    assert [r for r in df.collect() if r.got != r.want] == []


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["aa", None, "bb", "c" * 9, "", "d"])], ["id", "text"])
    got = list(slices(iter([batch, batch.slice(0, 0)]), most=4))
    assert [b.num_rows for b in got] == [3, 1, 2, 0]
    assert pa.Table.from_batches(got) == pa.Table.from_batches([batch])


def test_votes_once(spark, monkeypatch):
    """Weights and scores come from the same votes."""
    made = []
    three = detect.three_votes
    monkeypatch.setattr(detect, "three_votes", lambda *a: made.append(1) or three(*a))
    fitted_queries.vote_weighted_measured(spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def test_hints_of_characters(spark):
    t = F.col("text")
    df = spark.createDataFrame([("ij IJ bij",), ("niño ëë",), ("plain",), ("",), ("ÀB",)], "text string").select(*[c.alias(k) for k, c in T.char_hints(t).items()])
    got = [tuple(None if v is None else round(v, 6) for v in r) for r in df.collect()]
    assert got == [(None, round(3 / 9, 6), 0.1), (round(1 / 7, 6), round(2 / 7, 6), None), (None, None, 0.1), (None, None, 0.1), (None, None, None)]


def dealt(df):
    """How many partitions have rows."""
    return df.select(F.spark_partition_id()).distinct().count()


def test_spread_of_one_row_group(spark, tmp_path):
    """A file of one row group is dealt out, though it has more splits than there are cores."""
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        df = spark.read.parquet(str(tmp_path / "t"))
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and dealt(df) == 1
        assert dealt(tables.spread(df)) == spark.sparkContext.defaultParallelism
        assert tables.spread(df).count() == 1000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_parts_are_dealt_out(spark):
    assert dealt(rule_queries.made(spark, "/root/testdata/sf0.001")) > 1


def test_hints_once(spark):
    """Hints beside a detection take its tokens once."""
    df = spark.createDataFrame([("de casa the el",)], "text string").select(detect.hint_alternatives(F.col("text"), F.lit("en"), F.rand(1)).alias("a"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("{4,}") == 1


ODD = ["", " ", None, "ABC ABCé A1b b1 ab é ÿes Ëen foo_bar x-ray él ab‍c KKel Å İJ", "see http://a.example/the and www.x.nl or me@b.example the.com a.net", "the a an the  a\tan end ending ed bed. the", "el la los las a nación ión ado dado la mente", "de het de tie heid lijk vrijheid bij ij IJ Ij iJ iijj", "the  the\n" * 3000, "THE BIG Cat THEM Ñandú ÁÉÍÓ", "٣abc a٣ ² x² Ω \U0001d7d9 \U0001d400b"]


def test_read_once(spark):
    """What is read in one pass, or not squeezed, gives what several passes give."""
    t = F.col("text")
    passes = lambda p: F.regexp_count(t, F.lit(p))
    pairs = {"tokens": (T.detected_tokens(t), T.tokens(T.preprocess(t))), "words": (T.heuristic_words(t), T._cleaned_words(t))}
    for x in lexicon.LANGUAGES:
        phrases, ends = rf"(?U)\b(?:{'|'.join(lexicon.ARTICLES[x])})\s+\w", rf"(?U)(?<=\w)(?:{'|'.join(lexicon.ENDINGS[x])})\b"
        pairs[f"patterns_{x}"] = (T.evidence_patterns(t, x), passes(phrases) + passes(ends) + (passes(r"(?U)\bij\b") if x == "nl" else 0))
        pairs[f"chars_{x}"] = (T.evidence_chars(t, x), passes(lexicon.EVIDENCE_CHARS[x]))
    df = spark.createDataFrame([(x,) for x in ODD], "text string").filter("text is not null")
    wrong = df.select("text", *[(~a.eqNullSafe(b)).alias(k) for k, (a, b) in pairs.items()]).collect()
    assert [(r.text[:40], k) for r in wrong for k in pairs if r[k]] == []


def test_hints_of_every_character(spark):
    """Classes of both cases find what a text in lower case would have."""
    t, low = F.col("text"), F.lower("text")
    df = spark.range(1, 0x2FFF).select(F.lit("A").alias("a"), F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'utf-16be')").alias("c")).select(F.concat("a", "c").alias("text"))
    h = T.char_hints(t)
    want = {"es_chars": F.regexp_count(low, F.lit("[ñáéíóúü]")) > 0, "nl_chars": F.regexp_count(low, F.lit("[ëïöüÿ]|ij")) > 0, "en_ascii": ~low.rlike("[àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ]")}
    assert df.select("text", *[(h[k].isNotNull() != v).alias(k) for k, v in want.items()]).filter(" or ".join(want)).collect() == []


def test_tokens_and_spaces_of_every_character(spark):
    """Tokens of a text in lower case, and spaces that are only trimmed, are those that words and patterns one by one give."""
    texts = spark.range(1, 0xFFFF).filter("id < 55296 or id >= 57344").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'utf-16be')").alias("c")).select(F.explode(F.array(F.concat(F.lit("Ab"), "c", F.lit("cD x é"), "c"), F.concat("c", F.lit("ABC a"), "c", "c", F.lit("b ")))).alias("text"))
    texts = texts.unionByName(spark.createDataFrame([(x,) for x in ODD], "text string").filter("text is not null"))
    t, letter, capital = F.col("text"), f"[{T.LETTERS}]", f"[{T.CAPITALS}]"
    words = F.transform(F.regexp_extract_all(t, F.lit(f"(?<!{letter})(?!{capital}{{4,}}+(?!{letter})){letter}{letter}++"), F.lit(0)), F.lower)
    spaces = F.trim(F.regexp_replace(t, r"(?U)\s{2,}|[\s&&[^ ]]", " "))
    assert texts.filter(~T.tokens(t).eqNullSafe(words) | ~T.squeeze(t).eqNullSafe(spaces)).collect() == []


def test_only_what_is_said(spark):
    """Counts of issues make no snippets or contexts, and count the same issues."""
    blocks = spark.createDataFrame([(1, 0, "De kat zit op de mat en het is niet groot"), (1, 1, "the end of it.and the rest of that")], "page_id long, block_idx int, text string")
    few, all_ = (report.audited(blocks, AuditConfig(), said=said) for said in (report.COUNTED, report.REPORTED))
    assert few.select(F.inline("found")).columns == ["type", "severity"]
    got, want = (sorted(map(tuple, df.select("block_idx", F.inline("found")).select("block_idx", "type", "severity").collect())) for df in (few, all_))
    assert got == want and len(got) > 1
