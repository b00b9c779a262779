"""The training-data pipeline: each stage's decisions take effect on the documents the next one reads.

language_id drops documents without a letter or without a main language; line_dedup takes out lines that other
documents hold too; near_dedup leaves one document of each group of near copies; secret_scan replaces secrets;
packing puts the tokens of what is left into sequences. A stage returns all columns of its input, whatever their names,
packing the pieces. Rows count one by one where they repeat; no stage looks at more than doc_id, text and, as labels to
learn from, lang. Every stage takes an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriglot.llm import language_id, line_dedup, near_dedup, packing, secrets
from veriglot.llm.common import documents, materialise
from veriglot.llm.queries import tokenizer_file

#: A document stays if one language has this share of its letters.
MAIN_LANGUAGE = 0.5


def _with_text(packed: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of the struct doc with the text replaced and n_chars counted anew."""
    changed = {"text": F.when(F.col("doc.text").isNotNull(), F.col(text)), "n_chars": F.when(F.col("doc.text").isNotNull(), F.length(text).cast("long")).otherwise(F.col("doc.n_chars") if "n_chars" in columns else F.lit(None))}
    return packed.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in columns])


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose main language has at least half of the letters; null, empty and letterless texts go.
    Nothing is taken from lang but labels to learn from, and without any label every document goes."""
    model = language_id.train(docs)
    tagged = language_id.identify_rows(docs, model)
    return tagged.filter((F.col("lang_pred") != "und") & (F.col("score") >= MAIN_LANGUAGE)).select("doc.*")


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out repeated lines; documents stay, if with less text. Null texts stay null; of equal ids each row counts
    as one document with those of the same text."""
    applied = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return _with_text(applied, docs.columns, "kept_text")


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id in each group of near copies, and every document without words or without
    an id. Rows that repeat the kept id all stay."""
    return near_dedup.keep_representatives(docs)


def stage_secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by [secret]; all documents stay. Null texts stay null."""
    return _with_text(secrets.scan_rows(docs, secrets.train(docs)), docs.columns, "redacted")


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset, and their ids. A null or empty text is its end id; repeated
    rows are packed each."""
    tokens = packing.tokenise(docs, tokenizer_file("word_bpe_49k.json"))
    return packing.pack_groups(tokens, *packing.size_of(docs))


STAGES = [("language_id", stage_language_id), ("line_dedup", stage_line_dedup), ("near_dedup", stage_near_dedup), ("secret_scan", stage_secret_scan), ("packing", stage_packing)]
#: SQL can't express the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
