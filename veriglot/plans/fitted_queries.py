"""Queries with the fitted detector, with hints beside detections, and with weights that are measured."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect, fitted
from ..sources import tables
from . import duck
from .registry import query
from .text_queries import DOCS, HINTS, VOTES, docs, scores_sql, table, text, votes


def held_out():
    """A fifth of the documents, by their ids, which the detector never learns from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def model(spark, sf_dir) -> fitted.Fitted:
    return fitted.fit(tables.spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).filter(~held_out()))


@query("fitted_detection")
def fitted_detection(spark, sf_dir):
    """Every document's language by a detector fitted on four fifths of them."""
    found = fitted.label(docs(spark, sf_dir), model(spark, sf_dir), "doc_id")
    return found.select("doc_id", held_out().alias("held_out"), "lang", F.round("confidence", 6).alias("confidence"))


@query("fitted_benchmark")
def fitted_benchmark(spark, sf_dir):
    """Accuracy on the documents that were held out, by language, of the fitted detector and of the stopwords."""
    asked = tables.spread(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("expected")).filter("expected is not null")).filter(held_out())
    own = detect.native(asked).select("doc_id", "expected", F.lit("stopwords").alias("detector"), "lang", F.col("lang_confidence").alias("confidence"))
    learned = fitted.label(asked.select(F.struct("doc_id", "expected").alias("key"), "text"), model(spark, sf_dir), "key").select("key.*", F.lit("fitted").alias("detector"), "lang", "confidence")
    hit = (F.col("lang") == F.col("expected")).cast("int")
    return own.unionAll(learned).groupBy("detector", "expected").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("correct"), F.round(F.avg(hit), 6).alias("accuracy"), F.round(F.avg("confidence"), 6).alias("average_confidence"))


def hinted(found: DataFrame, kind) -> DataFrame:
    return found.select("doc_id", F.inline(kind(text(), F.col("lang"), F.col("lang_confidence")))).select("doc_id", "lang", F.round("confidence", 6).alias("confidence"))


def by_stopwords(spark, sf_dir) -> DataFrame:
    return detect.native(docs(spark, sf_dir))


def by_model(spark, sf_dir) -> DataFrame:
    return detect.model(docs(spark, sf_dir), model(spark, sf_dir).predict)


def others_sql(stop: float, chars: float) -> str:
    """doc_id, main, c, lang, h: for each detected document its other languages and what hints say of them."""
    own = f"SELECT doc_id, lang AS main, lang_confidence AS c FROM ({duck.detect(DOCS, 'doc_id')}) WHERE lang <> 'unknown'"
    each = f"SELECT doc_id, unnest(['es', 'en', 'nl']) AS lang, unnest([h_es, h_en, h_nl]) AS h FROM (SELECT doc_id, {scores_sql(stop, chars)} FROM ({HINTS}))"
    return f"SELECT doc_id, main, c, lang, h FROM ({own}) JOIN ({each}) USING (doc_id) WHERE lang <> main"


@query("hint_alternatives", f"SELECT doc_id, lang, round(least(h, c * 0.8::DOUBLE), 6) AS confidence FROM ({others_sql(0.5, 0.3)}) WHERE c < 0.8::DOUBLE AND h > 0.1::DOUBLE")
def hint_alternatives(spark, sf_dir):
    return hinted(by_stopwords(spark, sf_dir), detect.hint_alternatives)


@query("confidence_distribution", f"SELECT doc_id, main AS lang, round(max(c), 6) AS confidence FROM ({others_sql(0.6, 0.4)}) GROUP BY doc_id, main UNION ALL SELECT doc_id, lang, round(least(h, c * 0.8::DOUBLE), 6) FROM ({others_sql(0.6, 0.4)}) WHERE least(h, c * 0.8::DOUBLE) > 0.1::DOUBLE")
def confidence_distribution(spark, sf_dir):
    return hinted(by_stopwords(spark, sf_dir), detect.hint_distribution)


@query("fitted_alternatives")
def fitted_alternatives(spark, sf_dir):
    return hinted(by_model(spark, sf_dir), detect.hint_alternatives)


@query("fitted_distribution")
def fitted_distribution(spark, sf_dir):
    return hinted(by_model(spark, sf_dir), detect.hint_distribution)


MEASURED = "SELECT detector, count(*) AS votes, avg((votes.lang = d.lang)::INT) AS accuracy FROM votes JOIN documents d ON d.doc_id = votes.id WHERE d.lang IS NOT NULL GROUP BY detector"


def measured(spark, sf_dir, cast: DataFrame | None = None) -> DataFrame:
    labels = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("expected"))
    return detect.measured_weights((votes(spark, sf_dir) if cast is None else cast).join(labels.hint("merge"), "id"))


@query("detector_weights", f"{VOTES}, m AS ({MEASURED}) SELECT detector, votes, round(accuracy, 6) AS accuracy, round(greatest(0.1::DOUBLE, least(2, accuracy * 2)), 6) AS weight FROM m")
def detector_weights(spark, sf_dir):
    """Each detector's share of right votes, and the weight that it earns."""
    return measured(spark, sf_dir).select("detector", "votes", F.round("accuracy", 6).alias("accuracy"), F.round("weight", 6).alias("weight"))


@query("vote_weighted_measured", f"{VOTES}, m AS ({MEASURED}), earned AS (SELECT detector, greatest(0.1::DOUBLE, least(2, accuracy * 2)) AS w FROM m) SELECT id, lang, round(least(1, sum(confidence * w) / sum(w) + 0.1::DOUBLE * least(1, count(*) / sum(count(*)) OVER (PARTITION BY id))), 6) AS score FROM votes JOIN earned USING (detector) GROUP BY id, lang")
def vote_weighted_measured(spark, sf_dir):
    """Votes weighted by the accuracy that their detectors show on the documents."""
    cast = votes(spark, sf_dir).drop("alternatives").persist(StorageLevel.DISK_ONLY)  # read twice, made once
    weights = {r.detector: r.weight for r in measured(spark, sf_dir, cast).collect()}  # a row for each detector
    return detect.vote_weighted(cast, weights).select("id", "lang", F.round("score", 6).alias("score"))
