"""Language detection from stopwords and letters, votes of several detectors, and their statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import lexicon
from ..functions import text as T
from ..functions.batches import slices

WEIGHTS = {"fasttext": 1.5}
ALTERNATIVES = "array<struct<lang: string, confidence: double>>"
NO_ALTERNATIVES = f"cast(array() as {ALTERNATIVES})"


def model(df: DataFrame, predict: Callable[[list[str]], list[tuple[str, float]]], text_col: str = "text", least: int = 20, sure: float = 0.5, most: int = 3) -> DataFrame:
    """native() with a model in place of stopwords. predict(text) returns labels with their probability, the likeliest
    first; it is called on executors, after load() of whatever it needs. A language that isn't supported gives way to
    the first supported one."""
    import pyarrow as pa

    kinds = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64())]))
    rows = df.withColumns({"_text": T.preprocess(F.col(text_col)), "_row": F.struct(*[F.col(f"`{c}`") for c in df.columns])}).select("_row", "_text")

    def run(batches):
        for batch in slices(batches):
            found = [[{"lang": lang, "confidence": float(p)} for lang, p in predict(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kinds)], ["_row", "_found"])

    made = rows.mapInArrow(run, StructType([rows.schema["_row"], *StructType.fromDDL(f"_found {ALTERNATIVES}").fields]))
    labels = F.transform("_found", lambda a: F.struct(parse_label(a["lang"]).alias("lang"), a["confidence"].alias("confidence")))
    made = made.withColumn("_found", T.once(labels)).withColumn("_first", F.get("_found", F.lit(0))).withColumn("_rest", F.slice("_found", 2, most))
    best = made.withColumn("_best", T.once(restrict(F.col("_first.lang"), F.col("_first.confidence"), F.col("_rest")))).select("_row.*", "_best", "_rest")
    known = F.coalesce((T.reaches(F.col(text_col), least)) & (F.col("_best.confidence") >= sure), F.lit(False))
    return best.withColumns({"lang": F.when(known, F.col("_best.lang")).otherwise("unknown"), "lang_confidence": F.when(known, F.col("_best.confidence")).otherwise(0.0), "alternatives": F.coalesce("_rest", F.expr(NO_ALTERNATIVES))}).drop("_best", "_rest")


def native(df: DataFrame, text_col: str = "text", least: int = 20, sure: float = 0.5, longest: int = 10_000) -> DataFrame:
    """df with lang, lang_confidence and alternatives: the language of largest stopword ratio (ties es, en, nl) and its
    share of all ratios, unknown for short texts, without stopwords or below `sure`; and the other languages that have
    a share, the surest first (array of lang and confidence). Of texts over `longest` code points that many are read (0: all)."""
    t = F.col(text_col)
    listed = sorted({w for x in lexicon.LANGUAGES for w in lexicon.STOPWORDS[x]})

    def ratios(words: Column, n: Column) -> Column:
        return F.array(*[F.coalesce(F.try_divide(F.size(T.only(words, "x", lexicon.STOPWORDS[x])).cast("double"), n), F.lit(0.0)) for x in lexicon.LANGUAGES])

    def seen(tokens: Column) -> Column:
        return T.bind(T.only(tokens, "x", listed), lambda words: ratios(words, F.size(tokens)))

    staged = df.withColumn("_ratios", T.once(T.bind(T.detected_tokens(t, longest), seen)))
    ratio = [F.col("_ratios")[i] for i in range(3)]
    total, best = ratio[0] + ratio[1] + ratio[2], F.greatest(*ratio)
    lang = F.when(ratio[0] == best, "es").when(ratio[1] == best, "en").otherwise("nl")
    ok = (T.reaches(t, least)) & (total > 0)
    staged = staged.withColumn("_sure", T.once(F.when(ok, F.try_divide(best, total))))
    known = F.coalesce(F.col("_sure") >= sure, F.lit(False))
    shares = F.array(*[F.struct((-F.try_divide(ratio[i], total)).alias("c"), F.lit(x).alias("lang")) for i, x in enumerate(lexicon.LANGUAGES)])
    others = T.bind(lang, lambda best_: F.filter(shares, lambda a: (a["c"] < 0) & (a["lang"] != best_)))
    alternatives = F.when(ok, F.transform(F.array_sort(others), lambda a: F.struct(a["lang"].alias("lang"), (-a["c"]).alias("confidence")))).otherwise(F.expr(NO_ALTERNATIVES))
    return staged.withColumns({"lang": F.when(known, lang).otherwise("unknown"), "lang_confidence": F.when(known, F.col("_sure")).otherwise(0.0), "alternatives": alternatives}).drop("_ratios", "_sure")


#: Codes of model labels that stand for a supported language.
LABELS = {"spa": "es", "eng": "en", "nld": "nl", "dut": "nl"}


def parse_label(label: Column) -> Column:
    """The language of a model's label, such as __label__eng; other codes stay as they are."""
    code = F.regexp_replace(label, "^__label__", "")
    return F.coalesce(F.create_map(*[F.lit(x) for p in LABELS.items() for x in p])[code], code)


def restrict(lang: Column, confidence: Column, alternatives: Column) -> Column:
    """struct(lang, confidence): a language that isn't supported gives way to the first alternative that is."""
    supported = F.filter(alternatives, lambda a: a["lang"].isin(*lexicon.LANGUAGES))
    swap = ~lang.isin(*lexicon.LANGUAGES) & (F.size(supported) > 0)
    first = F.get(supported, F.lit(0))
    return F.struct(F.when(swap, first["lang"]).otherwise(lang).alias("lang"), F.when(swap, first["confidence"]).otherwise(confidence).alias("confidence"))


def hint_scores(hints: dict[str, Column], stop: float, chars: float) -> dict[str, Column]:
    zero = F.lit(0.0)
    return {lang: F.coalesce(hints[f"{lang}_stopwords"], zero) * stop + F.coalesce(hints.get(f"{lang}_chars", zero), zero) * chars for lang in lexicon.LANGUAGES}


#: Detections that are surer than that need no alternatives; others are at most so many times as sure as the detection.
NO_DOUBT, BESIDE, SOME = 0.8, 0.8, 0.1


def _hinted(t: Column, lang: Column, confidence: Column, stop: float, chars: float, kept: Callable[[Column, Column], Column]) -> Column:
    """Structs of c (less the confidence) and lang of the other supported languages, the surest first."""

    def every(scores: Column) -> Column:
        return F.array(*[F.struct(F.lit(x).alias("lang"), scores[i].alias("h"), F.least(scores[i], confidence * BESIDE).alias("c")) for i, x in enumerate(lexicon.LANGUAGES)])

    scores = T.bind(T.tokens(t), lambda words: F.array(*hint_scores(T.hints(t, words), stop, chars).values()))
    some = F.filter(T.bind(scores, every), lambda a: (a["lang"] != lang) & kept(a["h"], a["c"]))
    return F.transform(F.array_sort(F.transform(some, lambda a: F.struct((-a["c"]).alias("c"), a["lang"].alias("lang")))), lambda a: F.struct(a["lang"].alias("lang"), (-a["c"]).alias("confidence")))


def hint_alternatives(t: Column, lang: Column, confidence: Column) -> Column:
    """Alternatives that hints give to a detection that isn't sure, whatever detector it is of: array of lang and
    confidence, three at most; none for `unknown`."""
    found = _hinted(t, lang, confidence, 0.5, 0.3, lambda h, c: h > SOME)
    return F.when((lang != "unknown") & (confidence < NO_DOUBT), F.slice(found, 1, 3)).otherwise(F.expr(NO_ALTERNATIVES))


def hint_distribution(t: Column, lang: Column, confidence: Column) -> Column:
    """The detected language with its confidence and the others that hints give enough for."""
    found = _hinted(t, lang, confidence, 0.6, 0.4, lambda h, c: c > SOME)
    return F.when(lang != "unknown", F.concat(F.array(F.struct(lang.alias("lang"), confidence.alias("confidence"))), found)).otherwise(F.expr(NO_ALTERNATIVES))


def measured_weights(judged: DataFrame) -> DataFrame:
    """detector, votes, accuracy and weight from votes (detector, lang) beside the expected language; votes on rows
    without one don't count."""
    hit = (F.col("lang") == F.col("expected")).cast("int")
    per = judged.filter("expected is not null").groupBy("detector").agg(F.count(F.lit(1)).alias("votes"), F.avg(hit).alias("accuracy"))
    return per.withColumn("weight", new_weight(F.col("accuracy")))


def three_votes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ord, detector, lang, confidence, alternatives: votes of the stopword detector, of character hints and of
    heuristic evidence; a detector without evidence doesn't vote, and only the first one has alternatives."""
    staged = native(docs.select(id_col, text_col), text_col)
    t, words = F.col(text_col), F.col("_heard")
    h = T.char_hints(t)
    staged = staged.withColumns({"_heard": T.once(F.transform(T.heuristic_words(t), F.lower)), "_marks": T.once(F.array(*[F.coalesce(h[k], F.lit(0.0)) for k in ("es_chars", "nl_chars", "en_ascii")]))})
    es, nl, en = (F.col("_marks")[i] for i in range(3))
    chars = F.struct(F.lit(2).alias("ord"), F.lit("hints").alias("detector"), F.when((es >= nl) & (es > 0), "es").when(nl > 0, "nl").when(en > 0, "en").otherwise("unknown").alias("lang"), F.least(F.lit(1.0), F.greatest(es, nl, en) * 5).alias("confidence"), F.expr(NO_ALTERNATIVES).alias("alternatives"))
    staged = staged.withColumn("_scores", T.once(F.array(*[F.coalesce(T.evidence(t, words, lang, low=True), F.lit(0.0)) for lang in lexicon.LANGUAGES])))
    score = {lang: F.col("_scores")[i] for i, lang in enumerate(lexicon.LANGUAGES)}
    best = F.greatest(*score.values())
    heard = F.struct(F.lit(3).alias("ord"), F.lit("heuristic").alias("detector"), F.when(best <= 0, "unknown").when(score["es"] == best, "es").when(score["en"] == best, "en").otherwise("nl").alias("lang"), F.least(F.lit(1.0), best * 2).alias("confidence"), F.expr(NO_ALTERNATIVES).alias("alternatives"))
    first = F.struct(F.lit(1).alias("ord"), F.lit("stopwords").alias("detector"), F.col("lang"), F.col("lang_confidence").alias("confidence"), "alternatives")
    return staged.select(F.col(id_col).alias("id"), T.once(F.array(first, chars, heard)).alias("v")).select("id", F.inline("v")).filter("lang <> 'unknown'")


def vote_weighted(votes: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """All languages of each id with their score (mean confidence by weight, plus a tenth of their share of votes, at
    most 1) and rank; ties go to the earlier detector."""
    table = F.create_map(*[F.lit(x) for p in (weights or WEIGHTS).items() for x in p])
    weighted = votes.withColumn("w", F.coalesce(table[F.col("detector")], F.lit(1.0)))
    per = weighted.groupBy("id", "lang").agg(F.sum(F.col("confidence") * F.col("w")).alias("cw"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))
    all_ = Window.partitionBy("id")
    score = F.least(F.lit(1.0), F.col("cw") / F.col("w") + 0.1 * F.least(F.lit(1.0), F.col("n") / F.sum("n").over(all_)))
    return per.withColumn("score", score).withColumn("rank", F.row_number().over(all_.orderBy(F.desc("score"), "ord"))).select("id", "lang", "score", "rank")


def vote_majority(votes: DataFrame) -> DataFrame:
    """The language of most votes, ties to the higher mean confidence and then the earlier detector; with the share of
    votes it got and, as alternatives, the three surest other languages (ties by name)."""
    per = votes.groupBy("id", "lang").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.min("ord").alias("ord"))
    best = F.max_by(F.struct("lang", "confidence", "n"), F.struct("n", "confidence", (-F.col("ord")).alias("o")))
    all_ = F.collect_list(F.struct((-F.col("confidence")).alias("c"), "lang")).alias("all")
    found = per.groupBy("id").agg(best.alias("best"), F.sum("n").alias("votes"), all_)
    return found.select("id", "best.lang", "best.confidence", (F.col("best.n") / F.col("votes")).alias("consensus"), _surest(F.filter("all", lambda v: v["lang"] != F.col("best.lang"))).alias("alternatives"))


def _surest(all_: Column, most: int = 3) -> Column:
    """Alternatives from structs of c (less the confidence) and lang."""
    return F.transform(F.slice(F.array_sort(all_), 1, most), lambda v: F.struct(v["lang"].alias("lang"), (-v["c"]).alias("confidence")))


def vote_best(votes: DataFrame) -> DataFrame:
    """The single surest vote, ties to the earlier detector; as alternatives, the three surest languages of the other
    votes and of all votes' own alternatives (ties by name), each with the best confidence that it got there."""
    best = F.max_by(F.struct("lang", "confidence", "ord"), F.struct("confidence", (-F.col("ord")).alias("o")))
    first = votes.groupBy("id").agg(best.alias("best"), F.collect_list(F.struct("ord", "lang", "confidence", "alternatives")).alias("all"))
    others = F.filter("all", lambda v: v["ord"] != F.col("best.ord"))
    said = F.concat(F.transform(others, lambda v: F.struct(v["lang"].alias("lang"), v["confidence"].alias("confidence"))), F.flatten(F.transform("all", lambda v: v["alternatives"])))
    staged = first.withColumn("said", T.once(said))
    top = F.transform(F.array_distinct(F.transform("said", lambda v: v["lang"])), lambda x: F.struct((-F.array_max(F.transform(F.filter("said", lambda v: v["lang"] == x), lambda v: v["confidence"]))).alias("c"), x.alias("lang")))
    return staged.select("id", "best.lang", "best.confidence", _surest(top).alias("alternatives"))


def detector_stats(votes: DataFrame) -> DataFrame:
    return votes.groupBy("detector").agg(F.count(F.lit(1)).alias("detections"), F.sum("confidence").alias("total"), F.avg("confidence").alias("average"))


def new_weight(performance: Column) -> Column:
    return F.greatest(F.lit(0.1), F.least(F.lit(2.0), performance * 2))


def recommended(length: Column, accurate: bool = True, fast: bool = False, fasttext: bool = True, langid: bool = True) -> Column:
    if fasttext != langid:
        return F.lit("fasttext" if fasttext else "langid")
    if not fasttext:
        return F.lit("auto")
    if accurate and not fast:
        return F.lit("composite")
    out = F.when(length < 1000, "langid").when(length > 10_000, "fasttext") if fast else F.when(length > 10_000, "fasttext")
    return out.otherwise("composite")
