"""The audit of blocks, and statistics of pages and batches."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import lexicon
from ..config import AuditConfig
from ..functions import text as T
from ..sources import sink
from . import detect, heuristics, issues, placeholders, whitelist


def gate(t: Column, least: int = 3) -> Column:
    """Whether a text is worth verifying: long enough, and more than an URL or an e-mail address."""
    bare = T.strip(t)
    ok = T.reaches(t, least)
    for sign, pattern in (("http", r"(?U)https?://\S+"), ("@", f"(?U){T.EMAIL}")):
        ok = ok & (~t.contains(sign) | ~bare.rlike(pattern) | T.reaches(F.regexp_replace(bare, pattern, ""), least))
    return F.coalesce(ok, F.lit(False))


def detected(blocks: DataFrame, config: AuditConfig | None = None) -> DataFrame:
    """Blocks that aren't blank, with lang, lang_confidence, alternatives and tokens."""
    config = config or AuditConfig()
    return detect.native(blocks.filter(T.reaches(F.col("text"), 1)), "text", config.min_detect_chars, config.min_confidence, config.max_detect_chars).withColumn("tokens", T.count_words(F.col("text")))


def eligible(config: AuditConfig) -> Column:
    """Whether a detected block is verified: in the target language or unsure of it, and not too long, if there is a limit."""
    asked = (F.col("lang") != "unknown") & ((F.col("lang") == config.target) | (F.col("lang_confidence") < config.sure))
    return asked & (F.length("text") < config.max_verify_chars) if config.max_verify_chars else asked


def block_leak(config: AuditConfig) -> Column:
    """Array with an issue for a block in another language."""
    t = F.col("text")
    found = issues.issue("analyzer", "language_leak", "BLOCK_LANGUAGE", F.concat(F.lit("Block is in "), F.col("lang")), F.concat(F.lit("Translate to "), F.lit(config.target)), F.lit(0), F.length(t), F.col("lang_confidence"))
    return issues.one_if(~F.col("lang").isin("unknown", config.target), found)


KEYS = ["page_id", "block_idx"]


#: What audited() says of an issue.
REPORTED = ("s", "e", "type", "source", "rule_id", "message", "suggestion", "confidence", "seq", "severity", "snippet", "context")
#: What counts of issues take.
COUNTED = ("type", "severity")
#: What api_response() takes.
ANSWERED = ("s", "e", "type", "rule_id", "message", "suggestion", "confidence", "severity", "snippet")


def _rules(config: AuditConfig, tag: Column | None, heard: Column | None) -> Column:
    t = F.col("text")
    checked = F.concat(placeholders.check(t, config.target, config.check_quotes), heuristics.check(t, config, tag, F.col("_words"), heard))
    return F.concat(block_leak(config), F.when(eligible(config) & gate(t), checked).otherwise(issues.none()))


def audited(blocks: DataFrame, config: AuditConfig, grammar: DataFrame | None = None, rules: Column | None = None, only: Column | None = None, said: tuple[str, ...] = REPORTED) -> DataFrame:
    """Blocks that aren't blank (page_id, block_idx, text, tag_name if there is one) with lang, lang_confidence, tokens
    and found: the issues of the block (see ISSUE) with seq, severity, snippet and context, de-duplicated and merged.
    A block's issues are one array, so that nothing is shuffled and each text is read once. grammar: issues of a
    checker (see grammar.match_issues) with page_id, block_idx, seq; they meet their blocks in the only join there is,
    and come after those of the rules. rules: a column to use in place of all rules; it is taken as it is. only: a
    condition on columns of blocks, which reaches their scan; one on the result would not, as issues are made once. said:
    the fields of an issue that are wanted, as snippets and contexts cost time where issues are only counted.
    Terms of config.whitelist that have several words silence the evidence and all issues that they cover."""
    if only is not None:
        blocks = blocks.filter(only)
    phrases = tuple(term for term in config.whitelist if " " in term.strip())
    if phrases and rules is None:
        blocks = whitelist.with_phrases(blocks, phrases)
    t, tag = F.col("text"), F.col("tag_name") if "tag_name" in blocks.columns else None
    heard = F.col("masked") if phrases and rules is None else None
    known = detected(blocks, config).withColumn("_words", T.once(F.when(eligible(config), T.heuristic_words(t if heard is None else heard))))  # once for all rules
    raw = known.withColumn("found", T.once(_rules(config, tag, heard) if rules is None else rules))
    if grammar is not None:
        fields = [c.split(":")[0].strip() for c in issues.ISSUE.removeprefix("struct<").removesuffix(">").split(", ")]
        per = grammar.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(*fields).cast(issues.ISSUE).alias("i")))).alias("_more"))
        raw = raw.join(per.hint("merge"), KEYS, "left").withColumn("found", T.once(F.concat("found", F.coalesce(F.transform("_more", lambda m: m["i"]), issues.none()))))
    kept = F.filter(issues.numbered(F.col("found")), lambda i: issues.allowed(i["rule_id"], config.ignore_rules, config.enable_rules))
    if rules is None:
        kept = issues.dedup_array(kept) if config.dedup else kept
        kept = issues.merge_array(kept) if config.merge else kept
    if heard is not None:
        kept = whitelist.unsilenced(kept, F.col("phrases"))

    def reported(i: Column, n: Column, cut: Column) -> Column:
        s, e = i["s"], i["e"]
        snippet = F.concat(T.part(t, cut, s, F.when(e - s > 100, 100).otherwise(e - s)), F.when(e - s > 100, "...").otherwise(""))
        made = {"severity": issues.severity(i["type"], i["rule_id"], dict(config.severity)), "snippet": snippet, "context": T.context_window(t, s, e, length=n, cut=cut)}
        return F.struct(*[(made[c] if c in made else i[c]).alias(c) for c in said])

    def every(of: Column) -> Column:
        return T.bind(F.length(t), lambda n: T.bind(T.pieces(t, n, F.size(of)), lambda cut: F.transform(of, lambda i: reported(i, n, cut))))

    return raw.withColumn("found", T.once(T.bind(kept, every))).drop("_words", "_more", "phrases", "masked")


def audit(blocks: DataFrame, config: AuditConfig, grammar: DataFrame | None = None, only: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each issue that audited() finds: page_id, block_idx, the columns `carry` of the block (such as url and
    xpath), s, e, type, severity, source, rule_id, message, suggestion, confidence, seq, snippet, context."""
    return audited(blocks, config, grammar, only=only).select(*KEYS, *carry, F.inline("found"))


def observed(checked: DataFrame) -> tuple[DataFrame, Observation]:
    """audited() blocks, and what their own pass counts: blocks, checked (blocks with issues), issues, and issues by
    severity and by verifier. The observation is ready after the first action on the blocks; nothing is read twice."""
    seen = Observation()
    counts = {"blocks": F.count(F.lit(1)), "checked": F.count_if(F.size("found") > 0), "issues": F.sum(F.size("found"))}
    counts |= {s: F.sum(F.size(F.filter(F.col("found.severity"), equals(s)))) for s in SEVERITIES}
    counts |= {f"by_{v}": F.sum(F.size(F.filter(F.col("found.source"), equals(v)))) for v in ("analyzer", "heuristic", "placeholder", "languagetool")}
    return checked.observe(seen, *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in counts.items()]), seen


def run_metrics(checked: DataFrame, write: Callable[[DataFrame], None]) -> dict[str, float]:
    """Writes audited() blocks by `write` and returns observed() counts and the seconds that it took."""
    blocks, seen = observed(checked)
    began = time.perf_counter()
    write(blocks)
    seconds = time.perf_counter() - began
    return {**seen.get, "seconds": seconds}


def overall(critical: Column, errors: Column, warnings: Column, blocks: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.least((critical * 0.5 + errors * 0.2 + warnings * 0.05) / F.greatest(F.lit(1), blocks), F.lit(1.0)))


SEVERITIES = ("critical", "error", "warning", "info")


def _totals(config: AuditConfig, columns: list[str]) -> list[Column]:
    """Aggregates of a page's detected blocks; html_chars where the extractor gave it."""
    sizes = [F.max("html_chars").alias("html_size")] if "html_chars" in columns else []
    return [F.count(F.lit(1)).alias("total_blocks"), F.sum("tokens").alias("total_tokens"), F.sum(F.when(F.col("lang") == config.target, F.col("tokens")).otherwise(0)).alias("target_tokens"), (F.sum(F.length("text") + 2) - 2).alias("total_chars"), *sizes]


def _scored(pages: DataFrame) -> DataFrame:
    out = pages.withColumn("overall_score", overall(F.col("critical"), F.col("error"), F.col("warning"), F.col("total_blocks")))
    return out.withColumn("language_purity", F.coalesce(F.try_divide(F.col("target_tokens").cast("double"), F.col("total_tokens")), F.lit(0.0)))


def _severities() -> list[Column]:
    """Aggregates of the arrays of issues: how many there are of each severity."""
    return [F.sum(F.size(F.filter(F.col("found.severity"), equals(s)))).alias(s) for s in SEVERITIES]


def equals(value: str):
    return lambda x: x == value


def score_pages(checked: DataFrame, config: AuditConfig, *also: Column) -> DataFrame:
    """page_id, totals, counts by severity, overall_score and purity for each page of audited() blocks, and the aggregates
    `also`. Issues are counted in their arrays, and blocks are added up before the only shuffle."""
    per = [F.sum(F.size("found")).alias("issues"), *_severities(), *also]
    return _scored(checked.groupBy("page_id").agg(*_totals(config, checked.columns), *per))


def page_stats(blocks: DataFrame, found: DataFrame, config: AuditConfig) -> DataFrame:
    """score_pages() where issues are a table of their own. They are counted by page before they meet the pages."""
    known = detected(blocks, config)
    per = found.groupBy("page_id").agg(F.count(F.lit(1)).alias("issues"), *[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES])
    return _scored(known.groupBy("page_id").agg(*_totals(config, known.columns)).join(per.hint("merge"), "page_id", "left").fillna(0, ["issues", *SEVERITIES]))


def page_languages(blocks: DataFrame, config: AuditConfig | None = None) -> DataFrame:
    """page_id, lang, tokens, pct and rank of each language, `unknown` included."""
    from pyspark.sql import Window

    per = detected(blocks, config).groupBy("page_id", "lang").agg(F.sum("tokens").alias("tokens"))
    page = Window.partitionBy("page_id")
    per = per.withColumn("pct", F.coalesce(F.try_divide(F.col("tokens") * 100.0, F.sum("tokens").over(page)), F.lit(0.0)))
    return per.withColumn("rank", F.row_number().over(page.orderBy(F.desc("tokens"), "lang")))


def type_by_severity(checked: DataFrame) -> DataFrame:
    """Counts of audited() issues by type and severity, by type, by severity and of all, in one pass and one shuffle:
    level says which (type+severity, type, severity, all), and what a level adds up over is null. Blocks' issues are
    counted in their arrays first."""
    each = checked.select(F.inline(F.transform("found", lambda i: F.struct(i["type"].alias("type"), i["severity"].alias("severity")))))
    counted = each.groupingSets([[F.col("type"), F.col("severity")], [F.col("type")], [F.col("severity")], []], "type", "severity").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return counted.select(F.element_at(F.array(*map(F.lit, ("type+severity", "type", "severity", "all"))), F.col("g").cast("int") + 1).alias("level"), "type", "severity", "n")


def batch_summary(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count(F.lit(1)).alias("total_pages"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("issues", "total_issues"), ("critical", "total_critical"), ("error", "total_errors"), ("warning", "total_warnings"))], F.coalesce(F.avg("overall_score"), F.lit(0.0)).alias("average_score"))


def worst_pages(stats: DataFrame, n: int = 3) -> DataFrame:
    return stats.orderBy(F.desc("issues"), "overall_score", "page_id").limit(n)


def exit_code(stats: DataFrame, max_errors: int) -> DataFrame:
    """2 if there are more errors than allowed (0: any number is), else 0."""
    n = stats.agg(F.coalesce(F.sum(F.col("error") + F.col("critical")), F.lit(0)).alias("n_errors"))
    return n.withColumn("exit_code", F.when(F.lit(max_errors > 0) & (F.col("n_errors") > max_errors), 2).otherwise(0))


def page_error(pages: DataFrame) -> DataFrame:
    """A critical issue for each page that could not be fetched or has no content."""
    why = F.coalesce(F.col("error"), F.when(F.coalesce(F.length("html"), F.lit(0)) == 0, "no content"))
    return pages.withColumn("why", why).filter(F.col("why").isNotNull()).select("page_id", F.lit("grammar").alias("type"), F.lit("critical").alias("severity"), F.concat(F.lit("Page failed: "), F.col("why")).alias("message"), F.lit("/").alias("xpath"))


CSV_COLUMNS = ["url", "target_lang", "issue_type", "severity", "message", "suggestion", "snippet", "xpath", "confidence"]


def csv_rows(found: DataFrame, target: str, *also: str) -> DataFrame:
    return found.select(*also, "url", F.lit(target).alias("target_lang"), F.col("type").alias("issue_type"), "severity", "message", F.coalesce("suggestion", F.lit("")).alias("suggestion"), "snippet", "xpath", "confidence")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def html_rows(stats: DataFrame) -> DataFrame:
    """A table row of HTML for each page; texts are escaped."""
    cell = lambda c: F.concat(F.lit("<td>"), F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</td>"))
    return stats.select(F.concat(F.lit("<tr>"), *[cell(c) for c in ("page_id", "total_blocks", "issues", "overall_score")], F.lit("</tr>")).alias("value"))


def write_html(stats: DataFrame, path: str) -> None:
    head = stats.sparkSession.createDataFrame([("<!DOCTYPE html><title>Translation audit</title><table><tr><th>page<th>blocks<th>issues<th>score</tr>",)], "value string")
    foot = stats.sparkSession.createDataFrame([("</table>",)], "value string")
    head.unionAll(html_rows(stats)).unionAll(foot).write.text(path)


def _escaped(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return F.regexp_replace(text, "[\\r\\n]+", " ")


HTML_HEAD = "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Translation audit</title></head><body><h1>Translation audit</h1>"


def html_sections(stats: DataFrame) -> DataFrame:
    """page_id, block_idx and seq (null) and value: the heading of each page's section, from rows of score_pages() and url, if
    there is one."""
    named = F.col("url") if "url" in stats.columns else F.col("page_id")
    score = F.floor(F.col("overall_score") * 100).cast("string")
    value = F.concat(F.lit("<h2>"), _escaped(named), F.lit("</h2><p>"), F.col("total_blocks").cast("string"), F.lit(" blocks, "), F.col("issues").cast("string"), F.lit(" issues, score "), score, F.lit("</p>"))
    return stats.select("page_id", F.lit(None).cast("int").alias("block_idx"), F.lit(None).cast("int").alias("seq"), value.alias("value"))


def html_issues(checked: DataFrame) -> DataFrame:
    """page_id, block_idx, seq and value: a line for each issue of audited() blocks."""
    parts = [F.lit("<div class='"), F.col("severity"), F.lit("'><b>"), F.col("type"), F.lit("</b> ("), F.col("severity"), F.lit(") "), _escaped(F.col("message")), F.lit(" <code>"), _escaped(F.col("snippet")), F.lit("</code>")]
    advice = F.when(F.coalesce(F.col("suggestion"), F.lit("")) != "", F.concat(F.lit(" <i>"), _escaped(F.col("suggestion")), F.lit("</i>"))).otherwise("")
    return checked.select(*KEYS, F.inline("found")).select("page_id", F.col("block_idx").cast("int").alias("block_idx"), F.col("seq").cast("int").alias("seq"), F.concat(*parts, advice, F.lit("</div>")).alias("value"))


def html_lines(checked: DataFrame, config: AuditConfig) -> DataFrame:
    """at (0 head, 1 pages, 2 foot), page_id, block_idx, seq and value: the lines of a report on audited() blocks, each
    page's heading before the issues of its blocks. A page's issues are lines of their own, however many there are. Texts
    are escaped, and their line breaks are spaces. The first url of a page, if blocks have one, names it. Rows without page_id
    are a section of their own, the first one."""
    urls = [F.min("url").alias("url")] if "url" in checked.columns else []
    stats = score_pages(checked, config, *urls)
    at = lambda n: F.lit(n).alias("at")
    total = stats.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("issues"), F.lit(0)).alias("i"))
    place = [F.lit(None).cast(checked.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("int").alias("block_idx"), F.lit(None).cast("int").alias("seq")]
    head = total.select(at(0), *place, F.concat(F.lit(HTML_HEAD + "<p>"), F.col("n").cast("string"), F.lit(" pages, "), F.col("i").cast("string"), F.lit(" issues</p>")).alias("value"))
    foot = total.select(at(2), *place, F.lit("</body></html>").alias("value"))
    return head.unionAll(html_sections(stats).select(at(1), "*")).unionAll(html_issues(checked).select(at(1), "*")).unionAll(foot)


def write_html_report(checked: DataFrame, config: AuditConfig, path: str) -> None:
    """One HTML file with all issues of audited() blocks, in page order; see sink.write_ordered(). The audit runs once; what
    it found is held by Spark, on disk where memory ends, while headings, totals and the order are made of it."""
    held = checked.persist()
    try:
        sink.write_ordered(html_lines(held, config), path)
    finally:
        held.unpersist()


def csv_lines(found: DataFrame, target: str) -> DataFrame:
    """page_id, block_idx, seq and value: the header (nulls) and a line of CSV for each issue, for sink.write_ordered(); a
    quote in a field is doubled, and fields may go over several lines."""
    keys = ["page_id", "block_idx", "seq"]
    row = csv_rows(found.select("*", F.struct(*keys).alias("_at")), target, "_at")
    line = F.to_csv(F.struct(*CSV_COLUMNS), {"escape": '"', "quote": '"', "nullValue": "", "emptyValue": ""})
    head = found.sparkSession.range(1).select(*[F.lit(None).cast(found.schema[k].dataType).alias(k) for k in keys], F.lit(",".join(CSV_COLUMNS)).alias("value"))
    return head.unionAll(row.select("_at.*", line.alias("value")))


def supported_languages(spark) -> DataFrame:
    names = {"es": "Spanish", "en": "English", "nl": "Dutch"}
    return spark.createDataFrame([(code, names[code]) for code in lexicon.LANGUAGES], "code string, name string")


def api_response(checked: DataFrame, config: AuditConfig) -> DataFrame:
    """page_id and the answer of an analysis as JSON, with all issues of audited() blocks. A page is one row of the
    answer, so its issues come together."""
    issue = lambda i: F.struct("block_idx", i["s"].alias("start"), i["e"].alias("end"), *[i[c].alias(c) for c in ("type", "severity", "rule_id", "message", "suggestion", "snippet", "confidence")])
    langs = [F.sum(F.when(F.col("lang") == x, F.col("tokens"))).alias(f"_{x}") for x in (*lexicon.LANGUAGES, "unknown")]
    pages = _scored(checked.withColumn("_listed", T.once(F.transform("found", issue))).groupBy("page_id").agg(*_totals(config, checked.columns), *_severities(), *langs, F.array_sort(F.flatten(F.collect_list("_listed"))).alias("found")))
    share = lambda x: F.round(F.coalesce(F.try_divide(F.col(f"_{x}") * 100.0, F.col("total_tokens")), F.lit(0.0)), 4)
    languages = F.map_from_entries(F.filter(F.array(*[F.when(F.col(f"_{x}").isNotNull(), F.struct(F.lit(x).alias("lang"), share(x).alias("pct"))) for x in sorted((*lexicon.LANGUAGES, "unknown"))]), lambda p: p.isNotNull()))
    kinds = F.map_from_entries(F.transform(F.array_sort(F.array_distinct("found.type")), lambda k: F.struct(k, F.size(F.filter("found", lambda i: i["type"] == k)))))
    body = F.struct(F.size("found").alias("total_issues"), F.struct(*SEVERITIES).alias("by_severity"), kinds.alias("issues_by_type"), F.col("total_blocks").alias("total_text_blocks"), F.round(F.col("language_purity") * 100, 4).alias("target_language_percentage"), "overall_score", languages.alias("detected_languages"), F.col("found").alias("issues"))
    return pages.select("page_id", F.to_json(body).alias("response"))
