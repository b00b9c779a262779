"""Quality rules as a ledger of bits, with DataFrame functions only.

Every rule is evaluated once for each document. The ledger holds the measurements and one long, `failed`, in which bit i
says that rule i failed. A policy is a version and the rules that it counts: applying one compares bits with a mask, so
that a new policy needs no text. Ablations add up documents by their pattern of bits, of which there are at most 2 to the
number of rules, and derive from these counts what each rule drops and what it alone drops.

A text is an array of words in its own row; windows of eight words are compared by 64-bit hashes sorted inside the row,
so nothing is shuffled and a document never meets another. Memory grows with the longest text (about 100 bytes a word).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Words of a window whose repetition counts.
WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
#: Frequent short words of several languages (fixed values); prose holds some of them.
FUNCTION_WORDS = ("the", "of", "and", "to", "in", "is", "that", "with", "der", "die", "das", "und", "nicht", "ist", "el", "la", "los", "de", "que", "y", "en", "le", "les", "et", "des", "est", "het", "een", "van")


@dataclass(frozen=True)
class Rule:
    """A document fails where `fails`, SQL over the ledger's measurements, holds. All thresholds are whole numbers."""

    name: str
    fails: str


#: Bit i belongs to the i-th rule for good: new rules are appended, old ones stay.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("many_words", "n_words > 1000000"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_word_lines"),
    Rule("bullets", "10 * n_bullet_lines > 9 * n_word_lines"),
    Rule("ellipses", "10 * n_ellipsis_lines > 3 * n_word_lines"),
    Rule("letterless", "10 * n_letter_words < 7 * n_words"),
    Rule("no_function_words", "n_function_words = 0"),
    Rule("stutters", "100 * n_stutters > 30 * n_words"),
)
#: Policies by version; what a version counts never changes.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "many_words", "short_words", "long_words", "symbols", "repeated_lines", "bullets", "ellipses", "letterless"),
    3: ("few_words", "repeated_windows", "many_words", "short_words", "long_words", "symbols", "repeated_lines", "bullets", "ellipses", "letterless", "no_function_words", "stutters"),
}
LATEST = max(POLICIES)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines", "n_bullet_lines", "n_ellipsis_lines", "n_letter_words", "n_function_words", "n_stutters")


def mask(version: int = LATEST, rules: tuple[Rule, ...] = RULES, policies: dict[int, tuple[str, ...]] = POLICIES) -> int:
    """The bits that a policy counts."""
    bit = {rule.name: 1 << i for i, rule in enumerate(rules)}
    return sum(bit[name] for name in policies[version])


def _tail(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _shifted(values: Column, by: int) -> Column:
    """Hash of each value with the one `by` places on; the last `by` are of no use."""
    return F.zip_with(values, _tail(values, by), lambda a, b: F.xxhash64(a, b))


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each step's columns have several uses in the next one, so that Catalyst keeps the steps apart; no lambda refers to
    a column outside."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(f"`{text_col}`").alias("text"))
    parts = texts.select("id", "text", F.array_remove(F.split(F.regexp_replace("text", r"[\x09-\x0D]", " "), " ", -1), "").alias("words"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    counted = parts.select(
        "id", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("h1"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size("lines").alias("n_word_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).alias("n_ellipsis_lines"),
        F.size(F.filter("words", lambda x: x.rlike(r"\p{L}"))).alias("n_letter_words"),
        F.size(F.array_intersect("words", F.array(*map(F.lit, FUNCTION_WORDS)))).alias("n_function_words"),
    )
    kept = [c for c in MEASURES if c not in ("n_words", "n_repeat_words", "n_stutters")]
    counted = counted.select("id", "n", *kept, "h1", F.size(F.filter(F.zip_with("h1", _tail(F.col("h1"), 1), lambda a, b: a == b), lambda x: x)).alias("n_stutters"))
    kept, by = [*kept, "n_stutters"], 1
    while by < WINDOW:
        counted = counted.select("id", "n", *kept, _shifted(F.col("h1"), by).alias("h1"))
        by *= 2
    windows = counted.select("id", "n", *kept, F.slice("h1", 1, F.greatest(F.col("n") - (WINDOW - 1), F.lit(0))).alias("windows"))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = windows.select("id", "n", *kept, F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("w"))
    # what equals its successor, and what equals its predecessor, in the order of hashes
    up = F.zip_with("w", _tail(F.col("w"), 1), lambda a, b: F.struct(a["i"].alias("i"), (a["h"] == b["h"]).alias("same")))
    down = F.zip_with(_tail(F.col("w"), 1), "w", lambda a, b: F.struct(a["i"].alias("i"), (a["h"] == b["h"]).alias("same")))
    twice = F.transform(F.filter(F.concat(up, down), lambda x: x["same"]), lambda x: x["i"])
    starts = ordered.select("id", "n", *kept, F.when(F.col("w").isNotNull(), F.sort_array(F.array_distinct(twice))).alias("starts"))
    gaps = F.zip_with("starts", _tail(F.col("starts"), 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, b: a + b), F.lit(0))
    return starts.select(F.col("id").alias(id_col), *[F.coalesce({"n_words": F.col("n"), "n_repeat_words": covered}.get(c, F.col(c)), F.lit(0)).cast("long").alias(c) for c in MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of docs: id, the measurements and `failed`, a bit for each rule that fails. Null and empty
    texts have no words and no lines, all measurements 0. Rows that repeat, share an id or have none are measured each;
    other columns stay behind, whatever their names. An empty table gives an empty ledger."""
    bits = [F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(rules)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return _measured(docs, id_col, text_col).select(id_col, *MEASURES, failed.alias("failed"))


def apply_policy(entries: DataFrame, version: int = LATEST) -> DataFrame:
    """The ledger with policy (its version) and kept: whether no rule of the policy failed."""
    return entries.withColumns({"policy": F.lit(version), "kept": F.col("failed").bitwiseAND(F.lit(mask(version)).cast("long")) == 0})


def failed_names(failed: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules whose bits are set."""
    return F.array_compact(F.array(*[F.when(failed.bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(r.name)) for i, r in enumerate(rules)]))


def ablations(entries: DataFrame, versions: dict[int, tuple[str, ...]] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and each of its rules: policy, rule, n_docs, n_failed (the rule fails), n_dropped (by the policy),
    n_only (dropped for this rule alone), n_kept_without (kept if the rule were left out), shared (the bits of other rules of
    the policy that ever fail along with it). One aggregation of the ledger by pattern of bits, with partial counts; all
    else is computed from the patterns, at most 2 to the number of rules. Of an empty ledger there are no rows."""
    patterns = entries.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    bit = {rule.name: 1 << i for i, rule in enumerate(rules)}
    asked = F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(name).alias("rule"), F.lit(mask(v, rules, versions)).cast("long").alias("mask"), F.lit(bit[name]).cast("long").alias("bit")) for v, names in versions.items() for name in names])
    each = patterns.select("failed", "n", F.inline(asked)).withColumn("counts", F.col("failed").bitwiseAND(F.col("mask")))
    fails, rest = F.col("counts").bitwiseAND(F.col("bit")) != 0, F.col("counts").bitwiseAND(F.bitwise_not("bit"))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))

    return each.groupBy("policy", "rule").agg(F.sum("n").alias("n_docs"), total(fails).alias("n_failed"), total(F.col("counts") != 0).alias("n_dropped"), total(fails & (rest == 0)).alias("n_only"), total(rest == 0).alias("n_kept_without"), F.coalesce(F.bit_or(F.when(fails, rest)), F.lit(0).cast("long")).alias("shared"))
