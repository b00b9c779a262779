"""Issues: their structure, severity, filters, de-duplication and merging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon
from ..functions.text import bind, once

ISSUE = "struct<source: string, type: string, rule_id: string, message: string, suggestion: string, s: int, e: int, confidence: double>"
NONE = f"cast(array() as array<{ISSUE}>)"


def issue(source: str, kind: str, rule: Column | str, message: Column | str, suggestion: Column | str | None, s: Column, e: Column, confidence: Column | float) -> Column:
    return F.struct(*[x if isinstance(x, Column) else F.lit(x) for x in (source, kind, rule, message, suggestion, s, e, confidence)]).cast(ISSUE)


def unnest(df: DataFrame, found: Column, *keep: str) -> DataFrame:
    """A row for each issue of the arrays that `found` makes."""
    return df.select(*keep, once(found).alias("_found")).select(*keep, F.inline("_found"))


def none() -> Column:
    return F.expr(NONE)


def one_if(condition: Column, made: Column) -> Column:
    """An array of the issue where the condition holds, else an empty one."""
    return F.when(condition, F.array(made)).otherwise(none())


def severity(kind: Column, rule: Column, overrides: dict[str, str] | None = None) -> Column:
    """By an override for the rule, else for the type, else the type's default (warning)."""
    default = F.coalesce(F.create_map(*[F.lit(x) for p in lexicon.SEVERITY.items() for x in p])[kind], F.lit("warning"))
    if not overrides:
        return default
    table = F.create_map(*[F.lit(x) for p in overrides.items() for x in p])
    return F.coalesce(table[rule], table[kind], default)


def allowed(rule: Column, ignore: tuple[str, ...] = (), enable: tuple[str, ...] = ()) -> Column:
    """Rule filter: issues without a rule always pass."""
    ok = ~rule.isin(*ignore) if ignore else F.lit(True)
    if enable:
        ok = ok & rule.isin(*enable)
    return rule.isNull() | ok


def priority(source: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in lexicon.VERIFIER_PRIORITY.items() for x in p])[source], F.lit(lexicon.DEFAULT_PRIORITY))


ROW = ISSUE.replace("confidence: double>", "confidence: double, seq: int>")


def numbered(found: Column) -> Column:
    """The array's issues with their place in it as seq."""
    return F.transform(found, lambda i, n: F.struct(*[i[c].alias(c) for c in ("source", "type", "rule_id", "message", "suggestion", "s", "e", "confidence")], n.alias("seq")))


def _texts(of: Column, field: str) -> Column:
    """Distinct values of a field, sorted, without nulls."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(of, lambda i: i[field]), lambda v: v.isNotNull())))


def _with(i: Column, **changed: Column) -> Column:
    return F.struct(*[changed.get(c, i[c]).alias(c) for c in ("source", "type", "rule_id", "message", "suggestion", "s", "e", "confidence", "seq")])


def _groups(ordered: Column, begins: Callable[[Column, Column], Column], made: Callable[[Column], Column]) -> Column:
    """made() of each run of an array; a run begins where begins(previous, this) holds."""

    def of(a: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(a)), lambda n: (n == 1) | begins(F.get(a, n - 2), F.get(a, n - 1)))

        def runs(at: Column) -> Column:
            ends = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(a) + 1))
            return F.transform(F.zip_with(at, ends, lambda x, y: F.slice(a, x, y - x)), made)

        return bind(starts, runs)

    return bind(ordered, lambda a: F.when(F.size(a) > 0, of(a)).otherwise(F.expr(f"cast(array() as array<{ROW}>)")))


def _several(found: Column, made: Callable[[Column], Column]) -> Column:
    """made() of an array of several issues; an array of one, or of none, stays."""
    return bind(found, lambda f: F.when(F.size(f) > 1, made(f)).otherwise(f))


def dedup_array(found: Column) -> Column:
    """dedup() of the numbered issues of one block."""
    key = lambda f: F.transform(f, lambda i: F.struct(i["s"].alias("s"), i["e"].alias("e"), i["type"].alias("type"), F.lower(i["message"]).alias("low"), (-i["confidence"]).alias("c"), (-priority(i["source"])).alias("p"), i["seq"].alias("seq"), i.alias("i")))
    other = lambda x, y: (x["s"] != y["s"]) | (x["e"] != y["e"]) | ~x["type"].eqNullSafe(y["type"]) | ~x["low"].eqNullSafe(y["low"])

    def best(group: Column) -> Column:
        joined = bind(_texts(F.transform(group, lambda x: x["i"]), "suggestion"), lambda all_: F.when(F.size(all_) > 1, F.array_join(all_, "; ")))
        several = bind(group[0]["i"], lambda i: _with(i, suggestion=F.coalesce(joined, i["suggestion"])))
        return F.when(F.size(group) == 1, group[0]["i"]).otherwise(several)

    return _several(found, lambda f: _groups(F.array_sort(key(f)), other, best))


def merge_array(found: Column, near: int = 50) -> Column:
    """merge() of the numbered issues of one block."""
    key = lambda f: F.transform(f, lambda i: F.struct(i["s"].alias("s"), i["e"].alias("e"), i["seq"].alias("seq"), i.alias("i")))
    other = lambda x, y: ~F.coalesce((y["s"] <= x["e"]) & (y["i"]["type"] == x["i"]["type"]) & (y["s"] - x["s"] < near), F.lit(False))

    def joined(group: Column) -> Column:
        own = F.transform(group, lambda x: x["i"])
        best = F.array_max(F.transform(group, lambda x: F.struct(x["i"]["confidence"].alias("c"), (-x["seq"]).alias("q"), x["i"].alias("i"))))["i"]
        message = bind(_texts(own, "message"), lambda m: F.when(F.size(m) > 1, F.concat(F.lit("Multiple issues: "), F.array_join(m, "; "))))
        suggestion = bind(_texts(own, "suggestion"), lambda m: F.when(F.size(m) > 0, F.array_join(m, "; ")))
        several = bind(best, lambda i: _with(i, message=F.coalesce(message, i["message"]), suggestion=F.coalesce(suggestion, i["suggestion"]), s=group[0]["s"], e=F.array_max(F.transform(own, lambda o: o["e"]))))
        return F.when(F.size(group) == 1, group[0]["i"]).otherwise(several)

    return _several(found, lambda f: _groups(F.array_sort(key(f)), other, joined))


def dedup(issues: DataFrame, keys: list[str]) -> DataFrame:
    """One issue for each place, type and message (whatever its case) of a block: the surest, then that of the verifier
    of highest priority, then the first by seq. Different suggestions of a group are joined in order."""
    rest = [c for c in issues.columns if c not in (*keys, "s", "e", "type", "low")]
    low = issues.withColumn("low", F.lower("message"))
    rank = F.struct("confidence", priority(F.col("source")).alias("p"), (-F.col("seq")).alias("q"))
    best = low.groupBy(*keys, "s", "e", "type", "low").agg(F.max_by(F.struct(*rest), rank).alias("best"), F.array_sort(F.collect_set("suggestion")).alias("all"))
    best = best.select(*keys, "s", "e", "type", "best.*", "all")
    return best.withColumn("suggestion", F.when(F.size("all") > 1, F.array_join("all", "; ")).otherwise(F.col("suggestion"))).drop("all")


def merge(issues: DataFrame, keys: list[str], near: int = 50) -> DataFrame:
    """Joins an issue to the one before it (by place, then seq) if it begins inside that one, is of its type and begins
    less than `near` code points after it. The surest issue of a chain (then the first by seq, then by place) stands for it,
    over the whole place."""
    order = Window.partitionBy(*keys).orderBy("s", "e", "seq")
    goes_on = (F.col("s") <= F.lag("e").over(order)) & (F.col("type") == F.lag("type").over(order)) & (F.col("s") - F.lag("s").over(order) < near)
    chained = issues.withColumn("begins", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("chain", F.sum("begins").over(order)).drop("begins")
    rest = [c for c in issues.columns if c not in (*keys, "s", "e", "type")]
    merged = chained.groupBy(*keys, "chain", "type").agg(
        F.max_by(F.struct(*rest), F.struct("confidence", (-F.col("seq")).alias("q"), (-F.col("s")).alias("at"), (-F.col("e")).alias("to"))).alias("best"), F.min("s").alias("s"), F.max("e").alias("e"),
        F.array_sort(F.collect_set("message")).alias("messages"), F.array_sort(F.collect_set("suggestion")).alias("all"), F.count(F.lit(1)).alias("n_merged"),
    )
    merged = merged.select(*keys, "s", "e", "type", "best.*", "messages", "all", "n_merged")
    merged = merged.withColumn("message", F.when(F.size("messages") > 1, F.concat(F.lit("Multiple issues: "), F.array_join("messages", "; "))).otherwise(F.col("message")))
    return merged.withColumn("suggestion", F.when((F.col("n_merged") > 1) & (F.size("all") > 0), F.array_join("all", "; ")).otherwise(F.col("suggestion"))).drop("messages", "all")
