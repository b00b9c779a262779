"""Joins of intervals that overlap, as equality joins on bins.

An interval belongs to the level whose bins are at least as long as itself, so that it lies in two bins at most. A pair
meets at the higher of its two levels: each interval shows up in its bins at its own level and at those above it that
occur, up to the longest interval's. Two bins of length 2^k cover it at each, so that neither long nor short intervals
are spread over many rows, and nothing is compared that lies further apart than the longer of the two is long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _levels(s: Column, e: Column) -> Column:
    """The exponent of the shortest power of two that is no shorter than the interval."""
    return F.ceil(F.log2(F.greatest(e - s, F.lit(1)).cast("double"))).cast("int")


def _binned(df: DataFrame, s: str, e: str, met: list[int], prefix: str) -> DataFrame:
    """A row for the interval's own level and each higher one of the other side's (met), and each bin there; empty
    intervals and null bounds go."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(f"{prefix}row")
    others = F.array(*map(F.lit, met)).cast("array<int>")
    kept = df.select(row, F.col(f"`{s}`").cast("long").alias("s"), F.col(f"`{e}`").cast("long").alias("e")).filter("s < e")
    each = kept.withColumn("own", _levels(F.col("s"), F.col("e"))).withColumn("level", F.explode(F.concat(F.array("own"), F.filter(others, lambda x: x > F.col("own")))))
    each = each.withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / F.pow(F.lit(2.0), "level")), F.floor((F.col("e") - 1) / F.pow(F.lit(2.0), "level")))))
    return each.select(f"{prefix}row", F.col("s").alias(f"{prefix}s"), F.col("e").alias(f"{prefix}e"), F.col("own").alias(f"{prefix}own"), F.col("level").alias(f"{prefix}level"), F.col("bin").alias(f"{prefix}bin"))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], left_at: tuple[str, str] = ("s", "e"), right_at: tuple[str, str] = ("s", "e")) -> DataFrame:
    """left_row, right_row (structs of all columns), from and to (the part they share) of each pair of equal keys whose
    half-open intervals overlap. Rows that repeat count each; null keys meet nothing."""
    def occurring(df: DataFrame, s: str, e: str) -> list[int]:
        """The levels of a side: at most one for each power of two that a long holds."""
        return sorted(r.m for r in df.select(_levels(F.col(f"`{s}`").cast("long"), F.col(f"`{e}`").cast("long")).alias("m")).filter("m is not null").distinct().collect())

    a, b = _binned(left, *left_at, occurring(right, *right_at), "left_"), _binned(right, *right_at, occurring(left, *left_at), "right_")
    same = (F.col("left_level") == F.col("right_level")) & (F.col("left_bin") == F.col("right_bin"))
    for k in keys:
        same = same & (F.col(f"left_row.`{k}`") == F.col(f"right_row.`{k}`"))
    start = F.greatest("left_s", "right_s")
    # at the pair's own level only, and there in the bin where the shared part begins
    once = (F.col("left_level") == F.greatest("left_own", "right_own")) & (F.floor(start / F.pow(F.lit(2.0), "left_level")) == F.col("left_bin"))
    met = a.join(b.hint("merge"), same & once & (F.col("left_s") < F.col("right_e")) & (F.col("right_s") < F.col("left_e")))
    return met.select("left_row", "right_row", start.alias("from"), F.least("left_e", "right_e").alias("to"))


def outside(found: DataFrame, spans: DataFrame, keys: list[str], id_cols: list[str]) -> DataFrame:
    """Rows of found (with s and e) that no span covers whole; id_cols tell rows apart. For issues beside whitelisted,
    ignored or code spans."""
    covered = overlaps(found, spans, keys).filter((F.col("from") == F.col("left_row.s")) & (F.col("to") == F.col("left_row.e")))
    gone = covered.select(*[F.col(f"left_row.`{c}`").alias(c) for c in id_cols]).distinct()
    return found.join(gone.hint("merge"), id_cols, "left_anti")
