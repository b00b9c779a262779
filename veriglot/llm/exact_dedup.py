"""Exact duplicates by distributed MSD radix partitioning.

The digits are a text's length and then successive runs of its bytes, each run wider than the one before. A round
counts the rows of each (group, digit) with partial aggregation, so a hot group costs one row for each task; rows
whose group has become a singleton or has ended leave with their answer, and only the others carry the rest of their
bytes into the next round. Equality is decided by the bytes themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, text_or_empty

#: Bytes of the first digit, growth of the width from digit to digit, and the widest digit.
FIRST, GROWTH, WIDEST = 64, 32, 1 << 20


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = FIRST, growth: int = GROWTH, widest: int = WIDEST) -> DataFrame:
    """One row for each input row: id, keep_id (largest id of the group), group_size, text_sha256 (of the normalised
    text). Null texts count as empty. Rows that share an id are rows of their own and count each; a null id never is
    a keep_id unless the whole group has null ids. Very long texts take more rounds, none is cut; an empty table gives no
    rows; other columns stay behind, whatever their names."""
    text = ascii_lower(text_or_empty(text_col)).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("rest")).select("id", "rest", F.octet_length("rest").cast("long").alias("gid"), F.sha2("rest", 256).alias("sha"))
    done, at, width = [], 0, first
    while True:
        rows = rows.withColumn("digit", F.substring("rest", 1, width))
        groups = rows.groupBy("gid", "digit").agg(F.count(F.lit(1)).alias("size"), F.max("id").alias("keep")).filter("size > 1").withColumn("next", F.monotonically_increasing_id())
        groups = materialise(groups, f"radix-groups-{at}")
        ended = F.col("next").isNull() | (F.octet_length("rest") <= width)
        split = rows.join(groups.hint("merge"), ["gid", "digit"], "left").select(
            "id", "sha", F.col("next").alias("gid"), F.coalesce("size", F.lit(1)).alias("size"),
            F.when(F.col("next").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep"),
            F.when(~ended, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
        )
        split = materialise(split, f"radix-rows-{at}")
        done.append(split.filter("rest is null").select("id", "keep", "size", "sha"))
        rows = split.filter("rest is not null").select("id", "rest", "gid", "sha")
        if rows.isEmpty():
            break
        at, width = at + 1, min(width * growth, widest)
    return reduce(DataFrame.unionAll, done).select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"))
