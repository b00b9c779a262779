"""A manifest of a table as a Merkle tree, and proofs looked up by coordinates.

Rows are leaves; the leaves of a group (a source) make a tree whose nodes have three children, and the groups' roots make
the tree above. Nodes are kept in a table by group, height and index. A leaf knows from its index and its group's size
which siblings its proof needs: it explodes their coordinates, joins the node table, and orders and concatenates what
comes back. Folding a digest with a proof gives the root that the digest stands for.

Leaves are numbered by a sort of the whole table and the sizes of its partitions, so that a source with a third of all
rows is spread over many tasks. Trees grow in rounds of five heights, by blocks of 243 neighbours. Proofs go down the same
rounds: items look up their siblings inside their block only and take the rest of the proof from the block, once for each
block. No key meets more than 243 rows, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Children of a node; heights of a round; items of its blocks.
FAN, HEIGHTS = 3, 5
ITEMS = FAN**HEIGHTS
#: A proof: at each height, the digests left and right of the folded one, as hex text.
STEPS = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts' concatenation, as lowercase hex."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*map(encoded, values))


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(steps, start, lambda a, s: F.sha2(F.concat(s["left"], a, s["right"]).cast("binary"), 256))


def proof_digest(steps: Column) -> Column:
    """SHA-256 of a proof's digests, height by height, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def _parents(nodes: Column) -> Column:
    """Digests (binary) of successive groups of three."""
    groups = F.sequence(F.lit(0), ((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(groups, lambda i: F.unhex(F.sha2(F.array_join(F.transform(F.slice(nodes, FAN * i + 1, FAN), _hex), "").cast("binary"), 256)))


def _sorted(rows: DataFrame, by: list[Column], name: str) -> DataFrame:
    """rows as a table in order, with part (a number that grows along the order) and at (likewise, inside a part too)."""
    ordered = rows.orderBy(*by).withColumn("at", F.monotonically_increasing_id())
    return materialise(ordered, name).withColumn("part", F.shiftright("at", 33))


def _numbered(docs: DataFrame, group: str, order: str, leaf_of: Column, carried: dict[str, Column]) -> tuple[DataFrame, int]:
    """Leaves as a table: g (the group's number, from 0, in order), idx (inside it), n (its size), digest, id, carried. And
    the number of groups."""
    rows = docs.select(F.col(f"`{group}`").alias("key"), F.col(f"`{order}`").alias("id"), F.unhex(leaf_of).alias("digest"), F.monotonically_increasing_id().alias("row"), *[c.alias(k) for k, c in carried.items()])
    rows = _sorted(materialise(rows, "merkle-rows"), [F.asc_nulls_first("key"), F.asc_nulls_first("id"), F.asc("digest"), F.asc("row")], "merkle-sorted")
    pieces = materialise(rows.groupBy("key", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows")), "merkle-pieces")
    groups = _sorted(pieces.groupBy("key").agg(F.sum("rows").alias("n")), [F.asc_nulls_first("key")], "merkle-groups")
    # one row for each partition of the sort: at most as many as there are shuffle partitions
    parts = groups.groupBy("part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.join(F.broadcast(parts.select("part", (before - F.col("first")).alias("shift"))), "part").select(F.col("key").alias("k"), "n", (F.col("at") + F.col("shift")).alias("g"))
    earlier = F.coalesce(F.sum("rows").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.select("key", "part", (earlier - F.col("first")).alias("shift")).join(groups.hint("merge"), F.col("key").eqNullSafe(F.col("k"))).select(F.col("key").alias("k"), F.col("part").alias("p"), "g", "n", "shift")
    leaves = rows.join(placed.hint("merge"), F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")))
    leaves = materialise(leaves.select("g", (F.col("at") + F.col("shift")).alias("idx"), "n", "digest", "id", *carried), "merkle-leaves")
    return leaves, groups.count()


def _nodes(items: DataFrame) -> DataFrame:
    """The node table of a round over items (g, idx, n, digest): g, h (height in this round), idx, digest, n (of the items),
    top (whether it is the block's root)."""
    blocks = items.groupBy("g", F.expr(f"idx div {ITEMS}").alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("items"))

    def grow(levels: list[Column], h: int) -> Column:
        if h == HEIGHTS:
            return F.array(*levels)
        none = F.expr("cast(array() as array<binary>)")
        return _let(F.when(F.col("n") > FAN**h, _parents(levels[-1])).otherwise(none), lambda up: grow([*levels, up], h + 1))

    levels = blocks.select("g", "block", "n", _let(F.transform("items", lambda x: x["digest"]), lambda x: grow([x], 0)).alias("levels"))
    heights = levels.select("g", "block", "n", F.posexplode("levels").alias("h", "nodes"))
    span = F.element_at(F.array(*[F.lit(FAN ** (HEIGHTS - h)) for h in range(HEIGHTS + 1)]), F.col("h") + 1)
    each = heights.select("g", "block", "n", "h", F.posexplode("nodes").alias("i", "digest"))
    last = F.aggregate(F.array(*[F.lit(FAN**h) for h in range(HEIGHTS)]), F.lit(0), lambda a, x: a + (F.col("n") > x).cast("int"))
    return each.select("g", "h", (F.col("block") * span + F.col("i")).alias("idx"), "digest", "n", (F.col("h") == last).alias("top"))


def _place(h: int, k: int) -> Column:
    """Child k of the node that the item's node of height h is a child of."""
    return F.expr(f"idx div {FAN ** (h + 1)} * {FAN} + {k}")


def _is_sibling(h: int, k: int) -> Column:
    return (_place(h, k) != F.expr(f"idx div {FAN**h}")) & (_place(h, k) * FAN**h < F.col("n"))


def _paths(items: DataFrame, nodes: DataFrame, above: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """The proofs of items: their steps in this round, then those of their blocks, from above (g, idx, steps, top).
    Columns g, idx, steps, top and more of the items."""
    siblings = F.array(*[F.when(_is_sibling(h, k), F.struct(F.lit(h).alias("h"), _place(h, k).alias("at"))) for h in range(HEIGHTS) for k in range(FAN)])
    wanted = items.select("g", F.col("idx").alias("of"), F.inline(F.array_compact(siblings)))
    found = wanted.join(nodes.select("g", "h", F.col("idx").alias("at"), "digest").hint("merge"), ["g", "h", "at"])
    proofs = found.groupBy(F.col("g").alias("pg"), "of").agg(F.sort_array(F.collect_list(F.struct("h", "at", "digest"))).alias("siblings"))
    mine = items.join(proofs.hint("merge"), (F.col("g") == F.col("pg")) & (F.col("idx") == F.col("of")), "left").select("g", "idx", "n", "siblings", *more)

    def side(h: int, left: bool) -> Column:
        at = F.expr(f"idx div {FAN**h}")
        return F.array_join(F.transform(F.filter("siblings", lambda x: (x["h"] == h) & ((x["at"] < at) if left else (x["at"] > at))), lambda x: _hex(x["digest"])), "")

    steps = F.filter(F.array(*[F.when(F.col("n") > FAN**h, F.struct(F.coalesce(side(h, True), F.lit("")).alias("left"), F.coalesce(side(h, False), F.lit("")).alias("right"))) for h in range(HEIGHTS)]), lambda s: s.isNotNull())
    up = above.select(F.col("g").alias("ag"), F.col("idx").alias("block"), F.col("steps").alias("rest"), "top")
    mine = mine.select("g", "idx", steps.alias("steps"), F.expr(f"idx div {ITEMS}").alias("b"), *more)
    return mine.join(up.hint("merge"), (F.col("g") == F.col("ag")) & (F.col("b") == F.col("block"))).select("g", "idx", F.concat("steps", "rest").alias("steps"), "top", *more)


def _grown(items: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """Rounds (items, nodes) up to one item for each group; the groups' roots (g, idx, n, digest)."""
    rounds = []
    while (items.agg(F.max("n")).first()[0] or 0) > 1:
        nodes = materialise(_nodes(items), f"merkle-nodes-{len(rounds)}")
        rounds.append((items, nodes))
        items = nodes.filter("top").select("g", "idx", F.ceil(F.col("n") / ITEMS).cast("long").alias("n"), "digest")
    return rounds, items


def _descend(rounds: list[tuple[DataFrame, DataFrame]], above: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Proofs of the first round's items; more are columns of these."""
    for i in range(len(rounds) - 1, -1, -1):
        above = _paths(*rounds[i], above, more if i == 0 else ())
        above = above if i == 0 else materialise(above, f"merkle-proofs-{i}")
    return above


def manifest(docs: DataFrame, leaf_of: Column, group_col: str = "source", order_col: str = "doc_id", carried: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of docs: order_col, leaf, subroot (of its group), root, steps (its proof) and the carried
    columns, which are computed together with the leaf. leaf_of is the leaf's digest as hex text, e.g. by leaf().

    Groups are ordered by their value, null first, the leaves of a group by order_col, null first, then by digest, so that
    repeated rows are leaves of their own. A lone leaf is its group's root, a lone group's root the root of all. Very long
    texts are hashed whole in their row. An empty table gives no rows. Other columns stay behind, whatever their names."""
    carried = {f"carried_{k}": c for k, c in (carried or {}).items()}
    leaves, n_groups = _numbered(docs, group_col, order_col, leaf_of, carried)
    rounds, roots = _grown(leaves)
    subroots = materialise(roots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), F.lit(n_groups).cast("long").alias("n"), "digest"), "merkle-subroots")
    upper, top = _grown(subroots)
    root = top.select(_hex(F.col("digest")).alias("root")).first()
    start = top.select("g", "idx", F.expr(f"cast(array() as {STEPS})").alias("steps"), F.lit(None).cast("binary").alias("top"))
    start = materialise(_descend(upper, start, ("digest",)) if upper else subroots.select("g", "idx", F.expr(f"cast(array() as {STEPS})").alias("steps"), "digest"), "merkle-upper")
    start = start.select(F.col("idx").alias("g"), F.lit(0).cast("long").alias("idx"), "steps", F.col("digest").alias("top"))
    more = ("digest", "id", *carried)
    if rounds:
        proved = _descend(rounds, start, more)
    else:  # every group is a lone leaf
        proved = leaves.join(start.hint("merge"), ["g", "idx"])
    return proved.select(F.col("id").alias(order_col), _hex(F.col("digest")).alias("leaf"), _hex(F.col("top")).alias("subroot"), F.lit(root and root["root"]).cast("string").alias("root"), "steps", *[F.col(k).alias(k.removeprefix("carried_")) for k in carried])
