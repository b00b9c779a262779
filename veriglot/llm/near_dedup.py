"""Near duplicates by circulant MinHash.

Two permutations of the 32-bit universe, the second one shifted circularly, give all coordinates of a signature;
BANDS bands of ROWS coordinates are bucket keys, and links are confirmed by the Jaccard index of full shingle sets.

Texts with equal sets are one class with one representative, so copies never form pairs. Of each bucket, every member
is compared with one leader; where a bucket then still holds members of several components, these are compared across
components: in small buckets by pairs, in large ones with further leaders and then by full sets, in blocks, of which
one link for each member and other component comes out. So no link inside a bucket goes untested unless its two ends
are connected already. Pairs get their texts only after a filter on sizes and b-bit sketches, and each round links
the components of the round before, not documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import map_slices, materialise, packed_rows, small_batches, text_or_empty, with_id

WORDS, SIMILAR = 5, (75, 100)
#: A pair of Jaccard index 0.75 shares no band with a chance of (1 - 0.75**4)**32, 5 in a million.
BANDS, ROWS = 32, 4
#: A sketch keeps 8 bits of all coordinates and of EXTRA more. Of a linked pair, fewer than LEAST agree once in 10**9.
EXTRA, LEAST = 64, 108
SKETCH = BANDS * ROWS + EXTRA
#: Buckets above this size get further leaders, and then their members' full sets are compared in blocks of BLOCK.
#: A block's members have BLOCK_SHINGLES shingles together on average, if that makes it smaller.
LARGE, BLOCK, BLOCK_SHINGLES = 16, 1500, 1_500_000
#: Columns of a pair: two ids, the smaller one first, and the components they were in when it was made.
PAIR = ("a", "b", "of_a", "of_b")


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted 64-bit hashes of a text's distinct shingles; remembers hashes of words."""

    def __init__(self, words: int = WORDS):
        import xxhash

        self.words, self.hash, self.known = words, xxhash.xxh64_intdigest, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # of bytes: A-Z only, and white space is \x20\x09-\x0D
        if len(self.known) > 400_000:
            self.known.clear()
        try:
            codes = list(map(self.known.__getitem__, words))
        except KeyError:
            for w in words:
                if w not in self.known:
                    self.known[w] = self.hash(w)
            codes = list(map(self.known.__getitem__, words))
        codes = np.array(codes, np.uint64)
        n = min(self.words, len(codes))
        if not n:
            return codes
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            h = _mix64(h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(h)])
        return np.unique(h)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Minima of each non-empty set under the second permutation, shifted by 1, 2, ... coordinates. The first one is
    the mixing that made the hashes."""
    flat = np.concatenate(sets)
    flat = (flat >> np.uint64(32)).astype(np.uint32)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    out = np.empty((len(sets), coordinates), np.uint32)
    first = 0
    while first < len(sets):  # about 64k values at a time stay in the cache
        last = max(first + 1, int(np.searchsorted(begin, begin[first] + 65536, side="right")) - 1)
        x, starts = flat[begin[first] : begin[last]], begin[first:last] - begin[first]
        y, z = np.empty_like(x), np.empty_like(x)
        for k in range(coordinates):
            np.add(x, np.uint32((k + 1) * 0x9E3779B1 & 0xFFFFFFFF), out=y)
            np.multiply(y, np.uint32(0x85EBCA6B), out=y)
            np.right_shift(y, np.uint32(15), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, np.uint32(0xC2B2AE35), out=y)
            out[first:last, k] = np.minimum.reduceat(y, starts)
        first = last
    return out


def _profile(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, set_hash, bands and sketch of each row; the last three are null for texts without words."""

    def start():
        shingles = Shingler()
        salts = np.arange(BANDS, dtype=np.uint64)

        def columns(batch: pa.RecordBatch) -> list:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            hashes, bands, sketch = ([None] * len(sets) for _ in range(3))
            if full:
                sig = signatures([sets[i] for i in full], SKETCH)
                keys = np.broadcast_to(salts, (len(full), BANDS)).copy()
                for r in range(ROWS):
                    keys = _mix64(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, r : BANDS * ROWS : ROWS])
                low = (sig >> np.uint32(24) ^ sig).astype(np.uint8)
                for i, k, s in zip(full, keys.view(np.int64), low, strict=True):
                    hashes[i], bands[i], sketch[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), k, s.tobytes()
            return [batch.column(0), [len(s) for s in sets], hashes, bands, sketch]

        return columns

    return map_slices(docs.select(F.col(id_col), text_or_empty(text_col)), with_id(docs, id_col, "n_shingles bigint, set_hash binary, bands array<bigint>, sketch binary", "id"), 1, start)


def _promising(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Of distinct pairs those whose sizes and sketches allow a link."""
    for side in "ab":
        theirs = sketches.select(F.col("id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
        pairs = pairs.join(theirs.hint("merge"), side)
    share, of = SIMILAR
    sizes = F.least("n_a", "n_b") * of >= F.greatest("n_a", "n_b") * share

    def start():
        def columns(batch: pa.RecordBatch) -> list:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH) for k in (4, 5))
            keep = pa.array((x == y).sum(1) >= LEAST)
            return [batch.column(k).filter(keep) for k in range(4)]

        return columns

    return map_slices(pairs.filter(sizes).select(*PAIR, "sketch_a", "sketch_b"), pairs.select(*PAIR).schema, None, start)


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of distinct pairs those whose shingle sets are similar enough."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b").select(*PAIR, "text_a", "text_b")
    share, of = SIMILAR

    def start():
        shingles = Shingler()
        last: tuple[str, np.ndarray] = ("", np.zeros(0, np.uint64))

        def columns(batch: pa.RecordBatch) -> list:
            nonlocal last
            linked = []
            for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if y != last[0]:
                    last = (y, shingles(y))
                p, q = shingles(x), last[1]
                same = len(p) + len(q) - len(np.union1d(p, q))
                linked.append(of * same >= share * (len(p) + len(q) - same))
            keep = pa.array(linked, pa.bool_())
            return [batch.column(k).filter(keep) for k in range(4)]

        return columns

    return map_slices(both, pairs.select(*PAIR).schema, (4, 5), start)


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ends of links (a, b): each takes the smallest label among its neighbours' and its own,
    then that label's own label, until nothing changes."""
    edges = materialise(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = edges.join(labels.hint("merge"), edges["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near.hint("merge"), labels["id"] == near["a"], "left").select("id", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("jumped"))
        step = materialise(step.join(jump.hint("merge"), "next", "left").select("id", "component", F.least("next", "jumped").alias("next")), "labels")
        labels = step.select("id", F.col("next").alias("component"))
        if step.filter("component <> next").isEmpty():
            return labels


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, component) of all ids after links between components."""
    found = components(links.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()).select(F.col("id").alias("component"), F.col("component").alias("now"))
    return materialise(labels.join(found.hint("merge"), "component", "left").select("id", F.coalesce("now", "component").alias("component")), "components")


def _open_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of buckets that hold several components, with their component and the bucket's size."""
    rows = rows.select("id", "n_shingles", "key").join(labels.hint("merge"), "id")
    per = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("load"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    per = materialise(per, "open-buckets")  # as a table of its own, so that a hot bucket's partition can be split
    return materialise(rows.join(per.select("key", "size", "load").hint("merge"), "key"), "open")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs of the columns x, y and of_x, of_y."""
    up = F.col("x") < F.col("y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(up, F.col("of_x")).otherwise(F.col("of_y")).alias("of_a"), F.when(up, F.col("of_y")).otherwise(F.col("of_x")).alias("of_b")).distinct()


def _star(rows: DataFrame, further: bool = False) -> DataFrame:
    """Each member with its bucket's leader, if both are of different components: the member of smallest id, or, as
    further leaders, the one that is in most of these buckets and the one of smallest hash."""
    ranks = {"first": F.struct("id", "component")}
    if further:
        rows = rows.join(rows.groupBy("id").agg((-F.count(F.lit(1))).alias("degree")).hint("merge"), "id")
        ranks = {"most": F.struct("degree", "id", "component"), "drawn": F.struct(F.xxhash64(F.lit(2), "id"), "id", "component")}
    leaders = rows.groupBy("key").agg(*[F.min(r).alias(name) for name, r in ranks.items()])
    leaders = leaders.select("key", F.array_distinct(F.array(*[F.struct(f"{name}.id", f"{name}.component") for name in ranks])).alias("leaders"))
    met = rows.join(materialise(leaders, "leaders").hint("merge"), "key").select("id", "component", F.explode("leaders").alias("leader"))
    return _ordered(met.filter("component <> leader.component").select(F.col("id").alias("x"), F.col("leader.id").alias("y"), F.col("component").alias("of_x"), F.col("leader.component").alias("of_y")))


def _sets(texts: DataFrame) -> DataFrame:
    """id and its sorted shingle hashes as bytes."""

    def start():
        shingles = Shingler()
        return lambda batch: [batch.column(0), [shingles(t).tobytes() for t in batch.column(1).to_pylist()]]

    return map_slices(texts.select("id", "text"), with_id(texts, "id", "payload binary"), 1, start)


def _allowed(n: np.ndarray, m: int) -> np.ndarray:
    share, of = SIMILAR
    return of * np.minimum(n, m) >= share * np.maximum(n, m)


def similar_sketches(i: int, j: int, block: np.ndarray, ids: np.ndarray, comp: np.ndarray, n: np.ndarray, payload: list[bytes]) -> list[tuple]:
    """Pairs of a bucket across components whose sizes and sketches allow a link."""
    sketch, out = np.frombuffer(b"".join(payload), np.uint8).reshape(len(ids), SKETCH), []
    for p in range(len(ids)):
        may = np.flatnonzero((comp != comp[p]) & (ids > ids[p]) & _allowed(n, n[p]))
        may = may[(sketch[may] == sketch[p]).sum(1) >= LEAST]
        out += [(ids[p], ids[q], comp[p], comp[q]) for q in may]
    return out


def links_in_blocks(i: int, j: int, block: np.ndarray, ids: np.ndarray, comp: np.ndarray, n: np.ndarray, payload: list[bytes]) -> list[tuple]:
    """Of blocks i and j of a bucket (or of one block), a link for each member outside their most common component and
    each component that it links to. Intersections are counted over an index of all shingles."""
    values, size = np.unique(comp, return_counts=True)
    outside = np.flatnonzero(comp != values[size.argmax()])
    if not len(outside):
        return []
    sets = [np.frombuffer(x, np.uint64) for x in payload]
    shingle, owner = np.concatenate(sets), np.repeat(np.arange(len(ids)), [len(x) for x in sets])
    order = np.argsort(shingle, kind="stable")
    owner, (known, first, count) = owner[order], np.unique(shingle[order], return_index=True, return_counts=True)
    share, of = SIMILAR
    out = []
    for p in outside:
        at = np.searchsorted(known, sets[p])
        places = np.repeat(first[at] - np.append(0, np.cumsum(count[at])[:-1]), count[at]) + np.arange(count[at].sum())
        same = np.bincount(owner[places], minlength=len(ids))
        linked = (comp != comp[p]) & (of * same >= share * (n + n[p] - same)) & ((block != block[p]) | (i == j))
        hit = np.flatnonzero(linked)
        for q in hit[np.unique(comp[hit], return_index=True)[1]]:
            out.append((ids[p], ids[q], comp[p], comp[q]))
    return out


def _in_buckets(rows: DataFrame, payload: DataFrame, compare) -> DataFrame:
    """Pairs that compare() finds in each bucket of rows, or in each pair of its blocks; payload: id and bytes."""
    rows = rows.join(payload.hint("merge"), "id")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.least(F.col("size"), F.ceil(F.col("load") / BLOCK_SHINGLES))).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "id"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component", "n_shingles", "payload")

    names = ["x", "y", "of_x", "of_y"]

    def run(batches):
        """Bucket after bucket: rows come sorted, and a bucket may go on in the next batch."""
        held: list[pa.Table] = []

        def done() -> pa.RecordBatch:
            table = pa.concat_tables(held)
            found = compare(table.column("i")[0].as_py(), table.column("j")[0].as_py(), *(table.column(c).to_numpy() for c in ("block", "id", "component", "n_shingles")), table.column("payload").to_pylist())
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], table.schema.field("id").type) for k in range(4)], names)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")], 1)
            cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if held and any(held[-1].column(c)[0].as_py() != table.column(c)[int(a)].as_py() for c in ("key", "i", "j")):
                    yield done()
                    held = []
                held.append(table.slice(int(a), int(b - a)))
        if held:
            yield done()

    small_batches(rows.sparkSession)
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return _ordered(dealt.mapInArrow(run, StructType([StructField(name, rows.schema["id"].dataType) for name in names])))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable over links, itself included) and kept for each row. Null and
    wordless texts have no shingle and no link. Rows that share an id are one node; rows with a null id take no part
    and keep a null component. Texts of any length count whole; an empty table gives none."""
    profile = materialise(_profile(docs, id_col, text_col), "profile")
    classes = materialise(profile.filter("id is not null and set_hash is not null").groupBy("set_hash").agg(F.min("id").alias("rep")), "classes")
    ids = classes.select(F.col("rep").alias("id")).distinct()
    reps = profile.join(ids.hint("merge"), "id", "left_semi")
    rows = reps.select("id", "n_shingles", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    shared = materialise(shared, "shared")
    rows = materialise(rows.join(shared.hint("merge"), "key").select("id", "n_shingles", "key", F.col("id").alias("component")), "buckets")
    labels = materialise(rows.select("id").distinct().withColumn("component", F.col("id")), "candidates")
    wanted = labels.select("id").hint("merge")
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(wanted, "id", "left_semi")
    texts = materialise(texts, "candidate-texts")
    sketches = reps.select("id", "n_shingles", "sketch").join(wanted, "id", "left_semi").dropDuplicates(["id", "sketch"])
    sketches = materialise(sketches, "sketches")
    pairs = materialise(_promising(_star(rows), sketches), "pairs")
    tried = pairs.select("a", "b")
    labels = _merged(labels, materialise(_confirm(pairs, texts), "links"))
    rows = _open_rows(rows, labels)
    many = rows.filter(F.col("size") > LARGE)
    if not many.isEmpty():
        more = _promising(_star(many, further=True), sketches).join(tried.hint("merge"), ["a", "b"], "left_anti").select(*PAIR)
        more = materialise(more, "pairs")
        tried = tried.unionAll(more.select("a", "b"))
        links = materialise(_confirm(more, texts), "links")
        if not links.isEmpty():
            labels = _merged(labels, links)
            rows = _open_rows(rows, labels)
    pairs = _in_buckets(rows.filter(F.col("size") <= LARGE), sketches.select("id", F.col("sketch").alias("payload")), similar_sketches)
    pairs = materialise(pairs.join(tried.hint("merge"), ["a", "b"], "left_anti").select(*PAIR), "pairs")
    links = materialise(_confirm(pairs, texts), "links")
    large = rows.filter(F.col("size") > LARGE)
    if not large.isEmpty():
        sets = materialise(_sets(texts.join(large.select("id").distinct().hint("merge"), "id", "left_semi")), "sets")
        links = links.unionAll(materialise(_in_buckets(large, sets, links_in_blocks), "links"))
    if not links.isEmpty():
        labels = _merged(labels, links)
    home = classes.join(labels.hint("merge"), classes["rep"] == labels["id"], "left").select("set_hash", F.coalesce("component", "rep").alias("component"))
    # rows that share an id link the classes of their texts
    reach = profile.select("id", "set_hash").filter("id is not null and set_hash is not null").distinct()
    doubled = reach.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    bridges = materialise(reach.join(doubled.hint("merge"), "id").join(home.hint("merge"), "set_hash").select("id", "component"), "bridges")
    if not bridges.isEmpty():
        low = bridges.groupBy("id").agg(F.min("component").alias("a"))
        found = components(bridges.join(low.hint("merge"), "id").filter("component <> a").select("a", F.col("component").alias("b")).distinct())
        found = found.select(F.col("id").alias("component"), F.col("component").alias("now"))
        home = home.join(found.hint("merge"), "component", "left").select("set_hash", F.coalesce("now", "component").alias("component"))
    out = profile.join(home.hint("merge"), "set_hash", "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their group, with all their columns, whatever their names. Rows
    with a null id, and rows without words, stay; rows that repeat an id that stays all stay."""
    groups = near_groups(docs, id_col, text_col).filter("not kept").select(F.col(id_col).alias("lost")).distinct()
    return packed_rows(docs, text_col).join(groups.hint("merge"), F.col(f"doc.{id_col}") == F.col("lost"), "left_anti").select("doc.*")
