"""Approximate nearest neighbours by largest inner product: an inverted file of coarse centroids with
product-quantised residuals, asymmetric distance tables and exact reranking.

Centroids and codebooks are fitted on a sample of bounded size; every row is indexed. The share of cells to probe is
set at fit time so that the sample's own neighbours are found with the wanted recall. Rows go to blocks of bounded
size: small cells share a block, large ones (a vector that very many rows have) are spread over several. A query goes
to the blocks of its cells, which hold only codes, and comes back with its best rows by asymmetric distance. The best
of all its blocks, RERANK rows a query, are one shortlist; only these meet the query again, as whole vectors.

The index works on single precision, so rows are divided by a power of two near their median length, and each query by
one near its largest component, neither of which changes a query's order. Rows whose lengths differ from the median by
more than 2^8 are indexed by themselves, in classes that each span a factor of 2^16 (one class in ordinary tables, about
130 if every magnitude of a double occurs); a query's nearest are then the best of all classes by their exact scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import drawn, map_slices, materialise, small_batches, with_id

#: Rows to fit on and cells, at most; sub-vectors and codes of each; rows of a block and queries compared with it at a
#: time; rows on a query's shortlist; recall wanted of the probed cells.
SAMPLE, CELLS, PARTS, CODES, BLOCK, QUERIES, RERANK, RECALL = 20_000, 4096, 32, 256, 4096, 256, 100, 0.97
#: Powers of two that the lengths of a class of rows span.
MAGNITUDES = 16
#: A row that a block proposes: its id, a hash of its vector, its asymmetric distance.
FOUND = np.dtype([("id", "<i8"), ("copy", "<i8"), ("score", "<f4")])


@dataclass
class Index:
    centroids: np.ndarray
    scales: np.ndarray  # of residuals in each cell: dense cells are quantised as finely as their rows lie
    codebooks: np.ndarray
    probes: int

    @property
    def edges(self) -> np.ndarray:
        return np.linspace(0, self.centroids.shape[1], len(self.codebooks) + 1).astype(int)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centroids)

    def codes(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        rest, e = (x - self.centroids[cells]) / self.scales[cells, None], self.edges
        return np.stack([_nearest(rest[:, a:b], book[:, : b - a]) for book, a, b in zip(self.codebooks, e, e[1:], strict=False)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query's sub-vectors with all codes: queries x parts x codes."""
        e = self.edges
        return np.stack([q[:, a:b] @ book[:, : b - a].T for book, a, b in zip(self.codebooks, e, e[1:], strict=False)], 1)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        order = np.argsort(own, kind="stable")
        used, first, n = np.unique(own[order], return_index=True, return_counts=True)
        c[used] = np.add.reduceat(x[order], first) / n[:, None]
    return c


def fit(sample: np.ndarray, rows: int, k: int = 20, recall: float = RECALL, seed: int = 3) -> Index:
    """sample: float32 rows of a table of `rows` rows; the number of cells is its square root."""
    rng, sample = np.random.default_rng(seed), np.unique(sample, axis=0)  # copies of a vector would count as its neighbours
    centroids = _kmeans(sample, int(min(max(1, np.sqrt(rows)), CELLS, len(sample))), rng)
    index = Index(centroids, np.ones(len(centroids), np.float32), np.zeros((min(PARTS, sample.shape[1]), 0, 0), np.float32), len(centroids))
    own = index.cells(sample)
    rest, e = sample - centroids[own], index.edges
    spread = (rest * rest).sum(1)
    mean = np.bincount(own, spread, len(centroids)) / np.maximum(1, np.bincount(own, minlength=len(centroids)))
    index.scales = np.sqrt(np.where(mean > 1e-12, mean, max(float(spread.mean()), 1e-12))).astype(np.float32)
    rest = rest / index.scales[own, None]
    width, books = max(np.diff(e)), []
    for a, b in zip(e, e[1:], strict=False):
        book = _kmeans(rest[:, a:b], CODES, rng, 6)
        books.append(np.pad(book, ((0, 0), (0, width - (b - a)))))
    index.codebooks = np.stack(books)
    asked = sample[:: max(1, len(sample) // 256)]
    near = np.argsort(-(asked @ sample.T), 1)[:, 1 : k + 1]
    order = np.argsort(-(asked @ centroids.T), 1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None].repeat(len(asked), 0), 1)
    needed = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    index.probes = int(needed[min(len(needed) - 1, int(recall * len(needed)))]) + 1 if len(needed) else len(centroids)
    return index


def _among_copies(copy: np.ndarray) -> np.ndarray:
    """How many equal values come before each."""
    order = np.argsort(copy, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(copy[order]) != 0)) if len(copy) else np.zeros(0, np.int64)
    out = np.empty(len(copy), np.int64)
    out[order] = np.arange(len(copy)) - np.repeat(first, np.diff(np.append(first, len(copy))))
    return out


class CodedBlock:
    """Rows of a block by their codes. Of equal vectors, only the first k besides the query's own can be found."""

    def __init__(self, index: Index, ids: np.ndarray, cells: np.ndarray, codes: np.ndarray, copy: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")  # equal distances then keep the order of ids
        order = order[_among_copies(copy[order]) <= k]
        self.index, self.ids, self.cells, self.codes, self.copy = index, ids[order], cells[order], codes[order], copy[order]

    def propose(self, q_ids: np.ndarray, q: np.ndarray, probed: np.ndarray, most: int) -> list[bytes]:
        """Of each query (float32 rows of q; probed: queries x cells) the `most` best rows as FOUND records."""
        tables = np.ascontiguousarray(self.index.tables(q).transpose(1, 2, 0))
        toward, probed = np.ascontiguousarray((q @ self.index.centroids.T).T), np.ascontiguousarray(probed.T)
        near = np.empty((len(self.ids), len(q)), np.float32)
        for a in range(0, len(self.ids), 256):  # what is summed up stays in the cache
            cells, codes = self.cells[a : a + 256], self.codes[a : a + 256]
            total = tables[0][codes[:, 0]]
            for m in range(1, codes.shape[1]):
                total += tables[m][codes[:, m]]
            near[a : a + 256] = np.where(probed[cells], toward[cells] + self.index.scales[cells, None] * total, -np.inf)
        near = np.ascontiguousarray(near.T)
        near[q_ids[:, None] == self.ids[None]] = -np.inf
        least = np.partition(near, -most, axis=1)[:, -most] if near.shape[1] > most else np.full(len(q), -np.inf, np.float32)
        out = []
        for row, limit in zip(near, least, strict=True):
            at = np.flatnonzero((row >= limit) & (row > -np.inf))
            if len(at) > most:
                above = row[at] > limit
                at = np.sort(np.append(at[above], at[~above][: most - above.sum()]))
            found = np.empty(len(at), FOUND)
            found["id"], found["copy"], found["score"] = self.ids[at], self.copy[at], row[at]
            out.append(found.tobytes())
        return out


def shortlist(found: np.ndarray, k: int, most: int) -> np.ndarray:
    """Places in found (FOUND records of all blocks) of the `most` best by distance, ties to smaller ids; of equal
    vectors the first k + 1 only, so that copies don't crowd out the rest."""
    order = np.lexsort((found["id"], -found["score"]))
    return order[_among_copies(found["copy"][order]) <= k][:most]


ROW = "block int, asks boolean, id bigint, cell int, codes binary, copy bigint, v array<double>, wanted binary"


def _in_blocks(held: DataFrame, asking: DataFrame, schema: str, prepare: Callable[[pa.Table], Callable[[pa.Table], list]]) -> DataFrame:
    """Rows of a block, of bounded number, meet the queries that come to it, QUERIES at a time: both are dealt out by
    block and sorted so that rows come first. prepare(rows) returns the function from queries to output columns."""
    out = [f.name for f in StructType.fromDDL(schema)]
    fields = [f for f in StructType.fromDDL(ROW)]

    def shaped(df: DataFrame, asks: bool) -> DataFrame:
        df = df.withColumn("asks", F.lit(asks))
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, ready = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            key = table.column("block").to_numpy().astype(np.int64) * 2 + table.column("asks").to_numpy()
            cuts = np.flatnonzero(np.diff(key)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if key[a] // 2 != block:
                    block, rows, ready = key[a] // 2, [], None
                part = table.slice(a, b - a)
                if not key[a] % 2:
                    rows.append(part)
                elif rows:
                    ready = ready or prepare(pa.concat_tables(rows))
                    for i in range(0, part.num_rows, QUERIES):
                        yield pa.RecordBatch.from_arrays(ready(part.slice(i, QUERIES)), out)

    small_batches(held.sparkSession)
    both = shaped(held, False).unionAll(shaped(asking, True))
    return both.repartition("block").sortWithinPartitions("block", "asks", "id").mapInArrow(run, schema)


def deal_cells(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each cell and how many blocks it has: up to BLOCK rows each, small cells together."""
    first, parts, block, held = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // BLOCK)), 0, 0
    for cell, n in enumerate(counts.tolist()):
        if held and held + n > BLOCK:
            block, held = block + 1, 0
        first[cell] = block
        block, held = block + int(parts[cell]) - 1, held + n if parts[cell] == 1 else BLOCK
    return first, parts


def probe(index: Index, q: np.ndarray, counts: np.ndarray, least: int) -> list[np.ndarray]:
    """Cells that each query looks into: index.probes, or more until they hold `least` rows."""
    near = np.argsort(-(q @ index.centroids.T), axis=1)
    reach = (counts[near].cumsum(1) < least).sum(1) + 1
    return [order[: max(index.probes, n)] for order, n in zip(near, reach.tolist(), strict=True)]


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (array<double>) of rows that take part: no null id, vector or component, all finite, not zero, and as
    long as most vectors are (ties: the shorter)."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    ok = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    v = v.filter(F.col("id").isNotNull() & F.coalesce(ok, F.lit(False)))
    size = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.filter(F.size("v") == (size.n if size else 0))


def log_length(v: Column) -> Column:
    """The binary logarithm of a vector's length, whatever its components' magnitude."""
    plain = F.aggregate(v, F.lit(0.0), lambda a, c: a + c * c)
    top = F.array_max(F.transform(v, F.abs))
    scaled = F.log2(top) + F.log2(F.aggregate(v, F.lit(0.0), lambda a, c: a + (c / top) * (c / top))) / 2
    return F.when(plain.between(1e-200, 1e200), F.log2(plain) / 2).otherwise(scaled)


def _small(x: np.ndarray, exponent: int) -> np.ndarray:
    """Rows of a class in single precision, divided by 2^exponent."""
    return np.ldexp(x, -exponent).astype(np.float32)


def _asking(q: np.ndarray) -> np.ndarray:
    """Queries in single precision, each divided by the power of two next to its largest component."""
    return np.ldexp(q, -np.frexp(np.abs(q).max(1, keepdims=True))[1]).astype(np.float32)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id and score (inner product in double precision on the original vectors) of the k nearest
    rows found for each query row, nearest first, ties to smaller ids; is_query is a condition on id. Rows that share a
    query's id are its own and no candidates; other rows of a repeated id are candidates of their own, and a query id
    that repeats asks once, with the smallest of its vectors. With fewer than k candidates all come out. Any finite magnitude is searched; a score that overflows is infinite, and one
    that has both infinities in it comes last. Rows that
    don't take part (see _clean) neither ask nor are found; without rows nothing comes out."""
    rows = materialise(_clean(vectors, id_col, vector_col).withColumn("size", log_length(F.col("v"))), "vectors")
    queries = materialise(rows.filter(is_query).groupBy("id").agg(F.min("v").alias("v")), "queries")
    middle = rows.agg(F.percentile_approx("size", 0.5)).first()[0]
    if middle is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.withColumn("class", F.floor((F.col("size") - middle) / MAGNITUDES + 0.5).cast("int"))
    scored = []
    for r in rows.groupBy("class").count().orderBy("class").collect():  # a row for each class, of which doubles allow about 130
        part = rows.filter(F.col("class") == r["class"]).select("id", "v")
        scored.append(_scored(part, queries, r["count"], round(middle + r["class"] * MAGNITUDES), k, sample, rerank))
    order = Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id")
    return reduce(DataFrame.unionAll, scored).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scored(rows: DataFrame, queries: DataFrame, total: int, exponent: int, k: int, sample: int, rerank: int) -> DataFrame:
    """query_id, vec_id and score of what the index of one class of rows (of lengths near 2^exponent) finds."""
    picked = drawn(rows, total, sample).limit(2 * sample).toPandas()
    index = fit(_small(np.stack(picked["v"].to_numpy()), exponent), total, k)
    dims, spark = index.centroids.shape[1], rows.sparkSession

    def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return np.asarray(column.flatten(), np.float64).reshape(-1, dims)

    def place():
        def columns(batch: pa.RecordBatch) -> list:
            x = _small(matrix(batch.column(1)), exponent)
            cells = index.cells(x)
            return [batch.column(0), batch.column(1), cells, [c.tobytes() for c in index.codes(x, cells)]]

        return columns

    placed = map_slices(rows, with_id(rows, "id", "v array<double>, cell int, codes binary"), None, place)
    placed = materialise(placed.withColumns({"copy": F.xxhash64("v"), "row": F.monotonically_increasing_id()}), "placed")
    counts = np.zeros(len(index.centroids), np.int64)
    for r in placed.groupBy("cell").count().collect():  # a row for each cell, CELLS at most
        counts[r.cell] = r["count"]
    first, parts = deal_cells(counts)
    where = spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in np.flatnonzero(counts).tolist()], "cell int, first int, parts int")
    dealt = placed.join(F.broadcast(where), "cell").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("row"), "parts")).cast("int"))

    def ask():
        def columns(batch: pa.RecordBatch) -> list:
            out: tuple[list, list, list] = ([], [], [])
            for i, cells in enumerate(probe(index, _asking(matrix(batch.column(1))), counts, rerank + 1)):
                probed = np.zeros(len(counts), bool)
                probed[cells] = True
                blocks = np.unique(np.concatenate([np.arange(first[c], first[c] + parts[c]) for c in cells if counts[c]])).tolist()
                for x, y in zip(out, (blocks, [i] * len(blocks), [np.packbits(probed).tobytes()] * len(blocks)), strict=True):
                    x += y
            at = pa.array(out[1], pa.int64())
            return [out[0], batch.column(0).take(at), batch.column(1).take(at), out[2]]

        return columns

    asked = map_slices(queries, StructType.fromDDL("block int, id bigint, v array<double>, wanted binary"), None, ask)

    def coded(table: pa.Table) -> Callable[[pa.Table], list]:
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        block = CodedBlock(index, *(table.column(c).to_numpy() for c in ("id", "cell")), codes, table.column("copy").to_numpy(), k)

        def propose(part: pa.Table) -> list:
            probed = np.unpackbits(np.frombuffer(b"".join(part.column("wanted").to_pylist()), np.uint8).reshape(part.num_rows, -1), axis=1)[:, : len(counts)].astype(bool)
            found = block.propose(part.column("id").to_numpy(), _asking(matrix(part.column("v"))), probed, rerank)
            return [part.column("block").combine_chunks(), part.column("id").combine_chunks(), pa.array(found, pa.binary())]

        return propose

    proposed = _in_blocks(dealt.select("block", "id", "cell", "codes", "copy"), asked, "block int, id bigint, found binary", coded)
    gathered = proposed.groupBy("id").agg(F.collect_list(F.struct("block", "found")).alias("all")).join(queries.hint("merge"), "id")

    def choose():
        def columns(batch: pa.RecordBatch) -> list:
            out: tuple[list, list, list] = ([], [], [])
            for i, every in enumerate(batch.column(2).to_pylist()):
                found = np.concatenate([np.frombuffer(x["found"], FOUND) for x in every])
                block = np.repeat([x["block"] for x in every], [len(x["found"]) // FOUND.itemsize for x in every])
                best = shortlist(found, k, rerank)
                for b in np.unique(block[best]).tolist():
                    for x, y in zip(out, (b, i, np.unique(found["id"][best[block[best] == b]]).tobytes()), strict=True):
                        x.append(y)
            at = pa.array(out[1], pa.int64())
            return [out[0], batch.column(0).take(at), batch.column(1).take(at), out[2]]

        return columns

    wanted = map_slices(gathered.select("id", "v", "all"), StructType.fromDDL("block int, id bigint, v array<double>, wanted binary"), None, choose)

    def exact(table: pa.Table) -> Callable[[pa.Table], list]:
        ids, x = table.column("id").to_numpy(), matrix(table.column("v"))  # in the order of ids

        def measure(part: pa.Table) -> list:
            out: tuple[list, list, list] = ([], [], [])
            for q, y, want in zip(part.column("id").to_pylist(), matrix(part.column("v")), part.column("wanted").to_pylist(), strict=True):
                want = np.frombuffer(want, np.int64)
                a, b = np.searchsorted(ids, want, "left"), np.searchsorted(ids, want, "right")
                at = np.concatenate([np.arange(*p) for p in zip(a.tolist(), b.tolist(), strict=True)])
                with np.errstate(over="ignore", invalid="ignore"):
                    products = np.einsum("rd,d->r", x[at], y)
                for z, w in zip(out, (np.full(len(at), q), ids[at], products), strict=True):
                    z.append(w)
            return [pa.array(np.concatenate(z)) for z in out]

        return measure

    return _in_blocks(dealt.select("block", "id", "v"), wanted, "query_id bigint, vec_id bigint, score double", exact)
