"""Removal of repeated byte strings with blockwise suffix arrays over a difference cover.

Every string of LENGTH bytes contains a minimizer: its K-gram of least hash. Equal strings have equal minimizers, so
the strings of one minimizer, its context, only need comparing with contexts of the same K-gram (a bucket). Contexts
that occur several times are one text with a count. Buckets in which contexts differ are suffix-sorted, a block of
buckets at a time: suffixes at cover positions are ranked first, then one suffix bucket after the other is sorted by
its first V bytes, and longer ties are resolved by the ranks at the cover positions that both suffixes share. Memory
is bounded by the block. Buckets of very many different contexts are dealt out anew by what their strings share, so
that no task sorts more than MOST contexts of a bucket; what differs after that is suffix-sorted as well.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_slices, materialise, small_batches, text_or_empty, with_id

LENGTH, K = 400, 48
#: Contexts that a bucket may have before it is dealt out anew; bytes of contexts in a block; bytes of a document that
#: are hashed at a time.
MOST, BLOCK_BYTES, CHUNK = 1000, 2_000_000, 2_000_000
#: Tasks over which the contexts of one such bucket are dealt when they are looked up.
DEALS = 64
#: Period of the difference cover, and the number of suffix buckets in a block.
V, BUCKETS = 32, 8


def difference_cover(v: int) -> list[int]:
    """Residues such that each difference modulo v is one of two of them; each next residue adds most differences."""
    cover, missing = [0], set(range(1, v))
    while missing:
        gain = {c: {(c - x) % v for x in cover} | {(x - c) % v for x in cover} for c in range(v) if c not in cover}
        best = max(gain, key=lambda c: len(gain[c] & missing))
        cover.append(best)
        missing -= gain[best]
    return sorted(cover)


COVER = difference_cover(V)
#: SHIFT[r, s]: how far positions of residues r and s are from cover positions, the same distance for both.
SHIFT = np.array([[min(d for d in range(V) if (r + d) % V in COVER and (s + d) % V in COVER) for s in range(V)] for r in range(V)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each position on, from hashes of 1, 2, 4, ... bytes."""
    if len(data) < K:
        return np.zeros(0, np.uint64)
    h, n, parts, at, total = data.astype(np.uint64) + np.uint64(1), 1, [], 0, None
    while n <= K:
        if K & n:
            parts.append((n, h))
        n *= 2
        if n <= K:
            h = _mix(h[: len(h) - n // 2] * np.uint64(0x9E3779B97F4A7C15) + h[n // 2 :])
    for n, h in reversed(parts):
        part = h[at : at + len(data) - K + 1]
        total = part if total is None else _mix(total * np.uint64(0x9E3779B97F4A7C15) + part)
        at += n
    return total


def minimizer_runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with one minimizer: first start, last start, minimizer position and its K-gram's hash.
    data holds several texts that end at `ends`; no string crosses an end."""
    none = tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    if len(data) < length:
        return none
    h, w = _gram_hashes(data), length - K + 1
    value = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # ties go to the left
    pad = np.full(-len(value) % w + w, np.uint64(2**64 - 1), np.uint64)
    table = np.concatenate([value, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    last = len(data) - length + 1
    least = np.minimum(behind[:last], ahead[w - 1 : w - 1 + last])
    starts = np.arange(last)
    starts = starts[starts + length <= ends[np.searchsorted(ends, starts, side="right")]]
    if not len(starts):
        return none
    at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    final = np.append(first[1:], len(at)) - 1
    return starts[first], starts[final], at[first], h[at[first]]


def _occurrences(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """A row for each run: id, row, lo and hi (first and last start), at (the minimizer), key, and c1, c2 (128-bit hash
    of the context)."""

    def start():
        import xxhash

        def columns(batch: pa.RecordBatch) -> list:
            doc, offset, pieces = [], [], []
            for d, text in enumerate(batch.column(2).to_pylist()):
                raw = text.encode()
                for first in range(0, max(1, len(raw) - length + 1), CHUNK):
                    pieces.append(raw[first : first + CHUNK + length - 1])
                    doc.append(d)
                    offset.append(first)
            made: list[list] = [[] for _ in range(7)]
            first = 0
            while first < len(pieces):
                last, size = first + 1, len(pieces[first])
                while last < len(pieces) and size + len(pieces[last]) <= CHUNK:
                    size += len(pieces[last])
                    last += 1
                joined = b"".join(pieces[first:last])
                ends = np.cumsum([len(p) for p in pieces[first:last]])
                lo, hi, at, key = minimizer_runs(np.frombuffer(joined, np.uint8), ends, length)
                piece = np.searchsorted(ends, lo, side="right")
                shift = np.array(offset[first:last])[piece] - (np.append(0, ends)[:-1])[piece]
                hashes = [xxhash.xxh3_128_digest(joined[a : b + length]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                pair = np.frombuffer(b"".join(hashes), ">i8").reshape(-1, 2)
                for x, y in zip(made, (np.array(doc[first:last])[piece] if len(lo) else lo, lo + shift, hi + shift, at + shift, key.view(np.int64), pair[:, 0].astype(np.int64), pair[:, 1].astype(np.int64)), strict=True):
                    x.append(y)
                first = last
            made = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in made]
            owner = pa.array(made[0].astype(np.int64))
            return [batch.column(0).take(owner), batch.column(1).take(owner), *(pa.array(x) for x in made[1:])]

        return columns

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("row"), text_or_empty(text_col).alias("text"))
    return map_slices(rows, with_id(rows, "id", "row bigint, lo bigint, hi bigint, at bigint, key bigint, c1 bigint, c2 bigint"), 2, start)


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(2 * LENGTH + 8, np.uint8)]).astype(np.uint64)
    n = len(padded) - 8
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out |= padded[k : k + n] << np.uint64(56 - 8 * k)
    return out


def _names(order: np.ndarray, differs: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.append(True, differs))
    return out


class CoverRanks:
    """Ranks of the suffixes at cover positions, and names of their first 8 V bytes. Doubling goes on until the ranks
    differ: ranks of bounded depth would make comparisons at different distances disagree. What follows the end counts
    as less than any byte, a NUL included: of suffixes that agree so far, the one nearer to the end goes first."""

    def __init__(self, words: np.ndarray, size: int):
        cover = np.zeros(V, bool)
        cover[COVER] = True
        self.places = np.flatnonzero(cover[np.arange(size) % V])
        self.rank = np.zeros(len(words) + 1, np.int64)
        keys = [words[self.places + 8 * k] for k in range(V // 8)] + [np.minimum(size - self.places, V)]
        order = np.lexsort(keys[::-1])
        self._set(order, np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0))
        self.names, step = self.rank, V
        while self.rank.max(initial=0) < len(self.places) and step < 2 * size:
            ahead = self.rank[np.minimum(self.places + step, len(self.rank) - 1)]
            pair = self.rank[self.places] * (len(self.places) + 1) + ahead
            order = np.argsort(pair, kind="stable")
            self._set(order, pair[order[1:]] != pair[order[:-1]])
            step *= 2
            if step <= 8 * V:
                self.names = self.rank

    def _set(self, order: np.ndarray, differs: np.ndarray) -> None:
        rank = np.zeros_like(self.rank)
        if len(order):
            rank[self.places] = _names(order, differs)
        self.rank = rank

    def less(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        d = SHIFT[p % V, q % V]
        return self.rank[p + d] < self.rank[q + d]


def _resolve(order: np.ndarray, group: np.ndarray, ranks: CoverRanks) -> np.ndarray:
    """Sorts suffixes inside their tie groups (runs of equal `group`): a bottom-up merge of all groups at a time, in
    which each suffix finds its place in the neighbouring run by binary search."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    begin = np.repeat(first, np.diff(np.append(first, len(group))))
    end = begin + np.repeat(np.diff(np.append(first, len(group))), np.diff(np.append(first, len(group))))
    width, longest = 1, int((end - begin).max(initial=0))
    while width < longest:
        i = np.flatnonzero(end - begin > width)
        inside = i - begin[i]
        pair = begin[i] + inside // (2 * width) * (2 * width)
        right = inside // width % 2 == 1
        low = np.where(right, pair, np.minimum(pair + width, end[i]))
        high = np.where(right, pair + width, np.minimum(pair + 2 * width, end[i]))
        base, x = low.copy(), order[i]
        while (todo := np.flatnonzero(low < high)).size:
            mid = (low[todo] + high[todo]) // 2
            other = order[mid]
            before = np.where(right[todo], ~ranks.less(x[todo], other), ranks.less(other, x[todo]))
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
        moved = order.copy()
        moved[pair + (inside % width) + (low - base)] = x
        order, width = moved, 2 * width
    return order


def repeated_starts(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, which of its starts (0 to len - length) begin a string of `length` bytes that also begins at
    another start of these texts."""
    if not 12 * V < length <= 13 * V - 16:
        raise ValueError("the names of cover suffixes fit lengths of about 12.5 V")
    data = np.frombuffer(b"".join(texts), np.uint8)
    words = _words(data)
    ranks = CoverRanks(words, len(data))
    base = np.cumsum([0] + [len(t) for t in texts])
    spans = [max(0, len(t) - length + 1) for t in texts]
    starts = np.concatenate([np.arange(b, b + n) for b, n in zip(base, spans, strict=False)]) if texts else np.zeros(0, np.int64)
    found = np.zeros(len(data) + 1, bool)
    head = words[starts]
    splits = np.unique(np.sort(head[:: max(1, len(head) // 4096)])[:: max(1, min(len(head), 4096) // BUCKETS)])
    bucket = np.searchsorted(splits, head, side="right")
    for b in np.unique(bucket):
        own = starts[bucket == b]
        keys = [words[own + 8 * k] for k in range(V // 8)]
        order = np.lexsort(keys[::-1])
        differs = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
        order, group = own[order], np.cumsum(np.append(False, differs))
        tied = np.append(False, ~differs) | np.append(~differs, False)
        order, group = _resolve(order[tied], group[tied], ranks), group[tied]
        p, q = order[:-1], order[1:]
        same = np.flatnonzero(group[1:] == group[:-1])
        p, q = p[same], q[same]
        equal = np.ones(len(p), bool)
        for jump in (0, length - 8 * V - V + 1):  # names reach over 8 V bytes from at most V - 1 further on
            d = jump + SHIFT[(p + jump) % V, (q + jump) % V]
            equal &= ranks.names[p + d] == ranks.names[q + d]
        for k in range(length - V, length, 8):
            equal &= words[p + k] == words[q + k]
        found[p[equal]] = found[q[equal]] = True
    return [found[b : b + n] for b, n in zip(base, spans, strict=False)]


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last positions of runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


RANGES = "array<struct<a: bigint, b: bigint>>"


def _sorted_blocks(contexts: DataFrame, length: int) -> DataFrame:
    """key, c1, c2 and ranges of starts (from the context's first) that are repeated among contexts of the same key. A
    context alone under its key isn't sorted: no string occurs twice in it, so that only its copies repeat it."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def done(rows: list[tuple]) -> pa.RecordBatch:
            per = Counter(r[0] for r in rows)
            flags = iter(repeated_starts([r[4] for r in rows if per[r[0]] > 1], length))
            sorted_here = [next(flags) if per[r[0]] > 1 else np.zeros(0, bool) for r in rows]
            ranges = [[(0, len(r[4]) - length)] if r[3] > 1 else _ranges(f) for r, f in zip(rows, sorted_here, strict=True)]
            kept = [(r[:3], x) for r, x in zip(rows, ranges, strict=True) if x]
            kinds = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k, _ in kept], pa.int64()) for i in range(3)), pa.array([[{"a": a, "b": b} for a, b in x] for _, x in kept], kinds)], ["key", "c1", "c2", "ranges"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BLOCK_BYTES and held[-1][0] != r[0]:
                    yield done(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
        if held:
            yield done(held)

    small_batches(contexts.sparkSession)
    dealt = contexts.select("key", "c1", "c2", "n", "context").repartition("key").sortWithinPartitions("key", "c1", "c2")
    return dealt.mapInArrow(run, f"key bigint, c1 bigint, c2 bigint, ranges {RANGES}")


def _finer(contexts: DataFrame, width: int, length: int) -> DataFrame:
    """Cuts each context into contexts of `width` offsets of the start from the minimizer. Their key is a hash of the
    old key, the offsets and the bytes that all their strings share; from: their first start in the old context."""
    fields = "key bigint, c1 bigint, c2 bigint, n bigint, at bigint, context binary, pkey bigint, p1 bigint, p2 bigint, from bigint"

    def start():
        import xxhash

        def columns(batch: pa.RecordBatch) -> list:
            out: list[tuple] = []
            for key, c1, c2, n, at, text in zip(*(batch.column(c).to_pylist() for c in ("key", "c1", "c2", "n", "at", "context")), strict=True):
                low = at - (len(text) - length)
                for g in range(low // width, at // width + 1):
                    a, b = max(0, at - g * width - width + 1), min(len(text) - length, at - g * width)
                    if a <= b:
                        core = text[max(0, at - g * width) : at - g * width - width + 1 + length] if width > 1 else text[a : a + length]
                        piece = text[a : b + length]
                        pair = np.frombuffer(xxhash.xxh3_128_digest(piece + b"%d" % (at - a)), ">i8")
                        new = xxhash.xxh3_64_intdigest(b"%d:%d:%d:" % (key, width, g) + core) - 2**63
                        out.append((new, int(pair[0]), int(pair[1]), n, at - a, piece, key, c1, c2, a))
            return [list(x) for x in zip(*out, strict=True)] or [[]] * 10

        return columns

    return map_slices(contexts.select("key", "c1", "c2", "n", "at", "context"), StructType.fromDDL(fields), 5, start, 50_000)


def _of_buckets(contexts: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join with the keys of large buckets, in which no bucket meets in one task."""
    copies = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal"))
    dealt = contexts.withColumn("deal", F.pmod("c1", F.lit(DEALS)).cast("int"))
    return dealt.join(copies.hint("merge"), ["key", "deal"], how).drop("deal")


def _decide(contexts: DataFrame, length: int, widths: tuple[int, ...]) -> DataFrame:
    """Repeated starts of distinct contexts (key, c1, c2, n, at, context)."""
    large = materialise(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > MOST).select("key"), "large")
    if large.isEmpty():
        return _sorted_blocks(contexts, length)
    found = _sorted_blocks(_of_buckets(contexts, large, "left_anti"), length)
    hot = _of_buckets(contexts, large, "left_semi")
    if not widths:  # only strings that differ but share a 64-bit hash are left together
        return found.unionByName(_sorted_blocks(hot, length))
    parts = materialise(_finer(hot, widths[0], length), "finer")
    one = parts.groupBy("key", "c1", "c2").agg(F.sum("n").alias("n"), F.first("at").alias("at"), F.first("context").alias("context"))
    below = _decide(materialise(one, "finer-contexts"), length, widths[1:])
    up = parts.select("key", "c1", "c2", "pkey", "p1", "p2", "from").join(below.hint("merge"), ["key", "c1", "c2"])
    moved = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("from")).alias("a"), (r["b"] + F.col("from")).alias("b")))
    up = up.select("pkey", "p1", "p2", moved.alias("ranges")).groupBy("pkey", "p1", "p2").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    return found.unionByName(up.toDF("key", "c1", "c2", "ranges"))


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, row (hash of the text, for ids that repeat) and spans (start and end of bytes covered by repeated strings,
    unsorted, overlapping) of texts that have any."""
    runs = materialise(_occurrences(docs, id_col, text_col, length), "runs")
    keys = runs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("c1").alias("a1"), F.max("c1").alias("b1"), F.min("c2").alias("a2"), F.max("c2").alias("b2"))
    keys = keys.filter("n > 1").select("key", ((F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2"))).alias("mixed"))
    keys = materialise(keys, "keys")  # as a table of its own, so that a hot key's partition can be split
    runs = materialise(runs.join(keys.hint("merge"), "key"), "shared-runs")
    mixed = runs.filter("mixed")
    one = mixed.groupBy("key", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "row", "lo", "hi", "at")).alias("where")).select("key", "c1", "c2", "n", "where.*")
    wanted = one.groupBy("id", "row").agg(F.collect_list(F.struct("key", "c1", "c2", "n", "lo", "hi", "at")).alias("wanted"))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("row"), text_or_empty(text_col).alias("text")).withColumn("nth", F.lit(1))
    met = texts.join(wanted.hint("merge"), texts["id"].eqNullSafe(wanted["id"]) & (texts["row"] == wanted["row"])).select(F.inline("wanted"), F.encode("text", "UTF-8").alias("raw"))
    context = F.expr(f"substring(raw, cast(lo + 1 as int), cast(hi - lo + {length} as int))")
    contexts = materialise(met.select("key", "c1", "c2", "n", (F.col("at") - F.col("lo")).alias("at"), context.alias("context")).dropDuplicates(["key", "c1", "c2"]), "contexts")
    found = materialise(_decide(contexts, length, (16, 1)), "repeated")
    whole = runs.filter("not mixed").select("id", "row", F.array(F.struct(F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))).alias("spans"))
    moved = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("lo")).alias("a"), (r["b"] + F.col("lo") + length).alias("b")))
    parts = mixed.select("id", "row", "lo", "key", "c1", "c2").join(found.hint("merge"), ["key", "c1", "c2"]).select("id", "row", moved.alias("spans"))
    return whole.unionByName(parts).groupBy("id", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary) for each row. Null texts are empty; a
    text shorter than `length` loses nothing; rows of equal id and text repeat each other like any two texts, null ids
    included. Any byte may occur, NULs too; long texts are hashed CHUNK bytes at a time. An empty table gives none."""
    spans = repeated_ranges(docs, id_col, text_col, length)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("row"), text_or_empty(text_col).alias("text"))
    both = texts.join(spans.withColumnsRenamed({"id": "i", "row": "r"}).hint("merge"), texts["id"].eqNullSafe(F.col("i")) & (texts["row"] == F.col("r")), "left").select("id", "text", "spans")

    def start():
        def columns(batch: pa.RecordBatch) -> list:
            out: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                merged: list[list[int]] = []
                for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                edges = [0, *(x for m in merged for x in m), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for x, y in zip(out, (len(raw), len(raw) - len(kept), len(merged), kept), strict=True):
                    x.append(y)
            return [batch.column(0), *out]

        return columns

    return map_slices(both, with_id(docs, id_col, "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"), 1, start)
