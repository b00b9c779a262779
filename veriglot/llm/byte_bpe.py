"""Byte-level BPE encoding and decoding over a rank file.

A slice of documents is split into pre-tokens; each distinct pre-token that the worker has not seen is put into a
padded matrix with others of similar length. In each round every row merges its leftmost pair of minimum rank: ranks
come from a hash table of pairs, and both matrices are compacted by one column. Rows without a mergeable pair leave.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, map_slices, text_or_empty, with_id

NONE = np.int32(2**31 - 1)
#: Rows longer than this are merged with a heap instead: a matrix round costs the whole row.
LONGEST_ROW = 512


class PairTable:
    """Open addressing over keys left << 16 | right, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        at, todo, self.probes = self._slot(keys), np.arange(len(keys)), 1
        while len(todo):
            free = todo[self.keys[at[todo]] == -1]
            self.keys[at[free]] = keys[free]  # of several that want a slot, the last one gets it
            placed = self.keys[at[todo]] == keys[todo]
            self.values[at[todo[placed]]] = values[todo[placed]]
            todo = todo[~placed]
            at[todo] = (at[todo] + 1) & (size - 1)
            self.probes += len(todo) > 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 16) | right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        held = self.keys[at]
        found = np.where(held == keys, self.values[at], NONE)
        todo = np.flatnonzero((held != keys) & (held != -1))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            found[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (held != -1)]
        return found


class RowMerger:
    """Merges rows of ids, in padded matrices of rows of similar length."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray, new_ids: np.ndarray):
        """pairs: left << 16 | right; ranks: of each pair; new_ids: by rank."""
        self.table, self.new_ids = PairTable(pairs, ranks), new_ids

    def __call__(self, flat: np.ndarray, lengths: np.ndarray, kind: str) -> list[bytes]:
        """Ids of each row, as bytes of dtype kind. flat holds the first ids of all rows, one after the other."""
        out, begin, low = [b""] * len(lengths), np.cumsum(lengths) - lengths, 0
        while low < lengths.max(initial=0):
            high = max(4, 2 * low)
            of = np.flatnonzero((lengths > low) & (lengths <= high))
            for part in np.array_split(of, len(of) * high // 2_000_000 + 1):
                if len(part):
                    column = np.arange(high)
                    inside = column < lengths[part, None]
                    ids = np.where(inside, flat[np.where(inside, begin[part, None] + column, 0)], -1).astype(np.int32)
                    self._matrix(ids, part, kind, out)
            low = high
        return out

    def _matrix(self, ids: np.ndarray, part: np.ndarray, kind: str, out: list[bytes]) -> None:
        rank = self.table.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(part), ids.shape[1] - 1)
        while len(part):
            row = np.arange(len(part))
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(part), np.int64)
            best = rank[row, at] if rank.shape[1] else np.full(len(part), NONE)
            live = best != NONE
            if not live.all():
                ended = ids[~live]
                raw = ended.astype(kind)
                flat, size = raw.tobytes(), raw.itemsize * ended.shape[1]
                for k, (i, m) in enumerate(zip(part[~live].tolist(), (raw.itemsize * (ended >= 0).sum(1)).tolist(), strict=True)):
                    out[i] = flat[k * size : k * size + m]
                part, ids, rank, at, best = part[live], ids[live], rank[live], at[live], best[live]
                if not len(part):
                    return
                row = np.arange(len(part))
            ids[row, at] = self.new_ids[best]
            wide = ids.shape[1]
            ids = ids[np.arange(wide) != (at + 1)[:, None]].reshape(len(part), wide - 1)
            rank = rank[np.arange(wide - 1) != at[:, None]].reshape(len(part), wide - 2)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < wide - 2)
            rank[left, at[left] - 1] = self.table.get(ids[left, at[left] - 1], ids[left, at[left]])
            rank[right, at[right]] = self.table.get(ids[right, at[right]], ids[right, at[right] + 1])


class BytePairCodec:
    def __init__(self, file: bytes, pattern: str):
        """file: what the rank file holds."""
        import regex

        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines())}
        if max(self.ranks.values()) >= 1 << 16:
            raise ValueError("a pair's key holds ids below 65536 only")
        self.pieces = regex.compile(pattern)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(a << 16 | b, rank) for token, rank in self.ranks.items() for i in range(1, len(token)) if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None]
        keys, values = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.merger = RowMerger(keys, values.astype(np.int32), np.arange(len(self.tokens), dtype=np.int32))  # a merged pair's id is its rank
        self.known = Memory()

    def merge_rows(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        lengths = np.array([len(w) for w in words], np.int64)
        short = np.flatnonzero(lengths <= LONGEST_ROW)
        flat = self.single[np.frombuffer(b"".join([words[i] for i in short]), np.uint8)]
        out = [b""] * len(words)
        for i, ids in zip(short.tolist(), self.merger(flat, lengths[short], "<u4"), strict=True):
            out[i] = ids
        for i in np.flatnonzero(lengths > LONGEST_ROW):
            out[i] = self._heap(words[i])
        return out

    def _heap(self, word: bytes) -> bytes:
        import heapq

        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        ranks, tokens = self.ranks, self.tokens
        queue = [(r, i) for i in range(len(ids) - 1) if (r := ranks.get(tokens[ids[i]] + tokens[ids[i + 1]])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= len(ids) or ranks.get(tokens[ids[i]] + tokens[ids[j]]) != rank:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
                if (r := ranks.get(tokens[rank] + tokens[ids[after[j]]])) is not None:
                    heapq.heappush(queue, (r, i))
            if before[i] >= 0 and (r := ranks.get(tokens[ids[before[i]]] + tokens[rank])) is not None:
                heapq.heappush(queue, (r, before[i]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.pieces.findall(t) for t in texts]
        new = self.known.missing(set().union(*split))
        rows, words = [], []
        for word in new:
            raw = word.encode()
            whole = self.ranks.get(raw)  # a pre-token in the vocabulary is one token, whatever its merges give
            if whole is None:
                rows.append(word)
                words.append(raw)
            else:
                self.known[word] = whole.to_bytes(4, "little")
        self.known.update(zip(rows, self.merge_rows(words), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and ids (binary, little-endian unsigned 32-bit) of every whole text, however long: a slice holds one
    text at least. Null and empty texts have no ids; ids of documents may be null or repeated, each row is encoded by
    itself; other columns are not looked at; an empty table gives none. The rank file is read on the driver."""
    file = Path(path).read_bytes()

    def start():
        codec = BytePairCodec(file, pattern)

        def columns(batch: pa.RecordBatch) -> list:
            ids = codec.encode(batch.column(1).to_pylist())
            return [batch.column(0), [len(x) // 4 for x in ids], ids]

        return columns

    return map_slices(docs.select(F.col(id_col), text_or_empty(text_col)), with_id(docs, id_col, "n_tokens bigint, ids binary"), 1, start)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Adds decoded (binary) to the rows of encode(). The bytes are returned as they are, UTF-8 or not."""
    file = Path(path).read_bytes()

    def start():
        codec = BytePairCodec(file, pattern)
        return lambda batch: [batch.column(0), batch.column(1), batch.column(2), [codec.decode(x or b"") for x in batch.column(2).to_pylist()]]

    return map_slices(encoded.select(id_col, "n_tokens", "ids"), with_id(encoded, id_col, "n_tokens bigint, ids binary, decoded binary"), 2, start)
