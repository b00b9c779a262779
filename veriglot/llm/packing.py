"""Packing token sequences: first-fit decreasing with a tournament tree of bin capacities, run in randomised groups.

A document is cut into full sequences and a remainder. In each group, the remainders go, longest first, into the
leftmost bin with room. The bins' gaps are then closed by cutting the remainders of the emptiest bins, and what is
left over is cut at powers of two, so that only whole sequences or powers of two come out.
"""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import RowMerger
from .common import Memory, map_slices, text_or_empty, with_id

CAPACITY = 2048
#: Mean number of documents and of bytes of their texts in a group, at most; a group is packed by one task.
GROUP_DOCS, GROUP_BYTES = 2000, 8_000_000


class ChunkSplitter:
    """Chunks between white space. Texts of code points below 256 are lower-cased first, as the tokenizer does."""

    def __init__(self):
        import re

        #: str.split() also splits at these, which the tokenizer's \s doesn't.
        self.separators = re.compile("[\x1c-\x1f]")
        self.spaces = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

    def __call__(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        return [x for x in self.spaces.split(text) if x] if self.separators.search(text) else text.split()


class ChunkTokenizer:
    """Ids of chunks, as bytes. Letters below 256 are merged in matrices by the file's merges; ASCII signs behind
    them, and all other chunks, are left to the library."""

    def __init__(self, file: str):
        """file: what the tokenizer's JSON file holds."""
        import json
        import os
        import re

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(file)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids are held in 16 bits")
        model = json.loads(file)["model"]
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], np.int64)
        self.merger = RowMerger(pairs, np.arange(len(pairs), dtype=np.int32), np.array([vocab[a + b] for a, b in merges], np.int32))
        signs = byte_signs()
        self.inner, self.final = (np.array([vocab[signs[b] + end] for b in range(256)], np.int32) for end in ("", "</w>"))
        self.plain = re.compile("([a-z\xdf-\xf6\xf8-\xff]{1,100})([!-&(-/:-@\\[-^`{-~]*)")
        self.tails: dict[str, bytes] = {"": b""}

    def __call__(self, chunks: list[str]) -> list[bytes]:
        out, plain, words, tails = [b""] * len(chunks), [], [], []
        for i, m in enumerate(map(self.plain.fullmatch, chunks)):
            if m:
                word, tail = m.groups()
                plain.append(i)
                words.append(word)
                tails.append(tail)
            else:
                out[i] = self._by_library(chunks[i])
        for tail in set(tails).difference(self.tails):
            self.tails[tail] = self._by_library(tail)
        words = [w.encode() for w in words]
        lengths = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        flat, last = self.inner[raw], np.cumsum(lengths) - 1
        flat[last] = self.final[raw[last]]
        for i, ids, tail in zip(plain, self.merger(flat, lengths, "<u2"), map(self.tails.__getitem__, tails), strict=True):
            out[i] = ids + tail
        return out

    def _by_library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2").tobytes()


def byte_signs() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself where it is printable Latin-1,
    else one of the characters from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


def tokenise(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (binary, little-endian unsigned 16-bit) of each whole text, followed by end_id. The tokenizer's
    pieces never span white space, so each distinct chunk between white space is tokenised once and remembered. Null
    and empty texts have end_id alone; ids of documents may be null or repeated, each row is tokenised by itself; an
    empty table gives none. The tokenizer's file is read on the driver."""
    file = Path(path).read_text("utf-8")

    def start():
        chunks_of, ids_of, known = ChunkSplitter(), ChunkTokenizer(file), Memory()
        end = np.uint16(end_id).tobytes()

        def columns(batch: pa.RecordBatch) -> list:
            chunks = [chunks_of(t) for t in batch.column(1).to_pylist()]
            new = list(known.missing(set().union(*chunks)))
            known.update(zip(new, ids_of(new), strict=True))
            get = known.__getitem__
            return [batch.column(0), [b"".join(map(get, c)) + end for c in chunks]]

        return columns

    return map_slices(docs.select(F.col(id_col), text_or_empty(text_col)), with_id(docs, id_col, "ids binary"), 1, start, 4_000_000)


class Tournament:
    """Leftmost bin with enough room: a complete binary tree in which each node holds the larger room of its two."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> int:
        room, at = self.room, 1
        while at < self.leaves:
            at = 2 * at if room[2 * at] >= length else 2 * at + 1
        room[at] -= length
        bin_, at = at - self.leaves, at // 2
        while at:
            room[at] = max(room[2 * at], room[2 * at + 1])
            at //= 2
        return bin_


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; every id lies in one piece. Documents of no length
    have no piece. Among equal lengths the earlier document goes first."""
    out, sequence, rest = [], 0, []
    for d, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            out.append((d, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((d, n - n % capacity, n % capacity))
    rest.sort(key=lambda x: -x[2])
    tree, bins = Tournament(len(rest), capacity), []
    for piece in rest:
        k = tree.place(piece[2])
        if k == len(bins):
            bins.append([])
        bins[k].append(piece)
    bins = [[capacity - sum(p[2] for p in b), b] for b in bins]
    bins.sort(key=lambda b: b[0])
    gaps, loose = sum(b[0] for b in bins), []
    while bins and gaps - bins[-1][0] >= sum(p[2] for p in bins[-1][1]):  # the emptiest bin fits into the other bins' gaps
        room, pieces = bins.pop()
        for d, start, n in pieces:
            while n:
                into = next_gap(bins)
                take = min(n, into[0])
                into[1].append((d, start, take))
                into[0], start, n = into[0] - take, start + take, n - take
        gaps = sum(b[0] for b in bins)
    if bins and gaps:  # less than one bin of pieces is left over after the other bins are full
        _, loose = bins.pop()
        kept = []
        for d, start, n in loose:
            while n and (into := next_gap(bins)):
                take = min(n, into[0])
                into[1].append((d, start, take))
                into[0], start, n = into[0] - take, start + take, n - take
            if n:
                kept.append((d, start, n))
        loose = kept
    whole = [b[1] for b in bins]
    left = sum(p[2] for p in loose)
    while left:
        size, current = 1 << (left.bit_length() - 1), []
        left -= size
        while size:
            d, start, n = loose.pop(0)
            take = min(n, size)
            current.append((d, start, take))
            size -= take
            if n > take:
                loose.insert(0, (d, start + take, n - take))
        whole.append(current)
    for pieces in whole:
        offset = 0
        for d, start, n in pieces:
            out.append((d, start, n, sequence, offset))
            offset += n
        sequence += 1
    return out


def next_gap(bins: list[list]) -> list | None:
    return next((b for b in reversed(bins) if b[0]), None)


def size_of(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Number of documents and bytes of their texts, for pack_groups()."""
    return tuple(docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first())


def pack_groups(tokens: DataFrame, n_docs: int, n_bytes: int = 0, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, seed: int = 17, id_col: str = "doc_id") -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (the piece).
    Groups are drawn by a hash of id and ids; repeated rows are documents of their own. n_docs and n_bytes only set the
    number of groups. Null ids are ids like others; a very long document fills whole sequences and is cut at the end; an
    empty table gives no rows. Rows that are equal in id and text meet in one group."""
    groups = max(1, -(-n_docs // group_docs), -(-n_bytes // GROUP_BYTES))
    schema = with_id(tokens, id_col, "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        docs, ids = table.column(0).to_pylist(), table.column(1).to_pylist()
        order = sorted(range(len(docs)), key=lambda i: (docs[i] is None, docs[i], ids[i]))  # not the order of arrival
        docs, ids = [docs[i] for i in order], [ids[i] for i in order]
        pieces = pack([len(x) // 2 for x in ids], capacity)
        cut = [ids[d][2 * start : 2 * (start + n)] for d, start, n, _, _ in pieces]
        crc = [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in cut]
        base = key[0].as_py() << 32
        long = lambda values: pa.array(values, pa.int64())
        return pa.table([pa.array([docs[p[0]] for p in pieces], table.schema.field(0).type), long([p[1] for p in pieces]), long([p[2] for p in pieces]), long(crc), long([len(ids[p[0]]) // 2 for p in pieces]), long([base + p[3] for p in pieces]), long([p[4] for p in pieces]), pa.array(cut, pa.binary())], [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return tokens.select(id_col, "ids", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), "ids"), F.lit(groups)).alias("group")).groupBy("group").applyInArrow(lambda key, table: packed(key, table.select([id_col, "ids"])), schema)
