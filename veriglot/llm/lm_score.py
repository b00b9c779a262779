"""Cross-entropy difference of documents under a target and a background n-gram model.

Both models are byte n-grams of order ORDER over one vocabulary, the 256 bytes, smoothed alike: an order's counts are
mixed with PRIOR times the estimate of the order below, down to even chances. They are counted over every whole text,
without caps: blocks of documents give their distinct n-grams with counts, the counts of a block's n-grams are summed
over the corpus, and the losses return to the block, whose documents look them up. Hot n-grams cost a row for each
block. A document's score is its mean background loss less its mean target loss, in nats a byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_slices, materialise, small_batches, text_or_empty, with_id

ORDER, PRIOR = 5, 4.0
#: Bytes of text in a block of documents; a document is never cut.
BLOCK_BYTES = 8_000_000


def grams(raw: bytes, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each byte, as a number; zeros stand before a text."""
    data = np.frombuffer(b"\0" * (order - 1) + raw, np.uint8).astype(np.int64)
    out = np.zeros(len(raw), np.int64)
    for k in range(order):
        out = (out << 8) | data[k : k + len(raw)]
    return out


def _blocks(docs: DataFrame) -> DataFrame:
    """id, target, text and block: consecutive rows of a partition up to BLOCK_BYTES."""

    def start():
        part, state = TaskContext.get().partitionId(), [0, 0]

        def columns(batch: pa.RecordBatch) -> list:
            blocks = []
            for text in batch.column(2).to_pylist():
                size = len(text.encode())
                if state[1] and state[1] + size > BLOCK_BYTES:
                    state[0], state[1] = state[0] + 1, 0
                state[1] += size
                blocks.append(part << 32 | state[0])
            return [batch.column(0), batch.column(1), batch.column(2), blocks]

        return columns

    return map_slices(docs, with_id(docs, "id", "target boolean, text string, block bigint"), 2, start)


def _distinct(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, sorted, with their counts: about 1 MB of text at a time, then sums over these."""
    parts, held, size = [], [], 0
    for i, text in enumerate(texts):
        held.append(grams(text.encode()))
        size += len(held[-1])
        if size > 1_000_000 or i == len(texts) - 1:
            parts.append(np.unique(np.concatenate(held), return_counts=True))
            held, size = [], 0
    keys, counts = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _counts(blocks: DataFrame) -> DataFrame:
    """block, gram, t and b: counts in the block's target documents and in all of them. A block that several tasks
    read comes out in parts."""

    def run(batches):
        held: list[tuple[int, bool, str]] = []

        def done() -> pa.RecordBatch:
            gram, b = _distinct([t for _, _, t in held])
            own, n = _distinct([t for _, flag, t in held if flag])
            t = np.zeros(len(gram), np.int64)
            t[np.searchsorted(gram, own)] = n
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), held[0][0], np.int64)), pa.array(gram), pa.array(t), pa.array(b)], ["block", "gram", "t", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield done()
                    held = []
                held.append(row)
        if held:
            yield done()

    small_batches(blocks.sparkSession)
    return blocks.select("block", "target", "text").mapInArrow(run, "block bigint, gram bigint, t bigint, b bigint")


def model(counts: DataFrame, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """gram, t_loss and b_loss for all n-grams counted: each order's estimate needs the counts of its contexts (a
    window of 256 rows at most) and the estimate of the gram without its first byte."""
    full = counts.groupBy("gram").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
    full = materialise(full, "grams")
    below = None
    for n in range(1, order + 1):
        own = full if n == order else full.groupBy(F.expr(f"gram & {(1 << 8 * n) - 1}L").alias("gram")).agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
        own = own.withColumn("context", F.shiftright("gram", 8)) if n > 1 else own.withColumn("context", F.lit(0).cast("bigint"))
        per = own.groupBy("context").agg(F.sum("t").alias("ct"), F.sum("b").alias("cb"))
        own = own.join(per.hint("merge"), "context")
        if below is None:
            own = own.withColumn("pt", F.lit(1 / 256)).withColumn("pb", F.lit(1 / 256))
        else:
            own = own.withColumn("rest", F.expr(f"gram & {(1 << 8 * (n - 1)) - 1}L")).join(below.hint("merge"), "rest")
        p = [((F.col(c) + prior * F.col(q)) / (F.col(total) + prior)).alias(q) for c, q, total in (("t", "pt", "ct"), ("b", "pb", "cb"))]
        below = own.select(F.col("gram").alias("rest"), *p)
    return below.select(F.col("rest").alias("gram"), (-F.log("pt")).alias("t_loss"), (-F.log("pb")).alias("b_loss"))


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens (bytes), target_loss, background_loss (means) and score for each row of docs. target: ids of target
    documents, with or without repeats. Null and empty texts have no token, no loss (null) and score 0; repeated rows
    are counted and scored each; without a target document the target model gives even chances. Very long
    texts are counted and scored in successive blocks; an empty table gives no rows; other columns stay behind."""
    wanted = target.select(F.col(target.columns[0]).alias("wanted")).filter("wanted is not null").distinct()
    flagged = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(wanted.hint("shuffle_hash"), F.col("id") == F.col("wanted"), "left")  # texts stream past a table of ids
    blocks = materialise(_blocks(flagged.select("id", F.col("wanted").isNotNull().alias("target"), "text")), "blocks")
    counts = materialise(_counts(blocks), "counts")
    losses = counts.select("block", "gram").join(model(counts).hint("merge"), "gram").select("block", "gram", "t_loss", "b_loss")

    def look_up(texts: pa.Table, known: pa.Table) -> pa.Table:
        gram = known.column("gram").to_numpy()
        order = np.argsort(gram, kind="stable")
        gram = gram[order]
        t, b = (known.column(c).to_numpy()[order] for c in ("t_loss", "b_loss"))
        out: list[list] = [[], [], []]
        for text in texts.column("text").to_pylist():
            at = np.searchsorted(gram, grams(text.encode()))
            for x, y in zip(out, (len(at), float(t[at].mean()) if len(at) else None, float(b[at].mean()) if len(at) else None), strict=True):
                x.append(y)
        return pa.table([texts.column("id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.float64())], [id_col, "n_tokens", "target_loss", "background_loss"])

    schema = StructType.fromDDL("n_tokens bigint, target_loss double, background_loss double")
    scored = blocks.groupBy("block").cogroup(losses.groupBy("block")).applyInArrow(look_up, StructType([with_id(blocks, "id", "x int", id_col)[0], *schema.fields]))
    return scored.withColumn("score", F.coalesce(F.col("background_loss") - F.col("target_loss"), F.lit(0.0)))
