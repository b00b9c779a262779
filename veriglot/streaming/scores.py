"""Running scores of pages whose blocks arrive over time, such as the turns of a conversation: keyed state and timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import AuditConfig
from ..operators import report

#: What is added up of a page's blocks, in the order of their values in state.
COUNTS = ("total_blocks", "total_tokens", "target_tokens", "total_chars", "issues", *report.SEVERITIES)
_STATE = ", ".join(f"{c} bigint" for c in COUNTS)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def counted(checked: DataFrame, config: AuditConfig) -> DataFrame:
    """page_id, block_idx, version (0 where there is none or it is null), ts if there is one, and COUNTS of each audited()
    block; blocks without page_id or block_idx are left out, as no page is theirs."""
    severities = [F.size(F.filter(F.col("found.severity"), report.equals(s))) for s in report.SEVERITIES]
    values = [F.lit(1), F.col("tokens"), F.when(F.col("lang") == config.target, F.col("tokens")).otherwise(0), F.length("text") + 2, F.size("found"), *severities]
    version = F.coalesce(F.col("version").cast("long"), F.lit(0)) if "version" in checked.columns else F.lit(0)
    seen = ["ts"] if "ts" in checked.columns else []
    keyed = checked.filter("page_id is not null and block_idx is not null")
    return keyed.select(F.col("page_id").cast("long").alias("page_id"), F.col("block_idx").cast("int").alias("block_idx"), version.cast("long").alias("version"), *seen, *[v.cast("long").alias(c) for v, c in zip(values, COUNTS, strict=True)])


class PageState(StatefulProcessor):
    """Per page: its version, the sums of its blocks, and COUNTS of each block, so that a block that comes again replaces
    what it added before: a row costs one lookup, however many blocks its page has. A greater version starts the page anew,
    rows of a smaller one are left out; of rows of one block and version those with the greatest COUNTS stay. So the
    state doesn't depend on how rows were dealt into batches. quiet: milliseconds without a row after which a page is
    final and its state goes; None: never."""

    def __init__(self, quiet: int | None):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", f"version bigint, {_STATE}")
        self.blocks = handle.getMapState("blocks", "block_idx int", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.page.get()
        version, sums = (held[0], list(held[1:])) if held is not None else (None, [0] * len(COUNTS))
        latest = None
        for row in rows:
            if version is not None and row.version < version:
                continue
            if version is None or row.version > version:
                if version is not None:
                    self.blocks.clear()
                version, sums = row.version, [0] * len(COUNTS)
            new, at = tuple(row[c] for c in COUNTS), (row.block_idx,)
            old = tuple(self.blocks.getValue(at)) if self.blocks.containsKey(at) else None
            if old is None or new > old:
                self.blocks.updateValue(at, new)
                sums = [s + n - o for s, n, o in zip(sums, new, old or (0,) * len(COUNTS), strict=True)]
            if "ts" in row.__fields__ and row.ts is not None:
                latest = row.ts if latest is None else max(latest, row.ts)
        if version is None:
            return
        self.page.update((version, *sums))
        if self.quiet is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            now = int(latest.timestamp() * 1000) if latest is not None else timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(max(now, timerValues.getCurrentWatermarkInMs() if latest is not None else now) + self.quiet)
        yield self._row(key, version, sums, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.page.get()
        if held is not None:
            yield self._row(key, held[0], list(held[1:]), True)
            self.page.clear()
            self.blocks.clear()

    def close(self) -> None:
        pass

    def _row(self, key: tuple, version: int, sums: list[int], final: bool) -> Row:
        return Row(page_id=key[0], version=version, final=final, **dict(zip(COUNTS, sums, strict=True)))


def running(blocks: DataFrame, config: AuditConfig, quiet: timedelta | None = None, late: str = "10 minutes") -> DataFrame:
    """For each batch and page that it touches: page_id, version, final, COUNTS, overall_score and language_purity as
    score_pages() would give them for all blocks so far. With a column ts, time is that of the rows, those later than
    `late` are left out and a page is final `quiet` after its last row; without, it is the clock's. The session needs the
    RocksDB state store (see ROCKSDB), whose state doesn't live in memory."""
    per_block = counted(report.audited(blocks, config), config)
    timed = "ts" in per_block.columns
    mode = "None" if quiet is None and not timed else "EventTime" if timed else "ProcessingTime"
    keyed = per_block.withWatermark("ts", late) if timed else per_block
    wait = None if quiet is None else int(quiet.total_seconds() * 1000)
    states = keyed.groupBy("page_id").transformWithState(PageState(wait), f"page_id bigint, version bigint, final boolean, {_STATE}", "Update", mode)
    return report._scored(states.withColumn("total_chars", F.col("total_chars") - 2))


def score_writer(out: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch's scores to a folder by its id, so that a batch that runs again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return write


def scores_stream(blocks: DataFrame, config: AuditConfig, out: str, checkpoint: str, quiet: timedelta | None = None, late: str = "10 minutes") -> StreamingQuery:
    """Starts running() over what there is and writes each batch's scores below `out`."""
    return running(blocks, config, quiet, late).writeStream.outputMode("update").foreachBatch(score_writer(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(scores: DataFrame) -> DataFrame:
    """The last row of each page of what scores_stream() wrote."""
    return scores.groupBy("page_id").agg(F.max_by(F.struct(*[c for c in scores.columns if c != "page_id"]), F.struct("batch", "final")).alias("s")).select("page_id", "s.*")


def scores(blocks: DataFrame, config: AuditConfig) -> DataFrame:
    """What running() comes to after all blocks, as a batch: page_id, version, COUNTS, score and purity."""
    per_block = counted(report.audited(blocks, config), config)
    best = per_block.groupBy("page_id", "block_idx").agg(F.max(F.struct("version", *COUNTS)).alias("b")).select("page_id", "b.*")
    # a block's rows of smaller versions don't count, nor do blocks whose greatest version isn't their page's
    versions = best.groupBy("page_id", "version").agg(*[F.sum(c).alias(c) for c in COUNTS])
    newest = versions.groupBy("page_id").agg(F.max_by(F.struct("version", *COUNTS), "version").alias("v")).select("page_id", "v.*")
    return report._scored(newest.withColumn("total_chars", F.col("total_chars") - 2))
