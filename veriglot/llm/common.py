"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space of the contracts, [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
#: Python handles so much text at a time, whatever the number of rows in an Arrow batch.
SLICE_BYTES = 2_000_000
#: Rows and bytes of an Arrow batch; the JVM and Python hold several batches for each task.
BATCH_ROWS, BATCH_BYTES = 2_000, 16_000_000
BATCH_KEYS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
#: Words that a worker remembers results for, in each of two generations.
REMEMBERED = 120_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def drawn(df: DataFrame, total: int, rows: int, seed: int = 7) -> DataFrame:
    """A random sample of about `rows` of the `total` rows, drawn inside each partition: however many tasks there are,
    together they keep no more, and copies of a row are drawn one by one."""
    return df.filter(F.rand(seed) < rows / total) if total > rows else df


def scratch_root(spark: SparkSession) -> str:
    """This application's folder in the one that all executors share: spark.checkpoint.dir, else what setCheckpointDir()
    was given. Without either, a local folder serves a local session only; elsewhere executors would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "veriglot-scratch")
    return f"{root.rstrip('/')}/veriglot-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Deletes all tables that operators of this application wrote in between, and sets back the session's Arrow
    settings. Results not yet written read these tables and count on these settings."""
    for key in BATCH_KEYS:
        held = spark.conf.get(f"veriglot.before.{key}", None)
        if held == "none":
            spark.conf.unset(key)
        elif held is not None:
            spark.conf.set(key, held)
        spark.conf.unset(f"veriglot.before.{key}")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes a table in the shared folder and reads it back."""
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Memory(dict):
    """Results by word, in two generations: when the young one is full it becomes the old one, and words that are
    wanted again come back from there."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def missing(self, wanted: set) -> set:
        """Of wanted, what isn't known; all that is known is in the young generation afterwards."""
        new = wanted.difference(self)
        if len(self) + len(new) > REMEMBERED:
            self.old = dict(self)
            self.clear()
            new = wanted
        back = {w: self.old[w] for w in new if w in self.old}
        self.update(back)
        return new.difference(back)


def sliced(batches: Iterator[pa.RecordBatch], weigh: int | tuple[int, ...], most: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches where column number `weigh` (string or binary), or several together, would exceed `most` bytes."""
    import pyarrow.compute as pc

    for batch in batches:
        first, held = 0, 0
        sizes = (pc.fill_null(pc.binary_length(batch.column(c)), 0).to_pylist() for c in ((weigh,) if isinstance(weigh, int) else weigh))
        for i, n in enumerate(map(sum, zip(*sizes, strict=True))):
            if held and held + n > most:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        if first < batch.num_rows:
            yield batch.slice(first)


def with_id(df: DataFrame, id_col: str, rest: str, name: str | None = None) -> StructType:
    """Schema of the column id_col, called name, and of the columns in the DDL string rest."""
    return StructType([StructField(name or id_col, df.schema[id_col].dataType), *StructType.fromDDL(rest).fields])


def packed_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc (a struct of all columns, whatever their names) and the text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text_col}`").alias(text_col))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session are cut by rows and by bytes, more finely than before if not already so: results
    are computed when the caller asks for them, so the settings have to stay until then. clean() sets them back."""
    for key, most in zip(BATCH_KEYS, (BATCH_ROWS, BATCH_BYTES), strict=True):
        held = spark.conf.get(key, None)
        now = int(re.sub(r"\D", "", held or "") or 0)
        if not 0 < now <= most or re.search("[kmgt]", str(held).lower()):
            spark.conf.set(f"veriglot.before.{key}", "none" if held is None else held)
            spark.conf.set(key, most)


def map_slices(df: DataFrame, schema: StructType, weigh: int | tuple[int, ...] | None, start: Callable[[], Callable[[pa.RecordBatch], list]], most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over slices of bounded size (weigh None: over batches as they come). start() runs once in each task and returns the function that makes the
    output columns of a slice."""
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = start()
        for batch in (batches if weigh is None else sliced(batches, weigh, most)):
            made = columns(batch)
            yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type) for x, f in zip(made, out, strict=True)], schema=out)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
