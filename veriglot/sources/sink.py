"""A sink that writes rows that are in order as one file, or writes nothing."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

#: Bytes that are copied at a time when parts are joined.
PIECE = 8 << 20


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: the number of its partition, its file, and the keys of its first and last row."""

    number: int
    name: str
    rows: int
    first: tuple | None
    last: tuple | None


def comparable(values: tuple) -> tuple:
    """Keys in an order that puts nulls first, as an ascending sort does."""
    return tuple((v is not None, v) if v is not None else (False,) for v in values)


class OrderedFileWriter(DataSourceArrowWriter):
    """Each attempt of a task writes a file of its own into a folder beside the target. The commit joins the files of the
    attempts that count, by partition, and then renames; until that the target is what it was before. A lost executor's
    task runs again under another name, and what failed goes with the folder."""

    def __init__(self, path: str, names: list[str], folder: str):
        self.path, self.names, self.folder = path, names, folder

    def _system(self) -> tuple[pa.fs.FileSystem, str]:
        return pa.fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task, (system, _) = TaskContext.get(), self._system()
        name, rows, first, last = f"{self.folder}/{task.partitionId()}-{task.taskAttemptId()}", 0, None, None
        with system.open_output_stream(name) as out:
            for batch in iterator:
                *keys, lines = [batch.column(n).to_pylist() for n in (*self.names, "value")]
                if not lines:
                    continue
                for key in zip(*keys, strict=True):
                    key = comparable(key)
                    if last is not None and key < last:
                        raise ValueError("rows of an ordered file must be sorted by the columns before value")
                    first, last = key if first is None else first, key
                rows += len(lines)
                out.write("".join(f"{line or ''}\n" for line in lines).encode())
        return Part(task.partitionId(), name, rows, first, last)

    def commit(self, messages: list[Part | None]) -> None:
        system, target = self._system()
        try:
            if any(m is None for m in messages):
                raise ValueError("a task told nothing of what it wrote")
            parts = sorted((m for m in messages if m.rows), key=lambda m: m.number)
            for before, after in zip(parts, parts[1:]):
                if before.last is not None and after.first < before.last:
                    raise ValueError("rows of an ordered file must be sorted by the columns before value")
            whole = f"{self.folder}/whole"
            with system.open_output_stream(whole) as out:
                for part in parts:
                    with system.open_input_stream(part.name) as read:
                        while piece := read.read(PIECE):
                            out.write(piece)
            system.move(whole, target)
        finally:
            self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Takes the folder away. Only the driver makes it, so that a task that is still running can't bring it back; one that
        opens a file meanwhile makes it go at the next try."""
        system, _ = self._system()
        for again in range(5):
            try:
                if system.get_file_info(self.folder).type == pa.fs.FileType.Directory:
                    system.delete_dir(self.folder)
                return
            except OSError:
                time.sleep(0.1 * 2**again)


class OrderedFile(DataSource):
    """Format `ordered_file`: the lines in the column value, one file, in the order of the columns before it."""

    @classmethod
    def name(cls) -> str:
        return "ordered_file"

    def writer(self, schema: StructType, overwrite: bool) -> OrderedFileWriter:
        if schema.names[-1] != "value" or schema["value"].dataType != StringType():
            raise ValueError("an ordered file has a string column value, which is the last one")
        system, target = pa.fs.FileSystem.from_uri(self.options["path"])
        kind = system.get_file_info(target).type
        if kind == pa.fs.FileType.Directory or kind == pa.fs.FileType.File and not overwrite:
            raise ValueError(f"{target} is there already")
        folder = f"{target}.parts-{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        return OrderedFileWriter(self.options["path"], schema.names[:-1], folder)


def write_ordered(lines: DataFrame, path: str) -> None:
    """Writes the column value of `lines` (the last one) as one file at `path` (absolute, or an URI of a file system that all
    executors reach), sorted by the other columns, nulls first. Tasks write ranges of the order side by side; what is sorted
    is spread by Spark over all of them, and the commit copies their files one after the other in pieces of 8 MB. Whatever
    fails, the target stays as it was. Null lines are empty lines; without rows the file is empty. Without columns
    before value there is no order to ask for: rows come by partition."""
    lines.sparkSession.dataSource.register(OrderedFile)
    keys = lines.columns[:-1]
    (lines.orderBy(*keys) if keys else lines).write.format("ordered_file").mode("overwrite").save(path)
