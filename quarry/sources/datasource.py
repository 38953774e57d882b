"""Spreadsheets as a data source with a partition for each file, and reports as a sink whose commit publishes all or nothing.

Both are Python data sources: `spark.read.format("quarry_workbooks")` and
`df.write.format("quarry_report")` after `register(spark)`. Paths are those of
pyarrow's file systems (local and mounted folders, and the schemes it knows).

A report is written by tasks into a folder beside its place, one file for each
attempt of a task. The driver's commit moves the folder of those that counted to
the report's place; a failed job removes it, and what was there before stays.
Markdown and lines of JSON can also be one file (`single`): its parts are then
put together in the order of partitions, a piece at a time.
"""

from __future__ import annotations

import datetime
import decimal
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quarry.sources.workbooks import CELLS, cells

EXTENSIONS = {"jsonl": "jsonl", "markdown": "md"}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class File(InputPartition):
    path: str


class Workbooks(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        system, folder = _place(self.path)
        found = system.get_file_info(fs.FileSelector(folder, recursive=True))
        return [File(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.lower().endswith(".xlsx")]

    def read(self, partition: File | None) -> Iterator[tuple]:
        if partition is None:  # a folder without workbooks
            return
        system, _ = _place(self.path)
        names = [c.split()[0] for c in CELLS.split(", ")]
        with system.open_input_file(partition.path) as f:
            content = f.read()
        for row in cells(partition.path, content):
            yield tuple(row[n] for n in names)


class WorkbookSource(DataSource):
    """Cells and text boxes of all .xlsx files below `path`."""

    @classmethod
    def name(cls) -> str:
        return "quarry_workbooks"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: StructType) -> DataSourceReader:
        return Workbooks(self.options["path"])


def plain(value):
    """A value as JSON has it: rows as objects, dates as text, decimals as numbers in text."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (bytes, bytearray)):
        return value.hex()
    return value


def cell(value) -> str:
    """A value in a Markdown table: one line, with bars escaped; null is empty."""
    if value is None:
        return ""
    text = value if isinstance(value, str) else json.dumps(plain(value), ensure_ascii=False)
    return " ".join(text.replace("\\", "\\\\").replace("|", "\\|").split())


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    rows: int


class ReportWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], form: str, single: bool, title: str, overwrite: bool) -> None:
        if form not in EXTENSIONS:
            raise ValueError(f"a report is one of {sorted(EXTENSIONS)}, not {form!r}")
        self.path, self.columns, self.form, self.single, self.title, self.overwrite = path.rstrip("/"), columns, form, single, title, overwrite
        self.work = f"{self.path}.part-{uuid.uuid4().hex}"

    def _line(self, row: Row) -> str:
        if self.form == "markdown":
            return "| " + " | ".join(cell(v) for v in row) + " |"
        return json.dumps({c: plain(v) for c, v in zip(self.columns, row, strict=True)}, ensure_ascii=False)

    def _head(self) -> str:
        if self.form != "markdown":
            return ""
        title = f"# {self.title}\n\n" if self.title else ""
        return title + "| " + " | ".join(cell(c) for c in self.columns) + " |\n|" + " --- |" * len(self.columns) + "\n"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        context = TaskContext.get()
        system, folder = _place(self.work)  # made by the driver: a task that outlives its job finds no folder
        name, n = f"part-{context.partitionId():06}-{context.taskAttemptId()}.{EXTENSIONS[self.form]}", 0
        with system.open_output_stream(f"{folder}/{name}") as out:
            if not self.single:
                out.write(self._head().encode())
            for row in iterator:
                out.write((self._line(row) + "\n").encode())
                n += 1
        return Written(context.partitionId(), name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, work = _place(self.work)
        _, target = _place(self.path)
        kept = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        names = {m.name for m in kept}
        for f in system.get_file_info(fs.FileSelector(work)):
            if f.base_name not in names:
                system.delete_file(f.path)  # of attempts that don't count
        there = system.get_file_info(target).type != fs.FileType.NotFound
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(target)
        made = work
        if self.single:
            made = f"{work}/whole"
            with system.open_output_stream(made) as out:
                out.write(self._head().encode())
                for m in kept:
                    with system.open_input_stream(f"{work}/{m.name}") as part:
                        while piece := part.read(1 << 20):
                            out.write(piece)
        aside = f"{work}.before"
        if there:
            system.move(target, aside)
        system.move(made, target)
        if there:
            self._remove(system, aside)
        if self.single:
            self._remove(system, work)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, work = _place(self.work)
        self._remove(system, work)

    @staticmethod
    def _remove(system: fs.FileSystem, path: str) -> None:
        for last in (False, False, False, True):  # a task may be about to end, and leave a file while its folder goes
            kind = system.get_file_info(path).type
            try:
                if kind == fs.FileType.Directory:
                    system.delete_dir(path)
                elif kind == fs.FileType.File:
                    system.delete_file(path)
                return
            except OSError:
                if last:
                    raise
                time.sleep(0.5)


class ReportSink(DataSource):
    """Reports as lines of JSON or Markdown tables. Options: path, form (jsonl, markdown), single (true for one file), title."""

    @classmethod
    def name(cls) -> str:
        return "quarry_report"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        o = self.options
        writer = ReportWriter(o["path"], schema.names, o.get("form", "jsonl"), str(o.get("single", "false")).lower() == "true", o.get("title", ""), overwrite)
        system, work = _place(writer.work)
        system.create_dir(work, recursive=True)
        return writer


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)
    spark.dataSource.register(ReportSink)
