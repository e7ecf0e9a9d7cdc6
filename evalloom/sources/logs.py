"""Result files and evaluation logs as data sources.

``eval_files`` reads the lines of the files below a folder as ``<round>/<family>/.../<model>.jsonl``. Conditions on round and
family are pushed to it, so folders that they rule out aren't even listed; small files are read many to a task.

``eval_log`` writes a log whose lines have an order as part files and a manifest. Tasks write to a folder of their run; only
when all have ended are the parts named by their order and the manifest is written, so a run that breaks off leaves nothing
that a reader would see, and lines needn't be brought into one file. Read again, lines carry their place in that order.

Paths are local ones or URIs that pyarrow knows.
"""

from __future__ import annotations

import fnmatch
import json
import os
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

TASK_BYTES, TASK_FILES = 64 << 20, 2000  # of the files that a task reads, about
ROWS = 4096  # lines of a batch
SKIPPED = "__pycache__,.git"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class Files(InputPartition):
    """Files of one task: (path, round, family, model)."""

    found: list[tuple[str, str | None, str | None, str]]

    def __init__(self, found):
        super().__init__(len(found))
        self.found = found


class FileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.pattern = options.get("pattern", "*.jsonl")
        self.skip = set(filter(None, options.get("skip", SKIPPED).split(",")))
        self.most = int(options.get("taskbytes", TASK_BYTES))
        self.wanted: dict[str, set[str]] = {}
        self.listed = 0  # files and folders that the listing has met

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes equalities and sets of round, family and model; others stay with Spark."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name not in ("round", "family", "model"):
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[name] = self.wanted.get(name, values) & values

    def _fits(self, name: str, value: str | None) -> bool:
        return name not in self.wanted or value in self.wanted[name]

    def files(self) -> Iterator[tuple[str, str | None, str | None, str, int]]:
        """path, round, family, model, size, by name; only folders that the conditions allow are listed."""
        fs, root = opened(self.root)

        def below(folder: str, way: tuple[str, ...]):
            for i in sorted(fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)), key=lambda i: i.base_name):
                self.listed += 1
                if i.type == pafs.FileType.Directory:
                    level = {0: "round", 1: "family"}.get(len(way))
                    if i.base_name not in self.skip and (level is None or self._fits(level, i.base_name)):
                        yield from below(i.path, (*way, i.base_name))
                elif fnmatch.fnmatch(i.base_name, self.pattern):
                    got = (way[0] if way else None, way[1] if len(way) > 1 else None, i.base_name.rsplit(".", 1)[0])
                    if all(self._fits(n, v) for n, v in zip(("round", "family", "model"), got, strict=True)):
                        yield i.path, *got, i.size

        yield from below(root, ())

    def partitions(self) -> list[Files]:
        out, held, size = [], [], 0
        for *found, n in self.files():
            if held and (size + n > self.most or len(held) >= TASK_FILES):
                out.append(Files(held))
                held, size = [], 0
            held.append(tuple(found))
            size += n
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.root)
        for path, *of in partition.found:
            with fs.open_input_stream(path) as stream:
                for at, lines in _batches(stream):
                    n = len(lines)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), *(pa.array([v] * n, pa.string()) for v in of), pa.array(range(at, at + n), pa.int64()), pa.array(lines, pa.string())], ["path", "round", "family", "model", "line", "value"])


def _batches(stream) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, lines) of a stream of bytes, a block at a time."""
    at, lines, rest = 0, [], b""
    while block := stream.read(1 << 20):
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        lines += [x.decode("utf-8", "replace").removesuffix("\r") for x in parts]
        while len(lines) >= ROWS:
            yield at, lines[:ROWS]
            at, lines = at + ROWS, lines[ROWS:]
    if rest:
        lines.append(rest.decode("utf-8", "replace"))
    if lines:
        yield at, lines


class EvalFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "eval_files"

    def schema(self) -> str:
        return "path string, round string, family string, model string, line long, value string"

    def reader(self, schema) -> FileReader:
        return FileReader(self.options)


@dataclass
class Part(WriterCommitMessage):
    """A task's file: path, first key, lines."""

    path: str
    first: int
    lines: int


class LogWriter(DataSourceWriter):
    """Columns: seq (long), value. Rows of a task come in order of seq, and tasks hold ranges of it."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex

    def _pending(self) -> str:
        return posixpath.join(opened(self.path)[1], "_pending", self.run)

    def write(self, iterator: Iterator) -> Part | None:
        fs, _ = opened(self.path)
        fs.create_dir(self._pending())
        path, first, n = posixpath.join(self._pending(), uuid.uuid4().hex), None, 0
        with fs.open_output_stream(path) as out:
            for row in iterator:
                first = row[0] if first is None else first
                out.write(row[1].encode() + b"\n")
                n += 1
        return Part(path, first if first is not None else 0, n)

    def commit(self, messages: list[Part | None]) -> None:
        fs, root = opened(self.path)
        parts = sorted((m for m in messages if m is not None and m.lines), key=lambda m: m.first)
        manifest = posixpath.join(root, "manifest.json")
        if self.overwrite and fs.get_file_info(manifest).type == pafs.FileType.File:
            fs.delete_file(manifest)  # from here on there is no log, until the new one is whole
        named, at = [], 0
        for k, m in enumerate(parts):
            name = f"part-{self.run}-{k:06d}.jsonl"
            fs.move(m.path, posixpath.join(root, name))
            named.append({"name": name, "start": at, "lines": m.lines})
            at += m.lines
        fs.delete_dir(self._pending())
        with fs.open_output_stream(manifest + "." + self.run) as out:
            out.write(json.dumps({"parts": named}).encode())
        fs.move(manifest + "." + self.run, manifest)
        keep = {p["name"] for p in named}
        for i in fs.get_file_info(pafs.FileSelector(root)):
            if i.base_name.startswith("part-") and i.base_name not in keep:
                fs.delete_file(i.path)

    def abort(self, messages: list[Part | None]) -> None:
        fs, _ = opened(self.path)
        if fs.get_file_info(self._pending()).type == pafs.FileType.Directory:
            fs.delete_dir(self._pending())


@dataclass
class LogPart(InputPartition):
    path: str
    start: int

    def __init__(self, path, start):
        super().__init__(start)
        self.path, self.start = path, start


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[LogPart]:
        fs, root = opened(self.path)
        with fs.open_input_stream(posixpath.join(root, "manifest.json")) as f:
            return [LogPart(posixpath.join(root, p["name"]), p["start"]) for p in json.loads(f.read())["parts"]]

    def read(self, partition: LogPart) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        with fs.open_input_stream(partition.path) as stream:
            for at, lines in _batches(stream):
                yield pa.RecordBatch.from_arrays([pa.array(range(partition.start + at, partition.start + at + len(lines)), pa.int64()), pa.array(lines, pa.string())], ["seq", "value"])


class EvalLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "eval_log"

    def schema(self) -> str:
        return "seq long, value string"

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def writer(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Makes both sources known to a session, with conditions pushed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (EvalFiles, EvalLog):
        spark.dataSource.register(source)
    return spark


def result_lines(spark: SparkSession, root: str, rounds: list[str] | None = None, families: list[str] | None = None, pattern: str = "*.jsonl", skip: str = SKIPPED, task_bytes: int = TASK_BYTES) -> DataFrame:
    """path, round, family, model, line, value of the result files below a folder, of the wanted rounds and families."""
    x = register(spark).read.format("eval_files").options(path=root, pattern=pattern, skip=skip, taskBytes=task_bytes).load()
    x = x.where(F.col("round").isin(*rounds)) if rounds else x
    return x.where(F.col("family").isin(*families)) if families else x


def write_log(summary: DataFrame, samples: DataFrame, path: str, seq: str = "index", parts: int | None = None) -> None:
    """An evaluation log: the summary's line, then the samples' lines in order of ``seq``, as parts of ranges and a manifest.

    Without ``parts`` the size decides how many there are.
    """
    head = summary.select(F.lit(-(1 << 62)).alias("seq"), F.to_json(F.struct(F.lit("summary").alias("kind"), *summary.columns)).alias("value"))
    rest = samples.select(F.col(seq).cast("long").alias("seq"), F.to_json(F.struct(F.lit("sample").alias("kind"), *samples.columns)).alias("value"))
    register(summary.sparkSession)
    ranged = head.union(rest).repartitionByRange(parts, "seq") if parts else head.union(rest).repartitionByRange("seq")
    ranged.sortWithinPartitions("seq").write.format("eval_log").option("path", path).mode("overwrite").save()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """seq (from 0: the summary), value of a log's lines; no order is made, seq tells it."""
    return register(spark).read.format("eval_log").option("path", path).load()
