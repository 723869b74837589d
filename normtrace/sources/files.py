"""Text files as a Spark data source that reports what it cannot read, in the same pass.

``read_files`` lists a folder once and deals the files to tasks by bytes. A task gives one row per file: its
text, or the reason why there is none; a file that is gone, forbidden, or no UTF-8 costs that row only.
Paths are those that ``pyarrow.fs`` opens (local and shared folders, HDFS, S3); ``corpus.read_corpus`` serves others.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from normtrace.functions.text import strip
from normtrace.sources.corpus import FAILED, NOT_UTF8

SCHEMA = "source string, text string, reason string"
BYTES_PER_TASK = 128 * 2**20
OPENING = 2**16  # what opening a file costs, in bytes read; a task of small files takes some 2,000 of them
ROW_BYTES = 2**10
BATCH_BYTES = 8 * 2**20


class FileGroup(InputPartition):
    def __init__(self, root: str, paths: list[str]):
        self.root, self.paths = root, paths


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.glob = options["path"], options.get("glob", "*.txt")
        self.limit = int(options.get("bytespertask", BYTES_PER_TASK))
        self.hidden = options.get("hidden", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        """Files in order of path, cut where a task has its share."""
        system, base = _opened(self.root)
        files = sorted((f for f in system.get_file_info(fs.FileSelector(base, recursive=True))
                        if f.type != fs.FileType.Directory and fnmatchcase(f.base_name, self.glob)
                        and (self.hidden or not _is_hidden(f.path[len(base):]))), key=lambda f: f.path)
        groups: list[list[str]] = []
        held = self.limit
        for file in files:
            cost = OPENING + (file.size or 0)
            if held + cost > self.limit:
                groups.append([])
                held = 0
            groups[-1].append(file.path)
            held += cost
        return [FileGroup(self.root, paths) for paths in groups] or [FileGroup(self.root, [])]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(partition.root)
        rows, size = [], 0
        for path in partition.paths:
            text = reason = None
            try:
                with system.open_input_stream(path) as stream:
                    text = stream.read().decode()
            except UnicodeDecodeError:
                reason = NOT_UTF8
            except OSError:
                reason = FAILED
            rows.append(("/".join(path.split("/")[-2:]), text, reason))
            size += ROW_BYTES + len(text or "")
            if size > BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


class CorpusFiles(DataSource):
    """``spark.read.format("corpus_files")`` with ``path``, ``glob``, ``bytesPerTask``, ``hidden``."""

    @classmethod
    def name(cls) -> str:
        return "corpus_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CorpusReader:
        return CorpusReader(self.options)


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("/") else f"file://{root.removeprefix('file:')}")


def _is_hidden(path: str) -> bool:
    """Does Spark leave out the file, for its name or that of a folder it lies in?"""
    return any(name.startswith(".") or (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))
               or name.endswith("._COPYING_") for name in path.split("/"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, pa.string()) for column in zip(*rows)], ["source", "text", "reason"])


def read_files(spark: SparkSession, root: str, glob: str = "*.txt", bytes_per_task: int = BYTES_PER_TASK, hidden: bool = True) -> DataFrame:
    """``source, text, reason`` of every file under ``root``: stripped text, or null and why.

    An empty file has an empty text; an empty folder gives no rows; a missing one stops the job. ``hidden`` files are
    those that Spark's readers leave out.
    """
    spark.dataSource.register(CorpusFiles)
    files = spark.read.format("corpus_files").option("path", root).option("glob", glob).option("bytesPerTask", bytes_per_task) \
        .option("hidden", hidden).load()
    return files.select("source", strip(F.col("text")).alias("text"), "reason")
