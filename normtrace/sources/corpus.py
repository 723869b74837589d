"""Text corpora, CSV tables, process-graph documents and JSON reports."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, DataFrameReader, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normtrace.functions.text import strip

NODE = "struct<resourceId:string,NodeText:string,agent:string,type:string>"
FLOW = "struct<src:string,tgt:string,condition:string>"
PROCESS_GRAPH = (
    f"file_index bigint, paragraph string, step_nodes array<{NODE}>, SequenceFlow array<{FLOW}>, "
    "data_nodes array<string>, text_nodes array<string>, MessageFlow array<string>, "
    "Association array<string>, or_node_num int"
)


READ, NOT_UTF8, FAILED = "read", "not UTF-8", "failed"
TASKS_PER_CORE = 16


def write_texts(texts: DataFrame, path: str, folders: list[str]) -> None:
    """One file per row of ``texts(value, *folders)``, in a folder ``name=value`` for each of ``folders``, as the text writer has it.

    Hadoop's local file system starts a ``chmod`` process for each file and each checksum file, some 20 ms a row, so on
    local and mounted folders the tasks write their files themselves. Their names follow from the place of a row in its
    partition: a task that is tried again writes over its own files. Other file systems get the text writer.
    """
    root = _local_root(texts.sparkSession, path)
    if root is None:
        texts.write.partitionBy(*folders).option("maxRecordsPerFile", 1).text(path)
        return
    os.makedirs(root)

    def write(rows: Iterator[Row]) -> None:
        part, made = TaskContext.get().partitionId(), set()
        for i, row in enumerate(rows):
            folder = "/".join([root, *(f"{name}={_escaped(row[name])}" for name in folders)])
            if folder not in made:
                os.makedirs(folder, exist_ok=True)
                made.add(folder)
            with open(f"{folder}/part-{part:05d}-{i:09d}.txt", "wb") as file:
                file.write(bytes(row["value"] or b"") + b"\n")

    texts.select(F.col("value").cast("binary").alias("value"), *[F.col(c).cast("string").alias(c) for c in folders]).foreachPartition(write)


def _local_root(spark: SparkSession, path: str) -> str | None:
    """The path on a local or mounted folder, null on any other file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return "/" + whole.removeprefix("file:").lstrip("/") if whole.startswith("file:") else None


def _escaped(value: str | None) -> str:
    """A value as Spark writes it in the name of a folder."""
    return re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda c: f"%{ord(c[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__"


def read_corpus(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """``source, text`` of every text file under ``root``: ``parentfolder/file`` and stripped content.

    One row per file however deep it lies; files that are no UTF-8 are left out (:func:`file_status`
    tells which). A file that cannot be read at all stops the job.
    """
    files = _files(spark.read.option("wholetext", True), "text", root, glob)
    return _merged(files.where(F.is_valid_utf8("value")).select(_source(), strip(F.col("value")).alias("text")))


def file_status(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """``source, status`` of every file listed under ``root``: read, not UTF-8, or failed on reading.

    Spark's readers keep about 2 KB a file on the driver and list the folder for each of two scans, so files of local and
    mounted folders are opened once, by :func:`normtrace.sources.files.read_files`; other folders, and patterns of
    Hadoop's own kind, get Spark's readers.
    """
    local = None if set(root) & set("*?[{\\") or set(glob) & set("[{\\") else _local_root(spark, root)
    return _status_of_scans(spark, root, glob) if local is None else _status_once(spark, local, glob)


def _status_once(spark: SparkSession, root: str, glob: str) -> DataFrame:
    from normtrace.sources.files import read_files  # it takes its reasons from here

    return read_files(spark, root, glob, hidden=False).select("source", F.coalesce("reason", F.lit(READ)).alias("status"))


def _status_of_scans(spark: SparkSession, root: str, glob: str) -> DataFrame:
    path = F.col("_metadata.file_path").alias("_path")
    listed = _files(spark.read, "binaryFile", root, glob).select(path, _source())
    tried = _files(spark.read.option("wholetext", True).option("ignoreCorruptFiles", True), "text", root, glob)
    opened = tried.select(path, F.is_valid_utf8("value").alias("_valid"))
    status = F.when(F.col("_valid").isNull(), FAILED).when(F.col("_valid"), READ).otherwise(NOT_UTF8)
    return _merged(listed).join(_merged(opened), "_path", "left").select("source", status.alias("status"))


def unreadable_files(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """The files that give no text, with the reason."""
    return file_status(spark, root, glob).where(F.col("status") != READ)


def _files(reader: DataFrameReader, kind: str, root: str, glob: str) -> DataFrame:
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", glob).format(kind).load(root)


def _merged(rows: DataFrame) -> DataFrame:
    """Rows of files in tasks that take many files each.

    Spark counts opening a file as 4 MB, so that a task has some 30 small files and most of its time goes in its start.
    Files are still read one after the other, so a task holds no more than before.
    """
    return rows.coalesce(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)


def _source() -> Column:
    path = F.split(F.col("_metadata.file_path"), "/")
    name = F.concat_ws("/", F.element_at(path, -2), F.element_at(path, -1))
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("source")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with header and quoted multi-line texts, under a given schema (no inference pass)."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"',
                          ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header; texts quoted, quotes doubled, line breaks and outer blanks kept."""
    df.write.csv(path, mode=mode, header=True, quoteAll=True, quote='"', escape='"',
                 ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_process_graphs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Process-graph documents: one indented document per file, or one per line for big corpora."""
    return spark.read.schema(PROCESS_GRAPH).json(path, multiLine=multi_line)


def process_nodes(graphs: DataFrame) -> DataFrame:
    return graphs.select("file_index", F.posexplode("step_nodes").alias("node_pos", "n")).select(
        "file_index", "node_pos", F.col("n.resourceId").alias("resource_id"),
        F.col("n.NodeText").alias("node_text"), "n.agent", "n.type")


def process_flows(graphs: DataFrame) -> DataFrame:
    return graphs.select("file_index", F.posexplode("SequenceFlow").alias("flow_pos", "f")).select(
        "file_index", "flow_pos", "f.src", "f.tgt", "f.condition")


def write_report(report: DataFrame, path: str, mode: str = "errorifexists", indented: bool = False) -> None:
    """One JSON object per row, non-ASCII kept, null fields kept; one per line unless indented."""
    report.write.option("ignoreNullFields", False).option("pretty", indented).json(path, mode=mode)
