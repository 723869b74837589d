"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROWS_PER_TASK = 1 << 18
CHECKPOINT_CONF = "spark.checkpoint.dir"
_LOCAL_FOLDERS: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def build_session(app: str = "normtrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC timestamps; ``conf`` overrides anything."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # list aggregates leave the hash map for sorting after 128 groups by default
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "10000",
        "spark.ui.enabled": "false",
    }
    if (master or "").startswith("local"):
        # small tables: rows grow after some shuffles (a state tells others), so give each core its share
        settings["spark.sql.adaptive.coalescePartitions.minPartitionSize"] = "64KB"
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    A local run that names none gets a temporary folder. On any other master that would leave parts of a
    table on machines that the others cannot read, so the job stops.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"master {master}: name a folder that all executors reach in {CHECKPOINT_CONF}")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="spark-")
        base = _LOCAL_FOLDERS[app]
    return base.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """Give heavy per-row work one partition per core when the input comes in fewer.

    That is a shuffle of whole rows, worth it where the work on a row costs far more than moving it; an
    input with as many splits as cores is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def deal(df: DataFrame, rows: int, keys: list[str], rows_per_task: int | None = None) -> DataFrame:
    """Partition about ``rows`` rows by ``keys``, a bounded number to a task.

    AQE merges the partitions of a shuffle until there is about one a core, so the tables that a task holds
    would grow with the input. Where a core gets no more than its share, that merging is left to AQE.
    """
    tasks = -(-rows // (rows_per_task or ROWS_PER_TASK))
    return df.repartition(tasks, *keys) if tasks > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*keys)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed once per row.

    Filters on a plain column may be pushed below its projection, which computes it a second time;
    they cannot pass a generator.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path for ``name`` in the shared folder."""
    return f"{shared_folder(spark)}/normtrace/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Cuts the lineage, survives lost executors, and gives Catalyst the true size of the table, so
    that it broadcasts the table only when it is under ``spark.sql.autoBroadcastJoinThreshold``. So the
    values are written as they are: dictionaries and compression make files of repeated values a
    hundredth of the rows that a broadcast would hold on the driver.
    """
    return _settled(df, name, {"compression": "none", "parquet.enable.dictionary": "false"})


def settle_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """As :func:`settle`, with the number of rows."""
    seen = Observation()
    return settle(df.observe(seen, F.count(F.lit(1)).alias("n")), name), seen.get["n"]


def settle_packed(df: DataFrame, name: str) -> DataFrame:
    """As :func:`settle`, in compressed files: for whole texts and the like, whose size tells little less."""
    return _settled(df, name, {})


def _settled(df: DataFrame, name: str, options: dict[str, str]) -> DataFrame:
    spark = df.sparkSession
    path = fresh_path(spark, name)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that plans settle inside the block are deleted when it ends; write results before that."""
    written = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    first = len(written)
    try:
        yield
    finally:
        for path in written[first:]:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        del written[first:]
