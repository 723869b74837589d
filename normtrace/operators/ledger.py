"""A ledger of model calls: every attempt is kept, and a resumed job asks only what has no success.

Calls are keyed by what is asked (kind and SHA-256 of the prompt), so a text that occurs on many rows is
asked once and its answer joined back. Open prompts are written to files; a stream takes some files at a
time, asks, and writes the answers of that micro-batch to a folder of its own. What is written stays: a job
that dies loses at most the micro-batch at hand, and the next one starts from the ledger, with another
attempt for what failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normtrace.operators.models import METRIC_NAMES, SUCCESS, Loader, generate
from normtrace.session import fresh_path

CALLS = ("kind string, content string, attempt int, text string, latency_s double, prompt_tokens int, completion_tokens int, "
         "total_tokens int, finish_reason string, status string")
KEY = ["kind", "content"]
TRIES = 3
ROWS_PER_FILE = 1000


def content_hash(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def read_calls(spark: SparkSession, folder: str) -> DataFrame:
    """All attempts in the ledger at ``folder``; none if nothing was written yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/calls")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], CALLS)
    return spark.read.schema(CALLS).option("recursiveFileLookup", "true").parquet(f"{folder}/calls")


def settled_calls(calls: DataFrame) -> DataFrame:
    """One row per key: its last attempt, a success before a failure of the same number; and ``attempts``."""
    rest = [c for c in calls.columns if c not in KEY]
    order = F.struct("attempt", (F.col("status") == SUCCESS).alias("ok"), F.xxhash64(*rest))
    last = calls.groupBy(*KEY).agg(F.max_by(F.struct(*rest), order).alias("l"), F.max("attempt").alias("attempts"))
    return last.select(*KEY, *[F.col(f"l.{c}").alias(c) for c in rest if c != "attempt"], "attempts")


def open_prompts(df: DataFrame, prompt: str, calls: DataFrame, kind: str, tries: int = TRIES) -> DataFrame:
    """``(kind, content, attempt, prompt)`` of each distinct prompt without a success and with attempts left."""
    asked = df.where(F.col(prompt).isNotNull()).select(content_hash(F.col(prompt)).alias("content"), F.col(prompt).alias("prompt")).dropDuplicates(["content"])
    known = calls.where(F.col("kind") == kind).groupBy("content").agg(F.max("attempt").alias("before"), F.max(F.coalesce(F.col("status") == SUCCESS, F.lit(False))).alias("done"))
    left = asked.join(known, "content", "left").where(~F.coalesce("done", F.lit(False)) & (F.coalesce("before", F.lit(0)) < tries))
    return left.select(F.lit(kind).alias("kind"), "content", (F.coalesce("before", F.lit(0)) + 1).alias("attempt"), "prompt")


def ask_open(df: DataFrame, prompt: str, loader: Loader, folder: str, kind: str, tries: int = TRIES,
             rows_per_file: int = ROWS_PER_FILE, files_at_once: int = 1, **options) -> None:
    """One pass: every open prompt of ``df`` is asked once, micro-batch by micro-batch, into the ledger."""
    spark = df.sparkSession
    waiting = fresh_path(spark, "prompts")
    open_ = open_prompts(df, prompt, read_calls(spark, folder), kind, tries)
    open_.write.option("maxRecordsPerFile", rows_per_file).parquet(waiting)
    done_in = f"{folder}/calls/{waiting.rsplit('/', 1)[1]}"

    def record(batch: DataFrame, number: int) -> None:
        # a micro-batch that is done again writes over its own folder
        answered = generate(batch, "prompt", loader, out="_g", **options)
        answered.select(*KEY, "attempt", *[F.col(f"_g.{c}").alias(c) for c in METRIC_NAMES]).select(*[p.split()[0] for p in CALLS.split(", ")]) \
            .write.mode("overwrite").parquet(f"{done_in}/batch-{number}")

    stream = spark.readStream.schema(open_.schema).option("maxFilesPerTrigger", files_at_once).parquet(waiting)
    stream.writeStream.foreachBatch(record).option("checkpointLocation", f"{waiting}-progress").trigger(availableNow=True).start().awaitTermination()


def ask(df: DataFrame, prompt: str, loader: Loader, folder: str, kind: str, passes: int = 1, tries: int = TRIES, **options) -> DataFrame:
    """``df`` with the answer to its prompt (the metrics of a call) and ``attempts``, over the ledger at ``folder``.

    Up to ``passes`` passes are made, each over what is still open; null prompts are not asked and have
    null metrics. Rows of equal prompts share one call.
    """
    spark = df.sparkSession
    for _ in range(passes):
        if open_prompts(df, prompt, read_calls(spark, folder), kind, tries).isEmpty():
            break
        ask_open(df, prompt, loader, folder, kind, tries, **options)
    answers = settled_calls(read_calls(spark, folder).where(F.col("kind") == kind)).drop("kind").withColumnRenamed("content", "_content")
    return df.join(answers, content_hash(F.col(prompt)) == F.col("_content"), "left").drop("_content")
