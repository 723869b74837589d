"""Report documents of any size: one JSON document per norm, written as ordered lines over as many files as it needs.

A document is its head, one line per scenario, and its foot. The lines of all norms are dealt by range of
(norm, part, place) and written in that order to a folder per norm; the files of a folder, put together by name,
are the document. No row and no task holds more than its share of a norm. Each folder and file costs the driver some
memory when they are listed, so ``write_packed`` gives a folder to large norms only: a small document is a line of a
file that it shares with others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normtrace.operators.scoring import average_score
from normtrace.session import settle_counted

HEAD, ENTRY, FOOT = 0, 1, 2
KEEP_NULLS = {"ignoreNullFields": "false"}
OPENING, CLOSING = ',"scenarios":[', "]}"
PACKED_CHARS = 2**18  # longest document that is one line of a shared file
LINES, FOLDERS = "lines", "folders"
HEAD_FIELDS = ("norm_id bigint, execution_time_seconds double, average_score double, "
               "normative_reference struct<intent_T:string,nb_states:bigint,nb_edges:bigint>")
ENTRY_FIELDS = ("scenario string, score double, intent_F string, "
                "violations array<struct<transition_index:int,attempted_state:string,missing_preconditions:array<string>>>, "
                "contaminated_states array<string>, explanation string")


def report_fragments(results: DataFrame, norms: DataFrame, execution_time_seconds: float | None = None) -> DataFrame:
    """``norm_id, part, place, line`` of the documents of all norms with results.

    ``results`` holds one row per scenario with its ``scenario_pos`` from 1 in its norm, as
    ``plans.audit.number_scenarios`` gives it. A norm without exactly one first place, or with a null or lower one,
    stops the job; later places may repeat (the lines decide then) or be left out. It may carry ``scenario``, ``intent_F`` and ``explanation``, and is read twice, so it should be a settled table. Rows
    without ``norm_id`` make one document. Norms that ``norms`` lacks have nulls in their head; no results give no lines.
    """
    def col(name: str):
        return F.col(name) if name in results.columns else F.lit(None).cast("string")

    scenario = F.col("scenario") if "scenario" in results.columns else F.col("scenario_id").cast("string")
    entry = F.to_json(F.struct(
        scenario.alias("scenario"), "score", col("intent_F").alias("intent_F"), "violations", "contaminated_states",
        F.coalesce(col("explanation"), F.lit("")).alias("explanation")), KEEP_NULLS)
    comma = F.when(F.col("scenario_pos") == 1, F.lit("")).otherwise(F.lit(","))
    entries = results.select("norm_id", F.lit(ENTRY).alias("part"), F.col("scenario_pos").cast("long").alias("place"),
                             F.concat(comma, entry).alias("line"))

    pos = F.col("scenario_pos").cast("long")
    sound_places = (F.min(pos) == 1) & (F.count_if(pos == 1) == 1) & (F.count(pos) == F.count("*"))
    sums = average_score(results).select(F.col("norm_id").alias("_m"), "average_score")
    known = norms.select(F.col("norm_id").alias("_k"), "intent_T", "nb_states", "nb_edges")
    heads = (
        results.groupBy("norm_id").agg(sound_places.alias("_sound"))
        .join(sums, F.col("norm_id").eqNullSafe(F.col("_m")), "left")
        .join(known, F.col("norm_id").eqNullSafe(F.col("_k")), "left")
    )
    head = F.to_json(F.struct(
        "norm_id", F.lit(execution_time_seconds).cast("double").alias("execution_time_seconds"), "average_score",
        F.struct("intent_T", "nb_states", "nb_edges").alias("normative_reference")), KEEP_NULLS)
    sound = F.when(F.col("_sound"), head).otherwise(
        F.raise_error(F.concat(F.lit("scenario_pos does not begin with one 1 in norm "), F.coalesce(F.col("norm_id").cast("string"), F.lit("null")))))
    opened = F.concat(F.substring(sound, F.lit(1), F.length(sound) - 1), F.lit(OPENING))
    lines = F.array(F.struct(F.lit(HEAD).alias("part"), opened.alias("line")), F.struct(F.lit(FOOT).alias("part"), F.lit(CLOSING).alias("line")))
    ends = heads.select("norm_id", F.inline(lines)).select("norm_id", "part", F.lit(0).cast("long").alias("place"), "line")
    return entries.unionByName(ends)


def write_documents(fragments: DataFrame, path: str, files: int | None = None, mode: str = "errorifexists") -> None:
    """Write the lines of each norm, in order, to ``path/norm_id=...``.

    ``files`` (default: the session's shuffle partitions, merged by AQE where they are small) is the number of ranges.
    """
    keys = ["norm_id", "part", "place"]
    ranged = fragments.repartitionByRange(files, *keys) if files else fragments.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys, "line").select("norm_id", "line").write.partitionBy("norm_id").mode(mode).text(path)


def write_packed(fragments: DataFrame, path: str, most: int = PACKED_CHARS) -> bool:
    """Write documents of up to ``most`` characters as lines of ``path/lines``, larger ones as folders of ``path/folders``.

    So there are no more folders than ``most`` goes into the text of all documents. Tells whether any document is that large.
    ``fragments`` is read two or three times, so what it comes from should be a settled table.
    """
    long = fragments.groupBy("norm_id").agg(F.sum(F.length("line")).alias("n")).where(F.col("n") > most)
    long, n_long = settle_counted(long.select(F.col("norm_id").alias("_long")), "long-norms")
    is_long = F.col("norm_id").eqNullSafe(F.col("_long"))
    short = fragments.join(long, is_long, "left_anti") if n_long else fragments
    in_order = F.array_sort(F.collect_list(F.struct("part", "place", "line")))
    documents = short.groupBy("norm_id").agg(in_order.alias("_lines"))
    documents.select(F.array_join(F.transform("_lines", lambda entry: entry["line"]), "").alias("value")).write.text(f"{path}/{LINES}")
    if n_long:
        write_documents(fragments.join(long, is_long, "left_semi"), f"{path}/{FOLDERS}")
    return n_long > 0


def read_packed(spark: SparkSession, path: str, folders: bool) -> tuple[DataFrame, DataFrame]:
    """As :func:`read_documents`, of what :func:`write_packed` wrote; ``folders`` is what that told."""
    entry = F.from_json("value", f"{HEAD_FIELDS}, scenarios array<struct<{ENTRY_FIELDS}>>")
    documents = spark.read.schema("value string").text(f"{path}/{LINES}").select(entry.alias("d"))
    heads = documents.select("d.norm_id", "d.execution_time_seconds", "d.average_score", "d.normative_reference")
    entries = documents.select("d.norm_id", F.inline("d.scenarios"))
    if not folders:
        return heads, entries
    long_heads, long_entries = read_documents(spark, f"{path}/{FOLDERS}")
    return heads.unionByName(long_heads), entries.unionByName(long_entries)


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(heads, scenarios) of the written documents: the fields of each, with ``norm_id``; lines are parsed where they lie."""
    lines = spark.read.schema("value string, norm_id bigint").text(path).where(F.col("value") != CLOSING)
    is_head = F.endswith("value", F.lit(OPENING)) & F.startswith("value", F.lit('{"norm_id":'))
    heads = lines.where(is_head).select(F.from_json(F.concat(F.expr(f"left(value, length(value) - {len(OPENING)})"), F.lit("}")), HEAD_FIELDS).alias("h")).select("h.*")
    entries = lines.where(~is_head).select("norm_id", F.from_json(F.ltrim("value", F.lit(",")), ENTRY_FIELDS).alias("e")).select("norm_id", "e.*")
    return heads, entries
