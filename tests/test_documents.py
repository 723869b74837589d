"""Report documents written as ordered lines: each is valid JSON, in order, however many files it takes."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from normtrace.operators.scoring import average_score
from normtrace.plans import audit as au
from normtrace.sources import documents as dc

RESULTS = ("norm_id bigint, scenario_id bigint, scenario string, score double, scenario_pos int, "
           "violations array<struct<transition_index:int,attempted_state:string,missing_preconditions:array<string>>>, "
           "contaminated_states array<string>, extra string, line string, part string, place string")
NORMS = "norm_id bigint, intent_T string, nb_states bigint, nb_edges bigint"


def documents(path):
    """Text of each folder, its files put together by name."""
    out = {}
    for folder in glob.glob(f"{path}/norm_id=*"):
        text = "".join(open(name, encoding="utf-8").read() for name in sorted(glob.glob(f"{folder}/part-*")))
        out[folder.rsplit("=", 1)[1]] = json.loads(text)
    return out


def test_a_norm_of_a_million_scenarios(spark, tmp_path):
    """One norm holds nearly all rows; it takes many files and stays one document."""
    n = 1_000_000
    no_strings = F.array().cast("array<string>")
    results = spark.range(n + 5).select(
        F.when(F.col("id") < n, 7).otherwise(8).cast("long").alias("norm_id"), (F.col("id") * 31 % n).alias("scenario_id"),
        (F.col("id") % 10001 / 10000.0).cast("double").alias("score"),
        F.when(F.col("id") < n, F.col("id") + 1).otherwise(F.col("id") - n + 1).cast("int").alias("scenario_pos"),
        F.array().cast(f"array<{au.VIOLATION}>").alias("violations"), no_strings.alias("contaminated_states"))
    norms = spark.createDataFrame([(7, "é \"x\"", 3, 2)], NORMS)
    path = str(tmp_path / "out")
    dc.write_documents(dc.report_fragments(results, norms), path, files=12)
    assert len(glob.glob(f"{path}/norm_id=7/part-*")) >= 10
    got = documents(path)
    assert [s["scenario"] for s in got["7"]["scenarios"]] == [str(i * 31 % n) for i in range(n)]
    assert got["7"]["normative_reference"] == {"intent_T": 'é "x"', "nb_states": 3, "nb_edges": 2}
    assert got["8"]["normative_reference"] == {"intent_T": None, "nb_states": None, "nb_edges": None} and len(got["8"]["scenarios"]) == 5
    means = {str(r.norm_id): r.average_score for r in average_score(results).collect()}
    assert {k: d["average_score"] for k, d in got.items()} == means
    heads, entries = dc.read_documents(spark, path)
    assert heads.count() == 2 and entries.groupBy("norm_id").count().collect() != [] and entries.where("score IS NULL").count() == 0


@pytest.mark.parametrize("files", [1, 2, 40])
def test_odd_results(spark, tmp_path, files):
    """Null norms, nulls and line breaks in texts, an empty text, columns of clashing names."""
    violation = [(3, "b\n\"c\"", ["a", None])]
    rows = [(1, 1, "one\ntwo", 0.5, 1, violation, ["x"], "e", "l", "p", "q"), (1, 2, None, None, 2, None, None, None, None, None, None),
            (None, 1, "", 1.0, 1, [], [], "e", "l", "p", "q"), (2, 9, "]}", 0.25, 1, [], [], "e", "l", "p", "q"), (1, 3, ",{", 1.0, 3, [], [], "e", "l", "p", "q")]
    path = str(tmp_path / "out")
    dc.write_documents(dc.report_fragments(spark.createDataFrame(rows, RESULTS), spark.createDataFrame([(1, None, 3, 2), (None, "n", 1, 0), (5, "no results", 1, 1)], NORMS), 1.5), path, files)
    got = documents(path)
    assert set(got) == {"1", "2", "__HIVE_DEFAULT_PARTITION__"}
    assert [s["scenario"] for s in got["1"]["scenarios"]] == ["one\ntwo", None, ",{"] and got["2"]["scenarios"][0]["scenario"] == "]}"
    assert got["1"]["scenarios"][0]["violations"] == [{"transition_index": 3, "attempted_state": "b\n\"c\"", "missing_preconditions": ["a", None]}]
    assert got["1"]["scenarios"][1] == {"scenario": None, "score": None, "intent_F": None, "violations": None, "contaminated_states": None, "explanation": ""}
    assert got["__HIVE_DEFAULT_PARTITION__"]["normative_reference"]["intent_T"] == "n" and got["1"]["execution_time_seconds"] == 1.5
    heads, entries = dc.read_documents(spark, path)
    assert {(r.norm_id, r.scenario) for r in entries.collect()} == {(r[0], r[2]) for r in rows} and heads.count() == 3


@pytest.mark.parametrize("places", [[1, 1], [2, 3], [0, 1], [1, None]])
def test_places_without_one_first_stop_the_job(spark, tmp_path, places):
    with pytest.raises(Exception, match="does not begin with one 1"):
        dc.write_documents(dc.report_fragments(placed(spark, places), spark.createDataFrame([], NORMS)), str(tmp_path / "out"))


def test_places_that_repeat_or_are_left_out(spark, tmp_path):
    dc.write_documents(dc.report_fragments(placed(spark, [5, 2, 1, 2, 5]), spark.createDataFrame([], NORMS)), str(tmp_path / "out"), 3)
    assert [s["scenario"] for s in documents(str(tmp_path / "out"))["1"]["scenarios"]] == ["s2", "s1", "s3", "s0", "s4"]


def placed(spark, places):
    return spark.createDataFrame([(1, i, f"s{i}", 0.5, p, [], [], None, None, None, None) for i, p in enumerate(places)], RESULTS)


def test_no_results(spark, tmp_path):
    none = spark.createDataFrame([], RESULTS)
    assert dc.report_fragments(none, spark.createDataFrame([(1, None, 3, 2)], NORMS)).count() == 0
    dc.write_documents(dc.report_fragments(none, spark.createDataFrame([], NORMS)), str(tmp_path / "out"))
    assert documents(str(tmp_path / "out")) == {}


@pytest.mark.parametrize("most, n_folders", [(dc.PACKED_CHARS, 0), (900, 1), (0, 41)])
def test_small_norms_share_files(spark, tmp_path, most, n_folders):
    """Only norms that are too long for a line get a folder; heads and scenarios are those of a folder per norm."""
    rows = [(n, i, f"s{i}\n,", i / 9, i + 1, [(i, "b\n\"c\"", ["a", None])], ["x", "é"], None, None, None, None)
            for n in [*range(40), None] for i in range(30 if n is None else 3)]
    fragments = dc.report_fragments(spark.createDataFrame(rows, RESULTS), spark.createDataFrame([(n, "t", 3, 2) for n in range(40)], NORMS))
    path = str(tmp_path / "out")
    folders = dc.write_packed(fragments, path, most)
    assert len(glob.glob(f"{path}/folders/norm_id=*")) == n_folders and folders == (n_folders > 0)
    dc.write_documents(fragments, str(tmp_path / "plain"))
    lines = [json.loads(line) for name in glob.glob(f"{path}/lines/part-*") for line in open(name, encoding="utf-8")]
    packed = {"__HIVE_DEFAULT_PARTITION__" if d["norm_id"] is None else str(d["norm_id"]): d for d in lines}
    assert len(lines) == 41 - n_folders and packed | documents(f"{path}/folders") == documents(str(tmp_path / "plain"))
    for ours, theirs in zip(dc.read_packed(spark, path, folders), dc.read_documents(spark, str(tmp_path / "plain"))):
        assert ours.columns == theirs.columns and sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect()))
