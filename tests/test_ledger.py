"""The ledger of model calls: one call per text, resumed jobs, attempts; upserts with repeated keys."""

import os

import pytest

from normtrace.operators import ledger as lg
from normtrace.operators import models as md


def make_loader(log, flag):
    def loader():
        def model(prompt):
            with open(log, "a") as lines:
                lines.write(prompt + "\n")
            if prompt == "deadly" and os.path.exists(flag):
                os._exit(1)
            if prompt == "limited":
                raise RuntimeError("Error code: 429")
            if prompt == "bad":
                raise ValueError("no way")
            return {"text": prompt.upper(), "prompt_tokens": 1, "completion_tokens": 1, "total_tokens": 2, "finish_reason": "stop"}

        return model

    return loader


def asked(log):
    with open(log) as lines:
        return lines.read().split("\n")[:-1]


def test_each_text_is_asked_once(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path / "ledger")
    df = spark.createDataFrame([(i, ["same", "other", "bad", None][i % 4]) for i in range(40)], "id int, q string").repartition(5)
    loader = make_loader(log, "none")
    got = {(r.q, r.text, r.status, r.attempts) for r in lg.ask(df, "q", loader, folder, "k").collect()}
    assert got == {("same", "SAME", md.SUCCESS, 1), ("other", "OTHER", md.SUCCESS, 1), ("bad", None, "Erreur: no way", 1), (None, None, None, None)}
    assert sorted(asked(log)) == ["bad", "other", "same"]
    more = df.unionByName(spark.createDataFrame([(99, "new")], "id int, q string"))
    again = lg.ask(more, "q", loader, folder, "k", passes=5)
    assert again.count() == 41 and sorted(asked(log)) == ["bad"] * 3 + ["new", "other", "same"]
    assert {r.attempts for r in again.where("q = 'bad'").collect()} == {3}
    assert lg.ask(df, "q", loader, folder, "another kind").where("text = 'SAME'").count() == 10 and asked(log).count("same") == 2


def test_a_killed_job_goes_on_from_its_ledger(spark, tmp_path):
    log, folder, flag = (str(tmp_path / n) for n in ("log", "ledger", "flag"))
    open(flag, "w").close()
    prompts = [(f"p{i:02d}",) for i in range(12)] + [("deadly",)]
    df = spark.createDataFrame(prompts, "q string").coalesce(1)
    loader = make_loader(log, flag)
    with pytest.raises(Exception):
        lg.ask(df, "q", loader, folder, "k", rows_per_file=2)
    before = {r.text.lower() for r in lg.read_calls(spark, folder).collect()}
    os.remove(flag)
    done = lg.ask(df, "q", loader, folder, "k", rows_per_file=2)
    assert {r.text for r in done.collect()} == {p[0].upper() for p in prompts}
    repeated = {p for p in asked(log) if asked(log).count(p) > 1}
    assert len(repeated) <= 2 and not repeated & before


def test_nothing_to_ask(spark, tmp_path):
    none = spark.createDataFrame([], "q string")
    assert lg.ask(none, "q", make_loader(str(tmp_path / "log"), "none"), str(tmp_path / "ledger"), "k").count() == 0
    assert not os.path.exists(tmp_path / "log")


def test_upsert_gives_one_row_per_key(spark):
    old = spark.createDataFrame([(1, "a", "Erreur: x"), (2, "b", "Erreur: x"), (3, "c", "success")], "id int, text string, status string")
    new = spark.createDataFrame([(1, 1, "first", "success"), (1, 2, "second", "success"), (1, 3, None, "Erreur: 429"), (2, 2, "late", "Erreur: y"), (2, 1, "early", "success"), (3, None, None, None)],
                                "id int, n int, text string, status string")
    got = {tuple(r) for r in md.upsert(old, new, ["id"], ["text", "status"], attempt="n").collect()}
    assert got == {(1, "second", "success"), (2, "late", "Erreur: y"), (3, "c", "success")}
    plain = {tuple(r) for r in md.upsert(old, new.drop("n"), ["id"], ["text", "status"]).collect()}
    assert len(plain) == 3 and (2, "early", "success") in plain
