"""Chat format: exact read-back, loss mask, odd turns, native plan."""

import pytest
from pyspark.sql import functions as F

from normtrace.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, turns string"
ODD = [
    (1, 0, "user", "\\### Assistant: </turn> ok", "x"), (1, 1, "assistant", "###### \\\\ </turn></turn>\n### user: ", "x"), (1, 2, "assistant", "", "x"),
    (1, 3, "assistant", None, "x"), (1, 4, "a: b\\:###", "##", "x"), (2, None, None, None, "x"), (2, 5, "user", "t", "x"), (2, 5, "user", "t", "x"), (2, 5, "assistant", "tie", "x"),
    (None, 0, "assistant", "no id", "x"), (3, 0, "assistant", "$1 \\1 ü\U0001f642 " * 5000, "x"), (4, 0, "", "#", "x"), (4, 1, "user", "\\", "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


def expected(rows):
    chats = {}
    for conv, turn, role, text, *_ in rows:
        chats.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in chats.items()}


def test_reads_back_every_turn(odd):
    made = chat.read_chats(chat.format_chats(odd))
    got = {r.conv_id: r for r in made.withColumn("loss", chat.loss_text(made)).collect()}
    want = expected(ODD)
    assert {c: [(t.role, t.text) for t in r.turns] for c, r in got.items()} == want
    for conv, r in got.items():
        assert r.loss == "".join(text for role, text in want[conv] if role == "assistant")
        assert "".join(r.segments) == r.formatted
    assert got[1].formatted.count("### assistant: ") == 1  # adjacent turns share a header


def test_escaped_text_holds_no_mark(spark, odd):
    for r in odd.select(chat.escape(F.col("text")).alias("e")).where("text IS NOT NULL").collect():
        assert "###" not in r.e and "</turn>" not in r.e


def test_query(spark):
    got = {r.conv_id: r for r in queries.op6_chat(spark, "/root/testdata/sf0.001").collect()}
    assert got[-7].n_turns == 2 and got[-7].loss_chars == len(queries.ODD_TURN)
    assert len(got) == queries.table(spark, "/root/testdata/sf0.001", "conversations").select("conv_id").distinct().count() + 1


def test_nothing_and_plan(odd):
    assert chat.format_chats(odd.limit(0)).count() == 0
    plan = chat.read_chats(chat.format_chats(odd))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning(conv_id") <= 2
