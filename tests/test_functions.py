import pytest
from pyspark.sql import functions as F

from normtrace.functions import answers as ax
from normtrace.functions import scores as sc
from normtrace.functions import states as sx
from normtrace.functions import text as tx
from normtrace.functions import vectors as vx


@pytest.mark.parametrize("raw", [" a b ", " x ", "\x1c\x1fy\t\r\n", "", "　", "in side", "​zero"])
def test_strip_is_pythons(evaluate, raw):
    assert evaluate(tx.strip(F.lit(raw))) == raw.strip()


@pytest.mark.parametrize("body, facts", [
    ("1. (A, does, b)\n2. ( C ,d,  e )", [("A", "does", "b"), ("C", "d", "e")]),
    ("(x, y, z, w)", [("x", "y", "z, w")]),
    ("(x, y)", []),
    ("((inner, r, o)", [("(inner", "r", "o")]),
    ("(over\nlines, r, o)", [("over\nlines", "r", "o")]),
    ("(a, b, c) (d, e, f)", [("a", "b", "c"), ("d", "e", "f")]),
    ("", []),
])
def test_triplets(evaluate, body, facts):
    assert [tuple(f) for f in evaluate(tx.triplets(F.lit(body)))] == facts


def test_fact_text(evaluate):
    null = F.lit(None).cast("string")
    assert evaluate(tx.fact_text(F.lit("a"), null, F.lit("c"))) == "a  c"
    assert evaluate(tx.fact_text(null, F.lit("b"), null)) == "b"


def test_fact_text_any_case(spark):
    df = spark.createDataFrame([(("S", "r", None),)], "f struct<Subject:string,relation:string,object:string>")
    text = tx.fact_text_any_case(F.col("f"), ["Subject", "relation", "object"])
    assert df.select(text).first()[0] == "S r"


def test_template_is_literal(evaluate):
    out = evaluate(tx.fill_template("{a} {b} {c}", {"a": F.lit("{b}"), "b": F.lit("1$")}))
    assert out == "1$ 1$ {c}"


@pytest.mark.parametrize("value, out", [(None, tx.NO_TEXT), (" \n", tx.NO_TEXT), (" x ", " x ")])
def test_sentinel(evaluate, value, out):
    assert evaluate(tx.text_or_sentinel(F.lit(value).cast("string"))) == out


@pytest.mark.parametrize("state, entity, suffix, negative, positive", [
    ("Country:Accepted", "Country", "Accepted", False, True),
    ("Country:Rejected", "Country", "Rejected", True, False),
    ("Country:NotAccepted", "Country", "NotAccepted", True, True),
    ("Password:NotCreated", "Password", "NotCreated", True, True),
    ("Verification:Failed", "Verification", "Failed", True, False),
    ("X:Requested", "X", "Requested", False, True),
    ("NoColonRejected", "NoColonRejected", "", False, False),
    ("A:B:Rejected", "A", "B", False, False),
    ("A:Accepted:Late", "A", "Accepted", False, True),
])
def test_state_names(spark, state, entity, suffix, negative, positive):
    s = F.lit(state)
    row = spark.range(1).select(sx.entity(s), sx.suffix(s), sx.is_negative(s), sx.is_positive(s)).first()
    assert tuple(row) == (entity, suffix, negative, positive)


@pytest.mark.parametrize("raw, cleaned", [
    ("```json\n{}\n```", "{}"), ("```{}```", "{}"), (" {} ", "{}"), ("```json{}", "{}"), ("{}```\n", "{}"),
    ("```JSON {}```", "JSON {}"), ("```", ""), ("x ```json {} ```", "x ```json {}"),
])
def test_clean_answer(evaluate, raw, cleaned):
    assert evaluate(ax.clean_answer(F.lit(raw))) == cleaned


@pytest.mark.parametrize("raw, intent", [
    ('{"intent": "open"}', "open"), ('```json\n{"intent": "é"}\n```', "é"), ("{", ax.EXTRACTION_FAILED),
    ('{"other": 1}', ax.UNKNOWN), ('{"intent": null}', None), ('{"intent": 7}', "7"),
])
def test_intent(evaluate, raw, intent):
    assert evaluate(ax.intent_of(F.lit(raw))) == intent


@pytest.mark.parametrize("raw, universe", [
    ('{"U": {"b:1": "x", "a:1": "y"}}', [("b:1", "x"), ("a:1", "y")]),
    ('{"U": {"b:1": "x", "a:1": 3}}', []), ('{"U": ["x"]}', []), ('{"V": {}}', []), ("nope", []), ('{"U": {}}', []),
])
def test_universe_is_all_or_nothing_and_ordered(evaluate, raw, universe):
    assert [tuple(e) for e in evaluate(F.map_entries(ax.universe_of(F.lit(raw))))] == universe


@pytest.mark.parametrize("content, text", [
    ('"plain"', "plain"), ('[{"type": "text", "text": "a"}, {"x": 1}, "b"]', "ab"), ("null", "resp"), ("12", "12"),
])
def test_content(evaluate, content, text):
    assert evaluate(ax.content_text(F.parse_json(F.lit(content)), F.lit("resp"))) == text


def test_prompt_has_pythons_json_layout(spark, evaluate):
    import json

    data = {"T": 'say "é"\n', "tags": ["a", "b"], "empty": [], "n": 3, "m": {"k": "v"}}
    df = spark.createDataFrame(
        [(data,)], "d struct<T:string,tags:array<string>,empty:array<string>,n:int,m:map<string,string>>")
    text = ax.prompt(F.lit("Do it."), F.lit("here"), ax.indented_json(F.col("d"), df.schema["d"].dataType))
    expected = "# CONTEXTE\nhere\n\nDo it.\n\n# DONNÉES (JSON):\n" + json.dumps(data, indent=2, ensure_ascii=False)
    assert df.select(text).first()[0] == expected
    assert evaluate(ax.prompt(F.lit("Do it."), F.lit(""))) == "Do it."


@pytest.mark.parametrize("score, label", [(1.0, "ok"), (0.8, "ok"), (0.7999, "warn"), (0.5, "warn"), (0.4999, "fail"), (None, "fail")])
def test_verdict(evaluate, score, label):
    assert evaluate(sc.verdict(F.lit(score).cast("double"))) == label


@pytest.mark.parametrize("value", [0.03125, 0.09375, 0.27484, 0.5, 1 / 3, 2 / 3])
def test_round_is_half_even(evaluate, value):
    assert evaluate(sc.round_score(F.lit(value))) == round(value, 4)


def test_violation_text(spark):
    kind = "v array<struct<transition_index:int,attempted_state:string,missing_preconditions:array<string>>>"
    rows = [([(3, "a:1", ["x", "y"]), None, (None, None, None)],), ([],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, kind).select(sc.violation_text(F.col("v"))).collect()]
    assert got == [
        "- At index 3, tried to activate 'a:1' but missing prerequisites: [x, y]\n"
        "- At index ?, tried to activate '?' but missing prerequisites: []",
        sc.NO_VIOLATIONS, sc.NO_VIOLATIONS]


def test_cosine(evaluate):
    arr = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    assert evaluate(vx.cosine(arr([1, 0]), arr([1, 1]))) == pytest.approx(2 ** -0.5)
    assert evaluate(vx.cosine(arr([0, 0]), arr([1, 1]))) == 0.0
