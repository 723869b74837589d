"""Multiset hash: edits by definition, order independence, insertion and deletion, native plan."""

import hashlib

import pytest
from pyspark.sql import functions as F

from normtrace.llm import multiset_hash as mh


def plain_vector(text):
    total = [0] * 64
    for part in filter(None, (text or "").split("\n")):
        digits = "".join(hashlib.sha256(f"{i}:{part}".encode()).hexdigest() for i in range(4))
        total = [(t + int(digits[4 * j:4 * j + 4], 16) - 32768) % 2**32 for j, t in enumerate(total)]
    return total


def shown(vector):
    return "".join(f"{x:08x}" for x in vector)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([v - 2**32 if v >= 2**31 else v for v in z] for z in (a, b))
    size = sum(v * v for v in x) ** 0.5 * sum(v * v for v in y) ** 0.5
    return min(1.0, max(0.0, sum(p * q for p, q in zip(x, y)) / size)) if size else 0.0


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b = plain_vector(text), plain_vector(edited)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), round(plain_likeness(a, b), 9), round(plain_likeness(a, plain_vector(after)), 9)))
    return sorted(out, key=str)


def found(docs):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in mh.fingerprint_edits(docs).collect()), key=str)


def test_odd_documents(odd_docs):
    assert found(odd_docs) == expected([(r.doc_id, r.text) for r in odd_docs.collect()])


@pytest.mark.parametrize("rows", [[(1, "only")], [(None, "a\nb"), (None, None)], [(7, f"t{i}") for i in range(20)], [(i, f"line {i % 3}\nx") for i in range(60)]])
def test_next_of_every_row(spark, rows):
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == expected(rows)


def test_homomorphic(spark):
    frame = spark.createDataFrame([("a\nb\nb", "b\n\na\nb", "a\nb")], "x string, y string, z string")
    x, y, z = (mh.vector(F.col(c)) for c in "xyz")
    r = frame.select((x == y).alias("same"), (x == z).alias("other"), (mh.insert(z, F.lit("b")) == x).alias("insert"), (mh.delete(x, F.lit("b")) == z).alias("delete")).first()
    assert r.same and not r.other and r.insert and r.delete


def test_nothing_and_plan(no_docs, documents):
    assert mh.fingerprint_edits(no_docs).count() == 0
    plan = mh.fingerprint_edits(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") == 1
