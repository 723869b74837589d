"""Quality rules as a ledger: every rule is evaluated once, policies are bit masks over its failures.

A pass over the texts measures them. Each rule is then one comparison of two integers over these
measurements, and sets its own bit where it fails. The ledger keeps failures and measurements per
document; a policy is a version with the rules that reject under it, so another policy, or what would
happen without one of its rules, costs bit operations over the ledger, or over the few different
failure patterns in it, and never another look at a text.

Defined results: a null text has no words, no words fail ``few_words``; lines count only with a word
in them; a window of eight words counts when the same eight stand at another place of the text, and
windows may overlap; repeated rows come out as often as they occur; a null doc_id is kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normtrace.llm.batches import text_slices

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper", "n_letters")

# Rules in the order of their bits; a rule fails where its condition over the measurements holds.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "exclamations": "4 * n_marks > n_words",
    "capitals": "2 * n_upper > n_letters",
}
POLICIES: dict[int, tuple[str, ...]] = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "short_words", "long_words", "symbols", "repeated_lines"),
    3: tuple(RULES),
}
BASE, LATEST = 1, 3
BITS = {name: 1 << i for i, name in enumerate(RULES)}


def _repeats(words: list[int], owner: np.ndarray, docs: int, window: int) -> np.ndarray:
    """Per document, words inside windows that occur twice or more in it.

    Strings of 1, 2, 4, … words get numbers, equal ones the same, each from the numbers of its two
    halves: exact, without comparing or hashing windows.
    """
    if len(words) <= window:
        return np.zeros(docs, np.int64)
    names, size = np.array(words, np.int64), 1
    while size < window:
        names = np.unique(names[:-size] * (int(names.max()) + 1) + names[size:], return_inverse=True)[1]
        size *= 2
    inside = owner[:-(window - 1)] == owner[window - 1:]
    at = np.flatnonzero(inside)
    _, which, times = np.unique(names[at] * docs + owner[at], return_inverse=True, return_counts=True)
    at = at[times[which] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=docs)


def measure(texts: list[str], window: int = WINDOW) -> dict[str, np.ndarray]:
    """All measurements of some texts, in their order."""
    out = {name: np.zeros(len(texts), np.int64) for name in MEASURES}
    numbers: dict[bytes, int] = {}
    words: list[int] = []
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        parts = data.split()
        out["n_words"][i] = len(parts)
        if not parts:
            continue
        words.extend([numbers.setdefault(w, len(numbers)) for w in parts])
        points = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        out["word_chars"][i] = len(text) - points[9:14].sum() - points[32]
        out["n_symbols"][i] = sum(points[c] for c in b"#*$%&|<>")
        out["n_marks"][i] = points[ord("!")]
        out["n_upper"][i] = points[65:91].sum()
        out["n_letters"][i] = points[65:91].sum() + points[97:123].sum()
        lines = [line for line in data.split(b"\n") if line.strip()]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    owner = np.repeat(np.arange(len(texts)), out["n_words"])
    out["n_repeat_words"] = _repeats(words, owner, len(texts), window)
    return out


def measurements(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id`` and all measurements of every row of ``docs(doc_id, text)``, in one pass."""
    if window & (window - 1):
        raise ValueError("the window is a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in text_slices(batch.column(0), batch.column(1)):
                found = measure(texts, window)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(found[m]) for m in MEASURES)], ["doc_id", *MEASURES])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def with_failures(measured: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """``measured`` with ``failures``: the bit of every rule that fails, in the order of the rules."""
    if len(rules) > 63:
        raise ValueError("a ledger holds 63 rules")
    bits = F.lit(0).cast("long")
    for i, condition in enumerate(rules.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(0).cast("long"))
    return measured.withColumn("failures", bits)


def ledger(docs: DataFrame) -> DataFrame:
    """Failures and measurements of every document."""
    return with_failures(measurements(docs))


def mask(policy: int, policies: dict[int, tuple[str, ...]] = POLICIES) -> int:
    return sum(BITS[name] for name in policies[policy])


def rejected(policy: int) -> Column:
    """Does a policy reject a row of the ledger?"""
    return F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def patterns(book: DataFrame) -> DataFrame:
    """``(failures, n)``: how many documents fail in which way, at most one row per set of rules."""
    return book.groupBy("failures").agg(F.count("*").alias("n"))


def ablations(book: DataFrame, policies: dict[int, tuple[str, ...]] = POLICIES) -> DataFrame:
    """``(policy, rule, n_docs, n_rejected, n_failed, n_only, n_also)`` of every rule of every policy.

    ``n_rejected`` documents go under the policy and ``n_failed`` of them by this rule; ``n_only`` would
    stay without it; ``n_also`` lists, as one mask, the policy's rules that ever fail together with it.
    All from the failure patterns, each counted on the map side first.
    """
    names = [(p, mask(p, policies), r, BITS[r]) for p, rules in policies.items() for r in rules]
    plan = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(m).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit")) for p, m, r, b in names])
    hit = F.col("failures").bitwiseAND(F.col("mask"))
    mine = F.col("failures").bitwiseAND(F.col("bit")) != 0
    each = patterns(book).select("failures", "n", F.inline(plan))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).alias
    return each.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"), total(hit != 0)("n_rejected"), total(mine)("n_failed"), total(hit == F.col("bit"))("n_only"),
        F.coalesce(F.bit_or(F.when(mine, hit.bitwiseAND(F.bitwise_not("bit")))), F.lit(0)).alias("n_also"))


def judge(docs: DataFrame, policy: int = LATEST) -> DataFrame:
    """``(doc_id, n_words, …, n_repeat_words, base_failed, kept, failures)`` of every document."""
    return ledger(docs).select(
        "doc_id", *MEASURES[:5], rejected(BASE).alias("base_failed"), (~rejected(BASE) & ~rejected(policy)).alias("kept"), "failures")
