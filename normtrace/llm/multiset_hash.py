"""Document fingerprints by a homomorphic multiset hash, with column expressions only.

Each paragraph (what stands between line breaks, empty ones aside) is hashed to a wide vector of
signed 16-bit numbers; a document is their sum, modulo 2^32 in every lane. The order of paragraphs
does not matter, equal multisets have equal sums, and adding or removing a paragraph adds or subtracts
its vector, without the rest of the text. As the numbers are small beside the modulus, the sums also
tell likeness: the cosine of two sums estimates the cosine of the two multisets of paragraphs.

Defined results: a null text is empty and has the zero vector; two zero vectors are alike (1), a zero
vector and another are not (0); repeated rows come out as often as they occur; a null doc_id comes last
in descending order; equal doc_ids follow each other by text; the next document of the last is the
first (of a single row itself); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES = 64
MODULUS = 1 << 32
PER_HASH = 16


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: p != "")


def paragraph_vector(paragraph: Column) -> Column:
    """Signed 16-bit numbers out of salted SHA-256 digests, one lane per four hexadecimal digits."""
    digests = F.concat(*[F.sha2(F.concat(F.lit(f"{i}:"), paragraph), 256) for i in range(LANES // PER_HASH)])
    return F.transform(F.regexp_extract_all(digests, F.lit("([0-9a-f]{4})"), 1), lambda h: F.conv(h, 16, 10).cast("long") - 32768)


def vector(text: Column) -> Column:
    """Sum of the paragraph vectors of a text, each lane in [0, 2^32)."""
    zero = F.array_repeat(F.lit(0).cast("long"), LANES)
    add = lambda total, p: F.zip_with(total, paragraph_vector(p), lambda a, b: a + b)
    return F.aggregate(paragraphs(text), zero, add, lambda total: F.transform(total, lambda x: F.pmod(x, F.lit(MODULUS))))


def insert(total: Column, paragraph: Column) -> Column:
    """The vector of a document after a paragraph is added."""
    return F.zip_with(total, paragraph_vector(paragraph), lambda a, b: F.pmod(a + b, F.lit(MODULUS)))


def delete(total: Column, paragraph: Column) -> Column:
    """The vector of a document after a paragraph is removed."""
    return F.zip_with(total, paragraph_vector(paragraph), lambda a, b: F.pmod(a - b, F.lit(MODULUS)))


def as_text(total: Column) -> Column:
    """A vector as hexadecimal digits, eight per lane."""
    return F.array_join(F.transform(total, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two vectors read as signed numbers, at least 0; 1 for equal ones."""
    signed = lambda v: F.transform(v, lambda x: F.when(x < MODULUS // 2, x).otherwise(x - MODULUS).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    x, y = signed(a), signed(b)
    size = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(a == b, 1.0).when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / size)))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with ``next_<column>`` of the next row by descending doc_id, the first after the last.

    Rows are dealt to ranges of doc_id; the first row of a range also goes to the range above, where
    it is the next of the last row. Texts are shuffled once and no task holds more than a range. The
    bounds are quantiles of doc_id, two for each shuffle partition.
    """
    spark = docs.sparkSession
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    bounds = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []
    bounds = sorted(set(bounds))
    # range k holds bounds[k - 1] < doc_id <= bounds[k]; null ids go to the lowest range
    place = F.coalesce(F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col("doc_id"))), F.lit(0)) if bounds else F.lit(0)
    tops = {r.k: r.top for r in ids.groupBy(place.alias("k")).agg(F.max("doc_id").alias("top")).collect()}
    if not tops:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    used = sorted(tops)
    above = dict(zip(used, [*used[1:], used[0]]))  # the highest range's first row follows the last row of all
    guest = F.create_map(*[F.lit(x) for k in used for x in (k, above[k])])
    top = F.create_map(*[x for k in used for x in (F.lit(k), F.lit(tops[k]).cast("long"))])
    own = F.struct(F.col("_k").alias("range"), F.lit(False).alias("guest"))
    visit = F.struct(guest[F.col("_k")].alias("range"), F.lit(True).alias("guest"))
    first = F.col("doc_id").eqNullSafe(top[F.col("_k")])
    dealt = (docs.withColumn("_k", place).withColumn("_at", F.explode(F.when(first, F.array(own, visit)).otherwise(F.array(own))))
             .withColumns({"_range": F.col("_at.range"), "_guest": F.col("_at.guest")}))
    order = Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").desc_nulls_last(), "text")
    ahead = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return ahead.where("NOT _guest").drop("_k", "_at", "_range", "_guest")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half replaced by as much of the beginning of the next one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they and the next one are."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("vector", vector(F.col("text")))
    pair = with_next(own, ["text", "vector"]).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    pair = pair.withColumn("edited_vector", vector(F.col("edited")))
    return pair.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("vector")).alias("fingerprint"), as_text(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        likeness(F.col("vector"), F.col("next_vector")).alias("near_next"))
