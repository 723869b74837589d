"""SimHash near-duplicates: fingerprints of word shingles, linked by an exact tiled comparison.

A fingerprint has bit i set when more than half of the shingle hashes have it. Distinct fingerprints
are dealt to tiles by the numbers of bits set in their two halves. Two fingerprints within a radius r
differ by at most r in these numbers taken together, so tile pairs beyond that are never formed. A
task compares the rows of one tile pair: both sides are sorted by the counts of the four quarters, cut
into small blocks, and a pair of blocks whose counts differ by more than r is skipped as well; the
rest is exclusive-or and bit counts over whole blocks. Nothing is missed, whatever the data.

A tile pair gives a spanning forest of its links, not all of them, so a big group of near copies costs
as many edges as it has members. Equal fingerprints count once: copies never meet in a comparison.

Defined results: a null text has no words, and texts without words have fingerprint zero; repeated
rows come out as often as they occur; a row without doc_id is fingerprinted and linked, but gives its
group no name (a group of such rows alone has a null component); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normtrace.llm.batches import text_slices
from normtrace.llm.components import component_roots
from normtrace.session import settle_packed

WORDS = 3
SEED = 42
RADIUS = 3
TILE_ROWS = 4096
BLOCK_ROWS = 256
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of a text: lower-cased A-Z, words between ASCII white space, shingles with repeats."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    total = max(1, len(parts) - words + 1)
    reach = min(words, len(parts)) - 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for first in range(0, total, HASHES_AT_ONCE):
        last = min(first + HASHES_AT_ONCE, total)
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts[first:last], ends[first + reach:last + reach])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, fp)`` of every row, ``fp`` as a signed long; texts stay in their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in text_slices(batch.column(0), batch.column(1)):
                found = np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    while True:
        up = parent[at]
        if (up == at).all():
            return at
        at = up


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the trees of every pair; the smaller position becomes the root."""
    while len(a):
        a, b = _roots(parent, a), _roots(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _quarters(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _blocks(values: np.ndarray, rows: int) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Values sorted by the bit counts of their quarters, block bounds, and least and most counts."""
    counts = _quarters(values)
    order = np.lexsort(counts.T[::-1])
    counts = counts[order]
    bounds = [(i, min(i + rows, len(values))) for i in range(0, len(values), rows)]
    low = np.array([counts[a:b].min(axis=0) for a, b in bounds])
    return values[order], bounds, low, np.array([counts[a:b].max(axis=0) for a, b in bounds])


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int, rows: int = BLOCK_ROWS) -> np.ndarray:
    """Spanning forest of the links between two tiles (or inside one), as pairs of fingerprints."""
    a, a_bounds, a_low, a_high = _blocks(left, rows)
    b, b_bounds, b_low, b_high = (a, a_bounds, a_low, a_high) if right is None else _blocks(right, rows)
    shift = 0 if right is None else len(a)
    every = a if right is None else np.concatenate([a, b])
    parent = np.arange(len(every))
    for i, (a0, a1) in enumerate(a_bounds):
        gap = np.maximum(0, np.maximum(b_low - a_high[i], a_low[i] - b_high)).sum(axis=1)
        for j in np.flatnonzero(gap <= radius):
            if right is None and j < i:
                continue
            b0, b1 = b_bounds[j]
            near = np.bitwise_count(a[a0:a1, None] ^ b[None, b0:b1]) <= radius
            x, y = np.nonzero(near)
            _join(parent, x + a0, y + b0 + shift)
    root = _roots(parent, np.arange(len(every)))
    linked = np.flatnonzero(root != np.arange(len(every)))
    return np.stack([every[linked], every[root[linked]]], axis=1)


def _half_counts(fp: Column) -> tuple[Column, Column]:
    return F.bit_count(F.shiftrightunsigned(fp, 32)), F.bit_count(fp.bitwiseAND(F.lit(0xFFFFFFFF)))


def links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges ``(a, b)`` that connect all of ``distinct(fp)`` within ``radius`` bits.

    Tiles are cells of half counts, at most 33 by 33, cut by a hash where a cell is large; only their
    counts, a table of that fixed size, are broadcast.
    """
    high, low = _half_counts(F.col("fp"))
    cells = distinct.groupBy(high.alias("h"), low.alias("l")).agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("cuts"))
    steps = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius]
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])).alias("step")
    near = cells.select("h", "l", "cuts", step).select("h", "l", "cuts", (F.col("h") + F.col("step.i")).alias("h2"), (F.col("l") + F.col("step.j")).alias("l2"))
    plan = (near.join(cells.select(F.col("h").alias("h2"), F.col("l").alias("l2"), F.col("cuts").alias("cuts2")), ["h2", "l2"])
            .groupBy("h", "l", "cuts").agg(F.collect_list(F.struct("h2", "l2", "cuts2")).alias("others")))
    tile = lambda h, l, cut: F.concat_ws(".", h, l, cut)
    placed = (distinct.withColumns({"h": high, "l": low})
              .join(F.broadcast(plan), ["h", "l"])
              .withColumn("own", tile(F.col("h"), F.col("l"), F.pmod(F.xxhash64("fp"), F.col("cuts"))))
              .withColumn("o", F.explode("others"))
              .withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("o.cuts2") - 1)))
              .withColumn("other", tile(F.col("o.h2"), F.col("o.l2"), F.col("cut")))
              .select(F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), (F.col("own") > F.col("other")).alias("right"), "fp"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        values = group["fp"].to_numpy(np.int64).view(np.uint64)
        right = group["right"].to_numpy(bool)
        same = group["first"].iloc[0] == group["second"].iloc[0]
        if same:
            found = tile_links(values, None, radius)
        elif right.any() and not right.all():
            found = tile_links(values[~right], values[right], radius)
        else:
            found = np.zeros((0, 2), np.uint64)
        return pd.DataFrame(found.view(np.int64), columns=["a", "b"])

    return placed.groupBy("first", "second").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row of ``docs(doc_id, text)``."""
    found = settle_packed(fingerprints(docs, words, seed), "fingerprints")
    distinct = settle_packed(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = settle_packed(component_roots(links(distinct.select("fp"), radius)), "roots")
    member = distinct.join(roots.select(F.col("v").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = settle_packed(member.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    group = member.join(named, "root").select("fp", "component_id")
    return found.join(group, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

