"""Cycles of the precondition graphs: strongly connected components, small cuts, reach as bit vectors.

A norm is a graph of its own, and most are small. Edges are brought together by norm once and solved
there in linear time, norm after norm out of a sorted stream; only a norm of up to ``LOCAL_EDGES`` edges
is ever held. Larger norms are solved all together in rounds of joins over written tables.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from normtrace.session import settle

EDGE = ["norm_id", "source", "target"]
LOCAL_EDGES = 1 << 18
ROWS_AT_ONCE = 1 << 14


def split_by_size(edges: DataFrame, limit: int = LOCAL_EDGES) -> tuple[DataFrame, DataFrame | None]:
    """Edges of norms of up to ``limit`` edges, and those of larger ones (None if there are none)."""
    large = edges.groupBy(F.col("norm_id").alias("_norm")).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select("_norm")
    if large.isEmpty():
        return edges, None
    large, same = settle(large, "large"), F.col("norm_id").eqNullSafe(F.col("_norm"))
    return edges.join(large, same, "left_anti"), edges.join(large, same, "left_semi")


def per_key(rows: DataFrame, keys: list[str], columns: list[str], kernel: Callable[[list[tuple]], Iterable[tuple]], out: str) -> DataFrame:
    """``kernel`` over the rows of every key, which come sorted; its rows follow the key in the result."""
    rows = rows.select(*keys, *columns)
    schema = StructType([*[rows.schema[k] for k in keys], *_parse_datatype_string(out).fields])
    arrow, width = to_arrow_schema(schema), len(keys)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, group in groupby(read(batches), key=lambda r: r[:width]):
            for row in kernel([r[width:] for r in group]):
                yield (*key, *row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = solve(batches)
        while held := list(islice(found, ROWS_AT_ONCE)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *columns).mapInArrow(run, schema)


def _graph(rows: list[tuple]) -> tuple[list[str], list[list[int]]]:
    names = sorted({r[0] for r in rows} | {r[1] for r in rows})
    at = {name: i for i, name in enumerate(names)}
    after: list[list[int]] = [[] for _ in names]
    for r in rows:
        after[at[r[0]]].append(at[r[1]])
    return names, after


def strong_components(after: list[Iterable[int]]) -> list[int]:
    """Component of every vertex, numbered so that edges between components go to lower numbers."""
    size = len(after)
    seen, low, found = [-1] * size, [0] * size, [-1] * size
    path, clock, count = [], 0, 0
    for root in range(size):
        work = [(root, iter(after[root]))] if seen[root] < 0 else []
        while work:
            v, onward = work[-1]
            if seen[v] < 0:
                seen[v] = low[v] = clock
                clock += 1
                path.append(v)
            for w in onward:
                if seen[w] < 0:
                    work.append((w, iter(after[w])))
                    break
                if found[w] < 0:
                    low[v] = min(low[v], seen[w])
            else:
                work.pop()
                if low[v] == seen[v]:
                    while found[v] < 0:
                        found[path.pop()] = count
                    count += 1
                elif work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
    return found


def _members(found: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(found, default=-1) + 1)]
    for v, c in enumerate(found):
        out[c].append(v)
    return out


def _cyclic(members: list[list[int]], after: list[list[int]]) -> list[bool]:
    return [len(m) > 1 or m[0] in after[m[0]] for m in members]


def _reach_rows(rows: list[tuple]) -> Iterator[tuple]:
    """All pairs of a norm: one bit vector per component, filled along the order of components."""
    names, after = _graph(rows)
    found = strong_components(after)
    members, bits = _members(found), []
    for c, (inside, cyclic) in enumerate(zip(members, _cyclic(members, after))):
        reached = sum(1 << v for v in inside) if cyclic else 0
        for w in {w for v in inside for w in after[v] if found[w] != c}:
            reached |= (1 << w) | bits[found[w]]
        bits.append(reached)
    for c, inside in enumerate(members):
        packed = np.frombuffer(bits[c].to_bytes(len(names) // 8 + 1, "little"), np.uint8)
        ends = [names[i] for i in np.flatnonzero(np.unpackbits(packed, bitorder="little"))]
        for v in inside:
            for end in ends:
                yield names[v], end


def _core_rows(rows: list[tuple]) -> Iterator[tuple]:
    """Edges whose source lies on or after a cycle and whose target lies on or before one."""
    names, after = _graph(rows)
    found = strong_components(after)
    members = _members(found)
    behind = _cyclic(members, after)
    ahead = list(behind)
    for c, inside in enumerate(members):
        ahead[c] = ahead[c] or any(ahead[found[w]] for v in inside for w in after[v])
    for c in range(len(members) - 1, -1, -1):
        if behind[c]:
            for v in members[c]:
                for w in after[v]:
                    behind[found[w]] = True
    for v, onward in enumerate(after):
        for w in onward:
            if behind[found[v]] and ahead[found[w]]:
                yield names[v], names[w]


def _component_rows(rows: list[tuple]) -> Iterator[tuple]:
    names, after = _graph(rows)
    members = _members(strong_components(after))
    for inside, cyclic in zip(members, _cyclic(members, after)):
        for v in inside:
            yield names[v], names[inside[0]], len(inside), cyclic


def _way(after: list[Iterable[int]], start: int, end: int, inside: set[int] | None = None) -> list[int] | None:
    """A shortest way of one edge or more, by parent pointers, least vertices first."""
    parent, queue = {}, deque([start])
    while queue:
        v = queue.popleft()
        for w in sorted(after[v]):
            if w == end:
                way = [end, v]
                while way[-1] != start:
                    way.append(parent[way[-1]])
                return way[::-1]
            if w not in parent and w != start and (inside is None or w in inside):
                parent[w] = v
                queue.append(w)
    return None


def _cut_rows(rows: list[tuple]) -> Iterator[tuple]:
    """Witness cycles ``(cut_no, place, source, target, worst, put_back)`` of ``(source, target, source_rank, target_rank)``.

    While a component has a cycle, a shortest one through its least vertex loses its worst edge, the one
    along which the rank falls most (then the greatest names). Then the edges cut are put back, the least
    bad first, where that closes no cycle.
    """
    names, after = _graph(rows)
    at = {name: i for i, name in enumerate(names)}
    fall = {(at[s], at[t]): a - b for s, t, a, b in rows}
    left = [set(x) for x in after]
    worse = lambda e: (fall[e], e)
    cuts: list[tuple[tuple, list[int]]] = []
    members = _members(strong_components(after))
    open_ = [m for m, cyclic in zip(members, _cyclic(members, after)) if cyclic]
    while open_:
        inside = open_.pop()
        cycle = _way(left, inside[0], inside[0], set(inside))
        edge = max(zip(cycle, cycle[1:]), key=worse)
        cuts.append((edge, cycle))
        left[edge[0]].discard(edge[1])
        place = {v: i for i, v in enumerate(inside)}
        part = [[place[w] for w in left[v] if w in place] for v in inside]
        parts = _members(strong_components(part))
        open_ += [[inside[i] for i in m] for m, cyclic in zip(parts, _cyclic(parts, part)) if cyclic]
    back = set()
    for edge in sorted((e for e, _ in cuts), key=worse):
        if edge[0] != edge[1] and _way(left, edge[1], edge[0]) is None:
            left[edge[0]].add(edge[1])
            back.add(edge)
    for number, (edge, cycle) in enumerate(cuts):
        for place_, link in enumerate(zip(cycle, cycle[1:])):
            yield number, place_, names[link[0]], names[link[1]], link == edge, edge in back


def trimmed(edges: DataFrame) -> DataFrame:
    """``edges`` without those of vertices without a way in or a way out, again and again, by joins."""
    now, left = edges, edges.count()
    while left:
        ends = lambda c, to: now.select(F.col("norm_id").alias("_norm"), F.col(c).alias(to)).distinct()  # noqa: B023, E731
        same = F.col("norm_id").eqNullSafe(F.col("_norm"))
        now = settle(now.join(ends("target", "_in"), same & (F.col("source") == F.col("_in")), "left_semi")
                     .join(ends("source", "_out"), same & (F.col("target") == F.col("_out")), "left_semi"), "trimmed")
        left, before = now.count(), left
        if left == before:
            break
    return now


def _coloured(edges: DataFrame) -> DataFrame:
    """``(norm_id, state_id, component_id)`` of all vertices on cycles, by colours, in rounds of joins.

    A vertex takes the greatest name that leads to it; what leads back to that vertex within its colour is
    its component. Components leave, the rest is trimmed and coloured again. Rounds follow the longest
    shortest way.
    """
    key = ["norm_id", "state_id"]
    same = F.col("norm_id").eqNullSafe(F.col("_norm"))
    done, now = None, trimmed(edges)
    while not now.isEmpty():
        vertices = now.select("norm_id", F.explode(F.array("source", "target")).alias("state_id")).distinct()
        colour = settle(vertices.withColumn("colour", F.col("state_id")), "colours")
        while True:
            told = now.join(colour.select(F.col("norm_id").alias("_norm"), F.col("state_id").alias("_at"), "colour"), same & (F.col("source") == F.col("_at")))
            new = told.select("norm_id", F.col("target").alias("state_id"), "colour", F.lit(False).alias("own")).unionByName(colour.withColumn("own", F.lit(True)))
            grown = settle(new.groupBy(*key).agg(F.max("colour").alias("colour"), F.max(F.when(F.col("own"), F.col("colour"))).alias("was")), "colours")
            colour = grown.drop("was")
            if grown.where("colour != was").isEmpty():
                break
        ends = lambda c: colour.select(F.col("norm_id").alias("_norm"), F.col("state_id").alias(f"_{c}"), F.col("colour").alias(f"{c}_colour"))  # noqa: B023, E731
        inner = now.join(ends("s"), same & (F.col("source") == F.col("_s"))).drop("_norm").join(ends("t"), same & (F.col("target") == F.col("_t"))) \
            .where("s_colour = t_colour").select("norm_id", "source", "target")
        inner, found = settle(inner, "inner"), settle(colour.where("state_id = colour"), "roots")
        front = found
        while True:
            into = inner.join(front.select(F.col("norm_id").alias("_norm"), F.col("state_id").alias("_at"), "colour"), same & (F.col("target") == F.col("_at"))) \
                .select("norm_id", F.col("source").alias("state_id"), "colour").distinct()
            known = found.select(F.col("norm_id").alias("_norm"), F.col("state_id").alias("_at"))
            front = settle(into.join(known, same & (F.col("state_id") == F.col("_at")), "left_anti"), "front")
            if front.isEmpty():
                break
            found = found.unionByName(front)
        found = settle(found, "components")
        done = found if done is None else done.unionByName(found)
        gone = found.select(F.col("norm_id").alias("_norm"), F.col("state_id").alias("_at"))
        for end in ("source", "target"):
            now = now.join(gone, same & (F.col(end) == F.col("_at")), "left_anti")
        now = trimmed(settle(now, "rest"))
    if done is None:
        return edges.select("norm_id", F.col("source").alias("state_id"), F.col("source").alias("component_id")).limit(0)
    names = done.groupBy("norm_id", "colour").agg(F.min("state_id").alias("component_id")).select(F.col("norm_id").alias("_norm"), F.col("colour").alias("_colour"), "component_id")
    return done.join(names, same & (F.col("colour") == F.col("_colour"))).select(*key, "component_id")


def cycle_components(edges: DataFrame, limit: int = LOCAL_EDGES) -> DataFrame:
    """``(norm_id, state_id, component_id, n_states, cyclic)`` of every vertex of distinct ``edges``.

    A component is a largest set of states that all reach each other; its id is its least state. A state
    that reaches itself over no other is cyclic too.
    """
    small, large = split_by_size(edges, limit)
    out = per_key(small, ["norm_id"], ["source", "target"], _component_rows, "state_id string, component_id string, n_states long, cyclic boolean")
    if large is None:
        return out
    found = settle(_coloured(large), "components")
    sizes = found.groupBy("norm_id", "component_id").agg(F.count("*").alias("n_states")).select(F.col("norm_id").alias("_norm"), F.col("component_id").alias("_component"), "n_states")
    named = found.join(sizes, F.col("norm_id").eqNullSafe(F.col("_norm")) & (F.col("component_id") == F.col("_component"))) \
        .select(F.col("norm_id").alias("_norm"), F.col("state_id").alias("_state"), "component_id", "n_states")
    vertices = large.select("norm_id", F.explode(F.array("source", "target")).alias("state_id")).distinct()
    loops = large.where("source = target").select(F.col("norm_id").alias("_norm"), F.col("source").alias("_state"), F.lit(True).alias("_loop"))
    same = F.col("norm_id").eqNullSafe(F.col("_norm")) & (F.col("state_id") == F.col("_state"))
    all_ = vertices.join(named, same, "left").drop("_norm", "_state").join(loops, same, "left").select(
        "norm_id", "state_id", F.coalesce("component_id", "state_id").alias("component_id"), F.coalesce("n_states", F.lit(1)).cast("long").alias("n_states"),
        ((F.coalesce("n_states", F.lit(1)) > 1) | F.coalesce("_loop", F.lit(False))).alias("cyclic"))
    return out.unionByName(all_)


def cyclic_core(edges: DataFrame, limit: int = LOCAL_EDGES) -> DataFrame:
    """Edges of distinct ``edges`` left after trimming vertices without a way in or a way out, again and again.

    These are the edges whose source lies on or after a cycle and whose target lies on or before one;
    every cycle is among them, and an acyclic graph leaves none.
    """
    small, large = split_by_size(edges, limit)
    out = per_key(small, ["norm_id"], ["source", "target"], _core_rows, "source string, target string")
    return out if large is None else out.unionByName(trimmed(large.select(*EDGE)))


CUT = "cut_no long, place long, source string, target string, worst boolean, put_back boolean"


def witness_cycles(ranked: DataFrame, limit: int = LOCAL_EDGES) -> DataFrame:
    """The cycles by which a small cut was found, edge by edge, of ``ranked`` distinct edges.

    ``worst`` marks the edge that a cycle lost, ``put_back`` that the final cut does without it. In norms
    too large for one task, each component is cut by itself; one that is still too large has no witnesses.
    """
    columns = ["source", "target", "source_rank", "target_rank"]
    small, large = split_by_size(ranked.select("norm_id", *columns), limit)
    out = per_key(small, ["norm_id"], columns, _cut_rows, CUT)
    if large is None:
        return out
    fits, _ = split_components(large, limit)
    return out.unionByName(per_key(fits, ["norm_id", "component_id"], columns, _cut_rows, CUT).drop("component_id"))


def split_components(large: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Edges inside the components of large norms: of components up to ``limit`` edges, and of larger ones."""
    found = settle(_coloured(large.select(*EDGE)), "components")
    side = lambda c: found.select(F.col("norm_id").alias("_norm"), F.col("state_id").alias(f"_{c}"), F.col("component_id").alias(f"_{c}_of"))
    same = F.col("norm_id").eqNullSafe(F.col("_norm"))
    inner = large.join(side("s"), same & (F.col("source") == F.col("_s"))).drop("_norm").join(side("t"), same & (F.col("target") == F.col("_t"))) \
        .where("_s_of = _t_of").select(*large.columns, F.col("_s_of").alias("component_id"))
    inner = settle(inner, "inner")
    sizes = settle(inner.groupBy(F.col("norm_id").alias("_norm"), F.col("component_id").alias("_of")).agg(F.count("*").alias("_n")), "sizes")
    sized = inner.join(sizes, same & (F.col("component_id") == F.col("_of"))).drop("_norm", "_of")
    return sized.where(F.col("_n") <= limit).drop("_n"), sized.where(F.col("_n") > limit).drop("_n")


def minimal_cut(ranked: DataFrame, limit: int = LOCAL_EDGES, witnesses: DataFrame | None = None) -> DataFrame:
    """Distinct ``ranked`` edges with a ``removed`` flag: what stays is acyclic.

    None of the removed edges could be put back without a cycle. Only components of over ``limit`` edges
    fall back to losing every inner edge along which (rank, name) does not grow.
    """
    witnesses = witness_cycles(ranked, limit) if witnesses is None else witnesses
    cut = witnesses.where("worst AND NOT put_back").select(*EDGE)
    _, large = split_by_size(ranked, limit)
    if large is not None:
        _, huge = split_components(large.select("norm_id", "source", "target", "source_rank", "target_rank"), limit)
        cut = cut.unionByName(huge.where("NOT (struct(source_rank, source) < struct(target_rank, target))").select(*EDGE))
    gone = cut.select(*[F.col(c).alias(f"_{c}") for c in EDGE], F.lit(True).alias("_gone"))
    same = F.col("norm_id").eqNullSafe(F.col("_norm_id")) & (F.col("source") == F.col("_source")) & (F.col("target") == F.col("_target"))
    return ranked.join(gone, same, "left").select(*EDGE, F.coalesce("_gone", F.lit(False)).alias("removed"))


def reach_of_small(edges: DataFrame) -> DataFrame:
    """``(norm_id, src, dst)`` of norms that fit a task."""
    return per_key(edges, ["norm_id"], ["source", "target"], _reach_rows, "src string, dst string")
