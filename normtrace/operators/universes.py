"""Adaptive matching of vectors to norms of very many states, without all similarities.

With ``u`` the states of a norm as unit vectors, ``m`` their mean and ``C`` their centred second moments, the
cosines of a unit vector ``f`` with all states have mean ``f·m`` and variance ``fᵀCf``: the threshold needs no
similarity at all. States are cut into blocks by where they lie along the three main axes of ``C``; with
``c`` the centre of a block and ``r`` its radius, no cosine in it is over ``f·c + r``, so a block whose bound is
under the threshold is never opened. What is found is the same as in ``similarity.project``.

:func:`project_pruned` sorts the states of a norm past groups of its vectors, block by block. A task holds one group and one
block; each vector is sent once for every ``STATES_PER_TASK`` states of its norm and each state once for every group, and
what is found goes straight to whoever asked for it. So nothing that is written grows with the number of pairs.

A norm is held as one row of its moments, width² numbers, and one row a block. Meant for norms of thousands of
states; ``similarity.project`` serves small ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normtrace.functions import vectors as vx
from normtrace.operators.similarity import FACT_LAMBDA, FLAT_SPREAD, SIM_FLOOR
from normtrace.session import settle

STATES_PER_BLOCK = 1024
VECTORS_PER_GROUP = 4096
BOUNDS_AT_ONCE = 1 << 20
GROUP_BYTES = 1 << 24  # of the vectors that a task holds
STATES_PER_TASK = 1 << 18
FACTS_PER_ROW = 1024  # with one vector; of more there are several rows
SIMS_AT_ONCE = 1 << 21
ROWS_AT_ONCE = 1 << 16
AXES = 3
SLACK = 1e-12  # of rounding; greatest similarities closer than this count as equal


class Universe:
    """The settled tables of :func:`index_states`."""

    def __init__(self, states: DataFrame, moments: DataFrame):
        self.states, self.moments = states, moments

    @cached_property
    def blocks(self) -> DataFrame:
        """``norm_id, block, centre, radius``"""
        return settle(_bounds(self.states), "blocks")


def _unit(vector: str) -> Column:
    """The vector at length 1; zeros stay zeros."""
    return vx.let(F.col(vector).cast("array<double>"), lambda v: vx.let(
        vx.norm(v), lambda size: F.transform(v, lambda x: F.when(size == 0, F.lit(0.0)).otherwise(x / size))))


def _whole(vector: str) -> Column:
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())


def _sum_products(rows: DataFrame) -> DataFrame:
    """``norm_id, i, line``: line ``i`` of the sum of outer products of ``vector``, added up batch by batch."""

    def partial(batches):
        for batch in batches:
            for norm, group in batch.groupby("norm_id", sort=False, dropna=False):
                x = np.stack(group["vector"].to_numpy())
                lines = x.T @ x
                yield pd.DataFrame({"norm_id": pd.Series([norm] * len(lines), dtype=batch["norm_id"].dtype), "i": range(len(lines)), "line": list(lines)})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"norm_id": group["norm_id"].iloc[:1], "i": group["i"].iloc[:1], "line": [np.sum(np.stack(group["line"].to_numpy()), axis=0)]})

    schema = T.StructType([rows.schema["norm_id"], *T.StructType.fromDDL("i int, line array<double>")])
    return rows.select("norm_id", "vector").mapInPandas(partial, schema).groupBy("norm_id", "i").applyInPandas(add, schema)


def _axes(lines: DataFrame) -> DataFrame:
    """Moments of each norm with its main axes and the spread along them."""

    def decompose(group: pd.DataFrame) -> pd.DataFrame:
        moment = np.stack(group.sort_values("i")["line"].to_numpy()) / group["n"].iloc[0]
        sizes, directions = np.linalg.eigh(moment)
        axes = directions[:, ::-1].T[:AXES]
        return pd.DataFrame({"norm_id": group["norm_id"].iloc[:1], "mean": group["mean"].iloc[:1], "moment": [moment.ravel()],
                             "axes": [list(axes)], "spreads": [np.sqrt(np.maximum(sizes[::-1][:AXES], 0.0))]})

    schema = T.StructType([lines.schema["norm_id"], *T.StructType.fromDDL(
        "mean array<double>, moment array<double>, axes array<array<double>>, spreads array<double>")])
    return lines.groupBy("norm_id").applyInPandas(decompose, schema)


def index_states(states: DataFrame, states_per_block: int = STATES_PER_BLOCK) -> Universe:
    """Moments and blocks of ``states(norm_id, u_pos, state_id, vector)``.

    A norm with a null vector, a null element or vectors of several widths selects nothing and is left out.
    """
    sound = states.groupBy("norm_id").agg(
        F.count("*").alias("n"), F.min(_whole("vector")).alias("whole"),
        F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).where("whole AND least = most")
    units = settle(states.join(sound.select("norm_id", "n"), "norm_id").select("norm_id", "n", "u_pos", "state_id", _unit("vector").alias("vector")), "units")

    element = units.select("norm_id", "n", F.posexplode("vector").alias("i", "x")).groupBy("norm_id", "n", "i").agg(F.avg("x").alias("x"))
    means = settle(element.groupBy("norm_id", "n").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("e"))
                   .select("norm_id", "n", F.col("e.x").alias("mean")), "means")
    centred = units.drop("n").join(means, "norm_id").select("norm_id", F.zip_with("vector", "mean", lambda x, m: x - m).alias("vector"))
    moments = settle(_axes(_sum_products(centred).join(means, "norm_id")), "moments")

    # A cell is where a state lies along each axis, in steps of its spread, outer ones open.
    along = F.zip_with("axes", "spreads", lambda axis, spread: F.when(spread < FLAT_SPREAD, F.lit(0)).otherwise(
        F.greatest(F.lit(-2), F.least(F.lit(1), F.floor((vx.dot(axis, F.col("vector")) - vx.dot(axis, F.col("mean"))) / spread)))).cast("int"))
    placed = units.drop("n").join(moments.drop("moment"), "norm_id").select("norm_id", "u_pos", "state_id", "vector", F.array_join(along, ",").alias("cell"))
    sizes = placed.groupBy("norm_id", "cell").agg(F.ceil(F.count("*") / states_per_block).alias("parts"))
    part = F.pmod(F.xxhash64("u_pos", "state_id"), F.col("parts"))
    blocked = settle(placed.join(sizes, ["norm_id", "cell"]).select(
        "norm_id", F.concat_ws("/", "cell", part).alias("block"), "u_pos", "state_id", "vector"), "blocked")

    return Universe(blocked, moments)


def _bounds(blocked: DataFrame) -> DataFrame:
    def bound(group: pd.DataFrame) -> pd.DataFrame:
        centre, radius = _ball(np.stack(group["vector"].to_numpy()))
        return pd.DataFrame({"norm_id": group["norm_id"].iloc[:1], "block": group["block"].iloc[:1], "centre": [centre], "radius": [radius]})

    schema = T.StructType([blocked.schema["norm_id"], *T.StructType.fromDDL("block string, centre array<double>, radius double")])
    return blocked.groupBy("norm_id", "block").applyInPandas(bound, schema)


def _ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    centre = x.mean(axis=0)
    return centre, np.sqrt(((x - centre) ** 2).sum(axis=1).max())


def _bars(x: np.ndarray, mean: np.ndarray, moment: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """The threshold of each vector, and whether it is equally near to all states."""
    mu, spread = x @ mean, np.sqrt(np.maximum(((x @ moment.reshape(len(mean), -1)) * x).sum(axis=1), 0.0))
    flat = spread < FLAT_SPREAD
    return np.where(flat, mu - SLACK, mu + lam * spread), flat


def open_blocks(vectors: DataFrame, universe: Universe, lam: float, floor: float, per_group: int = VECTORS_PER_GROUP) -> DataFrame:
    """``norm_id, block, part, key, vector, bar, flat``: the blocks that each distinct vector has to open.

    ``vectors(norm_id, key, vector)`` are dealt to groups by their key, as many as their number asks for.
    """
    return _each_block(_choose_blocks(vectors, universe, lam, floor, per_group))


def _each_block(asked: DataFrame) -> DataFrame:
    return asked.select("norm_id", F.explode("blocks").alias("block"), "part", "key", "vector", "bar", "flat")


def _choose_blocks(vectors: DataFrame, universe: Universe, lam: float, floor: float, per_group: int) -> DataFrame:
    """One row per vector that opens a block, with the names of its blocks; a row per pair would hold it as often as that."""
    parts = vectors.groupBy("norm_id").agg(F.ceil(F.count("*") / per_group).alias("parts"))
    dealt = vectors.join(parts, "norm_id").select("norm_id", F.pmod(F.xxhash64("key"), F.col("parts")).alias("part"), "key", "vector")
    norm = universe.moments.select("norm_id", "mean", "moment").join(
        universe.blocks.groupBy("norm_id").agg(F.collect_list(F.struct("block", "centre", "radius")).alias("blocks")), "norm_id")
    sent = norm.join(parts, "norm_id").select("norm_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "mean", "moment", "blocks")
    columns = ["norm_id", "blocks", "part", "key", "vector", "bar", "flat"]

    def choose(facts: pd.DataFrame, norms: pd.DataFrame) -> pd.DataFrame:
        if facts.empty or norms.empty:
            return pd.DataFrame(columns=columns)
        mean = np.asarray(norms["mean"].iloc[0])
        facts = facts[[len(v) == len(mean) for v in facts["vector"]]]
        if facts.empty:
            return pd.DataFrame(columns=columns)
        blocks = norms["blocks"].iloc[0]
        centres, radii = np.stack([b["centre"] for b in blocks]), np.array([b["radius"] for b in blocks])
        x = np.stack(facts["vector"].to_numpy())
        bar, flat = _bars(x, mean, np.asarray(norms["moment"].iloc[0]), lam)
        low = np.maximum(bar, floor) - 2 * SLACK
        names = np.array([b["block"] for b in blocks], dtype=object)
        opened, some = [], max(1, BOUNDS_AT_ONCE // len(blocks))
        for at in range(0, len(x), some):
            near = x[at:at + some] @ centres.T + radii[None, :] >= low[at:at + some, None]
            opened += [names[row] for row in near]
        found = facts.assign(blocks=opened, bar=bar, flat=flat)[columns]
        return found[[len(names_) > 0 for names_ in opened]]

    schema = T.StructType([dealt.schema["norm_id"], *T.StructType.fromDDL("blocks array<string>, part long, key string, vector array<double>, bar double, flat boolean")])
    return dealt.groupBy("norm_id", "part").cogroup(sent.groupBy("norm_id", "part")).applyInPandas(choose, schema)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches cut where one of the named columns changes."""
    for batch in batches:
        n = batch.num_rows
        changed = np.zeros(max(0, n - 1), dtype=bool)
        for name in names if n > 1 else []:
            column = batch.column(name)
            changed |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).fill_null(False).to_numpy(zero_copy_only=False)
        ends = [*(np.flatnonzero(changed) + 1).tolist(), n]
        for begin, end in zip([0, *ends], ends):
            if end > begin:
                yield batch.slice(begin, end - begin)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy().reshape(len(vectors), -1)


def _sorted_past(rows: DataFrame, tasks: int, group: list[str], *then: str) -> DataFrame:
    """The rows of a group in one task, in order."""
    return rows.repartition(tasks, *group).sortWithinPartitions(*group, *then)


def _with_bars(dealt: DataFrame, moments: DataFrame, tasks: int, lam: float) -> DataFrame:
    """``dealt(norm_id, part, vector, rows)`` with ``bar`` and ``flat``; ``moments`` has a row for each part."""
    nothing = F.lit(None)
    together = moments.select("norm_id", "part", F.lit(0).alias("kind"), F.col("mean").alias("vector"), "moment", nothing.cast(dealt.schema["rows"].dataType).alias("rows")).unionByName(
        dealt.select("norm_id", "part", F.lit(1).alias("kind"), "vector", nothing.cast("array<double>").alias("moment"), "rows"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, ["norm_id", "part", "kind"]):
            x = _matrix(run.column("vector"))
            if run.column("kind")[0].as_py() == 0:
                mean, moment = x[0], run.column("moment").flatten().to_numpy()
                continue
            bar, flat = _bars(x, mean, moment, lam)
            yield pa.RecordBatch.from_arrays([*(run.column(c) for c in ("norm_id", "part", "vector", "rows")), pa.array(bar), pa.array(flat)],
                                             ["norm_id", "part", "vector", "rows", "bar", "flat"])

    schema = T.StructType([*(dealt.schema[c] for c in ("norm_id", "part", "vector", "rows")), *T.StructType.fromDDL("bar double, flat boolean")])
    return _sorted_past(together, tasks, ["norm_id", "part"], "kind").mapInArrow(add, schema)


class _Asked:
    """The vectors of a group, with the facts that have them."""

    def __init__(self, group: tuple):
        self.group, self.runs, self.x = group, [], None

    def close(self) -> None:
        """No more vectors come."""
        if self.x is None:
            whole = lambda c: pa.concat_arrays([run.column(c) for run in self.runs])
            rows = whole("rows")
            self.x, self.bar, self.norm, self.rows = _matrix(whole("vector")), whole("bar").to_numpy(), self.runs[0].column("norm_id")[0], rows.flatten()
            self.counts = rows.value_lengths().to_numpy()
            self.starts = np.cumsum(self.counts) - self.counts
            self.runs, self.best = [], {}

    def near(self, states: np.ndarray, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of a vector and a state of a block, and how near they are."""
        centre, radius = _ball(states)
        at = np.flatnonzero(self.x @ centre + radius >= np.maximum(self.bar, floor) - 2 * SLACK)
        some = max(1, SIMS_AT_ONCE // len(states))
        for part in (at[i:i + some] for i in range(0, len(at), some)):
            sims = self.x[part] @ states.T
            i, j = np.nonzero((sims >= self.bar[part, None]) & (sims >= floor))
            if len(i):
                yield part[i], j, sims[i, j]

    def found(self, i: np.ndarray, j: np.ndarray, sims: np.ndarray, u_pos: pa.Array, state_id: pa.Array) -> Iterator[pa.RecordBatch]:
        """A row for each fact of each pair."""
        passed = np.cumsum(self.counts[i]) // ROWS_AT_ONCE
        ends = [*(np.flatnonzero(np.diff(passed)) + 1).tolist(), len(i)]
        for begin, end in zip([0, *ends], ends):
            pairs, times = i[begin:end], self.counts[i[begin:end]]
            fact = np.repeat(self.starts[pairs] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            state = pa.array(np.repeat(j[begin:end], times))
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(self.norm, len(fact)), self.rows.take(pa.array(fact)), u_pos.take(state), state_id.take(state), pa.array(np.repeat(sims[begin:end], times))],
                ["norm_id", "row", "u_pos", "state_id", "sim"])


def _search(asked: DataFrame, states: DataFrame, tasks: int, floor: float, flat: bool) -> DataFrame:
    """``norm_id, row, u_pos, state_id, sim`` of ``asked(norm_id, part, slab, vector, bar, rows)``; if flat, the first of the nearest states alone.

    ``states(norm_id, part, slab, block, u_pos, state_id, vector)`` come to every group that may ask for them.
    """
    nothing = lambda kind: F.lit(None).cast(kind)
    group = ["norm_id", "part", "slab"]
    together = asked.select(*group, F.lit(0).alias("kind"), nothing("string").alias("block"), "vector", "bar", "rows", nothing("int").alias("u_pos"), nothing("string").alias("state_id")).unionByName(
        states.select(*group, F.lit(1).alias("kind"), "block", "vector", nothing("double").alias("bar"), nothing(asked.schema["rows"].dataType).alias("rows"), "u_pos", "state_id"))

    def last(asks: _Asked | None) -> Iterator[pa.RecordBatch]:
        for i, (_, u_pos, state_id, sim) in (asks.best.items() if asks and asks.x is not None else ()):
            yield from asks.found(np.array([i]), np.array([0]), np.array([sim]), pa.array([-u_pos], pa.int32()), pa.array([state_id]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks = None
        for run in _runs(batches, [*group, "kind", "block"]):
            here = tuple(run.column(c)[0].as_py() for c in group)
            if run.column("kind")[0].as_py() == 0:
                if asks is None or asks.group != here:
                    yield from last(asks)
                    asks = _Asked(here)
                asks.runs.append(run)
            elif asks is not None and asks.group == here:
                asks.close()
                u_pos, state_id = run.column("u_pos"), run.column("state_id")
                for i, j, sims in asks.near(_matrix(run.column("vector")), floor):
                    if not flat:
                        yield from asks.found(i, j, sims, u_pos, state_id)
                        continue
                    for a, b, sim in zip(i.tolist(), j.tolist(), sims.tolist()):
                        entry = (round(sim, 12), -u_pos[b].as_py(), state_id[b].as_py(), sim)
                        if a not in asks.best or entry[:2] > asks.best[a][:2]:
                            asks.best[a] = entry
        yield from last(asks)

    schema = T.StructType([asked.schema["norm_id"], T.StructField("row", asked.schema["rows"].dataType.elementType), *T.StructType.fromDDL("u_pos int, state_id string, sim double")])
    return _sorted_past(together, tasks, group, "kind", "block").mapInArrow(search, schema)


def project_pruned(
    facts: DataFrame, universe: Universe, vector: str = "vector",
    lam: float = FACT_LAMBDA, floor: float = SIM_FLOOR, per_group: int | None = None,
) -> DataFrame:
    """The rows of ``similarity.project``, for norms of very many states.

    Each distinct vector of a norm is matched once for every ``FACTS_PER_ROW`` facts that have it, so
    a vector on a third of the rows costs no more than any other. Null vectors, null elements, other widths
    and unknown norms select nothing. If a vector is equally near to all states, the first of the nearest
    stands, least ``u_pos`` of those within ``SLACK``. A group has ``per_group`` vectors, or as many as all cores
    want and ``GROUP_BYTES`` hold. The other columns go through Python, as Arrow.
    """
    kept = [c for c in facts.columns if c not in (vector, "norm_id")]
    key = F.unhex(F.sha2(F.array_join(F.col(vector).cast("array<double>").cast("array<string>"), ","), 256))
    rows = facts.where(_whole(vector)).select("norm_id", key.alias("key"), F.col(vector).alias("vector"), F.struct(*kept).alias("row") if kept else F.lit(1).alias("row"))
    often = rows.groupBy("norm_id", "key").agg(F.ceil(F.count("*") / FACTS_PER_ROW).alias("_turns")).where("_turns > 1").withColumnsRenamed({"norm_id": "_norm", "key": "_key"})
    turned = rows.withColumn("at", F.monotonically_increasing_id()).join(settle(often, "often"), (F.col("norm_id") == F.col("_norm")) & (F.col("key") == F.col("_key")), "left")
    distinct = turned.groupBy("norm_id", "key", F.pmod("at", F.coalesce("_turns", F.lit(1))).alias("turn")).agg(F.first("vector").alias("vector"), F.collect_list("row").alias("rows"))
    seen = Observation()
    distinct = settle(distinct.select("norm_id", F.xxhash64("key", "turn").alias("deal"), _unit("vector").alias("vector"), "rows").observe(seen, F.count("*").alias("n")), "vectors")

    cores = facts.sparkSession.sparkContext.defaultParallelism
    most = per_group or max(VECTORS_PER_GROUP, seen.get["n"] // (2 * cores))
    fitting = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(GROUP_BYTES) / (8 * F.size("mean")))))
    sizes = settle(distinct.groupBy("norm_id").agg(F.count("*").alias("n_asked")).join(universe.states.groupBy("norm_id").agg(F.count("*").alias("n_states")), "norm_id")
                   .join(universe.moments.select("norm_id", "mean"), "norm_id")
                   .select("norm_id", "n_asked", "n_states", F.size("mean").alias("width"), F.ceil(F.col("n_asked") / fitting).alias("parts"), F.ceil(F.col("n_states") / STATES_PER_TASK).alias("slabs")), "sizes")
    groups, sent = sizes.agg(F.coalesce(F.sum(F.col("parts") * F.col("slabs")), F.lit(0)), F.coalesce(F.sum(F.col("n_asked") * F.col("slabs") + F.col("n_states") * F.col("parts")), F.lit(0))).first()
    tasks = max(1, min(2 * groups, cores + sent // VECTORS_PER_GROUP))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    dealt = distinct.join(sizes.select("norm_id", "width", "parts"), "norm_id").where(F.size("vector") == F.col("width")).select("norm_id", F.pmod("deal", "parts").alias("part"), "vector", "rows")
    moments = universe.moments.join(sizes.select("norm_id", "parts"), "norm_id").select("norm_id", upto("parts").alias("part"), "mean", "moment")
    flats = Observation()
    asked = settle(_with_bars(dealt, moments, tasks, lam).observe(flats, F.count_if("flat").alias("n")), "asked")

    states = universe.states.join(sizes.select("norm_id", "parts", "slabs"), "norm_id").select(
        "norm_id", upto("parts").alias("part"), F.pmod(F.xxhash64("block"), "slabs").alias("slab"), "block", "u_pos", "state_id", "vector")
    found = _search(asked.where("NOT flat").join(sizes.select("norm_id", "slabs"), "norm_id").select("*", upto("slabs").alias("slab")), states, tasks, floor, flat=False)
    if flats.get["n"]:
        level = asked.where("flat").withColumn("slab", F.lit(0).cast("long"))
        wanted = level.select("norm_id", "part").distinct()
        found = found.unionByName(_search(level, states.withColumn("slab", F.lit(0).cast("long")).join(wanted, ["norm_id", "part"], "left_semi"), tasks, floor, flat=True))
    names = [c for c in facts.columns if c != vector]
    return found.select(*[F.col(f"row.{c}").alias(c) if c in kept else F.col(c) for c in names], "u_pos", "state_id", "sim")
