"""Causal check over a stream whose scenarios end: state is freed, contamination is sent by the processor.

Scenarios share ``groups`` rows of state by a hash of their keys, as calling Python for a scenario alone costs far more than
its walk. A row has the key, the time and a text for each of its open scenarios: the clock, and an entry for each state
with what it spoils downstream when violated. A batch reads and writes only the texts of scenarios that it has rows of;
the others of their groups pass through as they are. A row is sent out for every state, activated or only contaminated,
whose decision or contamination changed, with a higher ``revision``; no batch step follows.

A scenario is closed when the watermark (greatest ``ts`` less ``delay``) passes ``ts`` of its end marker, a row
without a state, or ``idle`` after its last row. One row with ``closed`` and no state is sent then, and the map is
dropped, so the state kept is that of the open scenarios alone.

Defined results: rows within ``delay`` of the greatest time seen always count; of older ones Spark may leave out
those that no newer row of the same scenario and state came with. A row after the closing begins a new ``walk`` of
its scenario. The place of a row without ``ts`` counts, its time does not; a scenario without any time closes
``idle`` after the watermark it began at, or after the first one there is. Repeated rows change nothing. A null ``norm_id`` or ``scenario_id`` is a
key like any other. Other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from normtrace.operators.causal import SCENARIO
from normtrace.session import fresh_path
from normtrace.streaming.incremental import stream_settings

ACTIVATIONS = "norm_id long, scenario_id long, step int, u_pos int, state_id string, ts timestamp"
GROUPS = 1 << 11  # has to stay the same over all runs of a stream, whatever its number of partitions
SEEN = ("state_id string, step int, u_pos int, pres array<string>, downs array<string>, missing array<string>, "
        "contaminated boolean, revision int")
STATE = "norm_id array<long>, scenario_id array<long>, nulls array<int>, timer array<long>, walk array<string>"
ROWS_AT_ONCE = 1 << 14
ROWS = ("norm_id long, scenario_id long, walk long, state_id string, step int, u_pos int, valid boolean, "
        "missing array<string>, contaminated boolean, revision int, closed boolean")
NAMES = [part.split()[0] for part in ROWS.split(", ")]
KEYS = [*SCENARIO, "nulls"]  # which of the keys are null, as pandas has no nulls among whole numbers


def _batch_firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first place and the latest time of each state of each scenario of an Arrow batch."""
    keys = [*KEYS, "state_id"]
    for pdf in batches:
        pdf["ts"] = pdf.groupby(keys, dropna=False)["ts"].transform("max")
        yield pdf.sort_values(["step", "u_pos"], kind="stable").drop_duplicates(keys)


def _walk(idle_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """What the scenarios of a group do with their rows of a batch, and those whose time is over."""

    def sent(group: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState, now: int) -> Iterator[tuple]:
        kept = {key: (timer, text) for *key_, timer, text in zip(*state.get) for key in [tuple(key_)]} if state.exists else {}
        walks = {}  # of the scenarios with rows: (walk, last, ends, known, moved)
        for pdf in () if state.hasTimedOut else pdfs:
            for *key_, name, step, pos, pres, downs, ms in zip(*(pdf[c].tolist() for c in (*KEYS, "state_id", "step", "u_pos", "pres", "downs", "ms"))):
                key = tuple(key_)
                if key not in walks:
                    walk, last, ends, seen = json.loads(kept.pop(key)[1]) if key in kept else (now, None, None, [])
                    walks[key] = [walk, last, ends, {entry[0]: entry[1:] for entry in seen}, set()]
                at = walks[key]
                if not pd.isna(ms):
                    at[1] = max(at[1] or 0, int(ms))
                    if name is None:
                        at[2] = max(at[2] or 0, int(ms))
                if name is None:
                    continue
                known, old = at[3], at[3].get(name)
                if old is None or old[0] is None:
                    known[name] = [int(step), int(pos), _listed(pres), _listed(downs), None, *(old[5:] if old else (False, 0))]
                elif (step, pos) < (old[0], old[1]):
                    old[0], old[1] = int(step), int(pos)
                else:
                    continue
                at[4].add(name)
        over = []
        for key, (timer, text) in kept.items():
            if max(1, timer) < now:
                walk, last, ends, _ = json.loads(text)
                if timer == idle_ms and last is None and ends is None:  # begun without time, before any watermark
                    kept[key] = (now + idle_ms, text)
                else:
                    over.append((key, walk))
        for key, (walk, last, ends, known, moved) in walks.items():
            if moved:
                for row in _decide(known, moved):
                    yield *key, walk, *row, False
            wanted = ends if ends is not None else (last if last is not None else now) + idle_ms
            if wanted < now:  # over already
                over.append((key, walk))
            else:
                kept[key] = (wanted, json.dumps([walk, last, ends, [(name, *entry) for name, entry in known.items()]]))
        for key, walk in over:
            kept.pop(key, None)
            yield *key, walk, None, None, None, None, None, None, None, True
        if kept:
            state.update(tuple(map(list, zip(*((*key, *entry) for key, entry in kept.items())))))
            state.setTimeoutTimestamp(max(1, min(timer for timer, _ in kept.values())))
        elif state.exists:
            state.remove()

    def run(group: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = sent(group, pdfs, state, max(0, state.getCurrentWatermarkMs()))
        while part := list(islice(rows, ROWS_AT_ONCE)):
            yield pd.DataFrame(part, columns=[*KEYS, *NAMES[2:]])

    return run


def _decide(known: dict, moved: set) -> Iterator[tuple]:
    """Walk the scenario again in order; rows of the states that are new or judged otherwise than before."""
    valid, spoiled, judged = set(), set(), {}
    active = sorted((e for e in known.items() if e[1][0] is not None), key=lambda e: (e[1][0], e[1][1], e[0]))
    for state, entry in active:
        judged[state] = sorted(set(entry[2]) - valid)
        if judged[state]:
            spoiled.add(state)
            spoiled.update(entry[3])
        else:
            valid.add(state)
    for state in sorted(known.keys() | spoiled):
        entry = known.setdefault(state, [None, None, [], [], None, False, 0])
        missing, tainted = judged.get(state), state in spoiled
        before = None if entry[4] is None else list(entry[4])
        if state in moved or before != missing or entry[5] != tainted:
            entry[4:] = missing, tainted, entry[6] + 1
            yield state, entry[0], entry[1], None if missing is None else not missing, missing, tainted, entry[6]


def _listed(names) -> list:
    return [] if names is None else list(names)


def closing_decisions(activations: DataFrame, links: DataFrame, idle_seconds: int, delay: str, groups: int = GROUPS) -> DataFrame:
    """Decisions and contamination of a streaming ``activations`` table, closing rows among them.

    Has to be started inside :func:`stream_settings`.
    """
    nulls = sum((F.when(F.col(c).isNull(), 2**i).otherwise(0) for i, c in enumerate(SCENARIO)), F.lit(0))
    keyed = activations.select(*[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in SCENARIO], nulls.alias("nulls"),
                               "step", "u_pos", "state_id", "ts")
    firsts = keyed.mapInPandas(_batch_firsts, ACTIVATIONS.replace("step", "nulls int, step", 1))
    near = links.select(F.col("norm_id").alias("_norm"), F.col("state_id").alias("_state"), "pres", "downs")
    known = (F.col("nulls").bitwiseAND(F.lit(1)) == 0) & (F.col("norm_id") == F.col("_norm")) & (F.col("state_id") == F.col("_state"))
    sent = (
        firsts.withWatermark("ts", delay).join(near, known, "left")
        .select(F.pmod(F.xxhash64(*KEYS), F.lit(groups)).cast("int").alias("share"), *KEYS, "state_id", "step", "u_pos", "pres", "downs",
                F.unix_millis("ts").alias("ms"), "ts")
        .groupBy("share")
        .applyInPandasWithState(_walk(idle_seconds * 1000), ROWS.replace("walk", "nulls int, walk", 1), STATE, "Update", GroupStateTimeout.EventTimeTimeout)
    )
    return sent.select(*_own_keys(), *NAMES[2:])


def _own_keys() -> list[Column]:
    """The keys with their nulls."""
    return [F.when(F.col("nulls").bitwiseAND(F.lit(2**i)) == 0, F.col(c)).alias(c) for i, c in enumerate(SCENARIO)]


def run_available(
    spark: SparkSession, activations: DataFrame, links: DataFrame, folder: str | None = None, idle_seconds: int = 3600,
    delay: str = "10 minutes", state_partitions: int | None = None, groups: int = GROUPS,
) -> DataFrame:
    """Run over all input there is now and return every row sent out so far.

    Progress and state live in ``folder``; a later call goes on from there, with the same ``groups``.
    """
    folder = folder or fresh_path(spark, "closing-stream")
    with stream_settings(spark, state_partitions):
        query = (
            closing_decisions(activations, links, idle_seconds, delay, groups).writeStream
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}"))
            .option("checkpointLocation", f"{folder}/progress")
            .outputMode("update").trigger(availableNow=True).start()
        )
    query.awaitTermination()
    return spark.read.schema(ROWS).parquet(f"{folder}/rows")


def latest(rows: DataFrame) -> DataFrame:
    """The last word on every state of every walk."""
    return rows.where("NOT closed").groupBy(*SCENARIO, "walk", "state_id").agg(
        F.max_by(F.struct("step", "u_pos", "valid", "missing", "contaminated"), "revision").alias("_d")
    ).select(*SCENARIO, "walk", "state_id", "_d.*")


def walk_summary(rows: DataFrame) -> DataFrame:
    """One row per walk of a scenario: counts of its states as they stand, and whether it is closed.

    One shuffle by scenario carries both the last revisions and the counts.
    """
    last = rows.groupBy(*SCENARIO, "walk", "state_id").agg(
        F.max_by(F.struct("valid", "contaminated"), "revision").alias("_d"), F.max("closed").alias("_closed"))
    return last.groupBy(*SCENARIO, "walk").agg(
        F.count_if("_d.valid").alias("n_validated"),
        F.count_if(~F.col("_d.valid")).alias("n_violations"),
        F.count_if("_d.contaminated").alias("n_contaminated"),
        F.max("_closed").alias("closed"),
    )


def open_states(spark: SparkSession, folder: str) -> DataFrame:
    """What the stream in ``folder`` still keeps, from its last checkpoint: ``norm_id, scenario_id, state_id`` and the entry."""
    with stream_settings(spark):
        kept = spark.read.format("statestore").load(f"{folder}/progress")
    scenarios = kept.select("value.groupState.*").select(F.inline(F.arrays_zip(*KEYS, "walk")))

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*key, *entry) for *key, walk in pdf.itertuples(index=False) for entry in json.loads(walk)[3]]
            yield pd.DataFrame(rows, columns=[*KEYS, *names])

    names = [part.split()[0] for part in SEEN.split(", ")]
    read = scenarios.mapInPandas(entries, f"norm_id long, scenario_id long, nulls int, {SEEN}")
    return read.select(*_own_keys(), *names)
