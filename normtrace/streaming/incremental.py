"""Causal check that follows a stream of activations with keyed state.

What decides a scenario is the first activation of each state, so that is all the stream keeps: one
small map per scenario, bounded by the states of its norm. New rows lower the firsts, the scenario is
walked again in order (a handful of states), and rows are sent out for states that are new or whose
decision changed. In-order input gives every decision exactly once; a late step corrects what it
changes, with a higher ``revision``. Before the shuffle each Arrow batch is reduced to the firsts it
holds, so a scenario with a third of all rows sends few of them to its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from normtrace.operators.causal import SCENARIO
from normtrace.session import fresh_path

ACTIVATIONS = "norm_id long, scenario_id long, step int, u_pos int, state_id string"
SEEN = "step int, u_pos int, pres array<string>, missing array<string>, revision int"
DECISIONS = ("norm_id long, scenario_id long, state_id string, step int, u_pos int, valid boolean, "
             "missing array<string>, revision int")
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"  # a batch writes what changed, no copies of the files
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _batch_firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    keys = [*SCENARIO, "state_id"]
    for pdf in batches:
        yield pdf.sort_values(["step", "u_pos"], kind="stable").drop_duplicates(keys)


class FirstActivationWalk(StatefulProcessor):
    """State per scenario: ``state_id -> first place, preconditions, and the decision sent out``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "state_id string", SEEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: list(v) for k, v in self.seen.iterator()}
        moved = set()
        for pdf in rows:
            for state, step, pos, pres in zip(pdf["state_id"], pdf["step"], pdf["u_pos"], pdf["pres"]):
                old = known.get(state)
                if old is None:
                    known[state] = [int(step), int(pos), list(pres) if pres is not None else [], None, 0]
                elif (step, pos) < (old[0], old[1]):
                    old[0], old[1] = int(step), int(pos)
                else:
                    continue
                moved.add(state)
        out, valid = [], set()
        for state, entry in sorted(known.items(), key=lambda e: (e[1][0], e[1][1], e[0])):
            missing = sorted(set(entry[2]) - valid)
            if not missing:
                valid.add(state)
            if state in moved or entry[3] is None or list(entry[3]) != missing:
                entry[3], entry[4] = missing, entry[4] + 1
                self.seen.updateValue((state,), tuple(entry))
                out.append((*key, state, entry[0], entry[1], not missing, missing, entry[4]))
        names = [part.split()[0] for part in DECISIONS.split(", ")]
        yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def incremental_decisions(activations: DataFrame, links: DataFrame) -> DataFrame:
    """Streaming decisions for a streaming ``activations`` table; the norm side is a static join.

    The query has to be started inside :func:`stream_settings`.
    """
    firsts = activations.mapInPandas(_batch_firsts, ACTIVATIONS)
    return (
        firsts.join(links.select("norm_id", "state_id", "pres"), ["norm_id", "state_id"], "left")
        .select(*SCENARIO, "state_id", "step", "u_pos", "pres")
        .groupBy(*SCENARIO)
        .transformWithStateInPandas(FirstActivationWalk(), DECISIONS, "Update", "None")
    )


def latest(decisions: DataFrame) -> DataFrame:
    """The last revision of every decision sent out (one row per scenario and state, usually all)."""
    return decisions.groupBy(*SCENARIO, "state_id").agg(
        F.max_by(F.struct("step", "u_pos", "valid", "missing"), "revision").alias("_d")
    ).select(*SCENARIO, "state_id", "_d.*")


def downstream(decisions: DataFrame, reach: DataFrame) -> DataFrame:
    """Contaminated states: violated ones and everything that can be reached from them."""
    seeds = decisions.where("NOT valid").select(*SCENARIO, "state_id")
    further = seeds.join(
        reach.select("norm_id", F.col("src").alias("state_id"), "dst"), ["norm_id", "state_id"]
    ).select(*SCENARIO, F.col("dst").alias("state_id"))
    return seeds.unionByName(further).distinct()


@contextmanager
def stream_settings(spark: SparkSession, state_partitions: int | None = None) -> Iterator[None]:
    """Settings a query takes over when it starts; the session has its own again afterwards."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, CHANGELOG: "true"}
    if state_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(state_partitions)
    usual = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in usual.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def run_available(
    spark: SparkSession, activations: DataFrame, links: DataFrame, folder: str | None = None,
    state_partitions: int | None = None,
) -> DataFrame:
    """Run over all input there is now, in as many micro-batches as the source gives, and return the
    decisions sent out. Progress and state live in ``folder``, so a later call goes on from there.

    ``state_partitions`` (default: the session's shuffle partitions) is fixed by the first run.
    """
    folder = folder or fresh_path(spark, "causal-stream")
    with stream_settings(spark, state_partitions):
        query = (
            incremental_decisions(activations, links).writeStream
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/decisions/batch={n}"))
            .option("checkpointLocation", f"{folder}/progress")
            .outputMode("update").trigger(availableNow=True).start()
        )
    query.awaitTermination()
    return spark.read.schema(DECISIONS).parquet(f"{folder}/decisions")
