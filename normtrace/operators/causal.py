"""Causal check of scenarios against the preconditions of their norm, in one set-based plan.

A state is decided once, at its first activation, because the validated set only grows and a
contaminated state stays so. With ``first(k)`` the least (step, position) at which ``k`` is active:

* ``k`` is a seed if a precondition is not active before ``first(k)``;
* contaminated are the seeds and everything reachable from them;
* active and contaminated is a violation, active and not contaminated is validated;
* missing are the preconditions that are contaminated or not active before ``first(k)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normtrace.session import deal, settle, settle_counted

SCENARIO = ["norm_id", "scenario_id"]
NO_STRINGS = "array<string>"
STEPS_PER_BLOCK = 65_536


def place(step: Column, u_pos: Column) -> Column:
    """(step, u_pos) as one long in the same order, so that its minimum is a plain hash aggregate."""
    return F.shiftleft(step.cast("long"), 32).bitwiseOR(u_pos.cast("long"))


def step_of(at: Column) -> Column:
    return F.shiftright(at, 32).cast("int")


def pos_of(at: Column) -> Column:
    return at.bitwiseAND(F.lit(2**31 - 1)).cast("int")


def first_activations(activations: DataFrame) -> DataFrame:
    """Per scenario and state: place of the first activation and number of occurrences.

    Aggregates on the map side, so a scenario of any length shrinks to its distinct states before
    the shuffle.
    """
    return activations.groupBy(*SCENARIO, "state_id").agg(
        F.min(place(F.col("step"), F.col("u_pos"))).alias("first"),
        F.count("*").alias("occurrences"),
    )


def norm_links(edges: DataFrame, reach: DataFrame, weights: DataFrame) -> DataFrame:
    """One row per (norm, state): weight, preconditions, direct successors, all states downstream."""
    nothing = F.lit(None).cast("string")

    def part(rows: DataFrame, state: str, other: str | None, role: str) -> DataFrame:
        given = {role: F.col(other)} if other else {}
        return rows.select(
            "norm_id", F.col(state).alias("state_id"),
            *[given.get(name, nothing).alias(name) for name in ("pre", "suc", "down")],
            (F.col("weight") if other is None else F.lit(None).cast("int")).alias("weight"))

    together = (
        part(edges, "target", "source", "pre").unionByName(part(edges, "source", "target", "suc"))
        .unionByName(part(reach, "src", "dst", "down")).unionByName(part(weights, "state_id", None, ""))
    )
    return together.groupBy("norm_id", "state_id").agg(
        F.collect_set("pre").alias("pres"),
        F.collect_set("suc").alias("sucs"),
        F.collect_set("down").alias("downs"),
        F.max("weight").alias("weight"),
    )


def _tell(state: Column, others: Column) -> Column:
    """Generator of (pos, k): the state itself at position 0, then every state it has to tell."""
    return F.posexplode(F.concat(F.array(state), F.coalesce(others, F.array().cast(NO_STRINGS)))).alias("pos", "k")


def _own(value: Column | str) -> Column:
    """The value on the state's own row, within a group of rows told to it."""
    return F.max(F.when(F.col("pos") == 0, F.col(value) if isinstance(value, str) else value))


def decide(firsts: DataFrame, links: DataFrame) -> DataFrame:
    """Every active or contaminated state of every scenario, decided.

    ``norm_id, scenario_id, state_id, first, first_step, first_pos, occurrences, weight, activated,
    contaminated``. The first activations are written and counted. Both aggregations that follow are dealt by
    scenario, a bounded number of first activations to a task. The norm side carries no hint: Catalyst
    broadcasts it when its size allows, else it is a join on (norm, state) that AQE splits on skew.
    """
    firsts, rows = settle_counted(firsts, "firsts")

    # Each first activation is told to the states that need it: how many preconditions came, and
    # when the last one did, is all there is to know.
    told = firsts.join(links.select("norm_id", "state_id", "sucs"), ["norm_id", "state_id"], "left").select(
        *SCENARIO, "first", "occurrences", _tell(F.col("state_id"), F.col("sucs")))
    gathered = (
        deal(told, rows, SCENARIO).groupBy(*SCENARIO, F.col("k").alias("state_id"))
        .agg(
            _own("first").alias("first"),
            _own("occurrences").alias("occurrences"),
            F.count_if(F.col("pos") > 0).alias("n_told"),
            F.max(F.when(F.col("pos") > 0, F.col("first"))).alias("last_told"),
        )
        .where("first IS NOT NULL")
    )
    too_late = F.coalesce(F.col("last_told") >= F.col("first"), F.lit(False))
    judged = gathered.join(
        links.select("norm_id", "state_id", F.size("pres").alias("n_pres"), "downs", "weight"),
        ["norm_id", "state_id"], "left",
    ).withColumn("seed", (F.col("n_told") < F.coalesce("n_pres", F.lit(0))) | too_late)

    # Each seed tells everything downstream.
    spoiled = judged.select(*SCENARIO, "first", "occurrences", "weight", "seed",
                            _tell(F.col("state_id"), F.when(F.col("seed"), F.col("downs"))))
    decided = (
        deal(spoiled, rows, SCENARIO).groupBy(*SCENARIO, F.col("k").alias("state_id"))
        .agg(
            _own("first").alias("first"),
            _own("occurrences").alias("occurrences"),
            _own("weight").alias("weight"),
            F.max("seed").alias("contaminated"),
        )
    )
    return decided.select(
        *SCENARIO, "state_id", "first",
        step_of(F.col("first")).alias("first_step"),
        pos_of(F.col("first")).alias("first_pos"),
        F.coalesce("occurrences", F.lit(0)).alias("occurrences"),
        "weight",
        F.col("first").isNotNull().alias("activated"),
        "contaminated",
    )


def with_missing(decisions: DataFrame, links: DataFrame) -> DataFrame:
    """Add ``missing`` to the violations: their preconditions without those validated before them.

    Only validated states tell their successors. The decisions are written and counted, so that a task holds a
    bounded number of them.
    """
    decisions, rows = settle_counted(decisions, "decisions")
    kept = ["first", "first_step", "first_pos", "occurrences", "weight", "activated", "contaminated"]
    sound = F.col("activated") & ~F.col("contaminated")
    sent = decisions.join(links.select("norm_id", "state_id", "sucs"), ["norm_id", "state_id"], "left").select(
        *SCENARIO, *kept, F.col("state_id").alias("pre"), _tell(F.col("state_id"), F.when(sound, F.col("sucs"))))
    told = (
        deal(sent, rows, SCENARIO).groupBy(*SCENARIO, F.col("k").alias("state_id"))
        .agg(*[_own(c).alias(c) for c in kept],
             F.collect_list(F.when(F.col("pos") > 0, F.struct("pre", "first"))).alias("told"))
        .where("contaminated IS NOT NULL")
    )
    in_time = F.transform(F.filter("told", lambda t: t["first"] < F.col("first")), lambda t: t["pre"])
    missing = F.array_sort(F.array_except(F.coalesce("pres", F.array().cast(NO_STRINGS)), in_time))
    return (
        told.join(links.select("norm_id", "state_id", "pres"), ["norm_id", "state_id"], "left")
        .select(*SCENARIO, "state_id", *kept,
                F.when(F.col("activated") & F.col("contaminated"), missing).alias("missing"))
    )


def violations(decisions: DataFrame, links: DataFrame) -> DataFrame:
    """One row per contaminated state that was attempted, at its first attempt."""
    return with_missing(decisions, links).where("activated AND contaminated").select(
        *SCENARIO,
        F.col("first_step").alias("transition_index"),
        F.col("state_id").alias("attempted_state"),
        F.col("missing").alias("missing_preconditions"),
    )


def validated(decisions: DataFrame) -> DataFrame:
    return decisions.where("activated AND NOT contaminated").select(*SCENARIO, "state_id", "first_step")


def contaminated(decisions: DataFrame) -> DataFrame:
    """Seeds and everything downstream, attempted or not."""
    return decisions.where("contaminated").select(
        *SCENARIO, "state_id", F.col("activated").alias("attempted"))


def _beside(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys``, null keys being keys like any other."""
    renamed = other.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same &= rows[k].eqNullSafe(renamed[f"_{k}"])
    return rows.join(renamed, same, "left").drop(*[f"_{k}" for k in keys])


def step_trace(facts: DataFrame, decisions: DataFrame, steps_per_block: int = STEPS_PER_BLOCK) -> DataFrame:
    """Per step: size of the validated set after it, violations so far, and new violations.

    Running sums over steps and decisions in one sorted pass. A scenario is cut into blocks of steps; a
    task sums within its block, and what the blocks before it add up to comes from a table with one row per
    scenario and later block. So no task sees a long scenario as a whole, and the work is that of a sort,
    whatever the number of states. A scenario without decisions counts nothing; decisions of a scenario
    without facts are not shown; repeated rows come out as often as they occur.
    """
    block = F.floor(F.col("step") / steps_per_block).alias("_block")
    marks = settle(
        decisions.where("activated").groupBy(*SCENARIO, F.col("first_step").alias("step")).agg(
            F.count_if(~F.col("contaminated")).alias("valid"), F.count_if("contaminated").alias("violated")),
        "marks").select("*", block)
    steps = facts.select(*SCENARIO, "step", block)
    nothing = [F.lit(0).cast("long").alias("valid"), F.lit(0).cast("long").alias("violated")]

    blocks = [*SCENARIO, "_block"]
    before = Window.partitionBy(*SCENARIO).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        steps.where("_block > 0").select(*blocks).distinct().select(*blocks, *nothing)
        .unionByName(marks.select(*blocks, "valid", "violated"))
        .groupBy(*blocks).agg(F.sum("valid").alias("valid"), F.sum("violated").alias("violated"))
        .select(*blocks, F.sum("valid").over(before).alias("_valid"), F.sum("violated").over(before).alias("_violated"))
        .where("_block > 0")
    )

    ordered = Window.partitionBy(*blocks).orderBy("step")
    upto = ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    at = ordered.rangeBetween(Window.currentRow, Window.currentRow)
    summed = (
        steps.select("*", *nothing, F.lit(True).alias("_shown"))
        .unionByName(marks.withColumn("_shown", F.lit(False)))
        .select(*blocks, "step", "_shown", F.sum("valid").over(upto).alias("valid"),
                F.sum("violated").over(upto).alias("violated"), F.sum("violated").over(at).alias("new"))
        .where("_shown")
    )
    carried = lambda own, offset: (F.col(own) + F.coalesce(offset, F.lit(0))).cast("int")
    return _beside(summed, offsets, blocks).select(
        *SCENARIO, "step",
        carried("valid", "_valid").alias("n_validated"),
        carried("violated", "_violated").alias("n_violations"),
        F.col("new").cast("int").alias("n_new_violations"),
    )


def activation_trace(activations: DataFrame, decisions: DataFrame, links: DataFrame) -> DataFrame:
    """Per activation the preconditions not validated by the end of its step (the displayed set).

    This uses the validated set after the step, so it can differ from the missing set of a violation.
    Every active state gets, once per scenario, the steps at which its preconditions were validated; an
    activation looks only at those of its own state.
    """
    state = [*SCENARIO, "state_id"]
    active = settle(decisions.where("activated").select(*state, "first_step", "contaminated"), "active")
    needed = active.join(links.select("norm_id", "state_id", "pres"), ["norm_id", "state_id"]).select(
        *state, F.explode("pres").alias("pre"))
    valid = active.where("NOT contaminated").select(*SCENARIO, F.col("state_id").alias("pre"), F.col("first_step").alias("since"))
    waits = _beside(needed, valid, [*SCENARIO, "pre"]).groupBy(*state).agg(
        F.collect_list(F.struct("pre", "since")).alias("waits"))
    late = F.filter("waits", lambda w: w["since"].isNull() | (w["since"] > F.col("step")))
    missing = F.array_sort(F.transform(late, lambda w: w["pre"]))
    return _beside(activations, waits, state).select(
        *SCENARIO, "step", "u_pos", "state_id", F.coalesce(missing, F.array().cast(NO_STRINGS)).alias("missing_after_step"))


def coverage(facts: DataFrame, activations: DataFrame) -> DataFrame:
    """Facts per scenario, and facts that activate at least one state."""
    active = activations.select(*SCENARIO, "step").distinct().groupBy(*SCENARIO).agg(F.count("*").alias("n_active"))
    return (
        facts.groupBy(*SCENARIO).agg(F.count("*").alias("n_facts"))
        .join(active, SCENARIO, "left")
        .select(*SCENARIO, "n_facts", F.coalesce("n_active", F.lit(0)).alias("n_active"))
    )
