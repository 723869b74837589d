"""The driver tables in the shapes the operators take (events as traces, orders as texts, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normtrace.operators.graph import distinct_edges
from normtrace.plans.normative import Norms, build_norms, norms_from_edges
from normtrace.session import settle, spread
from normtrace.sources.traces import number_steps

# A small acyclic norm over the event states: (state, precondition). Every user belongs to one of
# N_NORMS norms, which all have these rules.
N_NORMS = 4
EVENT_RULES = [
    ("signup:1", "signup:0"), ("view:0", "signup:1"), ("view:1", "view:0"), ("view:2", "view:1"),
    ("click:0", "view:0"), ("click:1", "click:0"), ("click:2", "view:2"), ("purchase:0", "click:1"),
    ("purchase:1", "purchase:0"), ("purchase:2", "click:2"), ("purchase:3", "signup:3"), ("error:0", "view:3"),
]
EVENT_TYPES = ["signup", "view", "click", "purchase", "error"]
EVENT_RANKS = [("signup", 0), ("view", 1), ("click", 2), ("purchase", 3)]
LABEL_STATES = [
    "Country:Accepted", "Country:Rejected", "Country:NotAccepted", "Verification:Failed",
    "Password:NotCreated", "NoColon", "A:B:C", "Account:Created", "Account:CreationFailed",
    "Request:Submitted",
]


def inline_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A literal table as a VALUES relation, whose size Catalyst knows."""
    names = [part.split()[0] for part in schema.split(", ")]
    value = lambda v: str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "\\'") + "'"
    body = ", ".join("(" + ", ".join(map(value, row)) + ")" for row in rows)
    table = spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")
    return table.select(*[F.col(p.split()[0]).cast(p.split()[1]).alias(p.split()[0]) for p in schema.split(", ")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ranks(spark: SparkSession) -> DataFrame:
    return inline_table(spark, "entity string, rank int", EVENT_RANKS)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return spread(table(spark, sf_dir, "events")).select("event_id", "ts", "user_id", "event_type", k.alias("k"))


def _activate(steps: DataFrame, keys: list[str]) -> DataFrame:
    """One or two states per event: by ``k % 4``, and by the next one when ``k % 3 = 0``."""
    state = lambda shift: F.concat_ws(":", "event_type", ((F.col("k") + shift) % 4).cast("string"))
    states = F.when(F.col("k") % 3 == 0, F.array(state(0), state(1))).otherwise(F.array(state(0)))
    return steps.select(*keys, "step", F.posexplode(states).alias("u_pos", "state_id"))


def user_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scenario per user: ``norm_id, scenario_id, step`` and the event."""
    ordered = number_steps(events(spark, sf_dir), ["user_id"], ["ts", "event_id"])
    return ordered.select((F.col("user_id") % N_NORMS).alias("norm_id"), F.col("user_id").alias("scenario_id"),
                          "step", "event_type", "k", "ts")


def user_activations(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None, timed: bool = False) -> DataFrame:
    """Of the given facts, or of those of the events."""
    return _activate(user_facts(spark, sf_dir) if facts is None else facts, ["norm_id", "scenario_id", *(["ts"] if timed else [])])


def event_edges(spark: SparkSession) -> DataFrame:
    rows = [(norm, pre, state) for norm in range(N_NORMS) for state, pre in EVENT_RULES]
    return inline_table(spark, "norm_id bigint, source string, target string", rows)


def event_states(spark: SparkSession) -> DataFrame:
    rows = [(norm, f"{t}:{i}", 4 * n + i)
            for norm in range(N_NORMS) for n, t in enumerate(EVENT_TYPES) for i in range(4)]
    return inline_table(spark, "norm_id bigint, state_id string, u_pos int", rows)


def event_norms(spark: SparkSession) -> Norms:
    """The literal norms."""
    return norms_from_edges(event_states(spark), event_edges(spark))


def declared_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One norm per user: every event declares that one state is a precondition of another."""
    k = F.col("k")
    source = F.concat_ws(":", "event_type", (k % 4).cast("string"))
    types = F.array(*[F.lit(t) for t in EVENT_TYPES])
    target = F.concat_ws(":", F.element_at(types, (F.floor(k / 4) % 5 + 1).cast("int")),
                         (F.floor(k / 20) % 4).cast("string"))
    return events(spark, sf_dir).select(F.col("user_id").alias("norm_id"), source.alias("source"),
                                        target.alias("target"))


def declared_states(edges: DataFrame) -> DataFrame:
    return edges.select("norm_id", F.col("target").alias("state_id")).distinct()


def declared_norms(spark: SparkSession, sf_dir: str) -> Norms:
    edges = settle(distinct_edges(declared_edges(spark, sf_dir)), "declared")
    return build_norms(declared_states(edges), edges, event_ranks(spark))


def daily_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One norm per user, one scenario per user and day."""
    daily = events(spark, sf_dir).withColumn("day", F.date_diff("ts", F.lit("2024-01-01")).cast("long"))
    ordered = number_steps(daily, ["user_id", "day"], ["ts", "event_id"])
    return ordered.select(F.col("user_id").alias("norm_id"), F.col("day").alias("scenario_id"),
                          "step", "event_type", "k", "ts")


def daily_activations(spark: SparkSession, sf_dir: str, timed: bool = False) -> DataFrame:
    return _activate(daily_facts(spark, sf_dir), ["norm_id", "scenario_id", *(["ts"] if timed else [])])


def mean_vector(vectors: DataFrame) -> Column:
    """Mean of the embeddings of a group, element by element, as wide as the widest of the table."""
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    return F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(width)]).alias("vector")


def label_states(vectors: DataFrame, norm_id) -> DataFrame:
    """States as mean vectors per norm and label: one map-side aggregation, no exploded elements."""
    means = mean_vector(vectors)
    names = F.array(*[F.lit(s) for s in LABEL_STATES])
    return vectors.groupBy(norm_id.alias("norm_id"), "label").agg(means).select(
        "norm_id", F.col("label").alias("u_pos"), F.element_at(names, F.col("label") + 1).alias("state_id"), "vector")
