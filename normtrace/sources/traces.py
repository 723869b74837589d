"""Event logs as ordered traces: numbering the events of each key, also for very long traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normtrace.session import settle


def number_steps(events: DataFrame, keys: list[str], order_by: list[str], step: str = "step") -> DataFrame:
    """Add the 0-based place of each event within its key.

    The log is sorted by keys and order columns over all partitions, and written once with running
    numbers. A key may stretch over any number of partitions: its place is the running number, less the
    first of its partition, plus its events in the partitions before. No task sees more than its share
    of a hot key, whatever the types of the columns. Nulls come first; null keys are a key like any
    other; ties keep the order in which they were written, decided by the other columns.
    """
    rest = [f.name for f in events.schema.fields if f.name not in (*keys, *order_by) and f.dataType.typeName() not in ("map", "variant")]
    tie = [F.xxhash64(*rest)] if rest else []
    columns = [*map(F.col, keys), *map(F.col, order_by), *tie]
    sorted_ = events.repartitionByRange(*columns).sortWithinPartitions(*columns)
    placed = settle(sorted_.withColumn("_at", F.monotonically_increasing_id()), "placed")

    part = F.shiftright("_at", 33)
    own = [F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]
    runs = placed.groupBy(*own, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*[f"_{i}" for i in range(len(keys))]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    same = part == F.col("_part")
    for i, key in enumerate(keys):
        same &= F.col(key).eqNullSafe(F.col(f"_{i}"))
    return placed.join(shifts, same).select(*events.columns, (F.col("_at") + F.col("_shift")).cast("int").alias(step))
