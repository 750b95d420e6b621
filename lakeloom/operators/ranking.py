"""Ranks and prefix sums over a whole table without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.plans.runtime import cut

#: Bytes of a side table, by its rows' estimated width, that may be broadcast.
BROADCAST_BYTES = 16 << 20


def bounded(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """A checkpointed side table, hinted for broadcast if its rows are few enough for their estimated width; else joined by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def dealt(df: DataFrame, keys: list[Column]) -> DataFrame:
    """df in order of keys over many tasks, with ``_task`` and ``_at``, which rises by one from row to row of a task."""
    placed = cut(cut(df).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    return placed.withColumn("_task", F.shiftright("_at", 33))


def ranked(df: DataFrame, order: list[str], group: str | list[str] | None = None, into: str = "rank") -> DataFrame:
    """df with the rank of each row, from 0, by ``order`` (nulls last) within its group, null being a group.

    Rows are dealt out by range, so a hot group spreads over many tasks; each task numbers its own rows, and a prefix
    sum over one count per task and group gives the rest. Rows that tie on all of ``order`` rank in any order.
    """
    groups = [group] if isinstance(group, str) else list(group or [])
    placed = dealt(df, [F.col(c).asc_nulls_last() for c in groups + order])
    by = ["_task", *groups]
    counts = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy(*groups).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    base = cut(counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    side = bounded(base.withColumnsRenamed({c: f"_s{c}" for c in by}), 256)
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_s{c}"))
    return placed.join(side, match).withColumn(into, (F.col("_base") + F.col("_at") - F.col("_first")).cast("long")).select(*df.columns, into)


def running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with sums of columns over all rows before each row by ``order`` (nulls last); ``sums`` names new column -> summed one.

    Each task sums its own rows; what stands before a task comes from one row of totals per task.
    """
    placed = dealt(df, [F.col(c).asc_nulls_last() for c in order])
    before = W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy("_task").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums.values())])
    base = totals.select(F.col("_task").alias("_of"), *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))])
    here = W.partitionBy("_task").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    # One row a task of the shuffle: small by its nature.
    joined = placed.join(F.broadcast(base), F.col("_task") == F.col("_of"))
    return joined.select(*df.columns, *[(F.col(f"_b{i}") + F.coalesce(F.sum(c).over(here), F.lit(0))).alias(name) for i, (name, c) in enumerate(sums.items())])
