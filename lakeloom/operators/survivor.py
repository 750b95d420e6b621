"""Which item of a group stays: a cascade of criteria with tolerances."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions.normalize import clean_name, stripped

Cascade = tuple[tuple[str, float], ...]

#: Tags that say nothing: fixed values.
EMPTY_TAGS = ("", "<unknown>", "[unknown]", "unknown", "unknown artist")


def _positive(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c).cast("double"))


def _real(c: str) -> Column:
    return F.coalesce(~F.lower(stripped(F.col(c))).isin(*EMPTY_TAGS), F.lit(False))


def tag_quality() -> Column:
    """One for a real performer, one for a real title that says more than the file name."""
    says_more = _real("title") & (clean_name(F.col("title")) != clean_name(F.col("name")))
    return _real("performer").cast("int") + says_more.cast("int")


#: Criterion -> (value, whether the largest is best). Values are null where unknown.
VALUES: dict[str, tuple[Callable[[], Column], bool]] = {
    "oldest": (lambda: F.col("item_id").cast("double"), False),
    "newest": (lambda: F.col("item_id").cast("double"), True),
    "largest": (lambda: _positive("size"), True),
    "smallest": (lambda: _positive("size"), False),
    "longest": (lambda: _positive("duration"), True),
    "shortest": (lambda: _positive("duration"), False),
    "best_meta": (lambda: tag_quality().cast("double"), True),
    "longest_clean_name": (lambda: F.nullif(F.length(clean_name(F.col("name"))), F.lit(0)).cast("double"), True),
}


def winners(members: DataFrame, cascade: Cascade) -> DataFrame:
    """Group members with ``keep``: the one that the cascade leaves.

    Every level is two window aggregates over one partitioning by group, so the whole cascade is one exchange.
    """
    group = W.partitionBy("scope", "group_id")
    alive = F.lit(True)
    df = members
    for i, (name, tolerance) in enumerate(cascade):
        value, largest = VALUES[name]
        df = df.withColumn(f"_v{i}", value()).withColumn(f"_alive{i}", alive)
        seen = F.when(F.col(f"_alive{i}"), F.col(f"_v{i}"))
        df = df.withColumn(f"_best{i}", (F.max(seen) if largest else F.min(seen)).over(group))
        best = F.col(f"_best{i}")
        near = F.coalesce(F.abs(F.col(f"_v{i}") - best) <= F.abs(best) * F.lit(float(tolerance)), F.lit(False))
        alive = F.col(f"_alive{i}") & (best.isNull() | near)
    first = F.min(F.when(alive, F.col("item_id"))).over(group)
    return df.withColumn("keep", F.coalesce(alive & (F.col("item_id") == first), F.lit(False))).select(*members.columns, "keep")


def keep_order(members: DataFrame, cascade: Cascade) -> DataFrame:
    """Group members with ``keep_rank`` from 0: the winner, then the winner of the rest, and so on.

    With no tolerance this is one sort. A tolerance is relative to the best that is left, so the order is found by repeating the
    cascade inside each group, in one task a group, as often as the group has different values.
    """
    named = [f"_v{i}" for i in range(len(cascade))]
    valued = members.select("*", *[VALUES[n][0]().alias(c) for (n, _), c in zip(cascade, named, strict=True)])
    if all(tolerance == 0 for _, tolerance in cascade):
        order = [F.col(c).desc_nulls_last() if VALUES[n][1] else F.col(c).asc_nulls_last() for (n, _), c in zip(cascade, named, strict=True)]
        rank = F.row_number().over(W.partitionBy("scope", "group_id").orderBy(*order, "item_id")) - 1
        return valued.withColumn("keep_rank", rank).drop(*named)
    levels = [(n, VALUES[n][1], tolerance) for n, tolerance in cascade]
    narrow = valued.select("scope", "group_id", "item_id", *named)
    spark = members.sparkSession
    # So many tasks by name: Spark would pack small rows, which take long to rank, into a few.
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = narrow.repartition(tasks, "scope", "group_id").sortWithinPartitions("scope", "group_id", F.col("item_id").asc_nulls_last())
    schema = T.StructType([members.schema["scope"], T.StructField("item_id", T.LongType()), T.StructField("keep_rank", T.IntegerType())])
    return members.join(sorted_rows.mapInArrow(_ranks(levels), schema), ["scope", "item_id"])


def _ranks(levels: list[tuple[str, bool, float]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ranks of rows in order of scope, group and id, a group at a time."""
    order = group_order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in chain(batches, [None]):
            rows = left if batch is None else pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            if rows is None or not rows.num_rows:
                continue
            # Where groups begin; null is a scope, and a group, of its own.
            new = np.zeros(rows.num_rows, bool)
            for name in ("scope", "group_id"):
                codes = rows.column(name).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            starts = np.concatenate(([0], np.flatnonzero(new)))
            # The last group may go on in the next batch.
            done = rows.num_rows if batch is None else int(starts[-1])
            left = rows.slice(done)
            if not done:
                continue
            columns = [rows.column(f"_v{i}").cast(pa.float64()).fill_null(np.nan).to_numpy() for i in range(len(levels))]
            ranks = np.zeros(done, np.int32)
            ends = [*starts[1:], rows.num_rows]
            for at, upto in zip(starts, ends, strict=True):
                if upto <= done:
                    ranks[at:upto] = order([c[at:upto] for c in columns], levels)
            ready = rows.slice(0, done)
            yield from pa.table({"scope": ready.column("scope"), "item_id": ready.column("item_id"), "keep_rank": pa.array(ranks)}).to_batches()

    return run


def group_order(columns: list[np.ndarray], levels: list[tuple[str, bool, float]]) -> np.ndarray:
    """Ranks of a group's rows, in order of id, by the values of the levels.

    Rows of equal values form a class. As long as no class of the pool runs out, the pool stays the same, so its rows take the next ranks
    in order of id, up to where the first class ends; the cascade is repeated for classes that are left, not for rows. A level by id
    ends the cascade: its best is the first or the last row of the pool.
    """
    n = len(columns[0])
    ranks = np.zeros(n, np.int32)
    # Ids beyond the precision of a double may tie; then, as for repeated ids, later levels matter.
    apart = lambda c: not np.isnan(c).any() and len(np.unique(c)) == n
    by_id = next((i for i, (name, _, tolerance) in enumerate(levels) if name in ("oldest", "newest") and tolerance == 0 and ((name == "oldest" and i == len(levels) - 1) or apart(columns[i]))), None)
    used = range(len(levels) if by_id is None else by_id)
    turned = by_id is not None and levels[by_id][0] == "newest"
    cls = np.zeros(n, np.int64)
    for i in used:
        codes = np.unique(columns[i], return_inverse=True)[1]
        cls = np.unique(cls * (codes.max() + 1) + codes, return_inverse=True)[1]
    first = np.unique(cls, return_index=True)[1]
    values = [columns[i][first] for i in used]
    # Rows of a class in the order in which they are taken.
    rows = np.argsort(cls, kind="stable") if not turned else (n - 1 - np.argsort(cls[::-1], kind="stable"))
    stop = np.cumsum(np.bincount(cls, minlength=len(first)))
    at = np.concatenate(([0], stop[:-1]))
    place = (lambda r: n - 1 - r) if turned else (lambda r: r)
    end = place(rows[stop - 1])
    left = np.arange(len(first))
    taken = 0
    while len(left):
        pool = left
        for k, i in enumerate(used):
            _, largest, tolerance = levels[i]
            here = values[k][pool]
            if len(pool) == 1 or np.isnan(here).all():
                continue
            best = np.nanmax(here) if largest else np.nanmin(here)
            pool = pool[np.abs(here - best) <= abs(best) * tolerance]
        last = end[pool].min()
        upto = [int(at[c] + np.searchsorted(place(rows[at[c] : stop[c]]), last, side="right")) for c in pool]
        out = np.concatenate([rows[at[c] : u] for c, u in zip(pool, upto, strict=True)])
        out = out[np.argsort(place(out))]
        ranks[out] = np.arange(taken, taken + len(out))
        taken += len(out)
        at[pool] = upto
        left = left[at[left] < stop[left]]
    return ranks
