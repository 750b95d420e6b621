"""Connected components of an undirected graph, by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.plans.runtime import cut

#: Pointers that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Rows of a task, where a small graph is packed into few of them.
TASK_ROWS = 200_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows ``(id, component)`` for every vertex of ``edges``; the component is its smallest id.

    Each round points every vertex at its smallest neighbour if that is smaller, doubles the pointers until they
    end, and moves the edges to those ends, so the graph shrinks until no edge is left. Self loops and null ends
    are no edges: a vertex that has nothing else does not appear. Ids may be of any type that orders.
    """
    real = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    live, n = _packed(real.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not n:
        return live.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = None
    while n:
        both = live.select(F.explode(_ends()).alias("e")).select("e.*")
        parent, rows = _packed(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")))
        while True:
            jumped, rows = _packed(_follow(parent, "p", parent, rows, "moved"))
            parent = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        found = parent.select(F.col("u").alias("id"), F.col("p").alias("component")) if found is None else _packed(_follow(found, "component", parent, rows))[0]
        moved = _follow(_follow(live, "a", parent, rows), "b", parent, rows).where("a <> b")
        live, n = _packed(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return found


def _packed(df: DataFrame) -> tuple[DataFrame, int]:
    """df checkpointed, in no more partitions than its rows need, and the number of its rows."""
    kept = cut(df)
    n = kept.count()
    return kept.coalesce(n // TASK_ROWS + 1), n


def _ends() -> Column:
    return F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))


def _follow(df: DataFrame, column: str, parent: DataFrame, rows: int, moved: str | None = None) -> DataFrame:
    """``column`` replaced by what it points at, where it points anywhere; ``moved`` names a column that tells."""
    to = parent.select(F.col("u").alias("_u"), F.col("p").alias("_p")).where("_u <> _p")
    joined = df.join(F.broadcast(to) if rows <= BROADCAST_ROWS else to, F.col(column) == F.col("_u"), "left")
    joined = joined if moved is None else joined.withColumn(moved, F.col("_p").isNotNull())
    return joined.withColumn(column, F.coalesce("_p", column)).drop("_u", "_p")
