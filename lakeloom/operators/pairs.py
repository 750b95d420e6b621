"""Candidate pairs: equal content, equal metadata, and neighbouring durations.

Pairs never cross a scope; ``a < b`` by item id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.operators.ranking import bounded, ranked
from lakeloom.plans.runtime import col, cut, many_tasks
from lakeloom.schema import PAYLOAD

#: Ids in a row of equal items, about; ids of one metadata in a piece that meets the others.
CHUNK, PIECE = 128, 1024

METADATA = tuple(c for c in PAYLOAD if c != "content_id")


def content_pairs(items: DataFrame, falsy: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Pairs of equal content id, with columns ``keep`` of the first; ids that are null or empty link only if ``falsy``."""
    keyed = items.select("scope", "item_id", F.col("content_id"), *keep)
    rows = keyed if falsy else keyed.where("content_id <> ''")
    a, b = rows.alias("a"), rows.select("scope", "item_id", "content_id").alias("b")
    on = F.col("a.scope").eqNullSafe(F.col("b.scope")) & F.col("a.content_id").eqNullSafe(F.col("b.content_id")) & (F.col("a.item_id") < F.col("b.item_id"))
    return a.join(b, on).select(F.col("a.scope").alias("scope"), F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), *[F.col(f"a.{c}").alias(c) for c in keep])


def metadata_pairs(items: DataFrame) -> DataFrame:
    """Pairs that agree on name, size, duration, performer and title, null being a value.

    Items of one metadata lie in pieces of about ``PIECE`` ids. A piece makes its own pairs; each two pieces of a metadata, which is
    a number by then, meet in one row, and such rows are dealt evenly, so no task has all pairs of a common metadata.
    """
    by = ["scope", *METADATA]
    equal = F.xxhash64(*by)
    counted = items.select(equal.alias("_equal")).groupBy("_equal").agg(F.count(F.lit(1)).alias("_n"))
    many = cut(counted.where(F.col("_n") > PIECE).select("_equal", F.ceil(F.col("_n") / PIECE).alias("_parts")))
    rows = items.select("item_id", *by, F.lit(0).cast("long").alias("_part"))
    if not many.isEmpty():
        rows = rows.join(bounded(many), equal == F.col("_equal"), "left").withColumn("_part", F.pmod(F.xxhash64("item_id"), F.coalesce("_parts", F.lit(1)))).select("item_id", *by, "_part")
    pieces = cut(rows.groupBy(*by, "_part").agg(F.collect_list("item_id").alias("ids")))
    tasks = many_tasks(items.sparkSession)
    met = pieces.where(F.size("ids") > 1).select("scope", "ids", F.col("ids").alias("others"), F.lit(True).alias("same"))
    if not many.isEmpty():
        hot = pieces.withColumn("_equal", equal).join(bounded(many), "_equal")
        groups = cut(hot.select(*by, "_parts").distinct().withColumn("_group", F.monotonically_increasing_id()))
        on = F.lit(True)
        for c in by:
            on = on & F.col(f"h.{c}").eqNullSafe(F.col(f"g.{c}"))
        placed = cut(hot.drop("_parts").alias("h").join(bounded(groups, 1024).alias("g"), on).select("h.scope", "h.ids", "h._part", "g._group", "g._parts"))
        first = placed.where("_part + 1 < _parts").select("scope", "ids", "_group", F.explode(F.sequence(F.col("_part") + 1, F.col("_parts") - 1)).alias("_other"))
        second = placed.select(F.col("_group").alias("_g"), F.col("_part").alias("_p"), F.col("ids").alias("others"))
        met = met.unionByName(first.join(second, (F.col("_group") == F.col("_g")) & (F.col("_other") == F.col("_p"))).select("scope", "ids", "others", F.lit(False).alias("same")))
    each = met.repartition(tasks).select("scope", "others", "same", F.explode("ids").alias("i")).select("scope", "same", "i", F.explode("others").alias("j"))
    return each.where(~F.col("same") | (F.col("i") < F.col("j"))).select("scope", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def exact_edges(items: DataFrame) -> DataFrame:
    """Edges of exact mode: equal content or equal metadata, content being the reason where both hold."""
    both = content_pairs(items, falsy=True).withColumn("rank", F.lit(0)).unionByName(metadata_pairs(items).withColumn("rank", F.lit(1)))
    return both.groupBy("scope", "a", "b").agg(F.when(F.min("rank") == 0, "uid").otherwise("meta").alias("reason"), F.lit(1.0).alias("score"))


def star_links(items: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Links (scope, a, b) of every row to the smallest id of its group: as many as rows, however large the group."""
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    rows = items.select("scope", "item_id", *[k.alias(f"_k{i}") for i, k in enumerate(named)])
    by = ["scope", *[f"_k{i}" for i in range(len(named))]]
    first = rows.groupBy(*by).agg(F.min("item_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    f, r = first.alias("f"), rows.alias("r")
    on = F.col("f.a") < F.col("r.item_id")
    for c in by:
        on = on & F.col(f"f.{c}").eqNullSafe(F.col(f"r.{c}"))
    return r.join(f, on).select(F.col("r.scope").alias("scope"), F.col("f.a").alias("a"), F.col("r.item_id").alias("b"))


def chunked(rows: DataFrame, item_id: str = "item_id") -> DataFrame:
    """Rows that differ in their id only as one: the other columns, ``ids``, and the ``first`` and ``last`` of them.

    A row holds about ``CHUNK`` ids at most, so a large group of equal items makes several rows; items without an id stand apart.
    """
    by = [c for c in rows.columns if c != item_id]
    # Counted by a hash: groups that share one are only dealt over more rows.
    equal = F.xxhash64(*[col(c) for c in by])
    many = cut(rows.select(equal.alias("_equal")).groupBy("_equal").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CHUNK).select("_equal", F.ceil(F.col("_n") / CHUNK).alias("_parts")))
    dealt = rows.withColumn("_part", F.lit(0).cast("long"))
    if not many.isEmpty():
        dealt = rows.join(bounded(many), equal == F.col("_equal"), "left").withColumn("_part", F.pmod(F.xxhash64(item_id), F.coalesce("_parts", F.lit(1)))).drop("_equal", "_parts")
    none = F.array_repeat(F.min(item_id), F.count(F.lit(1)).cast("int"))
    ids = F.when(F.count(item_id) == 0, none).otherwise(F.collect_list(item_id))
    made = dealt.groupBy(*[col(c) for c in by], F.col(item_id).isNull().alias("_none"), "_part").agg(ids.alias("ids"), F.min(item_id).alias("first"), F.max(item_id).alias("last"))
    return made.drop("_none", "_part")


def spread(pairs: DataFrame, *columns: str, key: str = "duration") -> DataFrame:
    """The pairs of ids that pairs of chunks (x, y) stand for: first, second and columns."""
    of = lambda s: F.coalesce(F.col(f"{s}.{key}"), F.lit(0))
    each = pairs.select(*columns, (of("x") < of("y")).alias("_apart"), F.col("y.ids").alias("_ids"), F.explode("x.ids").alias("first"))
    each = each.select(*columns, "_apart", "first", F.explode("_ids").alias("second"))
    return each.where(F.col("_apart") | (F.col("first") < F.col("second"))).select("first", "second", *columns)


def band_pairs(items: DataFrame, width: int) -> DataFrame:
    """How many pairs ``band_self_join`` makes, as one row (candidates), from a row per duration."""
    rows = items.select("scope", "item_id", F.coalesce("duration", F.lit(0)).cast("long").alias("d"))
    one = rows.groupBy("scope", "d", "item_id").agg(F.count(F.lit(1)).alias("m")).groupBy("scope", "d")
    counted = one.agg(F.sum("m").alias("n"), F.sum(F.when(F.col("item_id").isNotNull(), F.col("m"))).alias("named"), F.sum(F.when(F.col("item_id").isNotNull(), F.col("m") * F.col("m"))).alias("same"))
    later = F.coalesce(F.sum("n").over(W.partitionBy("scope").orderBy("d").rangeBetween(1, width)), F.lit(0)) if width > 0 else F.lit(0)
    inside = F.coalesce(F.expr("(named * named - same) div 2"), F.lit(0))
    return counted.select((F.col("n") * later + inside).alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("candidates"))


def band_self_join(rows: DataFrame, width: int, key: str = "duration", scope: str = "scope", item_id: str = "item_id", last: str | None = None) -> DataFrame:
    """Pairs (x, y) of row structs whose keys differ by ``width`` at most, null being 0; x comes first by (key, id).

    Keys fall into bins as wide as the band, so a partner stands in the same bin or the next: x goes to both, and the
    range predicate filters an equi-join. Chunks of ids have their ``first`` as item_id, and ``last``.
    """
    w = max(width, 1)
    value = F.coalesce(F.col(key), F.lit(0))
    based = rows.withColumn("_key", value).withColumn("_bin", F.floor(value / w))
    columns = [F.col(c) for c in rows.columns]
    tasks = many_tasks(rows.sparkSession)
    # Without a scope is a scope, by equalities that the tasks are dealt by.
    named = lambda side: [F.coalesce(F.col(scope).cast("string"), F.lit("")).alias(f"_{side}scope"), F.col(scope).isNull().alias(f"_{side}none")]
    left = based.select(*named(""), F.explode(F.array(F.col("_bin"), F.col("_bin") + 1)).alias("_bin"), F.col("_key").alias("_xk"), F.struct(*columns).alias("x")).repartition(tasks, "_scope", "_none", "_bin")
    right = based.select(*named("r"), F.col("_bin").alias("_rbin"), F.col("_key").alias("_yk"), F.struct(*columns).alias("y")).repartition(tasks, "_rscope", "_rnone", "_rbin")
    on = (F.col("_scope") == F.col("_rscope")) & (F.col("_none") == F.col("_rnone")) & (F.col("_bin") == F.col("_rbin")) & F.col("_yk").between(F.col("_xk"), F.col("_xk") + width)
    on = on & ((F.col("_xk") < F.col("_yk")) | (F.col(f"x.{item_id}") < F.col(f"y.{last or item_id}")))
    return left.join(right, on).select("x", "y")


def window_counts(items: DataFrame, width: int) -> DataFrame:
    """How many candidates of a later place each item has in its band.

    Items of one duration are ranked over many tasks; the window runs over one row per duration.
    """
    by = W.partitionBy("scope").orderBy("d").rangeBetween(0, width)
    rows = items.select("scope", "item_id", F.coalesce("duration", F.lit(0)).cast("long").alias("d"))
    in_band = rows.groupBy("scope", "d").agg(F.count(F.lit(1)).alias("n")).select(F.col("scope").alias("_scope"), F.col("d").alias("_d"), F.sum("n").over(by).alias("_near"))
    placed = ranked(rows, ["item_id"], ["scope", "d"]).join(in_band, F.col("scope").eqNullSafe(F.col("_scope")) & (F.col("d") == F.col("_d")))
    return placed.select("scope", "item_id", (F.col("_near") - F.col("rank") - 1).alias("candidates"))
