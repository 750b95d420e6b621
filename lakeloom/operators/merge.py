"""Keyed changes of stored relations: insert, upsert, update, delete, cursors, and retention.

Relations are immutable; every change returns the new relation. The key is (scope, item_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.plans.runtime import col
from lakeloom.schema import PAYLOAD

KEY = ["scope", "item_id"]


def insert_or_ignore(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """stored and the rows of batch with new keys; of equal keys in the batch one stays, the least by its payload."""
    first = W.partitionBy(*KEY).orderBy(*[F.col(c) for c in batch.columns if c not in KEY])
    new = batch.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").join(stored.select(*KEY), KEY, "left_anti")
    return stored.unionByName(new)


def last_of_each(batch: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per key: the last by ``order`` (nulls first), then by the other columns, so that reruns agree."""
    named = list(order or [])
    by = [F.col(c).desc_nulls_last() for c in [*named, *[c for c in batch.columns if c not in KEY and c not in named]]]
    return batch.withColumn("_n", F.row_number().over(W.partitionBy(*KEY).orderBy(*by))).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, batch: DataFrame, order: list[str] | None = None) -> DataFrame:
    """stored with all fields of batch's rows, nulls included, in place of rows with their keys; of equal keys in batch the last by ``order``."""
    return stored.join(batch.select(*KEY), KEY, "left_anti").unionByName(last_of_each(batch, order))


def delete_by_key(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """stored without the given keys."""
    return stored.join(keys.select(*KEY), KEY, "left_anti")


def update_by_key(stored: DataFrame, fresh: DataFrame, order: list[str] | None = None) -> DataFrame:
    """stored with the payload of fresh rows where there is one, of equal keys the last by ``order``; fresh rows with unknown keys are ignored."""
    fresh = last_of_each(fresh, order)
    fields = [c for c in PAYLOAD if c in stored.columns and c in fresh.columns]
    new = fresh.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.struct(*fields).alias("_new"))
    joined = stored.join(new, (F.col("scope") == F.col("_scope")) & (F.col("item_id") == F.col("_item_id")), "left")
    return joined.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in stored.columns])


def advance_cursors(cursors: DataFrame, scanned: DataFrame) -> DataFrame:
    """Cursors moved to the highest id scanned, of every kind of message, and marked synced; they never move back."""
    seen = scanned.groupBy("scope").agg(F.max("item_id").alias("_seen"))
    joined = cursors.join(seen, "scope", "full_outer")
    return joined.select("scope", F.when(F.col("_seen").isNotNull(), 1).otherwise(F.col("is_fully_synced")).cast("int").alias("is_fully_synced"), F.greatest("newest_scanned_id", "_seen").alias("newest_scanned_id"))


def increment(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """Messages beyond their scope's cursor; all of a scope that was never synced."""
    at = cursors.where("is_fully_synced = 1 and newest_scanned_id > 0").select(F.col("scope").alias("_scope"), "newest_scanned_id")
    joined = messages.join(at, F.col("scope") == F.col("_scope"), "left")
    return joined.where(F.col("newest_scanned_id").isNull() | (F.col("item_id") > F.col("newest_scanned_id"))).drop("_scope", "newest_scanned_id")


def newest(names: DataFrame, n: int, name: str = "name", by: list[str] | None = None) -> DataFrame:
    """Rows with ``keep``: whether they are among the n last by name (of each group)."""
    over = W.partitionBy(*(by or [])).orderBy(F.desc(name))
    return names.withColumn("keep", F.row_number().over(over) <= n)


def fingerprint(df: DataFrame) -> DataFrame:
    """Number of rows and an order-free hash of a relation, to tell whether it changed.

    The hash is the sum of the first 60 bits of every row's MD5. Values go in by column name, each with its length, nulls apart, so that
    no other row gives the same bytes.
    """
    values = [col(c).cast("string") for c in sorted(df.columns)]
    row = F.concat(*[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])
    bits = F.conv(F.substring(F.md5(row.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(bits).alias("hash"))
