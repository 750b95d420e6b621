"""Broken rows, validation and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.merge import delete_by_key, update_by_key
from lakeloom.schema import PAYLOAD


def broken() -> Column:
    """No content id, no text at all, or a size or duration that is null or negative."""
    textless = F.col("name").isNull() & F.col("performer").isNull() & F.col("title").isNull()
    bad = lambda c: F.col(c).isNull() | (F.col(c) < 0)
    return (F.coalesce("content_id", F.lit("")) == "") | textless | bad("size") | bad("duration")


def validate(items: DataFrame, cursors: DataFrame) -> DataFrame:
    """One row per check: its name and the number of rows that fail it."""
    items_row = items.agg(F.count_if(broken()).alias("n")).select(F.lit("broken_rows").alias("check"), "n")
    cursor_row = cursors.agg(F.count_if(F.col("newest_scanned_id") < 0).alias("n")).select(F.lit("negative_cursors").alias("check"), "n")
    keys = items.groupBy("scope", "item_id").count().agg(F.count_if(F.col("count") > 1).alias("n")).select(F.lit("repeated_keys").alias("check"), "n")
    return items_row.unionByName(cursor_row).unionByName(keys)


def missing_tables(required: list[str], present: list[str]) -> list[str]:
    """Tables that ought to be there and are not."""
    return sorted(set(required) - set(present))


def repair_plan(items: DataFrame, refetched: DataFrame) -> DataFrame:
    """Broken rows with what to do: update if found again, delete if gone, leave after an error.

    refetched: scope, item_id, status (ok, missing, error) and the payload.
    """
    again = refetched.select(F.col("scope").alias("_scope"), F.col("item_id").alias("_id"), F.col("status").alias("_status"), F.struct(*PAYLOAD).alias("fresh"))
    joined = items.where(broken()).join(again, (F.col("scope") == F.col("_scope")) & (F.col("item_id") == F.col("_id")), "left")
    found = (F.col("_status") == "ok") & F.col("fresh.content_id").isNotNull()
    step = F.when(F.coalesce(F.col("_status"), F.lit("missing")) == "error", "leave").when(found, "update").otherwise("delete")
    return joined.select("scope", "item_id", step.alias("step"), "fresh")


def repaired(items: DataFrame, plan: DataFrame) -> DataFrame:
    """items after the plan."""
    fresh = plan.where("step = 'update'").select("scope", "item_id", "fresh.*")
    return update_by_key(delete_by_key(items, plan.where("step = 'delete'")), fresh)


def reset_cursors(cursors: DataFrame) -> DataFrame:
    """Cursors with 0 in place of negative ids."""
    return cursors.withColumn("newest_scanned_id", F.when(F.col("newest_scanned_id") < 0, 0).otherwise(F.col("newest_scanned_id")).cast("long"))
