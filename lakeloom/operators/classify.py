"""Verification of groups against a snapshot, the actions that follow, and what protects an item from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.operators.ranking import ranked
from lakeloom.schema import PAYLOAD


def verified(members: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Members with ``status`` (ok, missing, error) and the snapshot's ``fresh`` payload; an unseen item is missing.

    snapshot: scope, item_id, status, and the payload columns (null where the item is no longer of its kind).
    """
    seen = snapshot.select(F.col("scope").alias("_scope"), F.col("item_id").alias("_id"), F.col("status").alias("_status"), F.struct(*PAYLOAD).alias("fresh"))
    joined = members.join(seen, F.col("scope").eqNullSafe(F.col("_scope")) & (F.col("item_id") == F.col("_id")), "left")
    return joined.withColumn("status", F.coalesce("_status", F.lit("missing"))).drop("_scope", "_id", "_status")


def spread_errors(snapshot: DataFrame, chunk: int) -> DataFrame:
    """A snapshot in which an error of one item is an error of its whole chunk of ``chunk`` ids."""
    numbered = batched(snapshot, chunk, "chunk")
    failed = F.max(F.col("status") == "error").over(W.partitionBy("scope", "chunk"))
    return numbered.withColumn("status", F.when(failed, "error").otherwise(F.col("status"))).drop("chunk")


def classified(members: DataFrame) -> DataFrame:
    """Verified members (with group_id, keep_rank) and their ``action``.

    A group with any error is skipped. Of the rest, items that are gone or of another kind are purged, changed ones are
    updated, the first unchanged one by keep_rank is kept, and later unchanged ones are deleted.
    """
    group = W.partitionBy("scope", "group_id")
    unchanged = F.lit(True)
    for c in PAYLOAD:
        unchanged = unchanged & F.col(c).eqNullSafe(F.col(f"fresh.{c}"))
    usable = (F.col("status") == "ok") & F.col("fresh.content_id").isNotNull()
    marked = members.withColumn("_error", F.max(F.col("status") == "error").over(group)).withColumn("_valid", usable & unchanged)
    marked = marked.withColumn("_first", F.min(F.when(F.col("_valid"), F.col("keep_rank"))).over(group))
    action = (
        F.when(F.col("_error"), "skipped")
        .when(~usable, "purge_local")
        .when(~F.col("_valid"), "update_local")
        .when(F.col("keep_rank") == F.col("_first"), "keep")
        .otherwise("delete_remote")
    )
    return marked.withColumn("action", action).drop("_error", "_valid", "_first")


def not_ignored(actions: DataFrame, ignored: DataFrame) -> DataFrame:
    """Actions without deletions of ignored items (scope, item_id); scope ``*`` is every scope."""
    rules = ignored.select(F.col("scope").cast("string").alias("_scope"), F.col("item_id").alias("_id")).distinct()
    same_scope = (F.col("_scope") == "*") | (F.col("_scope") == F.col("scope").cast("string"))
    hit = (F.col("action") == "delete_remote") & (F.col("item_id") == F.col("_id")) & same_scope
    return actions.join(rules, hit, "left_anti")


def protects(rules: list[tuple[str, str]]) -> Column:
    """Whether any pattern of (scope or *, pattern) rules is found in name, performer or title."""
    held = F.lit(False)
    for scope, pattern in rules:
        found = F.lit(False)
        for c in ("name", "performer", "title"):
            found = found | F.coalesce((F.col(c) != "") & F.col(c).rlike("(?Ud)" + pattern), F.lit(False))
        held = held | (found if scope == "*" else found & (F.col("scope").cast("string") == scope))
    return held


def unprotected(actions: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Actions without deletions of items that a rule protects."""
    return actions.where((F.col("action") != "delete_remote") | ~protects(rules))


def batched(rows: DataFrame, size: int, into: str = "batch") -> DataFrame:
    """Rows with a batch number: ``size`` of a scope at a time, by id. A large scope spreads over many tasks."""
    return ranked(rows, ["item_id"], "scope", "_rank").withColumn(into, F.floor(F.col("_rank") / size).cast("long")).drop("_rank")


def archive_gate(batches: DataFrame, archived: DataFrame) -> DataFrame:
    """Rows of batches whose every item was archived: archived has (scope, item_id, ok)."""
    ok = archived.select(F.col("scope").alias("_scope"), F.col("item_id").alias("_id"), F.col("ok").alias("_ok"))
    joined = batches.join(ok, (F.col("scope") == F.col("_scope")) & (F.col("item_id") == F.col("_id")), "left").drop("_scope", "_id")
    return joined.withColumn("_all", F.min(F.coalesce("_ok", F.lit(False))).over(W.partitionBy("scope", "batch"))).where("_all").drop("_ok", "_all")


def confirmed_gone(deleted: DataFrame, still_there: DataFrame) -> DataFrame:
    """Items asked to be deleted that a second look no longer finds."""
    return deleted.join(still_there.select("scope", "item_id"), ["scope", "item_id"], "left_anti")


def planned_changes(actions: DataFrame) -> DataFrame:
    """Number of items of every scope and action, and their first and last ids."""
    return actions.groupBy("scope", "action").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_id"), F.max("item_id").alias("last_id"))
