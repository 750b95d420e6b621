"""Duplicate groups: components of links inside a scope."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.config import FuzzyConfig
from lakeloom.operators.components import connected_components
from lakeloom.operators.pairs import METADATA, content_pairs, exact_edges, star_links
from lakeloom.operators.score import fuzzy_links, fuzzy_stars, fuzzy_ties, linked_chunks
from lakeloom.plans.runtime import cut


def grouped(links: DataFrame) -> DataFrame:
    """(scope, item_id, group_id) of the items that links (scope, a, b) tie together; a group is named by its smallest id."""
    ends = links.select(F.struct("scope", F.col("a").alias("id")).alias("a"), F.struct("scope", F.col("b").alias("id")).alias("b"))
    found = connected_components(ends)
    return found.select(F.col("id.scope").alias("scope"), F.col("id.id").alias("item_id"), F.col("component.id").alias("group_id"))


def exact_groups(items: DataFrame) -> DataFrame:
    """Groups of equal content or equal metadata. Links are stars, so a group of n copies costs n rows, not n squared."""
    return grouped(star_links(items, ["content_id"]).unionByName(star_links(items, list(METADATA))))


def _same_content(items: DataFrame) -> DataFrame:
    """Edges of equal content, as all edges of fuzzy mode look; with ``group_id`` where items have one."""
    none = [F.lit(None).cast("double").alias(c) for c in ("name_score", "duration_score", "size_score")]
    told = [F.lit("uid").alias("reason"), F.lit(1.0).alias("score"), *none, F.lit(0.0).alias("penalty"), F.lit(None).cast("int").alias("text_source")]
    return content_pairs(items, keep=[c for c in items.columns if c == "group_id"]).select("*", *told)


def fuzzy_edges(items: DataFrame, cfg: FuzzyConfig, shown: Callable[[DataFrame], DataFrame] = lambda edges: edges) -> DataFrame:
    """All edges of fuzzy mode: equal content, and scored links; ``shown`` changes what an edge says.

    It sees pairs of chunks, before they spread to thousands of edges that say the same.
    """
    return shown(_same_content(items)).unionByName(fuzzy_links(items, cfg, shown(linked_chunks(items, cfg))))


def fuzzy_groups(items: DataFrame, cfg: FuzzyConfig, links: DataFrame | None = None) -> DataFrame:
    """Groups of fuzzy mode; ``links`` saves computing them again."""
    scored = cut(fuzzy_ties(items, cfg)) if links is None else links
    return grouped(star_links(items.where("content_id <> ''"), ["content_id"]).unionByName(scored.select("scope", "a", "b")))


def groups_with_edges(items: DataFrame, cfg: FuzzyConfig, same: bool = False) -> tuple[DataFrame, DataFrame]:
    """Groups of fuzzy mode, and the scored links inside them with their ``group_id``; with ``same`` the edges of equal content, too.

    Links are found once, as pairs of chunks of equal items. Chunks take their group before they spread to pairs of items, so the pairs,
    as many as the product of their chunks, meet no join.
    """
    linked = linked_chunks(items, cfg)
    groups = cut(fuzzy_groups(items, cfg, fuzzy_stars(items, cfg, linked)))
    named = groups.select(F.col("scope").alias("_scope"), F.col("item_id").alias("_id"), "group_id")
    of = (F.col("scope") == F.col("_scope")) & (F.col("x.first") == F.col("_id"))
    edges = fuzzy_links(items, cfg, cut(linked.join(named, of).drop("_scope", "_id"))).where("a is not null and b is not null")
    return groups, edges.unionByName(_same_content(items.join(groups, ["scope", "item_id"]))) if same else edges


def group_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges with the group that both ends are in; edges that name it already stay as they are."""
    if "group_id" in edges.columns:
        return edges
    a = groups.select("scope", F.col("item_id").alias("a"), F.col("group_id"))
    b = groups.select("scope", F.col("item_id").alias("b"), F.col("group_id").alias("_other"))
    return edges.join(a, ["scope", "a"]).join(b, ["scope", "b"]).where("group_id = _other").drop("_other")


def score_distribution(links: DataFrame) -> DataFrame:
    """Number, least, quartiles and most of the scores."""
    return links.agg(F.count("score").alias("n"), F.min("score").alias("least"), F.percentile("score", 0.25).alias("p25"), F.percentile("score", 0.5).alias("median"), F.percentile("score", 0.75).alias("p75"), F.max("score").alias("most"))
