"""Ranked search over names and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import display, normalize as N
from lakeloom.functions.similarity import token_set_ratio, weighted_ratio

CUTOFF, LIMIT = 50.0, 200


def variants() -> Column:
    """The distinct non-empty texts that an item is found by: name and tags, lightly and fully cleaned."""
    name, performer, title = F.col("name"), F.col("performer"), F.col("title")
    texts = [N.clean_for_search(name), N.clean_name(name), N.clean_tags_for_search(performer, title), N.clean_tags(performer, title)]
    return F.filter(F.array_distinct(F.array(*[N.comparable(t) for t in texts])), lambda t: t != "")


def scored(items: DataFrame, query: str, wratio: bool = False) -> DataFrame:
    """Items with the best score of any of their texts."""
    asked = N.comparable(N.clean_for_search(F.lit(query)))
    ratio = weighted_ratio if wratio else token_set_ratio
    listed = items.withColumn("_texts", variants())
    # An item has four texts at most; a missing one scores null, which greatest skips.
    scores = [ratio(asked, F.get("_texts", F.lit(i))) for i in range(4)]
    return listed.withColumn("score", F.greatest(*scores)).drop("_texts")


def search(items: DataFrame, query: str, *, cutoff: float = CUTOFF, limit: int = LIMIT, wratio: bool = False) -> DataFrame:
    """The best items, by score, then scope and id; none for a query without letters or digits, or below the cutoff, or of score 0."""
    if not any(c.isalnum() for c in query):
        return scored(items.limit(0), query, wratio)
    found = scored(items, query, wratio).where((F.col("score") >= cutoff) & (F.col("score") > 0))
    return found.orderBy(F.desc("score"), "scope", "item_id").limit(max(limit, 0))


def listing(hits: DataFrame) -> DataFrame:
    """Hits as the console shows them."""
    return hits.select(
        "scope", "item_id", F.round("score", 6).alias("score"), display.display_title(F.col("name"), F.col("performer"), F.col("title")).alias("shown"),
        display.format_duration(F.col("duration")).alias("length"), display.format_bytes(F.col("size")).alias("bytes"), display.message_link(F.col("scope"), F.col("item_id")).alias("link"),
    )
