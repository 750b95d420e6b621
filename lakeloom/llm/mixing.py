"""Mixing sources to target weights by systematic sampling.

A source's target is its weighted share of ``total`` times all words, no more than ``cap`` times its own words; what is cut
off is shared out again by weight. Every document of a source is expected target / size of the source times. Within a source,
documents stand in order of size; expected copies are prefix-summed from one random offset, and a document is emitted
once per integer that its stretch crosses. As neighbours are of like size, the words taken come near the target too.

The offset of a source is a hash of the seed and its name, so reruns agree.

Edge cases: a null text has size 0; a null source is a source, last in order; a source without words has target 0
and takes nothing; very long texts are counted whole and taken as rarely as their size asks; rows that share a doc_id are separate
documents; an empty table has no sources; further columns, whatever their names and types, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.ranking import attach, bounded, ranked, row_hash, running
from lakeloom.plans.runtime import col, cut

WEIGHTS, TOTAL, CAP, SEED = (3, 1, 2), 1.5, 2, 7


def words_of(text: str) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, cap: int = CAP) -> DataFrame:
    """source, source_size, target, from rows (source, size).

    The level that uncapped sources get per weight is where, with sources in order of cap per weight, what the capped ones
    leave over first falls under the next cap.
    """
    named = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), ["source"], into="_rank")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.pmod("_rank", F.lit(len(weights))).cast("int") + 1)
    named = cut(named.withColumn("w", weight).withColumn("most", F.col("source_size") * cap).withColumn("edge", F.col("most") / F.col("w")))
    words, all_weights = named.agg(F.sum("source_size"), F.sum("w")).first()
    if words is None:
        return named.select("source", "source_size", F.lit(0.0).alias("target"))
    rising = running(named, ["edge", "source"], {"capped": "most", "closed": "w"})
    level = rising.withColumn("level", (F.lit(words * float(total)) - F.col("capped")) / (F.lit(all_weights) - F.col("closed")))
    least = level.where("level <= edge").agg(F.min(F.struct("edge", "level")).alias("at")).first().at
    chosen = F.lit(float("inf") if least is None else least.level)
    return named.select("source", "source_size", F.least(chosen * F.col("w"), F.col("most").cast("double")).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """Between 0 and 1, from a hash of seed and source."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, cap: int = CAP, seed: int = SEED, whole_row: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies (and a hash of the row)."""
    hashed = [row_hash(docs).alias("_hash")] if whole_row else []
    narrow = cut(docs.select(col(doc_id).alias("doc_id"), col(source).alias("source"), words_of(text).alias("size"), *hashed))
    goals = bounded(cut(targets(narrow, weights, total, cap)).withColumnRenamed("source", "_source"), 256)
    placed = ranked(narrow, ["size", "doc_id", *(["_hash"] if whole_row else [])], "source")
    joined = placed.join(goals, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    crossed = F.floor(u + (F.col("rank") + 1) * each) - F.floor(u + F.col("rank") * each)
    return joined.withColumn("copies", F.least(crossed, F.lit(cap)).cast("long")).drop("rank")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", **options: object) -> DataFrame:
    """docs, each row as often as the mix takes it."""
    made = copies(docs, doc_id=doc_id, whole_row=True, **options).select(F.col("doc_id").alias("_doc"), "_hash", "copies")
    both = attach(docs, made, doc_id, ["copies"], ["copies"])
    return both.where("copies > 0").select("d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("d.*")
