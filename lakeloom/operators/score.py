"""The weighted score of a candidate pair: text, duration and size, less a penalty for unlike numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.config import FuzzyConfig
from lakeloom.functions import normalize as N
from lakeloom.functions.similarity import SCORERS, SCORERS_FROM
from lakeloom.operators.candidates import hopeful_pairs, with_sketches
from lakeloom.operators.pairs import band_self_join, chunked, spread
from lakeloom.operators.ranking import bounded
from lakeloom.plans.runtime import cut, many_tasks
from lakeloom.schema import ITEMS

#: The texts compared, in the order that settles ties: of the first item, of the second.
SOURCES = (("name", "name"), ("name", "tags"), ("tags", "name"), ("tags", "tags"))


def prepared(items: DataFrame, cfg: FuzzyConfig) -> DataFrame:
    """Items, or chunks of them, with comparable texts and their numbers, computed once before any join."""
    cleaned = items.withColumn("_n", N.clean_name(F.col("name"), staged=True)).withColumn("_t", N.clean_tags(F.col("performer"), F.col("title"), staged=True) if cfg.use_meta_fuzzy else F.lit(""))
    return cleaned.select(
        "scope", *[c for c in ("item_id", "ids", "first", "last") if c in items.columns], "content_id", F.coalesce("duration", F.lit(0)).alias("duration"), F.coalesce("size", F.lit(0)).alias("size"),
        N.comparable(F.col("_n")).alias("name_text"), N.comparable(F.col("_t")).alias("tags_text"), N.number_tokens(F.col("_n")).alias("name_numbers"), N.number_tokens(F.col("_t")).alias("tags_numbers"),
    )


def closeness(a: Column, b: Column, power: float) -> Column:
    """(smaller / larger) ** power of two known values, else 0."""
    return F.when((a > 0) & (b > 0), F.pow(F.least(a, b) / F.greatest(a, b), F.lit(float(power)))).otherwise(F.lit(0.0))


def threshold(x: Column, y: Column, cfg: FuzzyConfig) -> Column:
    """The threshold, lowered by the share of every criterion that is unknown on either side."""
    known = lambda c: (x[c] > 0) & (y[c] > 0)
    t = F.lit(cfg.threshold)
    t = F.when(known("duration"), t).otherwise(t - cfg.threshold * cfg.weight_duration)
    return F.when(known("size"), t).otherwise(t - cfg.threshold * cfg.weight_size)


def number_penalty(a: Column, b: Column, weight: float, jaccard: bool) -> Column:
    """Nothing for equal sets of numbers; else the weight, or its share of numbers not in common."""
    common, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    part = F.lit(weight) * (F.lit(1.0) - common / F.greatest(either, F.lit(1))) if jaccard else F.lit(weight)
    return F.when(common == either, F.lit(0.0)).otherwise(part)


def numeric_scores(pairs: DataFrame, cfg: FuzzyConfig) -> DataFrame:
    """Pairs (x, y) with duration_score, size_score and threshold."""
    x, y = F.col("x"), F.col("y")
    return pairs.select("x", "y", closeness(x["duration"], y["duration"], cfg.duration_power).alias("duration_score"), closeness(x["size"], y["size"], cfg.size_power).alias("size_score"), threshold(x, y, cfg).alias("threshold"))


def best_text(pairs: DataFrame, cfg: FuzzyConfig, others: Column | None = None) -> DataFrame:
    """Pairs with ``text``: the source that does best after its penalty (score, source, ratio, penalty).

    With ``others``, the score of all but the text, sources that cannot lift a pair to its threshold are left out, most of them
    without comparing their texts: letters in any order bound what they have in common.
    """
    x, y = F.col("x"), F.col("y")
    penalties = [number_penalty(x[f"{i}_numbers"], y[f"{j}_numbers"], cfg.penalty_numbers_mismatch, cfg.use_jaccard_penalty) for i, j in SOURCES]
    staged = pairs.select("*", F.array(*penalties).alias("_p"))

    def ratio(k: int) -> Column:
        i, j = SOURCES[k]
        a, b = x[f"{i}_text"], y[f"{j}_text"]
        # Texts that are not there need no comparison.
        a, b = (F.when(t != "", t) if kind == "tags" else t for t, kind in ((a, i), (b, j)))
        if others is None or cfg.weight_name <= 0:
            return SCORERS[cfg.matching_mode](a, b)
        share = F.greatest((F.col("threshold") - others + F.col("_p")[k]) / cfg.weight_name, F.lit(0.0))
        return SCORERS_FROM[cfg.matching_mode](a, b, F.pow(share, F.lit(1 / cfg.name_power)) * 100 if cfg.name_power > 0 else F.lit(0.0))

    with_ratios = staged.select("*", *[ratio(k).alias(f"_r{k}") for k in range(len(SOURCES))])

    def of(k: int) -> Column:
        powered = F.pow(F.col(f"_r{k}") / 100, F.lit(float(cfg.name_power)))
        compared = F.struct((cfg.weight_name * powered - F.col("_p")[k]).alias("score"), F.lit(-k).alias("order"), powered.alias("ratio"), F.col("_p")[k].alias("penalty"))
        return F.when(F.col(f"_r{k}").isNotNull(), compared)

    ranked = with_ratios.withColumn("text", F.array_max(F.array(*[of(k) for k in range(len(SOURCES))])))
    return ranked.drop("_p", *[f"_r{k}" for k in range(len(SOURCES))])


def chunk_pairs(items: DataFrame, cfg: FuzzyConfig) -> DataFrame:
    """Pairs (x, y) of chunks of equal items in the duration band, with duration_score, size_score and threshold."""
    return numeric_scores(band_self_join(cut(prepared(chunked(items.select(*ITEMS.names)), cfg)), cfg.max_duration_diff_sec, item_id="first", last="last"), cfg)


def _numbered_chunks(items: DataFrame, cfg: FuzzyConfig) -> DataFrame:
    """Chunks of equal items with their texts, named by ``chunk``."""
    return cut(prepared(chunked(items.select(*ITEMS.names)), cfg).withColumn("chunk", F.monotonically_increasing_id()))


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col("chunk").alias(f"_{name}"), F.struct("*").alias(name))


def _scored_chunks(few: DataFrame, chunks: DataFrame, cfg: FuzzyConfig) -> DataFrame:
    """Of pairs (_x, _y) of chunks those that link, with what a link says."""
    x, y = F.col("x"), F.col("y")
    texts = chunks.drop("ids")
    pairs = numeric_scores(few.join(_side(texts, "x"), "_x").join(_side(texts, "y"), "_y").select("x", "y"), cfg)
    apart = ~((x["content_id"] == y["content_id"]) & (x["content_id"] != ""))
    others = cfg.weight_duration * F.col("duration_score") + cfg.weight_size * F.col("size_score")
    # A perfect text is the most a pair can add: those that would fall short even then are not compared.
    hopeful = pairs.where(F.coalesce(apart, F.lit(True)) & (F.lit(cfg.weight_name) + others >= F.col("threshold")))
    score = cfg.weight_name * F.col("text.ratio") + others - F.col("text.penalty")
    linked = best_text(hopeful, cfg, others).withColumn("score", score).where(F.col("score") >= F.col("threshold"))
    return cut(linked.select(
        x["chunk"].alias("_x"), y["chunk"].alias("_y"), x["scope"].alias("scope"), F.lit("fuzzy").alias("reason"), "score", F.col("text.ratio").alias("name_score"), "duration_score", "size_score",
        F.col("text.penalty").alias("penalty"), (-F.col("text.order")).cast("int").alias("text_source"),
    ))


def linked_chunks(items: DataFrame, cfg: FuzzyConfig) -> DataFrame:
    """Pairs of chunks of equal items that reach their threshold and do not share content already, computed once.

    Whatever is compared is the same for all items of a chunk, so it is compared once. Pairs are found where the rows of a band meet, so only
    those that link meet their texts again, and their ids.
    """
    chunks = _numbered_chunks(items, cfg)
    found = _scored_chunks(cut(hopeful_pairs(with_sketches(chunks, cfg.matching_mode), cfg)), chunks, cfg)
    ids = chunks.select("chunk", "ids", "first", "last", "duration")
    both = found.join(_side(ids, "x"), "_x").join(_side(ids, "y"), "_y").select("x", "y", *[c for c in found.columns if c not in ("_x", "_y")])
    # A pair of chunks spreads to thousands of rows, so they are dealt evenly.
    return cut(both.repartition(many_tasks(items.sparkSession)))


#: What a scored link says beside its ends.
SCORED = ("reason", "score", "name_score", "duration_score", "size_score", "penalty", "text_source")


def fuzzy_links(items: DataFrame, cfg: FuzzyConfig, linked: DataFrame | None = None) -> DataFrame:
    """Links of pairs in the duration band that reach their threshold and do not share content already; ``linked`` saves finding their chunks again."""
    found = linked_chunks(items, cfg) if linked is None else linked
    rest = ["scope", *SCORED, *(c for c in found.columns if c == "group_id")]
    each = spread(found, *rest)
    return each.select("scope", F.least("first", "second").alias("a"), F.greatest("first", "second").alias("b"), *rest[1:])


def fuzzy_ties(items: DataFrame, cfg: FuzzyConfig) -> DataFrame:
    """Links (scope, a, b) that tie together what ``fuzzy_links`` and equal content do; pairs that are tied already are not compared.

    All items of two linked chunks tie, whichever ids they have: of equal durations each two ids make a pair in one order, of others in any.
    """
    chunks = _numbered_chunks(items.where("item_id is not null"), cfg)
    few = cut(hopeful_pairs(with_sketches(chunks, cfg.matching_mode), cfg, tied=True))
    ties, doubtful = few.where("sure").select("_x", "_y"), few.where("not sure").select("_x", "_y")
    if not doubtful.isEmpty():
        ends = cut(doubtful.select(F.explode(F.array("_x", "_y")).alias("chunk")).distinct())
        ties = ties.unionByName(_scored_chunks(doubtful, cut(chunks.join(bounded(ends), "chunk")), cfg).select("_x", "_y"))
    ids = chunks.select("chunk", "scope", "ids", "first")
    pairs = ties.join(_side(ids, "x"), "_x").join(_side(ids.drop("scope"), "y"), "_y")
    return pairs.select("x.scope", F.col("x.first").alias("a"), F.explode(F.concat("x.ids", "y.ids")).alias("b")).where("a <> b")


def fuzzy_stars(items: DataFrame, cfg: FuzzyConfig, linked: DataFrame | None = None) -> DataFrame:
    """Links (scope, a, b) that tie together what ``fuzzy_links`` does: as many as two linked chunks have items, not their product.

    Of items of one duration only those link where x has the smaller id: each x that has one links with the last y, and each y with the first x.
    """
    x, y = F.col("x"), F.col("y")
    star = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    ends = F.concat(F.transform(x["ids"], lambda i: star(i, y["last"])), F.transform(y["ids"], lambda i: star(x["first"], i)))
    apart = x["duration"] < y["duration"]
    found = linked_chunks(items, cfg) if linked is None else linked
    each = found.select("scope", apart.alias("_apart"), F.explode(ends).alias("e"))
    return each.where(F.col("_apart") | (F.col("e.a") < F.col("e.b"))).select("scope", "e.a", "e.b")
