"""Quality rules [native]: a threshold table compiled into one Spark projection.

Every measure is an expression over the text of its own row, so there is no shuffle, no user function and no state:
words and lines are arrays, repeated 3-word windows are found by sorting (hash, position) pairs, and each rule of the
table compares a ratio of two measures with its bounds.

Edge cases: a null or blank text has no words, zero measures and fails the base rule; rules with a zero denominator
read the ratio as 0; very long texts are sorted, not compared pairwise; repeated rows are judged alike; further
columns, whatever their names, are ignored; an empty table gives an empty result. Windows are compared by 64-bit hashes within their text.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.plans.runtime import col

BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Common function words of English, French, German and Spanish, as fixed values.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with "
    "au aux avec ce dans de des du elle en est et il je la le les leur mais ne nous ou par pas pour que qui se ses son sur un une vous "
    "als am auch auf aus bei bin bis das dass dem den der die ein eine einem einen einer es für hat ich im ist mit nach nicht noch nur oder sich sie sind so und um von vor war wie wir zu zum zur "
    "al como con del el ella ellos entre era esta este la las lo los más muy no nos para pero por se sin su sus también todo y ya"
).split()


class Rule(NamedTuple):
    """``least <= numerator / denominator <= most``; a None bound is open, no denominator means 1."""

    name: str
    numerator: str
    denominator: str | None
    least: float | None
    most: float | None


#: The threshold table.
RULES = (
    Rule("length", "n_words", None, 50, 200_000),
    Rule("word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.3),
    Rule("repetition", "n_repeat_words", "n_words", None, 0.5),
)


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression over the measures: all rules hold."""
    verdict = F.lit(True)
    for r in rules:
        per = F.lit(1.0) if r.denominator is None else F.col(r.denominator).cast("double")
        value = F.col(r.numerator).cast("double")
        if r.least is not None:
            verdict = verdict & (value >= F.lit(float(r.least)) * per)
        if r.most is not None:
            verdict = verdict & (value <= F.lit(float(r.most)) * per)
    return verdict


def measures(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts that the rules use."""
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    long = lambda x: x.cast("long")
    body = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("_text"))
    parts = body.select(
        "doc_id",
        "_text",
        F.filter(F.split("_text", BLANK + "+"), lambda w: w != "").alias("_words"),
        F.filter(F.split("_text", "\n"), has_word).alias("_lines"),
    )
    hashed = parts.select(
        "doc_id",
        "_lines",
        long(F.size("_words")).alias("n_words"),
        long(F.length("_text") - F.length(F.translate("_text", " \t\n\x0b\x0c\r", ""))).alias("_blanks"),
        long(F.length("_text")).alias("_chars"),
        long(F.regexp_count("_text", F.lit(SYMBOLS))).alias("n_symbols"),
        long(F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS)))).alias("n_stop_words"),
        F.transform(F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))).alias("_grams"),
    )
    placed = hashed.withColumn(
        "_sorted",
        F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
        .otherwise(F.expr("cast(array() as array<struct<h:bigint,i:int>>)")),
    )
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    repeated = placed.withColumn("_repeated", F.filter("_sorted", lambda x, j: same(x, F.get("_sorted", j - 1)) | same(x, F.get("_sorted", j + 1))))
    return repeated.select(
        "doc_id",
        "n_words",
        (F.col("_chars") - F.col("_blanks")).alias("word_chars"),
        "n_symbols",
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        long(F.size(F.array_distinct(F.flatten(F.transform("_repeated", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))).alias("n_repeat_words"),
        "n_stop_words",
        long(F.size("_lines")).alias("n_lines"),
        long(F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09]*[-*]")))).alias("n_bullet_lines"),
        long(F.size(F.filter("_lines", lambda x: x.rlike(r"\.\.\.[\x20\x09-\x0D]*\z")))).alias("n_ellipsis_lines"),
    )


def judge(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, **columns: str) -> DataFrame:
    """One row per document: the measures, base_failed, and kept."""
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return measures(docs, **columns).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))
