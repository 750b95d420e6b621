"""Language identification by rank-order profiles.

A profile is the most frequent 1- to 3-grams of letters, in order. Words are padded with a blank on both sides, letters are
lower-cased, everything else is a blank. A document's profile is compared with each language's by out-of-place
distance: each of its n-grams costs the difference of its ranks, or the profile's length where the language lacks it.
The nearest language wins; its score is one minus the share of the largest possible distance.

Profiles are learned from all labelled rows. Whole texts are used for learning and for prediction. ``accept`` keeps what reads like a
learned language: the least score is learned from all those rows, too, by the size of a document's profile, from texts and the same texts
with their letters in random order, as short texts score higher by chance.

Edge cases: an empty table gives an empty result; very long texts are counted whole; a null text and one without letters are ``und`` with score 0, and so is every text if nothing was learned; rows
without a language or doc_id teach nothing; a row without doc_id counts as held out; equal counts are ordered by
n-gram, equal distances by language; repeated rows are predicted alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.textcore import map_batches, texts
from lakeloom.llm.ranking import bounded
from lakeloom.plans.runtime import col, cut, free_name

LENGTH, FOLDS = 300, 5
#: Rows of each language that teach: all.
SAMPLE: int | None = None
#: N-grams of a language that a task counts at once.
GRAMS = 1 << 20
#: How far the least score lies from that of shuffled texts to that of real ones.
MARGIN = 0.2
#: Sizes of a document's profile from which another least score holds.
SIZES = (0, 16, 32, 64, 96, 128, 160, 200, 250, 300)
UNKNOWN = "und"

#: Languages, sorted n-grams, and the rank of each n-gram in each language: plain data, which a worker reads without this package.
Model = tuple[list[str], np.ndarray, np.ndarray]


def letter_table() -> np.ndarray:
    """By code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: bytes | None, letters: np.ndarray) -> np.ndarray:
    """Codes of all 1- to 3-grams of a text, 21 bits a character."""
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    points = np.concatenate(([32], np.where(letters[points], points, 32), [32]))
    blank = points == 32
    points = points[~(blank & np.concatenate(([False], blank[:-1])))]
    if len(points) < 3:
        return np.empty(0, np.int64)
    blank = points == 32
    pairs = points[:-1] | points[1:] << 21
    return np.concatenate((points[~blank], pairs, (pairs[:-1] | points[2:] << 42)[~blank[1:-1]]))


def top(grams: np.ndarray, length: int) -> np.ndarray:
    """The most frequent n-grams, in order."""
    codes, counts = np.unique(grams, return_counts=True)
    if len(codes) > length:
        often = counts >= np.partition(counts, -length)[-length]
        codes, counts = codes[often], counts[often]
    return codes[np.argsort(-counts, kind="stable")[:length]]


def profiles_of(by_lang: dict[str, list[int]]) -> Model:
    """Profiles of all languages as one sorted list of n-grams with their ranks, -1 where a language lacks one."""
    langs = sorted(by_lang)
    codes = np.unique(np.array([c for p in by_lang.values() for c in p], np.int64))
    ranks = np.full((len(codes) + 1, len(langs)), -1, np.int32)
    for j, lang in enumerate(langs):
        ranks[np.searchsorted(codes, by_lang[lang]), j] = np.arange(len(by_lang[lang]))
    return langs, codes, ranks


def nearest(model: Model, profile: np.ndarray, length: int) -> tuple[str, float]:
    """The language of the least out-of-place distance, and one minus its share of the largest possible one."""
    langs, codes, ranks = model
    if not len(profile) or not langs:
        return UNKNOWN, 0.0
    at = np.searchsorted(codes, profile)
    at[at == len(codes)] = 0
    rows = ranks[np.where(codes[at] == profile, at, len(codes))]
    away = np.where(rows < 0, length, np.abs(rows - np.arange(len(profile))[:, None])).sum(axis=0)
    best = int(away.argmin())
    return langs[best], float(1 - away[best] / (length * len(profile)))


def held_out(doc_id: str, folds: int = FOLDS) -> Column:
    """Whether a row is kept from learning: crc32 of doc_id as text is divisible by ``folds``."""
    return F.coalesce(F.crc32(col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(True))


def sampled(docs: DataFrame, *, text: str, lang: str, doc_id: str, sample: int | None = SAMPLE) -> DataFrame:
    """lang, text and a hash h of every row that teaches; of at most about ``sample`` rows of each language, if that is given."""
    known = docs.select(col(lang).cast("string").alias("lang"), col(text).alias("text"), F.pmod(F.xxhash64(F.lit(1), col(doc_id)), F.lit(1_000_000)).cast("int").alias("h"), col(doc_id).isNotNull().alias("named")).where("lang is not null and text is not null and named").drop("named")
    if sample is None:
        return known
    counts = bounded(cut(known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample)) / F.count(F.lit(1))).alias("share"))).withColumnRenamed("lang", "l"))
    return known.join(counts, F.col("lang") == F.col("l")).where(F.col("h") < F.col("share") * 1_000_000).select("lang", "text", "h")


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", length: int = LENGTH) -> Model:
    """Profiles of the languages of docs, from all their labelled rows."""
    return _learned(sampled(docs, text=text, lang=lang, doc_id=doc_id), length)


def _learned(picked: DataFrame, length: int) -> Model:
    at_once = GRAMS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, held = letter_table(), {}
        waiting: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def add(name: str) -> None:
            codes, n = np.unique(np.concatenate(waiting.pop(name)), return_counts=True)
            was = held.get(name, (np.empty(0, np.int64), np.empty(0, np.int64)))
            both, at = np.unique(np.concatenate((was[0], codes)), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, at, np.concatenate((was[1], n)))
            held[name], size[name] = (both, total), 0

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True):
                grams = ngrams(body, letters)
                waiting.setdefault(name, []).append(grams)
                size[name] = size.get(name, 0) + len(grams)
                if size[name] >= at_once:
                    add(name)
        for name in list(waiting):
            add(name)
        for name, (codes, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "gram", "n"])

    summed = picked.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    by_lang: dict[str, list[int]] = {}
    for r in summed.withColumn("rank", rank).where(F.col("rank") <= length).orderBy("lang", "rank").collect():
        by_lang.setdefault(r.lang, []).append(r.gram)
    return profiles_of(by_lang)


def least_scores(picked: DataFrame, model: Model, length: int = LENGTH, margin: float = MARGIN) -> list[float]:
    """For every size of SIZES the least score of a text in a known language.

    All whole texts and their first 1, 2, 4, ... words are scored as they are and with their letters in random order. Where the 1 % quantile of the real ones lies above the median of the shuffled ones, the bound is ``margin`` of the way
    from this to that; elsewhere the two cannot be told apart and all texts pass.
    """
    held = picked.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()

        def shuffled(part: str, rng: np.random.Generator) -> bytes:
            points = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32).copy()
            at = np.flatnonzero(letters[points])
            points[at] = rng.permutation(points[at])
            return points.tobytes().decode("utf-32-le", "replace").encode("utf-8", "replace")

        for batch in batches:
            sizes, real, mixed = [], [], []
            for body, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rng = np.random.Generator(np.random.SFC64(h))
                words = body.split()
                for part in [*(" ".join(words[: 1 << k]) for k in range(len(words).bit_length())), body]:
                    profile = top(ngrams(part.encode("utf-8", "replace"), letters), length)
                    if len(profile):
                        sizes.append(int(np.searchsorted(SIZES, len(profile), side="right")) - 1)
                        real.append(nearest(held.value, profile, length)[1])
                        mixed.append(nearest(held.value, top(ngrams(shuffled(part, rng), letters), length), length)[1])
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(real, pa.float64()), pa.array(mixed, pa.float64())], ["size", "real", "mixed"])

    found = picked.select("text", "h").mapInArrow(score, "size int, real double, mixed double").groupBy("size").agg(F.percentile_approx("real", 0.01, 10_000).alias("real"), F.percentile_approx("mixed", 0.5, 10_000).alias("mixed"))
    least = [0.0] * len(SIZES)
    for r in found.collect():
        if r.real > r.mixed:
            least[r["size"]] = r.mixed + margin * (r.real - r.mixed)
    return least


def predict(docs: DataFrame, model: Model, *, text: str = "text", into: str = "language", keep: list[str] | None = None, length: int = LENGTH, least: list[float] | None = None) -> DataFrame:
    """``keep`` (all columns by default) and a struct ``into``: lang, score, known (its score reaches the least one of its size)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != into]
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("known", pa.bool_())])
    bound = np.zeros(len(SIZES)) if least is None else np.array(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            out: list[dict[str, Any]] = []
            for body in texts(batch, text):
                profile = top(ngrams(body, letters), length)
                lang, score = nearest(held.value, profile, length)
                out.append({"lang": lang, "score": score, "known": lang != UNKNOWN and score >= bound[np.searchsorted(SIZES, len(profile), side="right") - 1]})
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(out, kind)], [*keep, into])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(into, T.StructType().add("lang", "string").add("score", "double").add("known", "boolean"))])
    return map_batches(docs.select(*[col(c) for c in dict.fromkeys([*keep, text])]), run, schema)


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    model = learn(docs.where(~held_out(doc_id)), text=text, lang=lang, doc_id=doc_id, length=length)
    found = predict(docs, model, text=text, keep=[doc_id], into=free_name(docs, "language"), length=length)
    into = found.columns[-1]
    return found.select(col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(f"{into}.lang").alias("lang_pred"), F.col(f"{into}.score").alias("score"))


def accept(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", length: int = LENGTH, margin: float = MARGIN) -> DataFrame:
    """docs that read like one of the languages learned, with their columns; text of none of them goes, and text without letters."""
    picked = sampled(docs.where(~held_out(doc_id)), text=text, lang=lang, doc_id=doc_id)
    model = _learned(picked, length)
    into = free_name(docs, "language")
    found = predict(docs, model, text=text, into=into, length=length, least=least_scores(picked, model, length, margin))
    return found.where(f"{into}.known").select(*[col(c) for c in docs.columns])
