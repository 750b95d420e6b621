"""Quality classifier by importance resampling.

Two hashed n-gram models (words and word pairs in ``buckets`` buckets, smoothed) are estimated, one of target text and one of
all raw text. A document's log importance weight is the log ratio of the two models over its n-grams, divided by the number
of n-grams to the power ``normalise``. Gumbel noise from a hash of doc_id is added, and the top k documents are the sample:
a draw without replacement in proportion to the weights so tempered.

``normalise`` is 0.5, not 0: as chance alone moves a sum over n n-grams by about the root of n, untempered sums of texts of 1 to
20,000 words differ by length before all, and the longest texts would be drawn or left whatever they say. ``share`` is the share of documents
drawn; 0.85 is a mild filter that leaves out the texts least like the target, and smaller shares draw harder.

The raw model counts every document. The target model is fitted on a bounded sample, by hash, of about ``sample`` labelled
rows. The k-th largest key is found exactly by narrowing a histogram, so nothing is sorted or gathered.

Edge cases: a null or blank text has no n-grams, weight 0 and is never kept; keys are rounded to 2**-20, and all documents
that tie with the k-th are kept; without target rows all weights are 0; repeated rows share their key; very long texts are
counted whole, hashed a bounded stretch at a time; further columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.ranking import bounded
from lakeloom.llm.textcore import Roller, blank_words, bounds, texts
from lakeloom.plans.runtime import col, cut

BUCKETS, SAMPLE, SHARE, SEED, SMOOTHING, NORMALISE = 1 << 14, 20_000, 0.85, 11, 1.0, 0.5
SCALE = 1 << 20


def features(roller: Roller, text: bytes | None, buckets: int) -> np.ndarray:
    """Buckets of all words and word pairs."""
    joined = blank_words(text)
    starts, ends = bounds(joined)
    grams = np.concatenate((roller.spans(joined, starts, ends), roller.spans(joined, starts[:-1], ends[1:])))
    return (grams >> np.uint64(40)).astype(np.int64) & (buckets - 1)


def bucket_counts(docs: DataFrame, text: str, buckets: int) -> np.ndarray:
    """n-grams of all texts by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, total = Roller(), np.zeros(buckets, np.int64)
        for batch in batches:
            for body in texts(batch, text):
                total += np.bincount(features(roller, body, buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log of the target model's probability over the raw model's, by bucket."""
    if not target.sum():
        return np.zeros(len(target))
    p = lambda c: np.log((c + smoothing) / (c.sum() + smoothing * len(c)))
    return p(target) - p(raw)


def weights(docs: DataFrame, ratio: np.ndarray, *, doc_id: str, text: str, normalise: float) -> DataFrame:
    """doc_id, n_grams, log_weight."""
    held, buckets = docs.sparkSession.sparkContext.broadcast(ratio), len(ratio)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in batches:
            n, w = [], []
            for body in texts(batch, text):
                at = features(roller, body, buckets)
                n.append(len(at))
                w.append(float(held.value[at].sum()) / max(1, len(at)) ** normalise)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(w, pa.float64())], ["doc_id", "n_grams", "log_weight"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_grams long, log_weight double")


def kth_largest(df: DataFrame, key: str, k: int) -> int | None:
    """The k-th largest of a long column, by counting in ever finer bins; None if there are fewer than one."""
    lo, hi, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n or k < 1:
        return None
    k = min(k, n)
    while lo < hi:
        width = (hi - lo) // 4096 + 1
        bins = df.where(F.col(key).between(lo, hi)).groupBy(F.floor((F.col(key) - lo) / F.lit(width)).alias("bin")).count().collect()
        for b in sorted(bins, key=lambda r: -r["bin"]):
            if k <= b["count"]:
                lo, hi = lo + b["bin"] * width, min(hi, lo + (b["bin"] + 1) * width - 1)
                break
            k -= b["count"]
    return lo


def select(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", share: float = SHARE, buckets: int = BUCKETS, sample: int = SAMPLE, seed: int = SEED, normalise: float = NORMALISE) -> DataFrame:
    """One row per document: doc_id, n_grams, log_weight, gumbel_key, kept; target has the doc_id of target text."""
    docs = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    ids = cut(target.select(col(doc_id).alias("target_id")).where("target_id is not null").distinct())
    fit = min(1.0, sample / max(1, ids.count()))
    ids = bounded(cut(ids.where(F.pmod(F.xxhash64(F.lit(seed), "target_id"), F.lit(1_000_000)) < int(fit * 1_000_000))))
    fitted = docs.join(ids, F.col("doc_id") == F.col("target_id"), "left_semi")
    ratio = log_ratio(bucket_counts(fitted, "text", buckets), bucket_counts(docs, "text", buckets))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "doc_id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = weights(docs, ratio, doc_id="doc_id", text="text", normalise=normalise).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
    keyed = cut(keyed.withColumn("_key", F.when(F.col("n_grams") > 0, F.floor(F.col("gumbel_key") * SCALE))))
    k = int(share * keyed.count())
    least = kth_largest(keyed, "_key", k)
    kept = F.lit(False) if least is None else F.coalesce(F.col("_key") >= least, F.lit(False))
    return keyed.withColumn("kept", kept).drop("_key")
