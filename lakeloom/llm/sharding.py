"""Sharding along a Hilbert curve.

Several metadata dimensions (language, source, size) are quantised to cells of about equal numbers of rows, the cells
of a row become its index on a Hilbert curve, rows are sorted by that index and the order is cut into runs whose numbers of
rows differ by one at most. Rows near each other in all dimensions share shards, so that column statistics of a
shard's files prune on any of them.

Quantiles are those of the whole table: of numbers approximate but of bounded size, of texts exact, by the weighted position of
each distinct value among all, so that texts of equal first bytes part as well.

Equal texts stand together: all copies take the least index among them, a group of copies goes whole to the shard in which its middle
would fall, and what is left of every shard is filled with the other rows in order of the curve. So a group is divided only if it is
larger than a shard, or if a shard's groups alone overfill it; those rows then stand in order with the others.

Edge cases: a null text has size 1 and counts as an empty one; nulls in a dimension share its lowest cell; ties are ordered by
checksum and doc_id; repeated rows get slots of their own; very long texts are only measured and hashed; fewer rows than
shards leave shards empty; an empty table has no rows; further columns, whatever their names and types, pass through ``assign``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.ranking import attach, bounded, ranked, row_hash, running
from lakeloom.plans.runtime import col, cut

SHARDS, BITS, LAW = 8, 4, "rows"
DIMENSIONS = ("lang", "source", "size")


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of rows of cell numbers (rows x dimensions, each below 2 ** bits)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations of every finer level
        low = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def text_edges(df: DataFrame, column: str, cells: int) -> list[tuple[str, int]]:
    """The texts after which a cell begins, in byte order, with its number: a text is in the cell of all rows of smaller texts."""
    counts = cut(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0]
    if total is None:
        return []
    placed = running(counts, ["value"], {"before": "n"})
    level = lambda x: F.floor(x * F.lit(cells) / F.lit(total))
    upto = F.col("before") + F.col("n")
    edges = placed.where((level(upto) > level(F.col("before"))) & (upto < total)).select("value", level(upto).alias("cell"))
    return sorted(((r.value, int(r.cell)) for r in edges.collect()), key=lambda x: x[1])


def as_number(df: DataFrame, column: str, bits: int) -> Column:
    """A number in the column's order: of a text, its cell."""
    if isinstance(df.schema[column].dataType, T.StringType):
        reached = [F.when(F.col(column) > F.lit(value), F.lit(cell)) for value, cell in text_edges(df, column, 1 << bits)]
        return F.coalesce(F.greatest(F.lit(0), F.lit(0), *reached), F.lit(0)).cast("double")
    if isinstance(df.schema[column].dataType, T.DateType):
        return F.unix_date(column).cast("double")
    return F.col(column).cast("double")


def indexed(df: DataFrame, dimensions: tuple[str, ...], bits: int = BITS) -> DataFrame:
    """df with ``_index``, its place on the curve."""
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    numbered = df.select("*", *[as_number(df, c, bits).alias(f"_d{i}") for i, c in enumerate(dimensions)])
    edges = numbered.agg(*[F.percentile_approx(f"_d{i}", steps, 10_000).alias(f"_d{i}") for i in range(len(dimensions))]).first()
    texts = [isinstance(df.schema[c].dataType, T.StringType) for c in dimensions]
    cuts = [np.arange(1, 1 << bits, dtype=float) if is_text else np.array(e or [], float) for e, is_text in zip(edges, texts, strict=True)]

    @F.pandas_udf("long")
    def place(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            cells = [np.where(np.isnan(v := c.to_numpy(float, na_value=np.nan)), 0, np.searchsorted(e, v, side="right")) for c, e in zip(columns, cuts, strict=True)]
            yield pd.Series(hilbert_index(np.stack(cells, axis=1), bits))

    return numbered.select(*df.columns, place(*[f"_d{i}" for i in range(len(dimensions))]).alias("_index"))


def shards(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", dimensions: tuple[str, ...] = DIMENSIONS, count: int = SHARDS, bits: int = BITS, whole_row: bool = False) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    body = F.coalesce(col(text), F.lit("")).cast("binary")
    named = {c: f"_m{i}" for i, c in enumerate(dimensions) if c != "size"}
    size = (F.octet_length(body) + 1).cast("long")
    narrow = cut(docs.select(col(doc_id).alias("doc_id"), size.alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("_text"), *[col(c).alias(m) for c, m in named.items()], *([row_hash(docs).alias("_hash")] if whole_row else [])))
    n = narrow.count()
    quota = [(s + 1) * n // count - s * n // count for s in range(count)]
    equal = ["_text", "text_crc32", "size"]
    kept_columns = ["doc_id", *equal, *(["_hash"] if whole_row else [])]
    own = cut(indexed(narrow, tuple(named.get(c, "size") for c in dimensions), bits).select(*kept_columns, "_index"))
    groups = cut(own.groupBy(*equal).agg(F.min("_index").alias("_least"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1"))
    together = own.join(bounded(groups), equal, "left").withColumn("_index", F.coalesce("_least", "_index")).drop("_least")
    placed = cut(ranked(together, ["_index", *equal, "doc_id", *(["_hash"] if whole_row else [])]))
    # A group that fits into a shard goes to the one that its middle falls into.
    fits = F.coalesce(F.col("_copies") <= max(n // count, 1), F.lit(False))
    middle = placed.where(fits).groupBy(*equal).agg((2 * F.min("rank") + F.count(F.lit(1))).alias("_middle"))
    homes = cut(middle.select(*equal, F.expr(f"cast(_middle * {count} div {2 * max(n, 1)} as int)").alias("shard")))
    homed = ranked(placed.where(fits).join(bounded(homes), equal), ["rank"], "shard", into="slot")
    room = F.element_at(F.array(*[F.lit(q) for q in quota]).cast("array<long>"), F.col("shard") + 1)
    homed = cut(homed.withColumn("_in", F.col("slot") < room))
    used = {r.shard: r.n for r in homed.where("_in").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    # The other rows fill what is left, in order.
    loose = ranked(placed.where(~fits).select(*kept_columns, "rank").unionByName(homed.where(~F.col("_in")).select(*kept_columns, "rank")), ["rank"], into="_place")
    left = [q - used.get(s, 0) for s, q in enumerate(quota)]
    ends = np.cumsum(left).tolist()
    longs = lambda xs: F.array(*[F.lit(int(x)) for x in xs]).cast("array<long>")
    shard = F.size(F.filter(longs(ends), lambda e: e <= F.col("_place")))
    slot = F.col("_place") - F.element_at(longs(e - x for e, x in zip(ends, left, strict=True)), F.col("shard") + 1) + F.element_at(longs(used.get(s, 0) for s in range(count)), F.col("shard") + 1)
    filled = loose.withColumn("shard", shard).withColumn("slot", slot)
    out = homed.where("_in").select(*kept_columns, "shard", "slot").unionByName(filled.select(*kept_columns, "shard", "slot"))
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(["_hash"] if whole_row else []))


def assign(docs: DataFrame, *, doc_id: str = "doc_id", **options: object) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard, which replace columns of those names."""
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    made = shards(docs, doc_id=doc_id, whole_row=True, **options).withColumnRenamed("doc_id", "_doc")
    both = attach(docs, made, doc_id, ["shard", "slot"], added)
    return both.select(*[F.col("d").getField(c).alias(c) for c in docs.columns if c.lower() not in added], *added)
