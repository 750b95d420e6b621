"""Rows whose id is, or is not, in a list, without a shuffle of the rows.

A short list is broadcast as it is. A longer one is broadcast as a bitmap of hashed ids, 16 bits an id; the known ids that hit it without
being listed form a list themselves, some two hundred times shorter, which is treated the same way. So the answer is exact.
Only a list too long for a bitmap is joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.plans.runtime import col, cut, free_name

#: Ids that are broadcast as they are, and ids whose bitmap is (32 MB).
BROADCAST_IDS, BITMAP_IDS = 100_000, 1 << 24
#: Bits of the bitmap an id, 64-bit words of a block, bits that an id sets in its block.
BITS, WORDS, HASHES = 16, 16, 3


def among(rows: DataFrame, key: str, ids: DataFrame, known: DataFrame, *, out: bool = False) -> DataFrame:
    """rows whose ``key`` is in ids or, with ``out``, is not; null is in no list.

    ids and known, computed already, have one column each: distinct ids, and at least all keys of rows.
    """
    marked, listed = _marked(rows, key, ids, known, 0)
    return marked.where(~listed if out else listed).select(*[col(c) for c in rows.columns])


def _marked(rows: DataFrame, key: str, ids: DataFrame, known: DataFrame, level: int) -> tuple[DataFrame, Column]:
    """rows with further columns, and whether a row is listed."""
    n = ids.count()
    if n <= BROADCAST_IDS or n > BITMAP_IDS:
        name = free_name(rows, f"listed{level}")
        one = ids.toDF(name)
        return rows.join(F.broadcast(one) if n <= BROADCAST_IDS else one, col(key) == col(name), "left"), col(name).isNotNull()
    blocks = n * BITS // (64 * WORDS) + 1
    places = _bits(ids.columns[0], level)
    dealt = ids.select(_block(ids.columns[0], blocks, level).alias("block"), F.explode(F.array(*places)).alias("bit"))
    words = F.array(*[F.coalesce(F.bit_or(F.when(F.shiftright("bit", 6) == i, _one(F.col("bit")))), F.lit(0).cast("long")) for i in range(WORDS)])
    bitmap = cut(dealt.groupBy("block").agg(words.alias("words")))
    # Known ids that hit without being listed.
    met, hit = _hits(known, known.columns[0], bitmap, blocks, level)
    wrong = cut(met.where(hit).select(col(known.columns[0]).alias("wrong")).distinct().join(ids.toDF("listed"), F.col("wrong") == F.col("listed"), "left_anti"))
    met, hit = _hits(rows, key, bitmap, blocks, level)
    met, listed_wrong = _marked(met, key, wrong, ids, level + 1)
    return met, hit & ~listed_wrong


def _block(key: str, blocks: int, level: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(2 * level), col(key)), F.lit(blocks))


def _bits(key: str, level: int) -> list[Column]:
    """Places of an id's bits in its block."""
    h = F.xxhash64(F.lit(2 * level + 1), col(key))
    return [F.pmod(F.shiftrightunsigned(h, 16 * k), F.lit(64 * WORDS)).cast("int") for k in range(HASHES)]


def _hits(rows: DataFrame, key: str, bitmap: DataFrame, blocks: int, level: int) -> tuple[DataFrame, Column]:
    """rows with the words of their block, and whether all their bits are set there."""
    block, words = free_name(rows, f"block{level}"), free_name(rows, f"words{level}")
    met = rows.join(F.broadcast(bitmap.toDF(block, words)), _block(key, blocks, level) == col(block), "left")
    hit = col(key).isNotNull() & col(block).isNotNull()
    for bit in _bits(key, level):
        hit = hit & (F.get(col(words), F.shiftright(bit, 6)).bitwiseAND(_one(bit)) != 0)
    return met, hit


def _one(bit: Column) -> Column:
    """A word with this bit set, of a place in a block."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63))
