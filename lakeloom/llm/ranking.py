"""Hashes of whole rows, and decisions put back on the rows they were made for; ranks come from the core."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.operators.ranking import bounded, dealt, ranked, running
from lakeloom.plans.runtime import col

__all__ = ["attach", "bounded", "dealt", "ranked", "row_hash", "running"]


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row, of any type."""
    return F.xxhash64(*[col(f.name).cast("string") if _holds_map(f.dataType) else col(f.name) for f in docs.schema])


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    return isinstance(kind, (T.MapType, T.VariantType)) or (isinstance(kind, T.StructType) and any(_holds_map(f.dataType) for f in kind))


def attach(docs: DataFrame, decisions: DataFrame, doc_id: str, order: list[str], columns: list[str]) -> DataFrame:
    """Rows of docs as a struct ``d``, with ``columns`` of decisions, matched by doc_id; rows that share one are matched one to one.

    decisions has ``_doc``, ``_hash`` (``row_hash`` of the whole row) and ``columns``; ``order`` orders it among equal rows.
    """
    number = lambda *by: W.partitionBy(*by[:2]).orderBy(*by[2:])
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("d"), row_hash(docs).alias("_hash"), col(doc_id).alias("_id"))
    rows = rows.withColumn("_nth", F.row_number().over(number("_id", "_hash", "_id")))
    side = decisions.withColumn("_n", F.row_number().over(number("_doc", "_hash", *order))).withColumnRenamed("_hash", "_h").select("_doc", "_h", "_n", *columns)
    on = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_h")) & (F.col("_nth") == F.col("_n"))
    return rows.join(side, on).select("d", *columns)
