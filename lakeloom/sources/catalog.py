"""What a folder of stored tables holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.plans.runtime import table

SUFFIX = ".parquet"


def tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a folder, by name in order; only their schemas are read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return {n: table(spark, folder, n) for n in sorted(x.removesuffix(SUFFIX) for x in names if x.endswith(SUFFIX) and x[0] not in "._")}


def columns(spark: SparkSession, folder: str) -> DataFrame:
    """A row for every column of every table: table, position from 1, column and type."""
    rows = [(t, i, f.name, f.dataType.simpleString()) for t, df in tables(spark, folder).items() for i, f in enumerate(df.schema, 1)]
    return spark.createDataFrame(rows, "table string, position int, column string, type string")


def missing(spark: SparkSession, folder: str, required: list[str]) -> DataFrame:
    """Required tables that are not there."""
    asked = spark.createDataFrame([(t,) for t in required], "table string").distinct()
    return asked.join(columns(spark, folder).select("table").distinct(), "table", "left_anti")
