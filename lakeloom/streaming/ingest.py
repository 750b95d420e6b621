"""Incremental ingest of a message stream into an items table."""

from __future__ import annotations

import hashlib
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeloom.operators.merge import KEY, last_of_each
from lakeloom.plans.runtime import remove
from lakeloom.schema import ITEMS, MESSAGES
from lakeloom.sources.items import messages_as_items


def read_messages(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """The items of message files as a stream; ``max_files`` a trigger bounds the batches."""
    reader = spark.readStream.schema(MESSAGES)
    return messages_as_items((reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(folder))


#: Versions behind a base after which a new base is written.
COMPACT = 10


class Version(NamedTuple):
    """A folder of a table: a base holds all rows, a delta those that came or changed; both name the batch that made them."""

    number: int
    base: bool
    run: str
    batch: int

    @property
    def folder(self) -> str:
        return f"v{self.number:09d}_{'base' if self.base else 'delta'}_{self.run}_{self.batch}"


def _versions(spark: SparkSession, folder: str) -> list[Version]:
    """The complete versions of a table, in order."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for name in (s.getPath().getName() for s in fs.listStatus(path)):
        parts = name.split("_")
        if len(parts) == 4 and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")):
            found.append(Version(int(parts[0][1:]), parts[1] == "base", parts[2], int(parts[3])))
    return sorted(found)


def _read(spark: SparkSession, folder: str, versions: list[Version]) -> DataFrame:
    """The last row of every key since the last base."""
    last = max((i for i, v in enumerate(versions) if v.base), default=0)
    live = versions[last:]
    if not live:
        return spark.createDataFrame([], ITEMS)
    rows = [spark.read.schema(ITEMS).parquet(f"{folder}/{v.folder}").withColumn("_version", F.lit(v.number)) for v in live]
    merged = reduce(DataFrame.unionByName, rows)
    return merged.drop("_version") if len(live) == 1 else last_of_each(merged, ["_version"]).drop("_version")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """A table as its complete versions make it; empty if there are none."""
    return _read(spark, folder, _versions(spark, folder))


def ingest(items: DataFrame, table_folder: str, checkpoint: str, *, refresh: bool = False, order: list[str] | None = None) -> StreamingQuery:
    """Start a query that takes all the items there are into the table and stops.

    Every batch adds a version to the table's own last one, whatever the checkpoint: a delta with the rows of new keys or, to
    ``refresh``, all its rows, which take the place of known ones; of equal keys in a batch the last by ``order`` counts. A version names the
    query (its id in the checkpoint) and the batch, so a repeated batch is told and left out. After ``COMPACT`` deltas a base is
    written, and what it replaces is removed.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = hashlib.sha256("".join(r.value for r in spark.read.text(f"{checkpoint}/metadata").collect()).encode()).hexdigest()[:16]
        before = _versions(spark, table_folder)
        if any((v.run, v.batch) == (run, number) for v in before):
            return
        rows = last_of_each(batch, order)
        if not refresh:
            rows = rows.join(_read(spark, table_folder, before).select(*KEY), KEY, "left_anti")
        made = Version(before[-1].number + 1 if before else 1, False, run, number)
        rows.select(*[f.name for f in ITEMS]).write.mode("overwrite").parquet(f"{table_folder}/{made.folder}")
        after = [*before, made]
        if len(after) - max((i for i, v in enumerate(after) if v.base), default=0) > COMPACT:
            base = Version(made.number + 1, True, run, number)
            _read(spark, table_folder, after).write.mode("overwrite").parquet(f"{table_folder}/{base.folder}")
            for v in after:
                remove(spark, f"{table_folder}/{v.folder}")

    return items.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
