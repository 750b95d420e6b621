"""Kept copies of a relation, and the layout of its files, on the shared file system."""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession

from lakeloom.operators.merge import fingerprint
from lakeloom.plans.runtime import remove

ARCHIVE = "archive"


class Copy(NamedTuple):
    """A complete copy: its stamp, its number of rows and its fingerprint, all in the folder's name."""

    stamp: str
    rows: int
    hash: str

    @property
    def folder(self) -> str:
        return f"{self.stamp}={self.rows}={self.hash}"


def _at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _move(spark: SparkSession, source: str, to: str) -> None:
    fs, at = _at(spark, source)
    if not fs.rename(at, _at(spark, to)[1]):
        raise OSError(f"cannot rename {source} to {to}")


def copies(spark: SparkSession, folder: str) -> list[Copy]:
    """The complete copies in a folder, the oldest first; none where there is no folder."""
    fs, at = _at(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(Copy(parts[0], int(parts[1]), parts[2]) for parts in (n.split("=") for n in names) if len(parts) == 3 and not parts[0].startswith("."))


def _written(spark: SparkSession, rows: DataFrame, folder: str, name: str, codec: str) -> None:
    """Rows under a name that appears when they are complete."""
    fs, at = _at(spark, folder)
    fs.mkdirs(at)
    rows.write.mode("overwrite").option("compression", codec).parquet(f"{folder}/.{name}")
    _move(spark, f"{folder}/.{name}", f"{folder}/{name}")


def rotate(spark: SparkSession, folder: str, keep: int, archives: int | None = None) -> None:
    """Leave the last ``keep`` copies; older ones go to the archive, packed tightly, or, without ``archives``, are removed.

    Of the archive the last ``archives`` stay.
    """
    there = copies(spark, folder)
    for c in there[: max(len(there) - max(keep, 0), 0)]:
        if archives is not None and c not in copies(spark, f"{folder}/{ARCHIVE}"):
            _written(spark, spark.read.parquet(f"{folder}/{c.folder}"), f"{folder}/{ARCHIVE}", c.folder, "zstd")
        remove(spark, f"{folder}/{c.folder}")
    if archives is not None:
        packed = copies(spark, f"{folder}/{ARCHIVE}")
        for c in packed[: max(len(packed) - max(archives, 0), 0)]:
            remove(spark, f"{folder}/{ARCHIVE}/{c.folder}")


def back_up(df: DataFrame, folder: str, stamp: str, *, keep: int = 3, archives: int | None = None, only_if_changed: bool = True, rotate_first: bool = False) -> Copy | None:
    """A copy of df named by ``stamp`` (stamps must sort by age) and the rotation; None if the newest copy holds the same rows.

    ``rotate_first`` makes room before the copy is written instead of after. A copy that fails leaves those before it alone.
    """
    if "=" in stamp or "/" in stamp or stamp.startswith(".") or not stamp:
        raise ValueError(f"no stamp: {stamp!r}")
    spark = df.sparkSession
    seen = fingerprint(df).first()
    made = Copy(stamp, seen["n"], str(seen["hash"]))
    known = copies(spark, folder) or copies(spark, f"{folder}/{ARCHIVE}")
    if only_if_changed and known and known[-1][1:] == made[1:]:
        return None
    if rotate_first:
        rotate(spark, folder, max(keep - 1, 0), archives)
    _written(spark, df, folder, made.folder, "snappy")
    if not rotate_first or keep == 0:
        rotate(spark, folder, keep, archives)
    return made


def restored(spark: SparkSession, folder: str, stamp: str) -> DataFrame:
    """The rows of a copy, from the archive if it is there."""
    for at in (folder, f"{folder}/{ARCHIVE}"):
        for c in copies(spark, at):
            if c.stamp == stamp:
                return spark.read.parquet(f"{at}/{c.folder}")
    raise LookupError(f"no copy {stamp} in {folder}")


def vacuum(spark: SparkSession, folder: str, file_bytes: int = 256 << 20) -> int:
    """Rewrite a Parquet folder into files of about ``file_bytes``; its number of files after that.

    The new files are complete before the old ones go: a failure before that leaves the folder as it was, and one between the two
    renames leaves the old rows in ``folder.old``, which the next call puts back.
    """
    fs, at = _at(spark, folder)
    if not fs.exists(at) and fs.exists(_at(spark, f"{folder}.old")[1]):
        _move(spark, f"{folder}.old", folder)
    files = max(1, -(-fs.getContentSummary(at).getLength() // file_bytes))
    rows = spark.read.parquet(folder)
    rows.repartition(files).write.mode("overwrite").parquet(f"{folder}.new")
    remove(spark, f"{folder}.old")
    _move(spark, folder, f"{folder}.old")
    _move(spark, f"{folder}.new", folder)
    remove(spark, f"{folder}.old")
    spark.catalog.refreshByPath(folder)
    return files
