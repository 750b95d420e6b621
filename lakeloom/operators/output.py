"""Exports, reports and download plans, and the driver-side writers of single files."""

from __future__ import annotations

import csv
import mimetypes
import os
import re
from functools import cache
from itertools import chain
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.config import FuzzyConfig
from lakeloom.functions import display, normalize as N
from lakeloom.operators.groups import group_edges
from lakeloom.operators.survivor import Cascade, keep_order


def filenames(items: DataFrame) -> DataFrame:
    """Names that are not empty, in order."""
    return items.where(F.length("name") > 0).select("scope", "item_id", "name").orderBy("name", "scope", "item_id")


def filenames_with_links(items: DataFrame, width: int = 80) -> DataFrame:
    """Lines of a name, padded, and the item's link."""
    return items.where(F.length("name") > 0).select("scope", "item_id", "name", F.concat(display.padded(F.col("name"), width), display.message_link(F.col("scope"), F.col("item_id"))).alias("line")).orderBy("name", "scope", "item_id")


def cleaned_names(items: DataFrame) -> DataFrame:
    """Names with their cleaned and their comparable form, in order."""
    cleaned = N.clean_name(F.col("name"))
    return items.where(F.length("name") > 0).select("scope", "item_id", "name", cleaned.alias("cleaned"), N.comparable(cleaned).alias("comparable")).orderBy("name", "scope", "item_id")


def cleaned_tags(items: DataFrame) -> DataFrame:
    """Tags with their cleaned and their comparable form, where anything is left, in order (nulls first)."""
    cleaned = N.clean_tags(F.col("performer"), F.col("title"))
    rows = items.where("performer is not null or title is not null").select("scope", "item_id", "performer", "title", cleaned.alias("cleaned"))
    return rows.where("cleaned <> ''").withColumn("comparable", N.comparable(F.col("cleaned"))).orderBy("performer", "title", "scope", "item_id")


def cells(df: DataFrame) -> DataFrame:
    """Every column as spreadsheet text."""
    return df.select(*[display.safe_cell(F.col(c)).alias(c) for c in df.columns])


def report_rows(items: DataFrame, groups: DataFrame, cascade: Cascade) -> DataFrame:
    """Group members in keep order, the first marked to stay."""
    ranked = keep_order(items.join(groups, ["scope", "item_id"]), cascade)
    return ranked.select(
        "scope", "group_id", F.col("keep_rank").cast("int").alias("keep_rank"), "item_id", F.when(F.col("keep_rank") == 0, "KEEP").otherwise("").alias("mark"),
        display.display_title(F.col("name"), F.col("performer"), F.col("title")).alias("shown"), display.format_bytes(F.col("size")).alias("bytes"), display.format_duration(F.col("duration")).alias("length"),
        display.message_link(F.col("scope"), F.col("item_id")).alias("link"),
    )


def report_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges of each group, the strongest first."""
    order = W.partitionBy("scope", "group_id").orderBy(F.round("score", 9).desc(), "a", "b")
    return group_edges(edges, groups).withColumn("edge_rank", F.row_number().over(order))


def report_head(scope: str, groups: int, cascade: Cascade, stamp: str, cfg: FuzzyConfig | None = None) -> list[str]:
    """The lines before the groups of a report: what was looked for, and how."""
    order = ", ".join(f"{name} ~{tolerance:.0%}" if tolerance else name for name, tolerance in cascade)
    lines = [f"DUPLICATES (scope: {scope})", f"Made: {stamp}", f"Groups: {groups}", "", f"Original: {order}", "[KEEP] is preliminary: if that item fails verification, the next one stays.", ""]
    if cfg is None or not cfg.enable:
        return [*lines, "Mode: strict", "=" * 60, ""]
    shares = lambda *v: " | ".join(f"{n}={x}" for n, x in zip(("name", "duration", "size"), v, strict=True))
    return [
        *lines, f"Mode: {cfg.matching_mode}", f"Threshold: {cfg.threshold}", f"Band: {cfg.max_duration_diff_sec} s", f"Weights: {shares(cfg.weight_name, cfg.weight_duration, cfg.weight_size)}",
        f"Powers: {shares(cfg.name_power, cfg.duration_power, cfg.size_power)}", f"Penalty for numbers: {cfg.penalty_numbers_mismatch}", f"By share: {'on' if cfg.use_jaccard_penalty else 'off'}",
        f"Tags: {'on' if cfg.use_meta_fuzzy else 'off'}", "=" * 60, "",
    ]


def report_lines(items: DataFrame, groups: DataFrame, edges: DataFrame, cascade: Cascade) -> DataFrame:
    """The text of a report: rows (scope, group_id, part, place, line) that read in the order of these columns.

    Part 0 is the head of a group, 1 has the four lines of each member in keep order, 2 the head of the edges and 3 the edges, the strongest
    first. A line break inside a name becomes a blank.
    """
    flat = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    sizes = groups.groupBy("scope", "group_id").agg(F.count(F.lit(1)).alias("n"))
    heads = sizes.select("scope", "group_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("place"), F.format_string("--- GROUP %s (items: %d) ---", F.col("group_id").cast("string"), F.col("n")).alias("line"))
    tags = F.nullif(F.concat_ws(" - ", *[F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")) for c in ("performer", "title")]), F.lit(""))
    named = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("(untitled)"))
    about = F.concat_ws(" | ", display.format_bytes(F.coalesce("size", F.lit(0))), display.format_duration(F.col("duration")), F.concat(F.lit("id "), F.col("item_id").cast("string")), F.concat(F.lit("content "), F.coalesce("content_id", F.lit("-"))))
    four = F.array(
        F.concat(F.when(F.col("keep_rank") == 0, "* [KEEP] ").otherwise("* "), flat(named)), F.concat(F.lit("  Tags: "), F.coalesce(flat(tags), F.lit("none"))),
        F.concat(F.lit("  Info: "), about), F.concat(F.lit("  Link: "), display.message_link(F.col("scope"), F.col("item_id"))),
    )
    members = keep_order(items.join(groups, ["scope", "item_id"]), cascade).select("scope", "group_id", "keep_rank", F.posexplode(four).alias("nth", "line"))
    members = members.select("scope", "group_id", F.lit(1).alias("part"), (F.col("keep_rank").cast("long") * 4 + F.col("nth")).alias("place"), "line")
    scored = F.format_string("score %.3f | text %.2f%s | duration %.2f | size %.2f | penalty -%.2f", "score", "name_score", display.source_suffix(F.col("text_source")), "duration_score", "size_score", "penalty")
    why = F.when(F.col("reason") == "uid", "same content").when(F.col("reason") == "meta", "same metadata").otherwise(scored)
    ranked = report_edges(edges, groups).select("scope", "group_id", F.lit(3).alias("part"), F.col("edge_rank").cast("long").alias("place"), F.concat(F.lit("    "), F.col("a").cast("string"), F.lit(" <-> "), F.col("b").cast("string"), F.lit(": "), why).alias("line"))
    # Counted before they are ranked: a count alone needs neither their order nor their texts.
    linked = group_edges(edges, groups).groupBy("scope", "group_id").agg(F.count(F.lit(1)).alias("n"))
    edge_heads = linked.select("scope", "group_id", F.lit(2).alias("part"), F.lit(0).cast("long").alias("place"), F.format_string("  Links (%d):", F.col("n")).alias("line"))
    return heads.unionByName(members).unionByName(edge_heads).unionByName(ranked)


def write_report(head: list[str], lines: DataFrame, path: str | os.PathLike[str]) -> int:
    """The report as one text file, streamed through the driver, a blank line between groups; none without groups. Returns its number of groups."""
    rows = lines.orderBy("scope", "group_id", "part", "place").toLocalIterator()
    first = next(rows, None)
    if first is None:
        return 0
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8") as out:
        out.writelines(f"{line}\n" for line in head)
        for row in chain([first], rows):
            if row.part == 0:
                out.write("\n" if n else "")
                n += 1
            out.write(f"{row.line}\n")
    return n


#: Extensions of audio types that Python's tables lack: fixed values.
MORE_EXTENSIONS = {"audio/flac": ".flac", "audio/mp4": ".m4a", "audio/ogg": ".ogg", "audio/webm": ".weba"}


@cache
def extensions() -> dict[str, str]:
    """Audio types and their extensions, by Python's own tables as far as they go."""
    known = mimetypes.MimeTypes(filenames=())
    return MORE_EXTENSIONS | {t: e for t in sorted(set(known.types_map[True].values())) if t.startswith("audio/") and (e := known.guess_extension(t))}


def with_extension(name: Column, mime: Column | None = None) -> Column:
    """A name with an extension: its own, else the one of its type, else ``.mp3``."""
    table = F.create_map(*[F.lit(x) for pair in extensions().items() for x in pair])
    guessed = F.lit(".mp3") if mime is None else F.coalesce(F.try_element_at(table, F.lower(mime)), F.lit(".mp3"))
    return F.when(name.rlike(r"(?s)^.+\.[^.]+\z"), name).otherwise(F.concat(name, guessed))


def download_plan(items: DataFrame, files: DataFrame) -> DataFrame:
    """Target name of every item, made unique, and whether a file of that name, size and time is there already.

    files: name, size, mtime. items may have mtime (0 if unknown) and mime_type, by which a name without an extension gets one.
    """
    base = display.sanitize_filename(F.coalesce(F.nullif(F.col("name"), F.lit("")), F.concat(F.lit("audio_"), F.col("item_id").cast("string"))))
    named = items.withColumn("_base", with_extension(base, F.col("mime_type") if "mime_type" in items.columns else None))
    clash = F.count(F.lit(1)).over(W.partitionBy("scope", F.lower("_base"))) > 1
    target = F.when(clash, F.concat(F.col("item_id").cast("string"), F.lit("_"), F.col("_base"))).otherwise(F.col("_base"))
    planned = named.withColumn("file_name", target)
    there = files.select(F.col("name").alias("_name"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    same_size = (F.col("_size") > 0) & (F.abs(F.col("_size") - F.coalesce("size", F.lit(0))) < 100)
    mtime = F.col("mtime") if "mtime" in items.columns else F.lit(0.0)
    done = same_size & ((mtime == 0) | (F.abs(F.col("_mtime") - mtime) <= 2.0))
    joined = planned.join(there, F.col("file_name") == F.col("_name"), "left")
    return joined.select("scope", "item_id", "file_name", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce(done, F.lit(False)).alias("done"))


def download_totals(plan: DataFrame) -> DataFrame:
    """Files and bytes of a plan, and of what is left of it."""
    return plan.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_if(~F.col("done")).alias("files_left"), F.coalesce(F.sum(F.when(~F.col("done"), F.col("size"))), F.lit(0)).alias("bytes_left"))


def display_widths(hits: DataFrame, columns: list[str]) -> DataFrame:
    """The widest text of each column."""
    return hits.agg(*[F.max(display.visual_width(F.col(c).cast("string"))).alias(c) for c in columns])


def export_path(scope: str | int | None, kind: str, extension: str, stamp: str, root: str = "exports", base: str = "items") -> Path:
    """Where an export goes: a folder of its scope, or of everything."""
    return Path(root) / "_full" / f"{stamp}_{kind}_of_{base}.{extension}" if scope is None else Path(root) / str(scope) / f"{stamp}_{kind}.{extension}"


def write_lines(lines: DataFrame, column: str, path: str | os.PathLike[str]) -> int:
    """One text file, streamed through the driver a partition at a time; none for no lines. Returns their number."""
    rows, n = lines.select(column).toLocalIterator(), 0
    first = next(rows, None)
    if first is None:
        return 0
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        while first is not None:
            if first[0] is not None:
                out.write(f"{first[0]}\n")
                n += 1
            first = next(rows, None)
    return n


def write_csv(df: DataFrame, path: str | os.PathLike[str]) -> int:
    """One semicolon-separated file with a byte order mark and a header, streamed through the driver."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8-sig", newline="") as out:
        writer = csv.writer(out, delimiter=";")
        writer.writerow(df.columns)
        n = 0
        for row in df.toLocalIterator():
            writer.writerow(["" if v is None else v for v in row])
            n += 1
    return n


def sheet_names(tables: list[str]) -> list[str]:
    """Sheet names of at most 31 characters, without forbidden ones, each once."""
    out: list[str] = []
    for t in tables:
        base = re.sub(r"[\[\]:*?/\\]", "_", t)[:31] or "sheet"
        name, n = base, 1
        while name.lower() in (x.lower() for x in out):
            n += 1
            name = f"{base[: 31 - len(str(n)) - 1]}_{n}"
        out.append(name)
    return out


def write_workbook(tables: dict[str, DataFrame], path: str | os.PathLike[str], scope: str | int | None = None) -> dict[str, int]:
    """A workbook with a sheet for every table, of one scope where the table has one. Needs openpyxl."""
    try:
        from openpyxl import Workbook
    except ImportError as e:
        raise RuntimeError("write_workbook needs openpyxl") from e
    book, counts = Workbook(write_only=True), {}
    for (name, df), sheet in zip(tables.items(), sheet_names(list(tables)), strict=True):
        page = book.create_sheet(sheet)
        page.append(df.columns)
        rows = df.where(F.col("scope") == scope) if scope is not None and "scope" in df.columns else df
        counts[name] = 0
        for row in cells(rows).toLocalIterator():
            page.append(list(row))
            counts[name] += 1
    book.save(path)
    return counts


def access(private: Column, member: Column, public: Column, read_only: Column, owner: Column, can_delete: Column) -> Column:
    """Whether a scope may be processed."""
    return F.when(private, True).when(~member, read_only & public).when(read_only, True).otherwise(owner | can_delete)
