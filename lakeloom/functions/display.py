"""Presentation of sizes, durations, names and links as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File names that some systems reserve, and the most bytes of a file name: fixed values.
RESERVED = ["CON", "PRN", "AUX", "NUL", *[f"{p}{i}" for p in ("COM", "LPT") for i in range(1, 10)]]
NAME_BYTES, EXTENSION_BYTES = 215, 20
UNNAMED = "unnamed_file"


def format_bytes(n: Column) -> Column:
    """Size in B, KiB, MiB, GiB or TiB; the sign is dropped."""
    size = F.abs(n.cast("double"))
    out = F.format_string("%d B", F.floor(size))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB")):
        out = F.when(size >= float(1024**power), F.format_string(f"%.2f {unit}", F.bround(size / float(1024**power), 2))).otherwise(out)
    return F.when(n.isNotNull(), out)


def format_duration(seconds: Column) -> Column:
    """mm:ss, or h:mm:ss from an hour on; 00:00 where unknown."""
    s = F.coalesce(seconds, F.lit(0)).cast("long")
    h, m, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(s <= 0, F.lit("00:00")).when(h > 0, F.format_string("%d:%02d:%02d", h, m, rest)).otherwise(F.format_string("%02d:%02d", m, rest))


def message_link(scope: Column, item_id: Column) -> Column:
    """Address of an item in its scope."""
    return F.concat(F.lit("https://t.me/c/"), F.regexp_replace(scope.cast("string"), "^-100", ""), F.lit("/"), item_id.cast("string"))


def display_title(name: Column, performer: Column, title: Column, placeholder: str = "(untitled)") -> Column:
    """The name, else ``performer - title``, else a placeholder."""
    full = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(full(name), full(F.concat_ws(" - ", full(performer), full(title))), F.lit(placeholder))


def scope_label(scope: Column, title: Column, username: Column, parts: tuple[str, ...] = ("title", "username", "id")) -> Column:
    """``title [@username | id]`` of the parts asked for; the id where nothing else is known."""
    shown = {"title": F.nullif(title, F.lit("")), "username": F.concat(F.lit("@"), F.nullif(username, F.lit(""))), "id": scope.cast("string")}
    head = shown["title"] if "title" in parts else F.lit(None).cast("string")
    tail = F.concat_ws(" | ", *[shown[p] for p in parts if p != "title"]) if any(p != "title" for p in parts) else F.lit("")
    return F.when(head.isNull(), F.coalesce(F.nullif(tail, F.lit("")), scope.cast("string"))).when(tail == "", head).otherwise(F.concat(head, F.lit(" ["), tail, F.lit("]")))


def source_suffix(source: Column) -> Column:
    """Which texts of a pair were compared."""
    labels = [" (name-name)", " (name-tags)", " (tags-name)", " (tags-tags)"]
    return F.coalesce(F.get(F.array(*map(F.lit, labels)), source), F.lit(""))


def safe_cell(c: Column) -> Column:
    """A spreadsheet cell: '' for null, and text that would be read as a formula is quoted."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike("^[=+@-]"), F.concat(F.lit("'"), text)).otherwise(text)


def _front(text: Column, size: Column) -> Column:
    """As many whole characters of a text as fit into ``size`` bytes: a character has four at most."""
    raw = text.cast("binary")
    return F.coalesce(*[F.try_validate_utf8(F.substring(raw, F.lit(1), size - k).cast("string")) for k in range(4)])


def _fitted(name: Column) -> Column:
    """A long name cut to NAME_BYTES bytes; a short extension stays."""
    extension = F.regexp_extract(name, r"(?s)\.[^.]*\z", 0)
    tail = F.when(F.octet_length(extension) <= EXTENSION_BYTES + 1, extension).otherwise("")
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(tail))
    return F.concat(_front(stem, F.lit(NAME_BYTES) - F.octet_length(tail)), tail)


def sanitize_filename(name: Column) -> Column:
    """A name that every file system takes, of at most NAME_BYTES bytes; whole characters are kept."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[\x00-\x1F\x7F]", ""), r'[<>:"/\\|?*]', "_")
    clean = F.regexp_replace(clean, r"^[ .]+|[ .]+\z", "")
    clean = F.when(F.upper(F.substring_index(clean, ".", 1)).isin(RESERVED), F.concat(F.lit("_"), clean)).otherwise(clean)
    return F.when(clean == "", F.lit(UNNAMED)).when(F.octet_length(clean) > NAME_BYTES, _fitted(clean)).otherwise(clean)


def width_of(text: str | None) -> int:
    """Terminal cells of a text: two for wide characters, none for combining ones."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text or "")


def _class_of(member: Callable[[str], bool]) -> str:
    """The characters of which something holds, as a class of a pattern."""
    spans: list[list[int]] = []
    for code in range(sys.maxunicode + 1):
        if member(chr(code)):
            if spans and spans[-1][1] == code - 1:
                spans[-1][1] = code
            else:
                spans.append([code, code])
    return "".join(rf"\x{{{first:X}}}-\x{{{last:X}}}" for first, last in spans)


@cache
def width_classes() -> tuple[str, str]:
    """Classes of the combining characters, and of the wide ones that do not combine, by this Python's Unicode tables."""
    return _class_of(lambda c: bool(unicodedata.combining(c))), _class_of(lambda c: unicodedata.east_asian_width(c) in "WF" and not unicodedata.combining(c))


def visual_width(text: Column) -> Column:
    """Terminal cells of a text: two for wide characters, none for combining ones; null has none."""
    combining, wide = width_classes()
    seen = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{combining}]+", "")
    return (F.length(seen) + F.length(F.regexp_replace(seen, f"[^{wide}]+", ""))).cast("long")


def padded(c: Column, width: int) -> Column:
    """Text with spaces up to a visual width, at least one."""
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(width) - visual_width(c), F.lit(1)).cast("int")))
