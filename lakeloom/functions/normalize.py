"""Normalisation of names and tags as column expressions.

Patterns carry (?U) so that classes are Unicode-aware, and (?d) so that ``$`` stops at line feeds only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that decide which parts of a name are noise.
DOMAINS = "net|com|ru|me|fm|tv|org|biz|info|cc|xyz|ua|by|kz|top|click|su|pm"
MEDIA = "mp3|m4a|m4b|flac|wav|ogg|ogx|wma|aac|alac|aiff|ape|opus|wv|webm|mp4|avi|wmv|mkv|flv|mov"
SITES = "muzlome|myzuka|zaycev(?:_?net)?|zvuk|muzofon|hitmo|pesni|lightaudio(?:_ru)?|ruapporangespace|mp3pulse(?:_ru)?|jamix(?:_cc)?|ipleer(?:_com)?|skysound(?:_cc)?|vk4(?:_ru)?"
EXTENSION = rf"(?:\.(?:{MEDIA}))+$"
COPY_NUMBER = r"[\s_\-]*[\(\[]\d[\)\]]$"
PURE_ID = r"^\d{1,5}[\s_\-]\d{10,}$"
NUMBER_PREFIX = r"^\d{5,7}[\s_\-]+"
BRACKETED_SITE = rf"[\[\(][^\]\)]*\b[\w-]+\.(?:{DOMAINS})\b[^\]\)]*[\]\)]"
ADDRESS = r"(?:www[._]|https?://|ftp://)"
SITE_PREFIX = rf"^(?:{SITES})[_.\-\s]+"
SITE_SUFFIX = rf"[_.\-\s]+(?:{SITES})[_.\-\s]*$"
DOMAIN = rf"\b[a-z0-9]+\.(?:{DOMAINS})\b"
LONG_ID = r"(?<=[a-zа-яё\d])[\s_\-]+\d{7,}(?:[\s_\-]+\d{1,4})?$"
PLACEHOLDER = r"^\s*(?:<\s*unknown\s*>|\[\s*unknown\s*\])\s*$"

FLAGS = "(?iUd)"


def _sub(c: Column, pattern: str, to: str = " ") -> Column:
    return F.regexp_replace(c, FLAGS + pattern, to)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def stripped(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return _sub(c, r"^\s+|\s+\z", "")


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(_sub(c, r"\s+"))


def clean_name(name: Column, staged: bool = False) -> Column:
    """The comparable form of a file name: no extension, copy number, site, address or long id; '' for null.

    ``staged`` computes every step once and runs a pattern only where there is a sign of it, most of them at one end of the name; for
    columns that are stored, as Spark cannot take such a column apart again to feed a Python function.
    """
    hold = once if staged else lambda value, body: body(value)

    def where(c: Column, test: Callable[[Column], Column], pattern: str, to: str = " ") -> Column:
        return once(c, lambda x: F.when(test(x), _sub(x, pattern, to)).otherwise(x)) if staged else _sub(c, pattern, to)

    def ends(test: str, n: int, at: Callable[[Column, Column], Column] = F.right) -> Callable[[Column], Column]:
        return lambda x: at(x, F.lit(n)).rlike(FLAGS + test)

    def bare_ends(c: Column) -> Column:
        return where(c, lambda x: F.left(x, F.lit(1)).rlike(FLAGS + r"\s") | F.right(x, F.lit(1)).rlike(FLAGS + r"\s"), r"^\s+|\s+\z", "")

    def without_sites(uncopied: Column) -> Column:
        out = where(uncopied, ends(r"^\d{5}", 5, F.left), NUMBER_PREFIX)
        out = where(out, lambda x: (x.contains("[") | x.contains("(")) & x.contains("."), BRACKETED_SITE)
        out = where(out, lambda x: x.contains("www") | x.contains("://"), ADDRESS)
        out = where(out, ends(rf"^(?:{SITES})", 24, F.left), SITE_PREFIX)
        # No site is longer than 16 letters and its suffix; behind a long run of blanks it is looked for anyway.
        out = bare_ends(where(out, ends(rf"(?:{SITES})[_.\-\s]*$|[_.\-\s]{{20}}$", 44), SITE_SUFFIX))
        out = where(F.translate(out, "_-", "  "), lambda x: x.contains("."), DOMAIN)
        return bare_ends(where(collapsed(out), ends(r"(?:\d|[^\x00-\x7F])\z", 1), LONG_ID, ""))

    def chosen(bare: Column, uncopied: Column, out: Column) -> Column:
        left = bare_ends(bare)
        fallback = F.when(left != "", left).otherwise(name)
        pure = stripped(uncopied).rlike(FLAGS + PURE_ID)
        return F.when(ends(r"^[\s\d]", 1, F.left)(uncopied) & pure if staged else pure, stripped(F.translate(uncopied, "_-", "  "))).when(out != "", out).otherwise(fallback)

    cleaned = hold(where(name, ends(rf"\.(?:{MEDIA})$", 6), EXTENSION, ""), lambda bare: hold(where(F.lower(bare), ends(r"[\(\[]\d[\)\]]$", 4), COPY_NUMBER), lambda uncopied: hold(without_sites(uncopied), lambda out: chosen(bare, uncopied, out))))
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("")).otherwise(cleaned)


def clean_for_search(name: Column) -> Column:
    """Lower case, with every run of other than letters and digits as one space; '' for null."""
    return F.coalesce(F.trim(_sub(F.lower(name), r"[\W_]+")), F.lit(""))


def comparable(cleaned: Column) -> Column:
    """Cleaned text as the similarity functions take it."""
    return F.trim(_sub(F.lower(cleaned), r"\W+"))


def _tags(performer: Column, title: Column) -> Column:
    real = lambda c: F.when(~F.coalesce(c.rlike(FLAGS + PLACEHOLDER), F.lit(True)) & (c != ""), c)
    return F.concat_ws(" ", real(performer), real(title))


def clean_tags(performer: Column, title: Column, staged: bool = False) -> Column:
    """performer and title, without placeholders, cleaned like a name."""
    return clean_name(_tags(performer, title), staged)


def clean_tags_for_search(performer: Column, title: Column) -> Column:
    """performer and title, without placeholders, as search takes them."""
    return clean_for_search(_tags(performer, title))


def number_tokens(cleaned: Column) -> Column:
    """Distinct numbers of a text, as digits without leading zeros."""
    return F.array_distinct(F.transform(F.regexp_extract_all(cleaned, F.lit(r"(?U)(\d+)"), 1), lambda x: F.coalesce(F.nullif(F.regexp_replace(x, "^0+", ""), F.lit("")), F.lit("0"))))
