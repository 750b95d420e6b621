"""Rules that hold on small texts and rows: widths, file names, fingerprints, and which text pairs are compared."""

import unicodedata

from pyspark.sql import functions as F

from lakeloom.functions import display
from lakeloom.operators import merge

TEXTS = ["", "plain", "été", "漢字 kana カナ", "ﾊﾝｶｸ", "🙂🙂", "⃝̣x", "한글〪", "a\tb\n"]


def test_width_agrees_with_the_unicode_tables(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "i int, t string")
    got = {r.i: r.w for r in rows.select("i", display.visual_width(F.col("t")).alias("w")).collect()}
    assert got == {i: display.width_of(t) for i, t in enumerate(TEXTS)} | {99: 0}
    assert any(unicodedata.combining(c) for t in TEXTS for c in t)


def cut_name(name: str) -> str:
    """The rule for long names, a character at a time."""
    stem, dot, extension = name.rpartition(".")
    tail = dot + extension if dot and len(extension.encode()) <= display.EXTENSION_BYTES else ""
    head = stem if tail else name
    while len((head + tail).encode()) > display.NAME_BYTES:
        head = head[:-1]
    return head + tail


def test_long_names_keep_whole_characters_and_a_short_extension(spark):
    names = ["x" * 300, "é" * 200 + ".mp3", "漢" * 150 + ".flac", "🙂" * 80 + ".ogg", "a" + "🙂" * 80, "y" * 220 + "." + "z" * 30, "b" * 211 + ".mp3", "b" * 212 + ".mp3", "." * 3 + "c" * 400 + ".d"]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, t string")
    got = {r.i: r.f for r in rows.select("i", display.sanitize_filename(F.col("t")).alias("f")).collect()}
    for i, name in enumerate(names):
        legal = name.strip(" .")
        assert got[i] == (cut_name(legal) if len(legal.encode()) > display.NAME_BYTES else legal)
        assert len(got[i].encode()) <= display.NAME_BYTES


def test_fingerprint_tells_columns_and_nulls_apart_but_not_orders(spark):
    schema = "a string, b string"
    print_of = lambda rows: tuple(merge.fingerprint(spark.createDataFrame(rows, schema)).first())
    rows = [("x", None), ("1", "23"), (None, None)]
    assert print_of(rows) == print_of(rows[::-1])
    others = [[(None, "x"), *rows[1:]], [rows[0], ("12", "3"), rows[2]], [*rows[:2], ("", None)], rows[:2], [*rows, rows[0]]]
    assert len({print_of(r) for r in [rows, *others]}) == len(others) + 1
    assert print_of([])[0] == 0
