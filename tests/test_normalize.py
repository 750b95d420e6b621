import pytest
from pyspark.sql import functions as F

from lakeloom.functions import display, normalize as N

#: One or two names for every rule: extension, copy number, joined words, number in front, site, address, domain, long id, pure id, fallback.
NAMES = [
    ("Blue Harbour.ogg", "blue harbour"),
    ("Harbour.tar.flac.mp3", "harbour.tar"),
    ("Harbour (3).wav", "harbour"),
    ("Harbour [7].m4a", "harbour"),
    ("Harbour (12).m4a", "harbour (12)"),
    ("Blue_Harbour-Night.aac", "blue harbour night"),
    ("Über_den_Hafen.opus", "über den hafen"),
    ("54321 - Blue Harbour.mp3", "blue harbour"),
    ("4321 Blue Harbour.mp3", "4321 blue harbour"),
    ("zvuk_Blue Harbour.mp3", "blue harbour"),
    ("Blue Harbour - muzofon.mp3", "blue harbour"),
    ("Blue Harbour (get it at tunes.example.org now).mp3", "blue harbour"),
    ("https://tunes.example.biz Blue.mp3", "tunes. blue"),
    ("Blue Harbour 90817263.mp3", "blue harbour"),
    ("Blue Harbour 90817263_12.mp3", "blue harbour"),
    ("Blue Harbour 908172.mp3", "blue harbour 908172"),
    ("77_9081726354.mp3", "77 9081726354"),
    ("[5].ogg", "[5]"),
    ("   .mp3", "   .mp3"),
    ("", ""),
    (None, ""),
]
SEARCH = [("Blue_Harbour-(3).ogg", "blue harbour 3 ogg"), ("  ÉTÉ__à la mer! ", "été à la mer"), ("ftp://a.b/c", "ftp a b c"), ("---", ""), ("", ""), (None, "")]
TAGS = [
    ("Quay Four", "Blue Harbour", "quay four blue harbour"),
    ("Quay Four", None, "quay four"),
    (None, "Blue Harbour", "blue harbour"),
    (None, None, ""),
    ("[ Unknown ]", "Blue Harbour", "blue harbour"),
    ("<unknown>", "< UNKNOWN >", ""),
    ("Quay Four", "Blue Harbour [live].ogg", "quay four blue harbour [live]"),
]


def column(spark, values, kind, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_clean_name(spark):
    for staged in (False, True):
        assert column(spark, [a for a, _ in NAMES], "string", lambda c: N.clean_name(c, staged)) == [b for _, b in NAMES]  # noqa: B023


def test_clean_for_search(spark):
    assert column(spark, [a for a, _ in SEARCH], "string", N.clean_for_search) == [b for _, b in SEARCH]


def test_clean_tags(spark):
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(TAGS)], "i int, p string, t string")
    assert [r.out for r in df.select("i", N.clean_tags(F.col("p"), F.col("t")).alias("out")).orderBy("i").collect()] == [x for *_, x in TAGS]


def test_comparable_and_numbers(spark):
    assert column(spark, ["blue - harbour", "blue  harbour!", "über den_hafen", ""], "string", N.comparable) == ["blue harbour", "blue harbour", "über den_hafen", ""]
    assert column(spark, ["op 03 and 3", "00 x 12345678901234567890", ""], "string", N.number_tokens) == [["3"], ["0", "12345678901234567890"], []]


def test_bytes_and_durations(spark):
    sizes = [0, 512, 1024, 1536, 1024**2, 3 * 1024**3, 2 * 1024**4, -2048, 1152]
    assert column(spark, sizes, "long", display.format_bytes) == ["0 B", "512 B", "1.00 KiB", "1.50 KiB", "1.00 MiB", "3.00 GiB", "2.00 TiB", "2.00 KiB", "1.12 KiB"]
    assert column(spark, [None, 0, -5, 5, 65, 205, 3599, 3723], "long", display.format_duration) == ["00:00", "00:00", "00:00", "00:05", "01:05", "03:25", "59:59", "1:02:03"]


def test_file_names(spark):
    raw = ["", None, 'a<b>:c"d|e?f*g', "na\x01me", "name..", "  spaced  ", "nul.txt", "COM1", "песня.mp3", "я" * 200 + ".mp3", "я" * 200]
    out = column(spark, raw, "string", display.sanitize_filename)
    assert out[:9] == ["unnamed_file", "unnamed_file", "a_b__c_d_e_f_g", "name", "name", "spaced", "_nul.txt", "_COM1", "песня.mp3"]
    assert out[9].endswith(".mp3") and len(out[9].encode()) <= 215 and len(out[10].encode()) <= 215 and "�" not in out[9] + out[10]


@pytest.mark.parametrize(("text", "width"), [("abc", 3), ("日本", 4), ("é", 1), (None, 0)])
def test_width(text, width):
    assert display.width_of(text) == width


def test_staged_patterns_change_nothing(spark):
    fronts = ["", " ", "\u00a0", "12345 - ", "1234567_", "ruapporangespace. ", "[x.com] ", "12 "]
    backs = ["", ".mp3", ".MP3.flac\n", " (3)", "-[7].m4a\n", " mp3pulse_ru" + " " * 15, "_ZVUK" + "-." * 30, " 12345678", "\u00a0", "\u0661234567890", "-12345678901"]
    names = [(f + m + b,) for f in fronts for m in ("", "Blue Harbour", "Über", "7") for b in backs]
    df = spark.createDataFrame([*names, (None,)], "name string")
    pairs = df.select("name", N.clean_name(F.col("name")).alias("plain"), N.clean_name(F.col("name"), staged=True).alias("staged")).collect()
    assert [r.staged for r in pairs] == [r.plain for r in pairs]
