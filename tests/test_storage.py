import pytest

import seed
from lakeloom.operators import classify, groups, output, pairs, ranking, storage
from lakeloom.config import FuzzyConfig
from lakeloom.sources import catalog

CASCADE = (("largest", 0.0), ("oldest", 0.0))


def ids(df):
    return sorted(r.item_id for r in df.collect())


def test_copies_rotate_and_come_back(spark, tmp_path):
    items, at = seed.items(spark), str(tmp_path / "b")
    assert storage.copies(spark, at) == []
    assert storage.back_up(items, at, "1", keep=1, archives=1).rows == 12
    assert storage.back_up(items.orderBy("name"), at, "2", keep=1, archives=1) is None
    assert storage.back_up(items, at, "2", keep=1, archives=1, only_if_changed=False).stamp == "2"
    storage.back_up(items.where("item_id < 4"), at, "3", keep=1, archives=1, rotate_first=True)
    assert [c.stamp for c in storage.copies(spark, at)] == ["3"] and [c.stamp for c in storage.copies(spark, f"{at}/archive")] == ["2"]
    assert ids(storage.restored(spark, at, "3")) == [1, 2, 3] and ids(storage.restored(spark, at, "2")) == list(range(1, 13))
    storage.rotate(spark, at, 0)
    assert storage.copies(spark, at) == []
    storage.back_up(items.limit(0), at, "4", keep=0, archives=2)
    assert storage.copies(spark, at) == [] and storage.restored(spark, at, "4").count() == 0
    with pytest.raises(LookupError):
        storage.restored(spark, at, "1")
    with pytest.raises(ValueError):
        storage.back_up(items, at, "a=b")


def test_vacuum_keeps_rows(spark, tmp_path):
    at = str(tmp_path / "t")
    seed.items(spark).repartition(8).write.parquet(at)
    assert storage.vacuum(spark, at) == 1 and len(list((tmp_path / "t").glob("*.parquet"))) == 1
    assert ids(spark.read.parquet(at)) == list(range(1, 13)) and not list(tmp_path.glob("t.*"))
    # A call that stopped between the renames left the rows in t.old.
    (tmp_path / "t").rename(tmp_path / "t.old")
    assert storage.vacuum(spark, at) == 1 and ids(spark.read.parquet(at)) == list(range(1, 13))


def test_catalog(spark, tmp_path):
    seed.items(spark).write.parquet(str(tmp_path / "items.parquet"))
    (tmp_path / "notes.txt").write_text("x")
    assert list(catalog.tables(spark, str(tmp_path))) == ["items"]
    first = catalog.columns(spark, str(tmp_path)).orderBy("position").first()
    assert tuple(first) == ("items", 1, "scope", "string")
    assert [r["table"] for r in catalog.missing(spark, str(tmp_path), ["items", "cursors", "cursors"]).collect()] == ["cursors"]
    assert catalog.tables(spark, str(tmp_path / "none")) == {} and catalog.missing(spark, str(tmp_path / "none"), ["a"]).count() == 1


def test_report_file(spark, tmp_path):
    cfg = FuzzyConfig(enable=True, name_power=1.0, duration_power=3.0, size_power=1.0)
    items = seed.items(spark)
    edges = groups.fuzzy_edges(items, cfg)
    lines = output.report_lines(items, groups.fuzzy_groups(items, cfg), edges, CASCADE)
    head = output.report_head("main", 3, (("largest", 0.03), ("oldest", 0.0)), "now", cfg)
    assert "Original: largest ~3%, oldest" in head and "Mode: strict" in output.report_head("main", 3, CASCADE, "now")
    assert output.write_report(head, lines, tmp_path / "r" / "report.txt") == 3
    text = (tmp_path / "r" / "report.txt").read_text(encoding="utf-8").splitlines()
    assert [x for x in text if x.startswith("---")] == ["--- GROUP 1 (items: 2) ---", "--- GROUP 3 (items: 2) ---", "--- GROUP 5 (items: 2) ---"]
    at = text.index("--- GROUP 1 (items: 2) ---")
    assert text[at + 1].startswith("* [KEEP] Harbour Lights - Low Tide (2)") and text[at + 2] == "  Tags: Harbour Lights - Low Tide" and text[at + 5].startswith("* Harbour")
    assert text[at + 9 : at + 11] == ["  Links (1):", "    1 <-> 2: same content"]
    assert any("5 <-> 6: score" in x and "(tags-name)" in x for x in text)
    assert output.write_report(head, lines.limit(0), tmp_path / "none.txt") == 0 and not (tmp_path / "none.txt").exists()


def test_exports_are_ordered_and_names_get_extensions(spark):
    items = seed.items(spark)
    names = [r.name for r in output.cleaned_names(items).collect()]
    assert names == sorted(names)
    tags = [(r.performer or "", r.title or "") for r in output.cleaned_tags(items).collect()]
    assert tags == sorted(tags)
    df = spark.createDataFrame([("a", "audio/mpeg"), ("b.ogg", "audio/mpeg"), ("c", "audio/ogg"), ("d", None), ("e", "text/plain")], "n string, m string")
    assert [r.x for r in df.select(output.with_extension(df.n, df.m).alias("x")).collect()] == ["a.mp3", "b.ogg", "c.ogg", "d.mp3", "e.mp3"]


def test_large_scopes_spread(spark):
    df = spark.range(1000).selectExpr("if(id % 10 < 8, 'hot', 'cold') as scope", "id as item_id", "if(id % 3 = 0, null, id % 5) as duration")
    got = {r.item_id: r.batch for r in classify.batched(df, 7).collect()}
    for scope in ("hot", "cold"):
        own = sorted(i for i in got if (i % 10 < 8) == (scope == "hot"))
        assert [got[i] for i in own] == [k // 7 for k in range(len(own))]
    value = {i: 0 if i % 3 == 0 else i % 5 for i in got}
    near = {r.item_id: r.candidates for r in pairs.window_counts(df, 2).collect()}
    for i in range(0, 1000, 37):
        same = [j for j in got if (j % 10 < 8) == (i % 10 < 8) and j != i]
        assert near[i] == sum(value[i] < value[j] <= value[i] + 2 or (value[j] == value[i] and j > i) for j in same)
    assert ranking.ranked(df.limit(0), ["item_id"], ["scope", "duration"]).count() == 0
