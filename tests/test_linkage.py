import random

import pytest

import seed
from lakeloom.config import ConfigError, FuzzyConfig, load_config, parse_keep_priority
from lakeloom.operators import classify, groups, merge, output, pairs, quality, score, search, survivor
from lakeloom.schema import ITEMS, PAYLOAD
from lakeloom.sources.items import messages_as_items

CFG = FuzzyConfig(enable=True, name_power=1.0, duration_power=3.0, size_power=1.0)


def partition(df):
    found = {}
    for r in df.collect():
        found.setdefault((r.scope, r.group_id), set()).add(r.item_id)
    return sorted(sorted(x) for x in found.values())


def rows(*payloads):
    return [("s", i + 1, *p) for i, p in enumerate(payloads)]


def test_exact_groups(spark):
    items = seed.items(spark)
    assert partition(groups.exact_groups(items)) == [[1, 2], [3, 4]]
    assert {(r.a, r.b, r.reason) for r in pairs.exact_edges(items).collect()} == {(1, 2, "uid"), (3, 4, "meta")}


def test_null_is_a_value_in_exact_mode(spark):
    items = seed.items(spark, rows(("a", None, None, 1, None, None), ("b", None, None, 1, None, None), (None, "x", 1, 1, "p", "t"), (None, "y", 2, 2, None, None)))
    assert partition(groups.exact_groups(items)) == [[1, 2], [3, 4]]
    assert pairs.content_pairs(items).count() == 0


def test_fuzzy_groups(spark):
    assert partition(groups.fuzzy_groups(seed.items(spark), CFG)) == [[1, 2], [3, 4], [5, 6]]


def test_unknown_duration_and_size_lower_the_threshold(spark):
    items = seed.items(spark, rows(("a", "same name", 0, 0, None, None), ("b", "same name", None, None, None, None), ("c", "same name", None, 0, None, None)))
    found = score.fuzzy_links(items, CFG).collect()
    assert len(found) == 3 and {round(r.score, 6) for r in found} == {0.5}


def test_lower_threshold_adds_edges_and_above_one_leaves_content(spark):
    items = seed.items(spark)
    n = [groups.fuzzy_edges(items, FuzzyConfig(enable=True, threshold=t)).count() for t in (0.3, 0.9, 1.1)]
    assert n[0] >= n[1] >= n[2] == 1


@pytest.mark.parametrize(("a", "b", "jaccard", "expected"), [(["1", "2"], ["1", "3"], True, 0.5 * 2 / 3), (["1"], ["2"], True, 0.5), (["1"], ["2"], False, 0.5), (["1", "2"], ["2", "1"], True, 0.0), ([], [], True, 0.0), ([], ["1"], False, 0.5)])
def test_number_penalty(spark, a, b, jaccard, expected):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(score.number_penalty(df.a, df.b, 0.5, jaccard).alias("p")).first().p == pytest.approx(expected)


def test_band_join_equals_all_pairs(spark):
    rng = random.Random(4)
    data = [(rng.choice("ab"), i, rng.choice([None, *range(30)])) for i in range(120)]
    df = spark.createDataFrame(data, "scope string, item_id long, duration long")
    for width in (0, 1, 3, 7):
        got = sorted((r.x.item_id, r.y.item_id) for r in pairs.band_self_join(df, width).collect())
        want = []
        for s, i, d in data:
            for t, j, e in data:
                if s == t and ((d or 0), i) < ((e or 0), j) and (e or 0) - (d or 0) <= width:
                    want.append((i, j))
        assert got == sorted(want)


def ordered(spark, cascade, *triples):
    data = [("s", i, "c", n, s, d, p, t, 1) for i, n, s, d, p, t in triples]
    df = spark.createDataFrame(data, "scope string, item_id long, content_id string, name string, size long, duration long, performer string, title string, group_id long")
    out = [r.item_id for r in survivor.keep_order(df, cascade).orderBy("keep_rank").collect()]
    kept = [r.item_id for r in survivor.winners(df, cascade).where("keep").collect()]
    assert kept == out[:1]
    return out


def sized(*sizes):
    return [(i + 1, "n", s, 1, None, None) for i, s in enumerate(sizes)]


def test_survivor_order(spark):
    oldest = ("oldest", 0.0)
    assert ordered(spark, (("largest", 0.1), oldest), *sized(100, 105, 120)) == [3, 1, 2]
    assert ordered(spark, (("largest", 0.5), oldest), *sized(100, 140)) == [1, 2]
    assert ordered(spark, (("largest", 0.0), oldest), *sized(None, 0, 7)) == [3, 1, 2]
    assert ordered(spark, (("smallest", 0.0), oldest), *sized(9, 7, 8)) == [2, 3, 1]
    assert ordered(spark, (("newest", 0.0),), *sized(1, 1, 1)) == [3, 2, 1]
    assert ordered(spark, (("best_meta", 0.0), oldest), (1, "a.mp3", 1, 1, "<unknown>", "A"), (2, "a.mp3", 1, 1, "P", "other"), (3, "a.mp3", 1, 1, "P", "a")) == [2, 3, 1]
    assert ordered(spark, (("longest_clean_name", 0.0), oldest), (1, None, 1, 1, None, None), (2, "ab.mp3", 1, 1, None, None), (3, "abc", 1, 1, None, None)) == [3, 2, 1]


def test_classify(spark):
    base = [("s", i, "c", "n", 1, 1, None, None) for i in range(1, 8)]
    items = seed.items(spark, base)
    grouped = items.selectExpr("*", "case when item_id < 6 then 1 else 2 end as group_id", "cast(item_id as int) as keep_rank")
    fresh = {1: ("missing", None), 2: ("ok", ("c", "n", 1, 1, None, "new")), 3: ("ok", ("c", "n", 1, 1, None, None)), 4: ("ok", ("c", "n", 1, 1, None, None)), 5: ("ok", None), 6: ("error", None), 7: ("ok", ("c", "n", 1, 1, None, None))}
    snap = spark.createDataFrame([("s", i, st, *(p or (None,) * 6)) for i, (st, p) in fresh.items()], "scope string, item_id long, status string, content_id string, name string, size long, duration long, performer string, title string")
    acts = classify.classified(classify.verified(grouped, snap))
    assert {r.item_id: r.action for r in acts.collect()} == {1: "purge_local", 2: "update_local", 3: "keep", 4: "delete_remote", 5: "purge_local", 6: "skipped", 7: "skipped"}
    ignored = spark.createDataFrame([("*", 4)], "scope string, item_id long")
    assert "delete_remote" not in {r.action for r in classify.not_ignored(acts, ignored).collect()}
    assert classify.unprotected(acts, [("*", "^n$")]).where("action = 'delete_remote'").count() == 0
    spread = classify.spread_errors(snap.drop(*PAYLOAD), 3).collect()
    assert {r.item_id for r in spread if r.status == "error"} == {4, 5, 6}


def test_regex_protection(spark):
    items = seed.items(spark)
    held = lambda *p: {r.item_id for r in items.where(classify.protects([("*", x) for x in p])).collect()}
    assert held("^Salt Choir$") == {5} and held("Salt Choir") == {5, 6} and held("no length", "^Harbour Lights$", "Alone Tags") == {1, 2, 8, 10}


def test_batches_and_gone(spark):
    df = spark.createDataFrame([("s", i) for i in range(5)], "scope string, item_id long")
    batches = classify.batched(df, 2)
    assert sorted(r.batch for r in batches.collect()) == [0, 0, 1, 1, 2]
    archived = df.selectExpr("scope", "item_id", "item_id <> 1 as ok")
    assert {r.item_id for r in classify.archive_gate(batches, archived).collect()} == {2, 3, 4}
    assert {r.item_id for r in classify.confirmed_gone(df, df.where("item_id > 2")).collect()} == {0, 1, 2}


def test_search(spark):
    items = seed.items(spark)
    hits = search.search(items, "evening ferry").collect()
    assert {5, 6} <= {r.item_id for r in hits} and [r.score for r in hits] == sorted((r.score for r in hits), reverse=True)
    assert search.search(items, "!!!").count() == 0 and search.search(items, "tide", limit=0).count() == 0 and len(search.search(items, "low tide", limit=2).collect()) == 2
    sane = seed.items(spark, rows(("a", "Sane Sang.mp3", 1, 1, None, None), ("b", "Воскресный ангел", 1, 1, None, None)))
    assert {r.item_id for r in search.search(sane, "same song").collect()} == {1}
    assert search.search(sane, "ангил").count() == 0 and search.search(sane, "ангил", wratio=True).first().score >= 70


def test_merge(spark):
    stored = seed.items(spark, rows(("a", "old", 1, 1, "p", None), ("b", "b", 1, 1, None, None)))
    batch = seed.items(spark, [("s", 1, "a", "new", 2, 2, None, None), ("s", 3, "c", "c", 1, 1, None, None)])
    names = lambda df: {r.item_id: (r.name, r.performer) for r in df.collect()}
    assert names(merge.insert_or_ignore(stored, batch)) == {1: ("old", "p"), 2: ("b", None), 3: ("c", None)}
    assert names(merge.upsert(stored, batch)) == {1: ("new", None), 2: ("b", None), 3: ("c", None)}
    assert names(merge.update_by_key(stored, batch)) == {1: ("new", None), 2: ("b", None)}
    assert names(merge.delete_by_key(stored, batch)) == {2: ("b", None)}
    twice = seed.items(spark, [("s", 1, "a", "x", 1, 1, None, None), ("s", 1, "a", "y", 2, 1, None, None)])
    assert merge.upsert(stored, twice, ["size"]).count() == 2 and names(merge.upsert(stored, twice, ["size"]))[1] == ("y", None)
    assert merge.update_by_key(stored, twice, ["size"]).count() == 2 and names(merge.update_by_key(stored, twice, ["size"]))[1] == ("y", None)
    again = merge.insert_or_ignore(merge.insert_or_ignore(stored, batch), batch)
    assert again.count() == 3


def test_repair(spark):
    items = seed.items(spark, [("s", 1, "a", "n", 1, -5, None, None), ("s", 2, "b", "n", 1, -7, None, None), ("s", 3, "c", "n", 1, 1, None, None), ("s", 4, "", "n", 1, 1, None, None)])
    found = spark.createDataFrame([("s", 1, "ok", "a", "n", 1, 9, None, None), ("s", 2, "missing", *(None,) * 6), ("s", 4, "error", *(None,) * 6)], "scope string, item_id long, status string, content_id string, name string, size long, duration long, performer string, title string")
    plan = quality.repair_plan(items, found)
    assert {r.item_id: r.step for r in plan.collect()} == {1: "update", 2: "delete", 4: "leave"}
    assert {r.item_id: r.duration for r in quality.repaired(items, plan).collect()} == {1: 9, 3: 1, 4: 1}
    cursors = spark.createDataFrame([("s", 1, -42)], "scope string, is_fully_synced int, newest_scanned_id long")
    assert quality.reset_cursors(cursors).first().newest_scanned_id == 0
    assert {r["check"]: r.n for r in quality.validate(items, cursors).collect()} == {"broken_rows": 3, "negative_cursors": 1, "repeated_keys": 0}


def test_exports(spark, tmp_path):
    items = seed.items(spark)
    main = items.where(items.scope == seed.MAIN)
    assert output.filenames(main).count() == 10 and output.cleaned_names(items).count() == 11
    assert {r.item_id for r in output.cleaned_tags(main).collect()} == {1, 2, 3, 4, 5, 8, 11}
    assert output.write_lines(output.filenames(main), "name", tmp_path / "a" / "x.txt") == 10
    assert not (tmp_path / "none.txt").exists() and output.write_lines(output.filenames(main.limit(0)), "name", tmp_path / "none.txt") == 0
    assert output.write_csv(output.cleaned_names(main).select("name", "cleaned"), tmp_path / "x.csv") == 10
    raw = (tmp_path / "x.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfname;cleaned")
    report = output.report_rows(items, groups.exact_groups(items), (("largest", 0.03), ("oldest", 0.0))).collect()
    assert {r.item_id for r in report if r.mark == "KEEP"} == {1, 3}
    assert output.sheet_names(["a" * 40, "a" * 40, "x/y"]) == ["a" * 31, "a" * 29 + "_2", "x_y"]


def test_message_projection(spark):
    from lakeloom.schema import MESSAGES

    audio = ("u", "f.mp3", 10, None, "P", "T")
    data = [("s", 1, False, False, audio, None), ("s", 2, True, False, audio, None), ("s", 3, False, False, None, ("d", "x.ogg", 5, "audio/ogg")), ("s", 4, False, False, None, ("d", "x.pdf", 5, "application/pdf")), ("s", 5, False, True, None, None)]
    got = {r.item_id: r for r in messages_as_items(spark.createDataFrame(data, MESSAGES)).collect()}
    assert set(got) == {1, 3} and got[1].duration == 0 and got[3].performer is None and got[3].duration == 0


def test_stream_is_idempotent_and_refreshes(spark, tmp_path):
    from lakeloom.schema import MESSAGES
    from lakeloom.streaming import ingest

    folder, at = str(tmp_path / "in"), str(tmp_path / "t")
    one = ("u", "old.mp3", 10, 5, None, None)
    spark.createDataFrame([("s", 1, False, False, one, None), ("s", 2, False, False, one, None)], MESSAGES).write.parquet(folder)

    def run(checkpoint, **options):
        ingest.ingest(ingest.read_messages(spark, folder, 1), at, str(tmp_path / checkpoint), **options).awaitTermination()
        return {r.item_id: r.name for r in ingest.current(spark, at).collect()}

    assert run("c") == {1: "old.mp3", 2: "old.mp3"} == run("c")
    new = ("u", "new.mp3", 10, 5, None, None)
    spark.createDataFrame([("s", 2, False, False, new, None), ("s", 3, False, False, new, None)], MESSAGES).write.mode("append").parquet(folder)
    assert run("c") == {1: "old.mp3", 2: "old.mp3", 3: "new.mp3"}
    # A refresh from a new checkpoint reads all files again; the table keeps what it has and takes the last files' fields.
    assert set(run("fresh", refresh=True, order=["name"]).items()) >= {(1, "old.mp3"), (3, "new.mp3")} and len(run("fresh", refresh=True)) == 3
    assert run("again") == run("again") and len(run("third")) == 3


def test_ingest_keeps_the_last_row_of_a_key_and_compacts(spark, tmp_path, monkeypatch):
    from lakeloom.schema import MESSAGES
    from lakeloom.streaming import ingest

    monkeypatch.setattr(ingest, "COMPACT", 2)
    folder, at = str(tmp_path / "in"), str(tmp_path / "t")
    for k in range(7):
        rows = [("s", i, False, False, (f"u{k}", f"{k}-{v}.mp3", 1, 1, None, None), None) for i in (0, k + 1) for v in range(2)]
        spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(folder)
        ingest.ingest(ingest.read_messages(spark, folder), at, str(tmp_path / "c"), refresh=True, order=["name"]).awaitTermination()
    got = {r.item_id: r.name for r in ingest.current(spark, at).collect()}
    assert got == {0: "6-1.mp3"} | {k + 1: f"{k}-1.mp3" for k in range(7)} and ingest.current(spark, at).count() == 8
    assert len(list((tmp_path / "t").glob("v*"))) <= 3


def test_config(tmp_path):
    assert parse_keep_priority([]) == ((("oldest", 0.0),), []) and parse_keep_priority([], True)[0] == (("newest", 0.0),)
    assert parse_keep_priority(["largest ~ 3%"])[0] == (("largest", 0.03), ("oldest", 0.0))
    assert len(parse_keep_priority(["x", "largest", "largest", "oldest ~ 2%", "longest ~", "shortest ~ 200%"])[1]) == 5
    path = tmp_path / "c.ini"
    path.write_text("[fuzzy_matching]\nthreshold = 0.8\n[core]\nkeep_priority = largest ~ 3%, newest\n[ignore_list]\nchat = 1, 2\n[ignore_regex]\n* = ^a\n  b,c\n")
    got = load_config(str(path), {"LAKELOOM_FUZZY_MATCHING__THRESHOLD": "0.7"}, {"fuzzy_matching.name_power": "2"})
    assert got.fuzzy.threshold == 0.7 and got.fuzzy.name_power == 2.0 and got.keep_priority == (("largest", 0.03), ("newest", 0.0))
    assert got.ignore_ids == (("chat", 1), ("chat", 2)) and got.ignore_patterns == (("*", "^a"), ("*", "b,c"))
    with pytest.raises(ConfigError) as e:
        load_config(None, {}, {"fuzzy_matching.weight_name": "0.9", "fuzzy_matching.threshold": "x", "nothing": "1"})
    assert len(str(e.value).splitlines()) == 3


def test_items_schema_has_the_payload():
    assert [f.name for f in ITEMS][2:] == list(PAYLOAD)
