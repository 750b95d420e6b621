from itertools import combinations

from pyspark.sql import functions as F

from lakeloom.config import FuzzyConfig
from lakeloom.operators import groups, pairs, score

CFG = FuzzyConfig(enable=True)
NAMES = ["alpha song 1.mp3", "alpha song 1.flac", "alpha sonk 1.mp3", "other tune 7.mp3", None]


def repeated(spark, times):
    """Five items of three durations, and copies of them whose ids alone differ; two rows have no id."""
    rows = [("s", k * 5 + i, f"c{i}" if i % 2 else None, n, 1000, [200, 200, 201, None, 200][i], None, None) for k in range(times) for i, n in enumerate(NAMES)]
    return spark.createDataFrame([*rows, *[("s", None, "c9", NAMES[0], 1000, 202, None, None)] * 2], "scope string, item_id long, content_id string, name string, size long, duration long, performer string, title string")


def test_equal_items_are_compared_once(spark):
    few, many = (score.chunk_pairs(repeated(spark, n), CFG).select("x.name_text", "y.name_text").distinct().count() for n in (2, 40))
    assert score.chunk_pairs(repeated(spark, 40), CFG).count() < 60 and few == many


def test_chunks_stand_for_all_pairs(spark, monkeypatch):
    for size in (128, 4):
        monkeypatch.setattr(pairs, "CHUNK", size)
        items = repeated(spark, 12)
        rows = [(r.item_id, r.duration or 0) for r in items.collect()]
        want = sorted((str(a), str(b)) for (a, d), (b, e) in ((p, q) for x, y in combinations(rows, 2) for p, q in ((x, y), (y, x))) if d <= e <= d + 3 and (d < e or (a is not None and b is not None and a < b)))
        joined = pairs.band_self_join(pairs.chunked(items.select("scope", "item_id", "duration")), 3, item_id="first", last="last")
        assert sorted((str(r[0]), str(r[1])) for r in pairs.spread(joined).collect()) == want
        assert pairs.band_pairs(items, 3).first().candidates == len(want)


def test_stars_tie_what_links_tie(spark, monkeypatch):
    monkeypatch.setattr(pairs, "CHUNK", 4)
    items = repeated(spark, 12).where("item_id is not null")
    part = lambda df: sorted((r.item_id, r.group_id) for r in df.collect())
    assert part(groups.fuzzy_groups(items, CFG)) == part(groups.fuzzy_groups(items, CFG, score.fuzzy_links(items, CFG)))


def metadata(spark):
    """Thirty items of one metadata, some without an id or twice, and others."""
    rows = [("s", i % 23 if i % 7 else None, None, None) for i in range(30)] + [("s", 50 + i, "n", None) for i in range(3)] + [(None, 60 + i, None, 5) for i in range(9)]
    return spark.createDataFrame([(s, i, "c", n, z, None, None, None) for s, i, n, z in rows], "scope string, item_id long, content_id string, name string, size long, duration long, performer string, title string")


def test_pieces_stand_for_all_metadata_pairs(spark, monkeypatch):
    items = metadata(spark)
    rows = [tuple(r[:2]) + tuple(r[3:]) for r in items.collect()]
    want = sorted((str(p[0]), p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[2:] == q[2:] and p[1] is not None and q[1] is not None and p[1] < q[1])
    for size in (1024, 4):
        monkeypatch.setattr(pairs, "PIECE", size)
        assert sorted((str(r.scope), r.a, r.b) for r in pairs.metadata_pairs(items).collect()) == want and want


def tasks_with_rows(df):
    return df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(bool).count()


def test_a_common_metadata_is_many_tasks_work(spark, monkeypatch):
    """One metadata for all items: the join on it was one task's work."""
    monkeypatch.setattr(pairs, "PIECE", 8)
    items = spark.range(200).selectExpr("'s' scope", "id item_id", "'c' content_id", "string(null) name", "0L size", "1L duration", "'p' performer", "string(null) title")
    found = pairs.metadata_pairs(items)
    assert found.count() == 200 * 199 // 2 and tasks_with_rows(found) > 2


def test_pairs_of_chunks_are_many_tasks_work(spark):
    """Small rows that spread to many must not be packed into one task, neither those of a band nor those that link."""
    items = repeated(spark, 40).selectExpr("concat(scope, pmod(item_id div 5, 40)) scope", "item_id", "content_id", "name", "size", "duration", "performer", "title")
    assert tasks_with_rows(score.chunk_pairs(items, CFG).select("threshold")) > 2
    assert tasks_with_rows(score.linked_chunks(items, CFG).select("score")) > 2


def test_edges_are_shown_before_they_spread(spark):
    """What is made of a link's scores is made once for two chunks, not for each of their edges."""
    items, made = repeated(spark, 40), spark.sparkContext.accumulator(0)

    def shown(edges):
        count = F.udf(lambda x: (made.add(1), x)[1], "double")
        return edges.withColumn("score", F.when(F.col("reason") == "fuzzy", count("score")).otherwise(F.col("score")))

    edges = [r for r in groups.fuzzy_edges(items, CFG, shown).collect() if r.reason == "fuzzy"]
    assert len(edges) > 1000 and sorted(map(str, edges)) == sorted(str(r) for r in groups.fuzzy_edges(items, CFG).collect() if r.reason == "fuzzy")
    assert made.value < len(edges) / 10
