import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import mixing, ranking, sharding

ROWS = [(i, "w " * (i % 17), f"s{i % 5}") for i in range(300)] + [(300, None, "s1"), (301, "", None), (302, "a b", None), (303, None, "empty"), (302, "a b", None)]


def frame(spark):
    return spark.createDataFrame([(*r, "en", 7) for r in ROWS], "doc_id long, text string, source string, lang string, size int")


def water(sizes, weights, total, cap):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda x: (x is None, x))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, capped, left = {}, set(), total * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        share = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if share * w[s] > cap * sizes[s]]
        if not over:
            return target | {s: share * w[s] for s in free}
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
            capped.add(s)


def mixed_by_hand(rows):
    """Copies by doc_id of rows (doc_id, text, source) with ids of their own."""
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    by = {}
    for i, _, s in rows:
        by.setdefault(s, []).append((sizes[i], i))
    whole = {s: sum(n for n, _ in x) for s, x in by.items()}
    target, out = water(whole, mixing.WEIGHTS, mixing.TOTAL, mixing.CAP), {}
    for s, x in by.items():
        each = target[s] / whole[s] if whole[s] else 0
        u = int(hashlib.md5((f"{mixing.SEED}:" + ("" if s is None else "=" + s)).encode()).hexdigest()[:8], 16) / 2**32
        for rank, (_, i) in enumerate(sorted(x)):
            out[i] = min(math.floor(u + (rank + 1) * each) - math.floor(u + rank * each), mixing.CAP)
    return out


def sharded_by_hand(rows, hashes):
    """(shard, slot) by doc_id of rows (doc_id, text, source, lang) with ids of their own, and hashes of their texts."""
    size = {i: len((t or "").encode()) + 1 for i, t, _, _ in rows}
    n, most = len(rows), 1 << sharding.BITS

    def number_cells(values):
        edges = [sorted(values)[max(0, math.ceil(k / most * n) - 1)] for k in range(1, most)]
        return [sum(e <= v for e in edges) for v in values]

    def text_cells(values):
        counts, upto, cell = Counter(v for v in values if v is not None), 0, {}
        total = sum(counts.values())
        for v in sorted(counts):
            cell[v] = upto * most // total
            upto += counts[v]
        return [cell.get(v, 0) for v in values]

    cells = np.array([text_cells([r[3] for r in rows]), text_cells([r[2] for r in rows]), number_cells([size[r[0]] for r in rows])]).T
    index = sharding.hilbert_index(cells, sharding.BITS).tolist()
    groups = {}
    for (i, t, _, _), x in zip(rows, index, strict=True):
        groups.setdefault(t or "", []).append((x, i))
    order = sorted((min(x for x, _ in g), hashes[t], i, t) for t, g in groups.items() for _, i in g)
    quota = [(s + 1) * n // sharding.SHARDS - s * n // sharding.SHARDS for s in range(sharding.SHARDS)]
    first = {}
    for rank, (_, _, _, t) in enumerate(order):
        first.setdefault(t, rank)
    shards, loose = [[] for _ in quota], []
    for _, _, i, t in order:
        k = len(groups[t])
        home = (2 * first[t] + k) * sharding.SHARDS // (2 * n)
        if 1 < k <= max(n // sharding.SHARDS, 1) and len(shards[home]) < quota[home]:
            shards[home].append(i)
        else:
            loose.append(i)
    for s, q in zip(shards, quota, strict=True):
        k = q - len(s)
        s += loose[:k]
        del loose[:k]
    return {i: (s, slot) for s, ids in enumerate(shards) for slot, i in enumerate(ids)}


def test_targets_and_taken(spark):
    out = mixing.report(frame(spark)).join(frame(spark).select("doc_id", "source").distinct(), "doc_id").collect()
    sizes = Counter()
    for _, t, s in ROWS:
        sizes[s] += len((t or "").split())
    want = water(sizes, mixing.WEIGHTS, mixing.TOTAL, mixing.CAP)
    taken = Counter()
    for r in out:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    assert len(out) == len(ROWS)
    for s, n in sizes.items():
        assert abs(taken[s] - want[s]) <= 2 * 17
    again = mixing.report(frame(spark).repartition(7)).collect()
    key = lambda rows: sorted((r.doc_id, r.size, r.taken) for r in rows)
    assert key(again) == key(out)
    assert mixing.report(frame(spark).limit(0)).count() == 0


def test_mix_repeats_rows(spark):
    df = frame(spark)
    copies = Counter({r.doc_id: 0 for r in df.collect()})
    for r in mixing.copies(df).collect():
        copies[r.doc_id] += r.copies
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == +copies


def test_rank_is_a_rank(spark):
    df = frame(spark).select("doc_id", "source")
    got = ranking.ranked(df, ["doc_id"], "source").collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append((r.rank, r.doc_id))
    for rows in by.values():
        rows.sort()
        assert [x for x, _ in rows] == list(range(len(rows))) and [d for _, d in rows] == sorted(d for _, d in rows)


def test_running_sums_and_targets_of_many_sources(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.randrange(50), rng.randrange(9)) for i in range(500)], "id long, k long, v long")
    got = {r.id: r.before for r in ranking.running(df, ["k", "id"], {"before": "v"}).collect()}
    total = 0
    for r in sorted(df.collect(), key=lambda r: (r.k, r.id)):
        assert got[r.id] == total
        total += r.v
    sizes = {f"s{i:03d}": rng.randrange(1, 1000) for i in range(400)} | {None: 50}
    out = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    want = water(sizes, mixing.WEIGHTS, mixing.TOTAL, mixing.CAP)
    assert len(out) == 401 and all(r.target == pytest.approx(want[r.source]) for r in out)


def test_hilbert_curve_visits_all_cells_by_steps_of_one():
    for dims, bits in ((2, 3), (3, 2), (3, 3)):
        axes = np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")
        cells = np.stack([a.ravel() for a in axes], axis=1)
        index = sharding.hilbert_index(cells, bits)
        assert sorted(index) == list(range(len(cells)))
        path = cells[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark):
    df = frame(spark)
    out = sharding.shards(df).collect()
    text = {d: t or "" for d, t, _ in ROWS}
    by = {}
    for r in out:
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    few = sharding.shards(df.limit(3)).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0] and len({r.shard for r in few}) == 3
    assert sharding.shards(df.limit(0)).count() == 0
    whole = sharding.assign(df)
    assert whole.columns == ["doc_id", "text", "source", "lang", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted((r.shard, r.slot) for r in whole.collect()) == sorted((r.shard, r.slot) for r in out)


def test_a_filter_on_any_dimension_reads_fewer_shards_than_at_random(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("text", F.concat(F.col("doc_id").cast("string"), "text"))
    placed = sharding.assign(docs)
    mixed = placed.withColumn("shard", (F.hash("doc_id") % 4 + 4).cast("int"))

    def files_read(rows, name, test):
        rows.repartition(8, "shard").write.partitionBy("shard").parquet(str(tmp_path / name))
        spans = spark.read.parquet(str(tmp_path / name)).groupBy("shard").agg(F.min("lang").alias("a"), F.max("lang").alias("b"), F.min("size").alias("c"), F.max("size").alias("d"))
        return spans.where(test).count() / spans.count()

    sizes = sorted(r.size for r in placed.select("size").collect())
    for i, test in enumerate(["a <= 'de' and b >= 'de'", f"d >= {sizes[-len(sizes) // 20]}"]):
        assert files_read(placed, f"curve{i}", test) <= 0.75 * files_read(mixed, f"random{i}", test)


def test_shards_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    rows = [tuple(r) for r in docs.collect()]
    hashes = {r.text or "": r.h for r in docs.selectExpr("text", "xxhash64(cast(coalesce(text, '') as binary)) as h").collect()}
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.shards(docs).collect()} == sharded_by_hand(rows, hashes)


def test_equal_texts_share_a_shard(spark):
    """Groups of copies over all sources: whole unless larger than a shard; each shard within one row of the others."""
    sizes = [2] * 60 + [5] * 40 + [40] * 3 + [300]
    texts = [f"copy {g} " + "w " * (g % 30) for g, n in enumerate(sizes) for _ in range(n)] + [f"single {i} " + "w " * (i % 30) for i in range(300)] + [None, "", None]
    rows = [(i, t, f"s{i * 7 % 5}", "abcd"[i * 3 % 4]) for i, t in enumerate(texts)]
    out = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    by, slots = {}, {}
    for r in out:
        by.setdefault(texts[r.doc_id] or "", []).append(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    parted = {t: Counter(x) for t, x in by.items() if len(set(x)) > 1}
    assert len(by["copy 103 " + "w " * 13]) == 300 and len(parted) <= 2, parted
    only = sharding.shards(spark.createDataFrame([(i, "same", "s", "en") for i in range(20)], "doc_id long, text string, source string, lang string")).collect()
    assert sorted(Counter(r.shard for r in only).values()) == [2, 2, 2, 2, 3, 3, 3, 3]


def test_texts_of_equal_first_bytes_get_cells_of_their_own(spark):
    rows = [(i, f"{i:04d} " + "w " * (i % 50), f"https://site_{i * 7 % 16:02d}.example", "en") for i in range(1600)] + [(1600, "w", None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    names = sorted({r[2] for r in rows if r[2]})
    assert sharding.text_edges(df, "source", 16) == [(n, i + 1) for i, n in enumerate(names[:-1])]
    assert sharding.text_edges(df.where("source is null"), "source", 16) == []
    few = spark.createDataFrame([(x,) for x in "a" * 20 + "b" * 60 + "c" * 20], "source string")
    assert sharding.text_edges(few, "source", 4) == [("b", 3)]
    whole = sharding.assign(df, dimensions=("source", "size"))
    assert whole.select("shard", "source").where("source is not null").distinct().count() <= 72  # of 128 pairs, all if sources had no cells
