import random
import re
from itertools import combinations

import pytest

from lakeloom.llm import similarity_join as sj


def brute(rows, threshold=85):
    """Expected (n_shingles, component, links) by doc_id, from all pairs."""
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({i: i + 32 for i in range(65, 91)})) if t else []
        sets[d] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    label, links = {d: d for d in sets}, dict.fromkeys(sets, 0)

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = top(a), top(b)
            label[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d), links[d]) for d in sets}


def corpus(seed, bases, copies, edits, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 4)))
    rows = []
    for _ in range(bases):
        base = [word() for _ in range(rng.randint(1, length))]
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "bases", "copies", "edits", "length", "small"), [(1, 40, 4, 3, 200, 24), (2, 2, 60, 4, 150, 4), (3, 60, 3, 1, 12, 24)])
def test_finds_every_link(spark, monkeypatch, seed, bases, copies, edits, length, small):
    monkeypatch.setattr(sj, "BLOCK_SETS", 20)
    rows = corpus(seed, bases, copies, edits, length)
    got = sj.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), small=small).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == brute(rows)


def test_clusters_that_share_classes_are_not_united(spark):
    """A chain of buckets, each sharing a class with the next: one cluster a bucket, not one of all, and buckets of one leader together."""
    buckets = {1: range(1, 6), 2: range(5, 10), 3: range(9, 14), 4: [1, 2, 14]}
    rows = spark.createDataFrame([(x, min(b)) for b in buckets.values() for x in b], "id long, leader long")
    found = {}
    for r in sj.clusters(rows).collect():
        assert r.clusters == sorted(set(r.clusters))
        for c in r.clusters:
            found.setdefault(c, set()).add(r.dense_id)
    assert sorted(map(sorted, found.values())) == [[1, 2, 3, 4, 5, 14], [5, 6, 7, 8, 9], [9, 10, 11, 12, 13]]


def test_pairs_of_several_clusters_count_once(spark, monkeypatch):
    monkeypatch.setattr(sj, "BLOCK_SETS", 20)
    rows = corpus(5, 4, 30, 12, 90)
    got = sj.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), small=1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one  TWO"), (6, "a b c d"), (None, "a b c d"), (7, "A b c d"), (8, "É b c d"), (9, "é b c d"), (10, "x " * 30000), (11, "x " * 20000)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n_links int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in sj.similar_classes(df).collect()}
    assert got == {1: (0, 1, 0), 2: (0, 2, 0), 3: (0, 3, 0), 4: (1, 4, 1), 5: (1, 4, 1), 6: (1, 6, 1), None: (1, None, 0), 7: (1, 6, 1), 8: (1, 8, 0), 9: (1, 9, 0), 10: (1, 10, 1), 11: (1, 10, 1)}
    assert sj.similar_classes(df.limit(0)).count() == 0
    twice = {(r.doc_id, r.component_id, r.n_links) for r in sj.similar_classes(df.where("doc_id = 6").unionAll(df.where("doc_id = 6"))).collect()}
    assert twice == {(6, 6, 0)}


def test_ids_of_other_types_and_looser_thresholds(spark, monkeypatch):
    monkeypatch.setattr(sj, "BLOCK_SETS", 20)
    rows = corpus(4, 3, 40, 4, 60)
    named = [(f"d{i:03d}", t) for i, t in rows]
    df = spark.createDataFrame(named, "doc_id string, text string")
    for small in (4, 24):
        assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in sj.similar_classes(df, small=small).collect()} == brute(named)
    half = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in sj.similar_classes(df, numerator=50).collect()}
    assert half == brute(named, 50)


def test_texts_of_one_document(spark):
    rows = [(5, "a b c d e"), (5, "p q r s t"), (7, "a b c d e"), (3, "P q r s t"), (9, "u v w x"), (9, "u v w x"), (None, "u v w x"), (5, None)]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in sj.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 2, 3, 1), (7, 2, 3, 1), (3, 2, 3, 1), (9, 1, 9, 0), (None, 1, None, 0), (5, 0, 5, 0)}


def test_one_of_each_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", "x", 1), (2, "A b c d", "y", 2), (3, "e", "z", 3)], "doc_id long, text string, dropped string, `a.b` int")
    out = sj.one_of_each(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_repetitive_words_are_told_apart():
    """Words on which polynomial hashes modulo 2 ** 64 collide."""
    signs = b"a"
    for _ in range(12):
        signs += signs.translate(bytes.maketrans(b"ab", b"ba"))
    other = signs.translate(bytes.maketrans(b"ab", b"ba"))
    a, b = sj.ngram_sets([signs, other], 4)
    assert len(a) == len(b) == 1 and a[0] != b[0]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in sj.similar_classes(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
