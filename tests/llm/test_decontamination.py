import hashlib
import re

from lakeloom.llm import decontamination as dc


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({i: i + 32 for i in range(65, 91)})) if t else []


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = words(t)
        k = min(10, len(w))
        for j in range(max(0, len(w) - k + 1) if k else 0):
            grams.setdefault(tuple(w[j : j + k]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(g) for g in grams}:
            for j in range(len(w) - k + 1):
                if (at := grams.get(tuple(w[j : j + k]))) is not None:
                    hit |= set(range(j, j + k))
                    found |= {str(x) for x in at if x is not None}
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


DOCS = [
    (1, "Start. one two three four five six seven eight NINE ten eleven end"), (2, None), (3, ""), (4, "short Item here, and short item"), (5, "clean text of no interest"),
    (6, "one two three four five six seven eight nine"), (7, "ÉCOLE über 9lives"), (8, "école über 9lives"), (9, "w " * 20000 + "short-item"),
]
ITEMS = [(10, "one two three four five six seven eight nine ten eleven"), (9, "short item"), (9, "Short, item!"), (11, None), (12, " ... "), (None, "über 9lives"), (13, "one two three four five six seven eight nine ten")]


def frames(spark):
    return spark.createDataFrame([(*r, 0, "x") for r in DOCS], "doc_id long, text string, n_hit int, hits string"), spark.createDataFrame(ITEMS, "item_id long, text string")


def test_report(spark):
    docs, items = frames(spark)
    for size in (dc.BLOCK_BYTES, 40):
        got = {r.doc_id: tuple(r)[1:] for r in dc.report(docs, items, block_bytes=size).collect()}
        assert got == brute(DOCS, ITEMS)
    assert {r.n_hit for r in dc.report(docs, items.limit(0)).collect()} == {0}
    assert dc.report(docs.limit(0), items).count() == 0


def test_removal(spark):
    docs, items = frames(spark)
    assert {r.doc_id for r in dc.drop_documents(docs, items).collect()} == {2, 3, 5, 6}
    clean = dc.remove_spans(docs, items)
    assert clean.columns == docs.columns
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[1] == "Start.  end" and text[4] == " here, and " and text[2] is None and text[5] == DOCS[4][1] and text[7] == "ÉCOLE "


def test_whole_table(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {r.doc_id: tuple(r)[1:] for r in dc.report(docs, items).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()])
