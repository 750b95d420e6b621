import random

from pyspark.sql import functions as F

from lakeloom.llm import line_dedup as ld

TEXT = "doc_id long, text string, r string, _kept_chunks string, n_removed int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", "k", 1) for i, t in rows], TEXT)


def by_chunks(spark, rows):
    """Kept lines by (doc_id, text), by brute force from the boundaries: rows (doc_id, hash of the text, text)."""
    texts = sorted({(i is not None, i or 0, h, t) for i, h, t in rows if t is not None})
    df = spark.createDataFrame([(k, t) for k, (*_, t) in enumerate(texts)], "k long, text string")
    cuts = {r.k: r.b for r in df.select("k", ld.boundaries(F.split("text", "\n", -1)).alias("b")).collect()}
    first, kept = {}, {}
    for k, (known, i, _, t) in enumerate(texts):
        lines, gone = t.split("\n"), set()
        for s, e in zip(cuts[k], cuts[k][1:], strict=False):
            body = tuple(lines[s : e + 1])
            if not "".join(body).strip(" \t\n\r\x0b\x0c"):
                continue
            j, at = first.setdefault(body, (k, s))
            if (j, at) == (k, s):
                continue
            other, up, down = texts[j][-1].split("\n"), 0, 0
            # No further than the neighbouring chunks of both.
            top, end = max((x for x in cuts[k] if x < s), default=s), min((x for x in cuts[k] if x > e), default=e)
            top_2, end_2 = max((x for x in cuts[j] if x < at), default=at), min((x for x in cuts[j] if x > at + e - s), default=at + e - s)
            while s - up > top and at - up > top_2 and lines[s - up - 1] == other[at - up - 1]:
                up += 1
            while e + down < end and at + e - s + down < end_2 and lines[e + down + 1] == other[at + e - s + down + 1]:
                down += 1
            gone |= set(range(s - up, e + down + 1))
        kept[i if known else None, t] = [x for n, x in enumerate(lines) if n not in gone]
    return kept


def check(spark, df, got=None):
    want = by_chunks(spark, [(r.doc_id, r.h, r.text) for r in df.selectExpr("doc_id", "xxhash64(text) as h", "text").collect()])
    got = ld.dedup_lines(df.select("*", df.text.alias("whole")), removed="gone").collect()
    assert len(got) == df.count()
    for r in got:
        assert r.text == (None if r.whole is None else "\n".join(want[r.doc_id, r.whole]))
        assert r.gone == (0 if r.whole is None else r.whole.count("\n") + 1 - len(want[r.doc_id, r.whole]))


def words(rng, n):
    return [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(4)) for _ in range(n)]


def test_boundaries_do_not_shift(spark):
    """A passage has the same boundaries, but for those that lines around it decide, wherever it stands."""
    rng = random.Random(1)
    shared = words(rng, 60)
    rows = [(i, "\n".join(words(rng, i) + shared + words(rng, 3))) for i in range(8)]
    cuts = [{x - r.doc_id for x in r.b} for r in frame(spark, rows).select("doc_id", ld.boundaries(F.split("text", "\n", -1)).alias("b")).orderBy("doc_id").collect()]
    inside = [{x for x in c if ld.SPAN - 1 <= x < 60} for c in cuts]
    assert all(c == inside[0] for c in inside) and len(inside[0]) > 40


def test_passages_go_whole_and_the_rest_stays(spark):
    rng = random.Random(3)
    whole = 0
    for n in [*range(3, 11)] * 2:
        shared = words(rng, n)
        rows = []
        for i in range(4):
            own = words(rng, 4)
            at = rng.randint(0, 4)
            rows.append((i, "\n".join(own[:at] + shared + own[at:])))
        out = {r.doc_id: r for r in ld.dedup_lines(frame(spark, rows), removed="gone").collect()}
        assert out[0].text == rows[0][1] and out[0].gone == 0
        for i, text in rows[1:]:
            assert out[i].text.split("\n") in ([x for x in text.split("\n") if x not in shared], text.split("\n")) and out[i].gone in (0, n)
        whole += out[1].gone == n
    assert whole >= 13  # 16 passages of 3 to 10 lines


def test_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.randint(0, 40), "\n".join(rng.choice(["a", "b", "c", "d", "", " "] + [f"w{rng.randint(0, 40)}"] * 6) for _ in range(rng.randint(1, 25)))) for _ in range(60)]
    rows += [(i, "\n".join(rng.choice("abcd ") for _ in range(rng.randint(1, 25)))) for i in range(60, 100)]
    rows += [(1, None), (2, ""), (3, "\n\n\n"), rows[0], (50, "x\n" * 3000), (None, "a\nb\nc"), (None, None)]
    check(spark, frame(spark, rows))


def test_whole_table_by_brute_force(spark, sf_dir):
    check(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "\n\n\n"), (4, "a\nb"), (None, "a\nb"), (4, "a\nb"), (5, "x\n" * 30000)]
    df = frame(spark, rows)
    out = ld.report(df)
    assert out.count() == len(rows)
    assert {(r.n_lines, r.n_chars) for r in out.where("doc_id = 1").collect()} == {(0, 0)} and out.where("doc_id = 2").first().n_lines == 1
    assert ld.report(df.limit(0)).count() == 0
    kept = ld.dedup_lines(df)
    assert kept.columns == df.columns and "Python" not in kept._jdf.queryExecution().toString()
    assert sorted((r.doc_id or 0, r.text) for r in kept.where("doc_id is null or doc_id = 4").collect()) == [(0, "a\nb"), (4, ""), (4, "")]
