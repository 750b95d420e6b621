import duckdb

from lakeloom.llm import oracle, quality_rules as qr

TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two three " * 40), (5, "\n".join(["the same line of words"] * 30)), (6, "the cat # & of * and % it\n" * 2 + "- bullet\n* bullet\nmore...\nend… "),
    (7, " ".join(f"w{i} the" for i in range(100))), (8, "über x y z \x1c a"), (9, "a b c a b"), (10, "x " * 60000), (7, "repeated id"),
]


def test_matches_sql_on_edge_cases(spark):
    df = spark.createDataFrame([(*r, True) for r in TEXTS], "doc_id long, text string, kept boolean")
    got = df.transform(qr.judge).toPandas()
    documents = df.select("doc_id", "text").toPandas()  # noqa: F841
    want = duckdb.sql(oracle.SQL["op9_quality_rules"].replace("FROM documents", "FROM (SELECT row_number() OVER () AS doc_id, text FROM documents)")).df()
    key = lambda d: sorted(map(tuple, d[[c for c in sorted(d.columns) if c != "doc_id"]].astype(str).to_numpy()))
    assert key(got) == key(want)
    assert df.limit(0).transform(qr.judge).count() == 0


def test_is_native(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = qr.judge(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_repeated_windows(spark):
    df = spark.createDataFrame([(1, "a b c x a b c y"), (2, "a a a a"), (3, "a b a b")], "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in qr.measures(df).collect()} == {1: 6, 2: 4, 3: 0}
