from bisect import bisect_right
from collections import Counter

import pytest

import __spark_entry__ as entry

from lakeloom.llm import language_id as li

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_every_stage_works_on_what_is_left(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf_dir).cache()
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and ids
        if name != "sharding":
            assert after.columns == columns
        before = after
    assert before.count() == before.select("shard", "slot").distinct().count()


def test_stages_match_brute_force(spark, sf_dir):
    from test_decontamination import brute as contaminated
    from test_language_id import brute as languages
    from test_mixing_sharding import mixed_by_hand, sharded_by_hand
    from test_similarity_join import brute as components

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    firsts = {d for d, (_, top, _) in components(rows).items() if top == d}
    assert {r.doc_id for r in steps["near_duplicates"](spark, docs, sf_dir).collect()} == firsts
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    picked = li.sampled(docs.where(~li.held_out("doc_id")), text="text", lang="lang", doc_id="doc_id", sample=li.SAMPLE)
    least = li.least_scores(picked, li._learned(picked, li.LENGTH))
    read = {i: lang != "und" and score >= least[bisect_right(li.SIZES, size) - 1] for i, (_, lang, score, size) in languages([(r.doc_id, r.text, r.lang) for r in docs.collect()]).items()}
    assert {r.doc_id for r in steps["language"](spark, docs, sf_dir).collect()} == {i for i, x in read.items() if x}
    taken = mixed_by_hand([(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert Counter(r.doc_id for r in steps["mixing"](spark, docs, sf_dir).collect()) == +Counter(taken)
    hashes = {r.text or "": r.h for r in docs.selectExpr("text", "xxhash64(cast(coalesce(text, '') as binary)) as h").collect()}
    placed = {r.doc_id: (r.shard, r.slot) for r in steps["sharding"](spark, docs, sf_dir).collect()}
    assert placed == sharded_by_hand([(r.doc_id, r.text, r.source, r.lang) for r in docs.collect()], hashes)
    clean = {d for d, x in contaminated(rows, items).items() if not x[4]}
    assert {r.doc_id for r in steps["decontamination"](spark, docs, sf_dir).collect()} == clean


def test_a_run_leaves_the_last_stage_alone(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "checkpoint_dir", lambda _: str(tmp_path))
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert [p.name for p in tmp_path.glob("pipeline-*/*")] == ["sharding"]


def test_registered():
    assert len(corpus_pipeline.STAGES) == 5 and "pipeline" in entry.queries()
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(entry.oracle_sql()) <= set(entry.queries())
