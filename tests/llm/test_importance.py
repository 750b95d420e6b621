import numpy as np

from lakeloom.llm import importance as im
from lakeloom.llm.textcore import Roller


def test_kth_largest(spark):
    rng = np.random.default_rng(1)
    values = [int(x) for x in rng.integers(-(10**12), 10**12, 500)] + [5, 5, 5, None]
    df = spark.createDataFrame([(v,) for v in values], "k long")
    ranked = sorted((v for v in values if v is not None), reverse=True)
    for k in (1, 2, 100, len(ranked), 10_000):
        assert im.kth_largest(df, "k", k) == ranked[min(k, len(ranked)) - 1]
    assert im.kth_largest(df.where("false"), "k", 3) is None and im.kth_largest(df, "k", 0) is None


def test_weights_by_brute_force(spark):
    rows = [(1, "good words here"), (2, "bad ## words"), (3, None), (4, " "), (5, "good words here"), (6, "good " * 30000)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, log_weight double")
    target = spark.createDataFrame([(1, 1), (None, 2)], "doc_id long, text int")
    out = {r.doc_id: r for r in im.select(df, target, share=0.5).collect()}
    counts = lambda ids: sum(np.bincount(im.features(Roller(), t.encode(), im.BUCKETS), minlength=im.BUCKETS) for d, t in rows if t and d in ids)
    ratio = im.log_ratio(counts({1}), counts({1, 2, 4, 5, 6}))
    for d, t in rows:
        at = im.features(Roller(), (t or "").encode(), im.BUCKETS)
        assert out[d].n_grams == len(at) and abs(out[d].log_weight - ratio[at].sum() / max(1, len(at)) ** im.NORMALISE) < 1e-9
    assert not out[3].kept and not out[4].kept and sum(r.kept for r in out.values()) == 3
    best = sorted((r.gumbel_key for r in out.values() if r.n_grams), reverse=True)[:3]
    assert {r.gumbel_key for r in out.values() if r.kept} == set(best)
    assert im.select(df.limit(0), target).count() == 0
    assert {r.log_weight for r in im.select(df, target.limit(0)).collect()} == {0.0}


def test_separates_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = im.select(docs, labels.where("quality = 1")).join(labels, "doc_id").toPandas()
    assert out[out.quality == 1].log_weight.median() > out[out.quality == 0].log_weight.median()
