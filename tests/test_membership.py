import pytest

from lakeloom.llm import similarity_join as sj
from lakeloom.operators import membership
from lakeloom.plans.runtime import cut


@pytest.mark.parametrize("limits", [{}, {"BROADCAST_IDS": 3}, {"BROADCAST_IDS": 3, "BITS": 1}, {"BROADCAST_IDS": 3, "BITMAP_IDS": 10}])
def test_rows_in_and_not_in_a_list(spark, monkeypatch, limits):
    """Short lists, bitmaps, bitmaps of many false hits and lists too long for them."""
    for name, value in limits.items():
        monkeypatch.setattr(membership, name, value)
    rows = spark.createDataFrame([(None if i == 7 else i % 1500, f"t{i}") for i in range(2000)], "`an id` long, words0 string")
    ids = cut(rows.where("`an id` % 3 = 0").selectExpr("`an id` as x").distinct())
    known = rows.select("`an id`")
    inside, outside = (membership.among(rows, "an id", ids, known, out=out) for out in (False, True))
    assert inside.columns == rows.columns
    assert sorted(r[1] for r in inside.collect()) == sorted(f"t{i}" for i in range(2000) if i != 7 and i % 1500 % 3 == 0)
    assert sorted(r[1] for r in outside.collect()) == sorted(f"t{i}" for i in range(2000) if i == 7 or i % 1500 % 3)


def test_a_long_list_of_copies_deals_no_texts(spark, monkeypatch):
    """More ids than are broadcast: the texts stay where they are, and the same ones go."""
    docs = spark.createDataFrame([(i, f"word{i % 40} " * 3 + f"end{i % 40}") for i in range(400)], "doc_id long, text string")
    monkeypatch.setattr(membership, "BROADCAST_IDS", 100)
    left = sj.one_of_each(docs)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in left.collect()) == list(range(40))
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
