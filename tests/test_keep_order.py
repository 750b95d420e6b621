import numpy as np

from lakeloom.operators import survivor

LEVELS = [("largest", True, 0.1), ("shortest", False, 0.05), ("oldest", False, 0.0)]


def by_rows(columns, levels):
    """The cascade, repeated for every row."""
    left, ranks = np.arange(len(columns[0])), np.zeros(len(columns[0]), int)
    for place in range(len(ranks)):
        pool = left
        for values, (_, largest, tolerance) in zip(columns, levels, strict=True):
            here = values[pool]
            if len(pool) > 1 and not np.isnan(here).all():
                best = np.nanmax(here) if largest else np.nanmin(here)
                pool = pool[np.abs(here - best) <= abs(best) * tolerance]
        ranks[pool[0]] = place
        left = left[left != pool[0]]
    return ranks


def test_order_of_a_group_by_repeated_cascade():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        ids = np.sort(rng.choice(500, n, replace=False)).astype(float)
        columns = [rng.integers(1, 60, n).astype(float) for _ in range(2)]
        for c in columns:
            c[rng.random(n) < 0.2] = np.nan
        for last in (("oldest", False, 0.0), ("newest", True, 0.0)):
            levels = [*LEVELS[:2], last]
            assert survivor.group_order([*columns, ids], levels).tolist() == by_rows([*columns, ids], levels).tolist()


def test_the_cascade_is_repeated_for_values_not_for_rows(monkeypatch):
    n, calls = 20_000, []
    columns = [np.repeat([100.0, 95.0, np.nan, 10.0], n // 4), np.tile([3.0, 4.0], n // 2), np.arange(n, dtype=float)]
    largest = np.nanmax
    monkeypatch.setattr(np, "nanmax", lambda v: calls.append(1) or largest(v))
    assert sorted(survivor.group_order(columns, LEVELS)) == list(range(n)) and len(calls) <= 8


def test_groups_that_go_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = [("s" if i % 5 else None, i, i % 3, 100 + i % 11, 10 + i % 4) for i in range(200)]
    members = spark.createDataFrame(rows, "scope string, item_id long, group_id long, size long, duration long")
    found = survivor.keep_order(members, (("largest", 0.1), ("shortest", 0.05), ("oldest", 0.0))).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in range(3):
        rows_of = sorted((r for r in found if r.scope == "s" and r.group_id == g), key=lambda r: r.item_id)
        columns = [np.array([getattr(r, c) for r in rows_of], float) for c in ("size", "duration", "item_id")]
        assert rows_of and [r.keep_rank for r in rows_of] == by_rows(columns, LEVELS).tolist()
