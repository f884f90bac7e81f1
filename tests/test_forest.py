"""Level-wise histogram forests: exact splits, no leak from held-out rows, and the
same trees however the rows lie."""

import numpy as np

from branchlens.operators import forest as fo


def _table(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.where(x[:, 0] > 0, 10.0, 0.0) + np.where(x[:, 1] > 0.5, 3.0, 0.0) + rng.normal(size=n) * 0.1
    rows = [(f"r{i}", *[float(v) for v in x[i]], float(y[i]), float(-y[i]), i % 4 if i % 10 else None) for i in range(n)]
    rows[3] = ("r3", None, float("nan"), float("inf"), *rows[3][4:])
    return spark.createDataFrame(rows, "id string, a double, b double, c double, y double, z double, fold int"), x, y


SETS = {"two": ["a", "b"], "all": ["a", "b", "c"]}


def _fit(df, **kw):
    got = fo.fit_forests(df, "id", ["a", "b", "c"], ["y", "z"], "fold", SETS, 4, trees=60, **kw)
    return {(r["target"], r["feature_set"], r["held"], r["id"]): r["prediction"] for r in got.collect()}


def test_forests(spark, monkeypatch):
    df, _, y = _table(spark)
    got = _fit(df)
    folds = {r["id"]: r["fold"] for r in df.collect()}
    assert set(got) == {(t, s, h, i) for t in ("y", "z") for s in SETS for i, f in folds.items()
                        for h in {-1, f} if h is not None}
    held = np.array([got[("y", "all", f, i)] for i, f in folds.items() if f is not None])
    real = np.array([y[int(i[1:])] for i, f in folds.items() if f is not None])
    assert np.sqrt(np.mean((held - real) ** 2)) < 0.75 * real.std()
    # targets are independent of each other, so the mirrored one gives mirrored trees
    assert all(abs(v + got[("z", "two", 1, k[3])]) < 9 for k, v in got.items() if k[:3] == ("y", "two", 1))
    # other blocks, other partitions: the same trees
    monkeypatch.setattr(fo, "BLOCK_ROWS", 7)
    monkeypatch.setattr(fo, "HELD_CELLS", 50)
    again = _fit(df.repartition(5))
    assert set(again) == set(got) and all(abs(again[k] - v) < 1e-9 for k, v in got.items())


def test_held_out_rows_do_not_leak(spark):
    from pyspark.sql import functions as F
    df, _, _ = _table(spark)
    a = _fit(df)
    b = _fit(df.withColumn("y", F.when(F.col("fold") == 2, F.col("y") + 1000).otherwise(F.col("y"))))
    assert all(a[k] == v for k, v in b.items() if k[0] == "y" and k[2] == 2)
    assert any(a[k] != v for k, v in b.items() if k[0] == "y" and k[2] == 1)


def test_best_split():
    """Unit weights and one feature: the split with the least squared error."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, fo.BINS, (80, 1)).astype(np.uint8), rng.normal(size=80)
    task, ids, trees = fo.Task(0, 0, (0,), -1), np.array([5], np.uint64), fo.Trees(1)
    fo.split(trees, task, ids, *fo.counts(trees, task, ids, x, y, np.ones((80, 1)), 0, 1), 0, 1)
    errors = {}
    for c in range(fo.BINS):
        left, right = y[x[:, 0] <= c], y[x[:, 0] > c]
        if min(len(left), len(right)) >= fo.MIN_LEAF:
            errors[c] = ((left - left.mean()) ** 2).sum() + ((right - right.mean()) ** 2).sum()
    assert abs(errors[int(trees.cut[0, 0])] - min(errors.values())) < 1e-9
    assert abs(trees.value[0, 0] - y.mean()) < 1e-12


def test_poisson_weights():
    rows, trees = fo._mix(np.arange(3000, dtype=np.uint64)), np.arange(20, dtype=np.uint64)
    w = fo.poisson(rows, trees, 42)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and abs((w == 0).mean() - np.exp(-1)) < 0.01
