"""Ridge LOOCV closed form vs refits, k-means and silhouette vs numpy."""

import numpy as np
from pyspark.sql import functions as F

from branchlens.operators import kmeans as km
from branchlens.operators import ridge as rg


def test_ridge_loocv_equals_refits(spark):
    """Two groups and two penalties in one fit against refits without each row."""
    rng = np.random.default_rng(0)
    data = {}
    for g, n in (("a", 12), ("b", 9)):
        x = rng.normal(size=(n, 3)) * [1.0, 50.0, 0.0 if g == "b" else 1.0] + 5
        data[g] = x, x @ np.array([1.0, -2.0, 0.5]) + rng.normal(size=n) * 0.1
    rows = [(g, [float(v) for v in r], float(t)) for g, (x, y) in data.items() for r, t in zip(x, y)]
    df = spark.createDataFrame(rows, "g string, x array<double>, y double")
    scale, models, scores, chosen = rg.fit_ridge_loocv(df, ["g"], 3, [0.1, 1.0])
    got = {(r["g"], r["alpha"]): r["loocv_rmse"] for r in scores.collect()}
    beta = {(r["g"], r["alpha"]): r["beta"] for r in models.collect()}
    for g, (x, y) in data.items():
        sd = np.where(x.std(0) > 0, x.std(0), 1)
        z = np.c_[np.ones(len(x)), (x - x.mean(0)) / sd]
        for alpha in (0.1, 1.0):
            p = np.diag([0.0, alpha, alpha, alpha])
            assert np.allclose(np.linalg.solve(z.T @ z + p, z.T @ y), beta[(g, alpha)])
            left = [y[i] - z[i] @ np.linalg.solve(z[k].T @ z[k] + p, z[k].T @ y[k])
                    for i in range(len(y)) for k in [np.arange(len(y)) != i]]
            assert abs(np.sqrt(np.mean(np.square(left))) - got[(g, alpha)]) < 1e-9
    assert {r["g"]: r["alpha"] for r in chosen.collect()} == {g: min((got[(g, a)], a) for a in (0.1, 1.0))[1] for g in data}
    out = rg.predict(df, scale, models.filter("alpha = 1.0"), ["g"])
    assert out.count() == len(rows) and out.filter("abs(predicted - y) > 100").count() == 0


def test_ridge_of_one_row_and_none(spark):
    import pytest
    df = spark.createDataFrame([("a", [1.0, 2.0], 3.0)], "g string, x array<double>, y double")
    _, _, scores, chosen = rg.fit_ridge_loocv(df, ["g"], 2, [0.5, 2.0])
    assert {r["loocv_rmse"] for r in scores.collect()} == {None} and chosen.first()["alpha"] == 0.5
    with pytest.raises(ValueError):
        rg.fit_ridge_loocv(df.where("false"), ["g"], 2, [0.5])


def test_kmeans_and_silhouette(spark):
    rng = np.random.default_rng(1)
    pts = np.r_[rng.normal(0, 0.1, size=(20, 2)), rng.normal(5, 0.1, size=(20, 2))]
    df = spark.createDataFrame([("g", f"p{i}", [float(x), float(y)]) for i, (x, y) in enumerate(pts)],
                               "branch string, Product string, x array<double>")
    models, p2 = km.fit_kmeans(df, ["branch"], "Product", [2], starts=2, max_iter=10)
    a = km.assign(p2, km.best_restart(models, ["branch"]), ["branch"], "Product").drop("r")
    lab = {r["Product"]: r["cluster"] for r in a.collect()}
    assert len({lab[f"p{i}"] for i in range(20)}) == 1
    assert len({lab[f"p{i}"] for i in range(20, 40)}) == 1
    assert lab["p0"] != lab["p20"]
    sil = km.silhouette(a, ["branch"]).first()["silhouette"]
    # brute force, squared Euclidean
    L = np.array([lab[f"p{i}"] for i in range(40)])
    D = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(40):
        own = L == L[i]
        ai = D[i, own].sum() / (own.sum() - 1)
        bi = D[i, ~own].mean()
        s.append((bi - ai) / max(ai, bi))
    assert abs(np.mean(s) - sil) < 1e-9


def _lloyd(x, c):
    while True:
        at = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        new = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
        if ((new - c) ** 2).sum() <= 1e-4:
            return ((x[:, None] - new[None]) ** 2).sum(-1).min(1).sum()
        c = new


def test_kmeans_runs_to_convergence(spark, monkeypatch):
    from branchlens.plans import clustering as cl
    monkeypatch.setattr(km, "BLOCK_POINTS", 50)
    rng = np.random.default_rng(7)
    x = {b: rng.normal(size=(n, 3)) * rng.integers(1, 4, size=(n, 1)) for b, n in (("a", 170), ("b", 40))}
    df = spark.createDataFrame([(b, f"p{i}", [float(v) for v in row]) for b, m in x.items() for i, row in enumerate(m)],
                               "branch string, Product string, x array<double>")
    models, _ = km.fit_kmeans(df, ["branch"], "Product", [4, 7], starts=cl.STARTS, max_iter=cl.MAX_ITER)
    rows = models.collect()
    assert len(rows) == 2 * 2 * cl.STARTS and all(r["converged"] for r in rows)
    for r in rows:
        c, pts = np.array(r["centers"]), x[r["branch"]]
        d = ((pts[:, None] - c[None]) ** 2).sum(-1)
        assert abs(d.min(1).sum() - r["inertia"]) < 1e-9
        at = d.argmin(1)
        again = np.array([pts[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
        assert ((again - c) ** 2).sum() <= 1e-3
    for b, k in (("a", 4), ("a", 7), ("b", 4), ("b", 7)):
        best = min(r["inertia"] for r in rows if (r["branch"], r["k"]) == (b, k))
        other = min(_lloyd(x[b], x[b][rng.choice(len(x[b]), k, replace=False)]) for _ in range(80))
        assert best <= 1.01 * other


def test_kmeans_empty_clusters_count(spark):
    """Two places, six clusters: four stay empty and have size 0; an empty table
    gives empty results."""
    rows = [("g", f"p{i}", [float(i % 2), 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "branch string, Product string, x array<double>")
    models, pts = km.fit_kmeans(df, ["branch"], "Product", [2, 6], starts=3)
    best = km.best_restart(models, ["branch"])
    scores = {r["k"]: r for r in km.k_scores(km.assign(pts, best, ["branch"], "Product"), best, ["branch"]).collect()}
    assert (scores[2]["min_cluster_size"], scores[2]["inertia"]) == (20, 0.0)
    assert (scores[6]["min_cluster_size"], scores[6]["min_cluster_ratio"], scores[6]["inertia"]) == (0, 0.0, 0.0)
    none = df.where("false")
    models, pts = km.fit_kmeans(none, ["branch"], "Product", [2])
    best = km.best_restart(models, ["branch"])
    assert models.count() == 0
    assert km.k_scores(km.assign(pts, best, ["branch"], "Product"), best, ["branch"]).count() == 0


def test_kmeans_empty_cluster_moves_to_the_farthest_point(spark):
    """One Lloyd pass over centres of which one attracts nothing."""
    lay = km.Layout([3], 1, 1, 1e-4, 1)
    fresh, block, merge = km._lloyd_pass()
    state, flags = np.array([0.0, 1.0, 500.0]), np.array([km.MOVING], np.int8)
    acc = fresh(lay)
    block(lay, acc, np.array([[0.0], [0.2], [1.0], [9.0]]), None, state, flags)
    new, flags, _ = merge(lay, [acc], state, flags, 4)
    assert new.tolist() == [0.1, 5.0, 9.0] and flags.tolist() == [km.MOVING]


def test_seeding_beats_plain_starts(spark):
    """Well separated clusters of very different sizes, which plain starts miss."""
    rng = np.random.default_rng(12)
    x = np.r_[rng.normal(0, 1, (900, 2)), *[rng.normal(c, 0.1, (12, 2)) for c in ((30, 0), (30, 8), (0, 40), (-35, 9))]]
    df = spark.createDataFrame([("g", f"p{i}", [float(v) for v in row]) for i, row in enumerate(x)],
                               "branch string, Product string, x array<double>")
    models, _ = km.fit_kmeans(df, ["branch"], "Product", [5], starts=8)
    best = km.best_restart(models, ["branch"]).first()["inertia"]
    plain = min(_lloyd(x, x[rng.choice(len(x), 5, replace=False)]) for _ in range(80))
    assert best <= 1.001 * plain


def test_group_quantiles(spark, monkeypatch):
    """Equal to ``percentile`` with brackets that need many rounds, ties, nulls,
    null keys, negative values and values far apart."""
    from branchlens.operators import quantiles as gq
    monkeypatch.setattr(gq, "LEAF", 5)
    monkeypatch.setattr(gq, "BINS", 8)
    rng = np.random.default_rng(5)
    rows = [("a", float(v), float(-v)) for v in rng.lognormal(0, 6, 500)]
    rows += [("b", float(v), None) for v in rng.integers(0, 4, 300)] + [(None, float(2.0 ** i), 1.0) for i in range(-60, 60)]
    rows += [("c", None, -1e308), ("c", None, 1e308), ("d", 3.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    qs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["g"]: (r["x_q"], r["y_q"]) for r in gq.group_quantiles(df, ["g"], ["x", "y"], qs).collect()}
    want = df.groupBy("g").agg(F.percentile("x", qs).alias("x"), F.percentile("y", qs).alias("y")).collect()
    assert len(want) == len(got) == 5
    for r in want:
        for a, b in zip(got[r["g"]], (r["x"], r["y"])):
            assert (a is None) == (b is None) and (a is None or np.allclose(a, b, rtol=1e-14, atol=0))
    assert gq.group_quantiles(df.where("false"), ["g"], ["x"], [0.5]).count() == 0


def test_sinks_roundtrip(spark, tmp_path):
    from branchlens import sinks
    df = spark.createDataFrame([("b1", 1, 2.0), ("b2", 2, 1.0), ("b1", 3, 0.5)], "branch string, K int, v double")
    sinks.write_facts(df, str(tmp_path / "facts"))
    assert spark.read.parquet(str(tmp_path / "facts")).filter("branch = 'b1'").count() == 2
    sinks.write_sorted(df, str(tmp_path / "sorted"), ["v"], fmt="csv", partitions=2)
    got = spark.read.option("header", True).csv(str(tmp_path / "sorted")).count()
    assert got == 3
    sinks.write_by_k(df, str(tmp_path / "byk"))
    assert spark.read.parquet(str(tmp_path / "byk")).filter("K = 2").count() == 1
    sinks.write_chosen_k(spark.createDataFrame([(10,)], "k int"), str(tmp_path / "k"))
    assert spark.read.parquet(str(tmp_path / "k")).first()[0] == 10
    sinks.require_columns(df, ["branch", "v"])
    import pytest
    with pytest.raises(ValueError):
        sinks.require_columns(df, ["nope"])
    with pytest.raises(FileNotFoundError):
        sinks.require_paths(spark, [str(tmp_path / "absent")])
