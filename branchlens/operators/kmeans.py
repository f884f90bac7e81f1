"""Grouped k-means (L1-L8, L4, D15f, D16f, G24, I14) as DataFrame jobs.

Every (group, k, start) model is fitted at the same time:

* points: blocks of about BLOCK_POINTS points of a group as flat arrays, dealt by
  the hash of their id, never collected;
* models: one row per group; ``state`` holds the centres of all its models one
  after the other, ``flags`` whether each is absent, moving or settled.

A pass joins every block to the models of its group (salted, so the blocks of a
hot group are many tasks), works on it with NumPy and combines what the blocks
of a task say about a group before anything is shuffled: a group sends one row
a task. Passes depend on each other only through the models, so several make
one job; its result is a table in the shared folder.

Seeding is oversampled and weighted by distance: a start begins with one point
and in each of ROUNDS passes takes OVERSAMPLE * k_max points at once, drawn
without replacement with odds in proportion to the squared distance to the
nearest point taken so far (the smallest of -ln(u) / d^2, u from the hash of the
point, so no total is needed). A last pass counts the points nearest to each
candidate, and the k centres of a start are the best of TRIES weighted k-means++
over these few candidates.

A Lloyd pass emits counts, sums and the farthest point. A model is settled once
its summed squared centre shift is <= tol. An empty cluster moves to the farthest
point, one a pass; where no point is off its centre it stays empty and counts as
a cluster of size 0. Equal distances go to the first centre. Lowest inertia wins.

Silhouette uses squared Euclidean distances (the definition of Spark ML's
``ClusteringEvaluator``), computed from per-cluster sufficient statistics in
O(n k); the exact Euclidean form needs all pairs inside a group, which is not
built.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import finite_or_null
from ..session import cut_lineage
from .quantiles import group_quantiles

BLOCK_POINTS = 2048               # points of a group that are held against its models together
SALTS = 8                         # join keys over which the blocks of a group are dealt
ROUNDS, OVERSAMPLE = 3, 2
TRIES = 2                         # k-means++ runs over the candidates of a start, the best one counts
CHAIN = 4                         # Lloyd passes in one job
ABSENT, MOVING, SETTLED = 0, 1, 2


# --------------------------------------------------------------- features (L1)
def feature_matrix(df: DataFrame, group: Sequence[str], id_col: str, features: Sequence[str],
                   clip_quantile: float = 0.01) -> DataFrame:
    """inf -> null, impute the group median, winsorise each feature at its
    group quantiles [q, 1-q] (linear interpolation), standardise with the
    group mean and population std (std 0 -> 1). Returns (group, id, x).

    Group statistics are aggregates joined back on the group key; medians and
    quantiles come from ``quantiles.group_quantiles``, which holds no group's
    values in one task."""
    g = list(group)
    x = df.select(*g, id_col, *[finite_or_null(F.col(f"`{f}`")).alias(f"f{i}") for i, f in enumerate(features)])
    p = len(features)
    names = [f"f{i}" for i in range(p)]
    x = cut_lineage(x)
    med = group_quantiles(x, g, names, [0.5])
    x = x.join(med, g).select(*g, id_col, *[F.coalesce(F.col(c), F.col(f"{c}_q")[0], F.lit(0.0)).alias(c) for c in names])
    if 0.0 < clip_quantile < 0.5:
        x = cut_lineage(x)
        qs = group_quantiles(x, g, names, [clip_quantile, 1.0 - clip_quantile])
        x = x.join(qs, g).select(*g, id_col, *[
            F.least(F.greatest(F.col(c), F.col(f"{c}_q")[0]), F.col(f"{c}_q")[1]).alias(c) for c in names])
    st = x.groupBy(*g).agg(*[F.avg(f"f{i}").alias(f"mu{i}") for i in range(p)],
                           *[F.stddev_pop(f"f{i}").alias(f"sd{i}") for i in range(p)])
    z = [((F.col(f"f{i}") - F.col(f"mu{i}"))
          / F.when(F.col(f"sd{i}") > 1e-12, F.col(f"sd{i}")).otherwise(F.lit(1.0))) for i in range(p)]
    return x.join(st, g).select(*g, id_col, F.array(*z).alias("x"))


# ------------------------------------------------------------ k-means
def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Layout:
    """Where the centres of (k, start) lie in a group's ``state``."""

    def __init__(self, ks: Sequence[int], starts: int, p: int, tol: float, seed: int):
        self.ks, self.starts, self.p, self.tol, self.seed = sorted(set(ks)), starts, p, tol, seed
        self.models = [(k, r) for k in self.ks for r in range(starts)]
        self.first = np.cumsum([0] + [k for k, _ in self.models])
        self.cells = int(self.first[-1])
        self.take = OVERSAMPLE * max(self.ks)
        self.n_cand = 1 + ROUNDS * self.take

    def of_k(self, k: int) -> tuple[int, slice]:
        """First model and cells of one k."""
        m = self.ks.index(k) * self.starts
        return m, slice(int(self.first[m]), int(self.first[m + self.starts]))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of points (n, p) to centres (..., p) as (n, ...)."""
    d = np.zeros((len(x), *c.shape[:-1]))
    for i in range(x.shape[1]):
        d += (x[:, i].reshape(-1, *[1] * (c.ndim - 1)) - c[..., i]) ** 2
    return d


def _seed_pass(turn: int):
    """The points a block offers as candidates of every start."""
    take = lambda lay: 1 if turn == 0 else lay.take

    def fresh(lay):
        n = take(lay)
        return np.full((lay.starts, n), np.inf), np.zeros((lay.starts, n, lay.p))

    def block(lay, acc, x, h, state, flags):
        cand = state.reshape(lay.starts, lay.n_cand, lay.p)[:, :1 + (turn - 1) * lay.take]
        for r in range(lay.starts):
            u = _mix(h ^ _mix(np.array([(lay.seed << 32) + (r << 8) + turn + 1], np.uint64)))
            key = -np.log((u.astype(np.float64) + 1.0) / 2.0 ** 64)
            if turn:
                d = _distances(x, cand[r])
                near = np.nanmin(np.where(np.isnan(d), np.inf, d), axis=1)
                key = np.where(near > 0, key / np.where(near > 0, near, 1.0), np.inf)
            keys, xs = np.concatenate([acc[0][r], key]), np.concatenate([acc[1][r], x])
            best = np.argsort(keys, kind="stable")[:take(lay)]
            acc[0][r], acc[1][r] = keys[best], xs[best]

    def merge(lay, accs, state, flags, n):
        keys, xs = np.concatenate([a[0] for a in accs], axis=1), np.concatenate([a[1] for a in accs], axis=1)
        out = state.reshape(lay.starts, lay.n_cand, lay.p).copy()
        at = 0 if turn == 0 else 1 + (turn - 1) * lay.take
        for r in range(lay.starts):
            best = np.argsort(keys[r], kind="stable")[:take(lay)]
            picked = np.where(np.isfinite(keys[r][best])[:, None], xs[r][best], np.nan)
            out[r, at:at + take(lay)] = picked
        return out.ravel(), flags, 0.0
    return fresh, block, merge


def _plus_plus(x: np.ndarray, w: np.ndarray, k: int, rng) -> np.ndarray:
    """Weighted greedy k-means++ over a few candidates, then Lloyd steps on
    them."""
    c = [x[rng.choice(len(x), p=w / w.sum())]]
    while len(c) < k:
        d = _distances(x, np.array(c)).min(axis=1)
        odds = w * d
        if odds.sum() <= 0:
            c.append(c[-1])
            continue
        tries = rng.choice(len(x), 2 + int(np.log(k)), p=odds / odds.sum())
        left = [(w * np.minimum(d, ((x - x[t]) ** 2).sum(axis=1))).sum() for t in tries]
        c.append(x[tries[int(np.argmin(left))]])
    c = np.array(c)
    for _ in range(3):
        at = _distances(x, c).argmin(axis=1)
        c = np.array([np.average(x[at == j], axis=0, weights=w[at == j]) if w[at == j].sum() > 0 else c[j] for j in range(k)])
    return c


def _weight_pass():
    """Points nearest to each candidate, and from them the first centres."""
    def fresh(lay):
        return (np.zeros((lay.starts, lay.n_cand)),)

    def block(lay, acc, x, h, state, flags):
        for r, cand in enumerate(state.reshape(lay.starts, lay.n_cand, lay.p)):
            d = _distances(x, cand)
            acc[0][r] += np.bincount(np.where(np.isnan(d), np.inf, d).argmin(axis=1), minlength=lay.n_cand)

    def merge(lay, accs, state, flags, n):
        weight, out = sum(a[0] for a in accs), np.zeros((lay.cells, lay.p))
        for m, (k, r) in enumerate(lay.models):
            if flags[m] == ABSENT:
                continue
            cand = state.reshape(lay.starts, lay.n_cand, lay.p)[r]
            real = ~np.isnan(cand[:, 0]) & (weight[r] > 0)
            rng = np.random.default_rng([lay.seed, k, r])
            tries = [_plus_plus(cand[real], weight[r][real], k, rng) for _ in range(TRIES)]
            costs = [(weight[r][real] * _distances(cand[real], c).min(axis=1)).sum() for c in tries]
            out[lay.first[m]:lay.first[m + 1]] = tries[int(np.argmin(costs))]
        return out.ravel(), flags, 0.0
    return fresh, block, merge


def _lloyd_pass(moves: bool = True):
    """Counts, squared distances and sums of every cluster, and the farthest
    point of every model. Without ``moves`` the centres stay and the result is
    the inertia of every model."""
    def fresh(lay):
        return np.zeros((lay.cells, lay.p + 2)), np.zeros((len(lay.models), lay.p + 1))

    def block(lay, acc, x, h, state, flags):
        c_all = state.reshape(lay.cells, lay.p)
        for k in lay.ks:
            m0, cells = lay.of_k(k)
            mine = np.flatnonzero(flags[m0:m0 + lay.starts] != ABSENT if not moves
                                  else flags[m0:m0 + lay.starts] == MOVING)
            if not len(mine):
                continue
            d = _distances(x, c_all[cells].reshape(lay.starts, k, lay.p)[mine])
            near, dist = d.argmin(axis=2), d.min(axis=2)
            at = (near + k * mine + cells.start).ravel()
            acc[0][:, 0] += np.bincount(at, minlength=lay.cells)
            acc[0][:, 1] += np.bincount(at, dist.ravel(), lay.cells)
            for i in range(lay.p):
                acc[0][:, 2 + i] += np.bincount(at, np.repeat(x[:, i], len(mine)), lay.cells)
            far = dist.argmax(axis=0)
            for m, f, v in zip(m0 + mine, far, dist[far, np.arange(len(mine))]):
                if v > acc[1][m, 0]:
                    acc[1][m] = [v, *x[f]]

    def merge(lay, accs, state, flags, n):
        total = sum(a[0] for a in accs)
        far = np.stack([a[1] for a in accs])
        far = far[far[:, :, 0].argmax(axis=0), np.arange(len(lay.models))]
        if not moves:
            return state, flags, np.add.reduceat(total[:, 1], lay.first[:-1])
        c = state.reshape(lay.cells, lay.p)
        new, flags = c.copy(), flags.copy()
        full = total[:, 0] > 0
        new[full] = total[full, 2:] / total[full, :1]
        for m in np.flatnonzero(flags == MOVING):
            mine = slice(lay.first[m], lay.first[m + 1])
            empty = np.flatnonzero(~full[mine])
            if len(empty) and far[m, 0] > 0:
                new[lay.first[m] + empty[0]] = far[m, 1:]
            elif ((new[mine] - c[mine]) ** 2).sum() <= lay.tol:
                flags[m] = SETTLED
        still = np.repeat(flags == ABSENT, [k for k, _ in lay.models])
        return np.where(still[:, None], c, new).ravel(), flags, 0.0
    return fresh, block, merge


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.offsets.to_numpy(), column.values.to_numpy()


def _run_pass(blocks: DataFrame, models: DataFrame, group: list[str], lay: Layout, kind) -> DataFrame:
    """One pass of all blocks over the models of their groups; returns the
    models it leads to."""
    fresh, block, merge = kind
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in models.select(*group).schema.fields)
    model_schema = f"{keys}, n long, state binary, flags binary, moving int, inertia array<double>"

    def partials(batches):
        held = {}
        for batch in batches:
            key_cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in group]
            (xo, xs), (ho, hs) = (_lists(batch.column(batch.schema.get_field_index(c))) for c in ("x", "h"))
            raw = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n", "state", "flags")}
            for i, key in enumerate(zip(*key_cols)):
                if key not in held:
                    held[key] = fresh(lay), raw["n"][i], raw["state"][i], raw["flags"][i]
                acc, _, state, flags = held[key]
                block(lay, acc, xs[xo[i]:xo[i + 1]].reshape(-1, lay.p), hs[ho[i]:ho[i + 1]].view(np.uint64),
                      np.frombuffer(state, np.float64), np.frombuffer(flags, np.int8))
        for key, (acc, n, state, flags) in held.items():
            yield pa.RecordBatch.from_pydict({**{c: [v] for c, v in zip(group, key)}, "n": [n], "state": [state],
                                              "flags": [flags], "acc": [[a.tobytes() for a in acc]]})

    def update(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        shapes = [a.shape for a in fresh(lay)]
        accs = [[np.frombuffer(b, np.float64).reshape(s) for b, s in zip(r["acc"], shapes)] for r in rows]
        state, flags, inertia = merge(lay, accs, np.frombuffer(rows[0]["state"], np.float64),
                                      np.frombuffer(rows[0]["flags"], np.int8), rows[0]["n"])
        inertia = [] if np.isscalar(inertia) else inertia.tolist()
        return pa.table({**{c: table[c].slice(0, 1) for c in group}, "n": pa.array([rows[0]["n"]], pa.int64()),
                         "state": pa.array([state.tobytes()], pa.binary()), "flags": pa.array([flags.tobytes()], pa.binary()),
                         "moving": pa.array([int((flags == MOVING).sum())], pa.int32()),
                         "inertia": pa.array([inertia], pa.list_(pa.float64()))})

    salted = models.select(*group, "n", "state", "flags", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return (blocks.drop("ids").join(salted, [*group, "salt"])
            .mapInArrow(partials, f"{keys}, n long, state binary, flags binary, acc array<binary>")
            .groupBy(*group).applyInArrow(update, model_schema))


def point_blocks(points: DataFrame, group: list[str], id_col: str, min_points: int = 1) -> DataFrame:
    """(group, salt, ids, h, x): blocks of a group's points, x one point after
    the other, for groups of at least ``min_points`` points."""
    sizes = points.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_points)
    h = F.xxhash64(F.col(id_col).cast("string"))
    b = (points.join(sizes, group).groupBy(*group, F.pmod(h, F.ceil(F.col("n") / BLOCK_POINTS)).alias("block"))
         .agg(F.sort_array(F.collect_list(F.struct(h.alias("h"), F.col(id_col).alias("id"), "x"))).alias("s")))
    return cut_lineage(b.select(*group, F.pmod("block", F.lit(SALTS)).cast("int").alias("salt"), F.col("s.id").alias("ids"),
                                F.col("s.h").alias("h"), F.flatten("s.x").alias("x")))


def fit_kmeans(points: DataFrame, group: Sequence[str], id_col: str, k_values: Sequence[int],
               starts: int = 8, max_iter: int = 300, tol: float = 1e-4, seed: int = 42,
               min_points: int = 2) -> tuple[DataFrame, DataFrame]:
    """Fit every (group, k, start) model with k <= n - 1, as in the reference's
    bounds check. Returns (models, points) where models = (group, k, r, n, centers,
    inertia, converged) and points is the cut-lineage points table."""
    g = list(group)
    pts = cut_lineage(points.select(*g, id_col, "x"))
    some = pts.select("x").first()
    lay = Layout(k_values, starts, len(some[0]) if some else 0, tol, seed)
    blocks = point_blocks(pts, g, id_col, min_points)
    model_ks = np.array([k for k, _ in lay.models])
    state = np.full(lay.starts * lay.n_cand * lay.p, np.nan).tobytes()

    def first(batches):
        for batch in batches:
            n = batch.column(batch.schema.get_field_index("n")).to_pylist()
            flags = [np.where(model_ks <= v - 1, MOVING, ABSENT).astype(np.int8).tobytes() for v in n]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([state] * len(n), pa.binary()), pa.array(flags, pa.binary())],
                                             names=[*batch.schema.names, "state", "flags"])

    sizes = pts.groupBy(*g).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_points)
    schema = T.StructType([*sizes.schema.fields, T.StructField("state", T.BinaryType()), T.StructField("flags", T.BinaryType())])
    models = sizes.mapInArrow(first, schema)
    for kind in (*[_seed_pass(t) for t in range(ROUNDS + 1)], _weight_pass()):
        models = _run_pass(blocks, models, g, lay, kind)
    models, settled, passes = cut_lineage(models), None, 0
    while passes < max_iter:
        at_rest = models.filter("moving = 0")
        settled = at_rest if settled is None else settled.unionByName(at_rest)
        models = models.filter("moving > 0")
        if not models.head(1):
            break
        for _ in range(min(CHAIN, max_iter - passes)):
            models = _run_pass(blocks, models, g, lay, _lloyd_pass())
            passes += 1
        models = cut_lineage(models)
    models = models if settled is None else models.unionByName(settled)
    done = cut_lineage(_run_pass(blocks, models, g, lay, _lloyd_pass(moves=False)))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pts.select(*g).schema.fields)

    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                flags, c = np.frombuffer(row["flags"], np.int8), np.frombuffer(row["state"], np.float64).reshape(-1, lay.p)
                at = [m for m in range(len(lay.models)) if flags[m] != ABSENT]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[f]] * len(at), batch.schema.field(f).type) for f in g]
                    + [pa.array([lay.models[m][0] for m in at], pa.int32()), pa.array([lay.models[m][1] for m in at], pa.int32()),
                       pa.array([row["n"]] * len(at), pa.int64()),
                       pa.array([c[lay.first[m]:lay.first[m + 1]].tolist() for m in at], pa.list_(pa.list_(pa.float64()))),
                       pa.array([row["inertia"][m] for m in at], pa.float64()), pa.array([bool(flags[m] == SETTLED) for m in at])],
                    names=[*g, "k", "r", "n", "centers", "inertia", "converged"])

    out = done.mapInArrow(rows, f"{keys}, k int, r int, n long, centers array<array<double>>, inertia double, converged boolean")
    return cut_lineage(out), pts


def assign(pts: DataFrame, models: DataFrame, group: Sequence[str], id_col: str) -> DataFrame:
    """Points with their nearest centre and squared distance for every model:
    (group, id, x, k, r, cluster, dist)."""
    g = list(group)
    blocks = point_blocks(pts, g, id_col)
    per = (models.groupBy(*g).agg(F.collect_list(F.struct("k", "r", "centers")).alias("models"))
           .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    fields = blocks.select(*g).schema.fields
    schema = T.StructType([*fields, T.StructField(id_col, blocks.schema["ids"].dataType.elementType),
                           T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("k", T.IntegerType()),
                           T.StructField("r", T.IntegerType()), T.StructField("cluster", T.IntegerType()),
                           T.StructField("dist", T.DoubleType())])

    def run(batches):
        for batch in batches:
            ids, (xo, xs) = batch.column(batch.schema.get_field_index("ids")), _lists(batch.column(batch.schema.get_field_index("x")))
            held = batch.column(batch.schema.get_field_index("models")).to_pylist()
            for i in range(batch.num_rows):
                mine = ids.slice(i, 1).flatten()
                flat, n = xs[xo[i]:xo[i + 1]], len(mine)
                p = len(flat) // n
                points = pa.ListArray.from_arrays(pa.array(np.arange(0, n * p + 1, p), pa.int32()), pa.array(flat))
                for m in held[i]:
                    d = _distances(flat.reshape(n, p), np.array(m["centers"], float))
                    at = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(batch.column(batch.schema.get_field_index(f.name))[i], n) for f in fields]
                        + [mine, points, pa.array(np.full(n, m["k"], np.int32)), pa.array(np.full(n, m["r"], np.int32)),
                           pa.array(at.astype(np.int32)), pa.array(d[np.arange(n), at])], names=schema.names)

    return blocks.join(per, [*g, "salt"]).select(*g, "ids", "x", "models").mapInArrow(run, schema)


def best_restart(models: DataFrame, group: Sequence[str]) -> DataFrame:
    """Lowest inertia per (group, k); ties -> smallest restart index."""
    g = list(group)
    return (models.groupBy(*g, "k")
            .agg(F.min_by(F.struct("r", "centers", "inertia", "n", "converged"), F.struct("inertia", "r")).alias("b"))
            .select(*g, "k", "b.r", "b.centers", "b.inertia", "b.n", "b.converged"))


def silhouette(assigned: DataFrame, group: Sequence[str]) -> DataFrame:
    """Mean silhouette per (group, k) with squared Euclidean distances from
    per-cluster sums: for point i and cluster c,
    sum_j |x_i - x_j|^2 = n_c |x_i|^2 - 2 x_i.S_c + Q_c.
    Own cluster divides by n_c - 1; singleton clusters score 0; a model with a
    single non-empty cluster gets NULL."""
    g = list(group)
    nx = F.aggregate(F.col("x"), F.lit(0.0), lambda s, v: s + v * v)
    a = assigned.withColumn("sq", nx)
    some = a.select("x").first()
    p = len(some[0]) if some else 0
    stats = (a.groupBy(*g, "k", "cluster")
             .agg(F.count(F.lit(1)).alias("nc"), F.sum("sq").alias("qc"),
                  *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(p)])
             .select(*g, "k", F.struct("cluster", "nc", "qc",
                                       F.array(*[F.col(f"s{i}") for i in range(p)]).alias("sc")).alias("st")))
    per_model = stats.groupBy(*g, "k").agg(F.collect_list("st").alias("sts"))
    j = a.join(per_model, [*g, "k"])

    def dsum(e):
        return e["nc"] * F.col("sq") - 2 * F.aggregate(F.zip_with(F.col("x"), e["sc"], lambda u, v: u * v),
                                                       F.lit(0.0), lambda s, v: s + v) + e["qc"]
    own = F.filter("sts", lambda e: e["cluster"] == F.col("cluster"))[0]
    others = F.transform(F.filter("sts", lambda e: e["cluster"] != F.col("cluster")),
                         lambda e: dsum(e) / e["nc"])
    ai = F.when(own["nc"] > 1, dsum(own) / (own["nc"] - 1))
    bi = F.array_min(others)
    si = (F.when(F.size(others) == 0, F.lit(None).cast("double"))
          .when(own["nc"] <= 1, F.lit(0.0))
          .otherwise(F.when(F.greatest(ai, bi) > 0, (bi - ai) / F.greatest(ai, bi)).otherwise(F.lit(0.0))))
    return j.groupBy(*g, "k").agg(F.avg(si).alias("silhouette"))


def k_scores(assigned: DataFrame, models_best: DataFrame, group: Sequence[str]) -> DataFrame:
    """Diagnostics per (group, k): inertia, silhouette, min/max cluster size
    and ratio (L5, L8, G24); a cluster without points has size 0."""
    g = list(group)
    sizes = (assigned.groupBy(*g, "k", "cluster").agg(F.count(F.lit(1)).alias("size"))
             .groupBy(*g, "k").agg(F.when(F.count(F.lit(1)) < F.col("k"), F.lit(0)).otherwise(F.min("size"))
                                   .alias("min_cluster_size"), F.max("size").alias("max_cluster_size")))
    sil = silhouette(assigned, g)
    return (models_best.select(*g, "k", "inertia", "n", "converged").join(sil, [*g, "k"]).join(sizes, [*g, "k"])
            .withColumn("min_cluster_ratio", F.col("min_cluster_size") / F.col("n"))
            .withColumn("max_cluster_ratio", F.col("max_cluster_size") / F.col("n")))


def choose_k(scores: DataFrame, group: Sequence[str], min_cluster_ratio: float = 0.05,
             forced_k: int | None = None) -> DataFrame:
    """selected = the forced k, else among candidates with
    min_cluster_ratio >= t (all when none qualifies) the highest silhouette,
    NULLs last, then the smallest k (D16f, I14, C14)."""
    g = list(group)
    if forced_k is not None:
        valid = sorted(r[0] for r in scores.select("k").distinct().collect())   # |K| values
        if forced_k not in valid:
            raise ValueError(f"Forced k={forced_k} is outside evaluated range. Valid: {valid}")   # I15
        return scores.withColumn("selected", F.col("k") == forced_k)
    ok = F.col("min_cluster_ratio") >= min_cluster_ratio
    any_ok = F.max(ok.cast("int")).over(Window.partitionBy(*g))
    cand = scores.withColumn("cand", ok | (any_ok == 0))
    w = Window.partitionBy(*g).orderBy(F.desc("cand"), F.desc_nulls_last("silhouette"), "k")
    return cand.withColumn("selected", F.row_number().over(w) == 1).drop("cand")
