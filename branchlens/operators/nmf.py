"""Branch x group revenue shares (G15, J4, K18) and sparse non-negative matrix
factorisation X ~ W H (L25-L27), with the pattern read-outs (H13-H16, K17).

X is long (row, col, x) and stays sparse: absent cells are zeros and enter only
through algebra. All models - every K with every start - are fitted together: a
row (column) has one vector with the factors of all models side by side. Both
factors are tables of blocks of about ``BLOCK`` rows (columns), and X is a table of
(row block, column block) cells, so

* X H^T: a block of cells is multiplied with its columns' vectors inside the task,
  and the partial products meet at their row block (one cogroup);
* the K x K matrices H H^T are sums over blocks and the only thing, besides one
  error term per model, that passes through the driver, like a centroid table;
* W is updated block by block: ``SWEEPS`` passes of coordinate descent over its
  non-negative least squares problem, then extrapolated along its last step.

The error needs no cell of W H: |X - WH|^2 = |X|^2 - 2 <X^T W, H> + <W^T W, H H^T>.
A step that raises a model's error is taken back and its extrapolation is
shortened. Every half step is a table in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK = 1024
SWEEPS = 10
#: Extrapolation weight: first value, growth while errors fall, cut when one rises.
WEIGHT, GROW, GROW_CAP, CUT = 0.5, 1.1, 1.05, 1.5


def group_shares(facts: DataFrame, branch: str = "branch", group: str = "grp", amount: str = "price") -> DataFrame:
    """Revenue of every (branch, group) and its share of the branch total
    (G15, F4): rows without a branch or amount are dropped (D9f); a NULL
    group counts in the branch total."""
    f = facts.filter(F.col(branch).isNotNull() & F.col(amount).isNotNull())
    g = f.groupBy(branch, group).agg(F.sum(amount).alias("TotalAmount"))
    t = g.groupBy(branch).agg(F.sum("TotalAmount").alias("branch_total"))
    return g.join(t, branch).withColumn("rev_share", F.col("TotalAmount") / F.col("branch_total"))


def l1_normalise(long: DataFrame, branch: str = "branch", value: str = "x") -> DataFrame:
    """Row-wise L1 normalisation (K18); rows already summing to 1 stay."""
    t = long.groupBy(branch).agg(F.sum(F.abs(value)).alias("_l1"))
    return long.join(t, branch).withColumn(value, F.when(F.col("_l1") > 0, F.col(value) / F.col("_l1"))
                                           .otherwise(F.col(value))).drop("_l1")


def in_blocks(keys: DataFrame, key: str) -> DataFrame:
    """(key, block, at, size): distinct keys dealt into blocks by their hash and
    numbered within the block."""
    keys = keys.select(F.col(key).alias("key")).distinct()
    n_blocks = max(1, -(-keys.count() // BLOCK))
    w = Window.partitionBy("block")                       # bounded: one block
    return cut_lineage(keys.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)))
                       .withColumn("at", F.row_number().over(w.orderBy("key")) - 1)
                       .withColumn("size", F.count(F.lit(1)).over(w).cast("int")))


_FACTOR = "block long, size int, cur binary, new binary, ext binary, stats array<double>"


class Models:
    """Layout of the models in a vector: for every K, ``starts`` slices of K."""

    def __init__(self, ks, starts: int):
        self.ks, self.starts = list(ks), starts
        self.width = starts * sum(self.ks)
        self.first = dict(zip(self.ks, np.cumsum([0] + [starts * k for k in self.ks[:-1]]).tolist()))

    def stack(self, m: np.ndarray, k: int) -> np.ndarray:
        """(starts, rows, k) of the models of one K."""
        part = m[:, self.first[k]:self.first[k] + self.starts * k]
        return part.reshape(len(m), self.starts, k).transpose(1, 0, 2)

    def put(self, m: np.ndarray, k: int, stack: np.ndarray) -> None:
        m[:, self.first[k]:self.first[k] + self.starts * k] = stack.transpose(1, 0, 2).reshape(len(m), -1)

    def grams(self, m: np.ndarray) -> np.ndarray:
        """W^T W of every model, one after the other."""
        return np.concatenate([np.einsum("snk,snl->skl", x, x).ravel() for x in (self.stack(m, k) for k in self.ks)])

    def dots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([(self.stack(a, k) * self.stack(b, k)).sum(axis=(1, 2)) for k in self.ks])

    def gram_of(self, flat: np.ndarray, k: int) -> np.ndarray:
        at = sum(self.starts * j * j for j in self.ks[:self.ks.index(k)])
        return flat[at:at + self.starts * k * k].reshape(self.starts, k, k)

    def mask(self, per_model: np.ndarray) -> np.ndarray:
        """A value per model as a value per vector place."""
        return np.concatenate([np.repeat(per_model[i * self.starts:(i + 1) * self.starts], k) for i, k in enumerate(self.ks)])

    def update(self, a: np.ndarray, gram: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Coordinate descent on min |X - m H|, m >= 0, with a = X H^T."""
        out = m.copy()
        for k in self.ks:
            x, ax, g = self.stack(m, k).copy(), self.stack(a, k), self.gram_of(gram, k)
            for _ in range(SWEEPS):
                for j in range(k):
                    d = g[:, j, j][:, None]
                    step = (ax[:, :, j] - np.einsum("snk,sk->sn", x, g[:, :, j])) / np.where(d > 0, d, 1.0)
                    x[:, :, j] = np.where(d > 0, np.maximum(x[:, :, j] + step, 0.0), x[:, :, j])
            self.put(out, k, x)
        return out


def _matrix(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, width)


def _factor_rows(block, size, cur, new, ext, stats) -> dict:
    return {"block": [block], "size": pa.array([size], pa.int32()), "cur": [cur.tobytes()], "new": [new.tobytes()],
            "ext": [ext.tobytes()], "stats": [stats]}


def _start(keys: DataFrame, models: Models, scale: float, seed: int) -> DataFrame:
    """Random factors in (0.1, 1) x scale; a block's numbers depend on its number."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                m = np.random.default_rng([seed, row["block"]]).uniform(0.1, 1.0, (row["size"], models.width))
                # models of different K get different scales, so that W H starts near X
                m *= scale / np.sqrt(models.mask(np.repeat(np.array(models.ks, float), models.starts)))
                yield pa.RecordBatch.from_pydict(_factor_rows(row["block"], row["size"], m, m, m, models.grams(m)))
    return cut_lineage(keys.select("block", "size").distinct().mapInArrow(run, _FACTOR))


def _half(cells: DataFrame, fixed: DataFrame, moved: DataFrame, models: Models, sides: tuple[str, str], pick, keep,
          gram: np.ndarray, beta: np.ndarray, closing: bool) -> DataFrame:
    """One half step: ``moved`` is updated against ``fixed`` (``sides``: the
    column names of their blocks and places in ``cells``). ``pick(row)`` is the
    fixed matrix in use, ``keep(row)`` the accepted and the starting matrix."""
    own, other = sides
    width = models.width

    def products(batches):
        for batch in batches:
            for row in batch.to_pylist():
                f = pick(row)
                own_at, other_at, x = (np.array(row[c]) for c in (f"{own}_at", f"{other}_at", "x"))
                order = np.argsort(own_at, kind="stable")
                out = np.zeros((int(own_at.max()) + 1, width))
                for at in range(0, len(order), 4096):
                    part = order[at:at + 4096]
                    places, first = np.unique(own_at[part], return_index=True)
                    out[places] += np.add.reduceat(f[other_at[part]] * x[part, None], first, axis=0)
                yield pa.RecordBatch.from_pydict({"block": [row[own]], "part": [out.tobytes()]})

    def update(parts: pa.Table, state: pa.Table) -> pa.Table:
        row = state.to_pylist()[0]
        a = np.zeros((row["size"], width))
        for raw in parts["part"].to_pylist():
            m = _matrix(raw, width)
            a[:len(m)] += m
        cur, at = keep(row)
        new = models.update(a, gram, at)
        ext = np.maximum(new + models.mask(beta) * (new - cur), 0.0)
        new = new if closing else ext
        stats = np.concatenate([models.dots(a, new), models.grams(new), models.grams(ext)]) if closing else models.grams(ext)
        return pa.table(_factor_rows(row["block"], row["size"], cur, new, ext, stats))

    parts = (cells.join(fixed.select(F.col("block").alias(other), "cur", "new", "ext"), other)
             .mapInArrow(products, "block long, part binary"))
    return cut_lineage(parts.groupBy("block").cogroup(moved.withColumnRenamed("block", "home").groupBy("home"))
                       .applyInArrow(lambda p, s: update(p, s.rename_columns({"home": "block"})), _FACTOR))


def _total(factor: DataFrame) -> np.ndarray:
    rows = (factor.select(F.posexplode("stats").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v"))
            .orderBy("pos").collect())                    # K^2 numbers a model
    return np.array([r["v"] for r in rows])


def fit_nmf(x: DataFrame, row: str, col: str, value: str, ks, starts: int = 8, max_iter: int = 40, tol: float = 1e-4,
            seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fit every K of ``ks`` from ``starts`` random starts on the non-negative
    cells of ``x``. Returns, for the best start of every K, W = (K, row, pattern,
    weight), H = (K, pattern, col, weight), and metrics (K, Reconstruction_Error,
    Pseudo_R2, iterations, converged), where converged means that the last five
    iterations lowered the error by less than ``tol`` of it."""
    models = Models(ks, starts)
    n = len(models.ks) * starts
    x = cut_lineage(x.select(F.col(row).alias("row"), F.col(col).alias("col"), F.col(value).cast("double").alias("x")))
    rows, cols = in_blocks(x, "row"), in_blocks(x, "col")
    sums = x.agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).first()
    if not sums["q"]:
        raise ValueError("nothing to factorise: the matrix has no non-zero cell")
    scale = float(np.sqrt(sums["s"] / (rows.count() * cols.count())))
    r = rows.select(F.col("key").alias("row"), F.col("block").alias("r"), F.col("at").alias("r_at"))
    c = cols.select(F.col("key").alias("col"), F.col("block").alias("c"), F.col("at").alias("c_at"))
    cells = (x.where("x <> 0").join(r, "row").join(c, "col").groupBy("r", "c")
             .agg(F.sort_array(F.collect_list(F.struct("r_at", "c_at", "x"))).alias("s")))
    cells = cut_lineage(cells.select("r", "c", *[F.col(f"s.{v}").alias(v) for v in ("r_at", "c_at", "x")]))
    w, h = _start(rows, models, scale, seed), _start(cols, models, scale, seed + 1)

    width = models.width
    ok = np.ones(n, bool)
    gram_h = gram_kept = _total(h)
    best, beta, cap = np.full(n, np.inf), np.full(n, WEIGHT), np.ones(n)
    history = []
    for _ in range(max_iter):
        taken = models.mask(ok)

        def resolve(row, a="new", taken=taken):
            return np.where(taken, _matrix(row[a], width), _matrix(row["cur"], width))
        w = _half(cells, h, w, models, ("r", "c"), lambda row: resolve(row, "ext"),
                  lambda row: (resolve(row),) * 2, gram_h, beta, False)
        gram_w = _total(w)
        h = _half(cells, w, h, models, ("c", "r"), lambda row: _matrix(row["new"], width),
                  lambda row: (resolve(row), resolve(row, "ext")), gram_w, beta, True)
        stats = _total(h)
        size = (len(stats) - n) // 2
        dots, new, ext = stats[:n], stats[n:n + size], stats[n + size:]
        both, at = [], 0
        for k in models.ks:
            a, b = models.gram_of(gram_w, k), models.gram_of(new, k)
            both += (a * b).sum(axis=(1, 2)).tolist()
        error = np.sqrt(np.maximum(sums["q"] - 2 * dots + np.array(both), 0.0))
        ok = error <= best
        best = np.where(ok, error, best)
        beta, cap = (np.where(ok, np.minimum(cap, GROW * beta), beta / CUT),
                     np.where(ok, np.minimum(1.0, GROW_CAP * cap), beta))
        # per model: the Gram matrix of the columns' factor in use next
        in_use = np.concatenate([np.repeat(ok[i * starts:(i + 1) * starts], k * k) for i, k in enumerate(models.ks)])
        gram_h, gram_kept = np.where(in_use, ext, gram_kept), np.where(in_use, new, gram_kept)
        history.append(best.copy())
        if len(history) > 5 and (history[-6] - best <= tol * best).all():
            break
    taken = models.mask(ok)
    settled = (history[-6] - best <= tol * best) if len(history) > 5 else np.zeros(n, bool)
    winner = {k: int(best[i * starts:(i + 1) * starts].argmin()) for i, k in enumerate(models.ks)}

    def long(batches):
        for batch in batches:
            for row in batch.to_pylist():
                m = np.where(taken, _matrix(row["new"], width), _matrix(row["cur"], width))
                for k in models.ks:
                    part = models.stack(m, k)[winner[k]]
                    at, j = np.indices(part.shape)
                    yield pa.RecordBatch.from_pydict({
                        "K": pa.array(np.full(part.size, k, np.int32)), "block": pa.array(np.full(part.size, row["block"])),
                        "at": pa.array(at.ravel().astype(np.int32)), "j": pa.array(j.ravel().astype(np.int32)),
                        "weight": pa.array(part.ravel())})

    def named(factor, keys, name):
        out = factor.mapInArrow(long, "K int, block long, at int, j int, weight double").join(keys, ["block", "at"])
        return out.select("K", F.concat(F.lit("Pattern_"), F.col("j").cast("string")).alias("pattern"),
                          F.col("key").alias(name), "weight")

    metrics = []
    for i, k in enumerate(models.ks):
        e = float(best[i * starts + winner[k]])
        metrics.append((k, e, 1.0 - e * e / sums["q"], len(history), bool(settled[i * starts + winner[k]])))
    table = x.sparkSession.createDataFrame(
        metrics, "K int, Reconstruction_Error double, Pseudo_R2 double, iterations int, converged boolean")
    return named(w, rows, row), named(h, cols, col), table


def dominant(weights: DataFrame, key: str = "branch", pattern: str = "pattern", weight: str = "weight") -> DataFrame:
    """argmax pattern per key and its weight, first pattern on ties."""
    best = F.min_by(F.struct(F.col(weight).alias("w"), F.col(pattern).alias("p")),
                    F.struct(-F.col(weight), F.col(pattern)))
    return (weights.groupBy(key).agg(best.alias("b"))
            .select(key, F.col("b.p").alias("Dominant_Pattern"), F.col("b.w").alias("Dominant_Weight")))


def entropy(weights: DataFrame, key: str = "branch", weight: str = "weight") -> DataFrame:
    """Shannon entropy (natural log) of the L1-normalised weights, 0 log 0 = 0."""
    t = weights.groupBy(key).agg(F.sum(weight).alias("_t"))
    p = weights.join(t, key).withColumn("_p", F.try_divide(F.col(weight), F.col("_t")))
    return p.groupBy(key).agg((-F.sum(F.when(F.col("_p") > 0, F.col("_p") * F.log(F.col("_p"))).otherwise(0.0)))
                              .alias("Entropy"))


def top_n(weights: DataFrame, part: str, item: str, weight: str, n: int) -> DataFrame:
    """Rank items inside each ``part`` by weight desc, item asc; keep n."""
    w = Window.partitionBy(part).orderBy(F.desc(weight), item)
    return weights.withColumn("Rank", F.row_number().over(w)).filter(F.col("Rank") <= n)


def top_n_joined(weights: DataFrame, part: str, item: str, weight: str, n: int, alias: str) -> DataFrame:
    """', '-joined top-n items per part."""
    t = top_n(weights, part, item, weight, n)
    return (t.groupBy(part).agg(F.array_sort(F.collect_list(F.struct("Rank", F.col(item).alias("i")))).alias("_s"))
            .select(part, F.array_join(F.transform("_s", lambda e: e["i"]), ", ").alias(alias)))


def choose_k(metrics: DataFrame, rule: str = "min_gain") -> DataFrame:
    """Chosen K from (K, Pseudo_R2): ``min_gain`` = K with the smallest
    successive R2 gain (the reference's rule, X7), NULL -> K of max R2;
    ``elbow`` = largest K whose gain is still >= 10 % of the first gain.
    The metrics table has one row per K (a handful), so the order-only window
    is bounded."""
    w = Window.orderBy("K")
    m = metrics.withColumn("R2_diff", F.col("Pseudo_R2") - F.lag("Pseudo_R2").over(w))
    if rule == "elbow":
        first = m.filter(F.col("R2_diff").isNotNull()).orderBy("K").select("R2_diff").limit(1)
        g0 = first.scalar()
        return m.agg(F.max(F.when(F.col("R2_diff") >= g0 * 0.1, F.col("K"))).alias("chosen_K"))
    return m.agg(F.coalesce(F.min_by("K", F.when(F.col("R2_diff").isNotNull(), F.struct("R2_diff", "K"))),
                            F.max_by("K", "Pseudo_R2")).alias("chosen_K"))
