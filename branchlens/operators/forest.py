"""Random forests of many tasks at once (L19, L20): level-wise histogram trees.

A task is one forest to fit: a target, a feature set and a held-out fold. The
trees of all tasks grow together, a level a pass. A row of the training table is
never copied per tree: blocks of binned rows meet the trees (equi-join on a lane
number, so every block sees every group of trees), a block finds each row's node
in each tree and counts weight, sum and sum of squares by (node, drawn feature,
bin); counts of a group of trees meet in one place, where every node gets the
split with the largest fall of the squared error. All levels are one job.

Row weights are Poisson(1) draws from the hash of row and tree (the bootstrap of
a stream), each node draws the square root of its task's features from the hash
of tree and node, and a split leaves at least MIN_LEAF weight on both sides, so
results do not depend on the partitioning. Bins are exact quantile cuts of the
training values; with no more distinct values than bins every value is a bin.
Missing values take the median of the task's training rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite_or_null
from ..session import cut_lineage
from .quantiles import group_quantiles

BINS = 64
DEPTH = 6
MIN_LEAF = 2
GROUP_TREES = 50
BLOCK_ROWS = 2048
LANES = 8
SLOTS = 8                           # tasks over which the groups that meet a lane are dealt
HELD_CELLS = 4_000_000            # counts a task holds before it hands them on
MISSING = 255


@dataclass(frozen=True)
class Task:
    """One forest. ``held`` is the fold it does not see; -1: none."""
    number: int
    target: int
    columns: tuple[int, ...]
    held: int


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) / 2.0 ** 53


def poisson(rows: np.ndarray, trees: np.ndarray, seed: int) -> np.ndarray:
    """(rows, trees) draws of Poisson(1), up to 7."""
    u = _unit(_mix(rows[:, None] ^ _mix(trees + np.uint64(seed))[None, :]))
    steps = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 8)]))
    return np.searchsorted(steps[:-1], u).astype(np.float64)


def drawn(task: Task, trees: np.ndarray, nodes: np.ndarray, seed: int) -> np.ndarray:
    """(pairs, s) features each (tree, node) may split on."""
    cols = np.array(task.columns)
    h = _mix(_mix(trees + np.uint64(seed + 7)) + nodes.astype(np.uint64))
    order = np.argsort(_mix(h[:, None] ^ _mix(cols.astype(np.uint64) + np.uint64(1))), axis=1, kind="stable")
    return cols[order[:, :max(1, int(np.sqrt(len(cols))))]]


class Trees:
    """A group of trees: per heap place the feature split on (-1: leaf), the last
    bin that goes left, and the mean of the training rows."""

    def __init__(self, n: int, raw: bytes | None = None):
        size = 2 ** (DEPTH + 1) - 1
        if raw is None:
            self.feature = np.full((n, size), -1, np.int16)
            self.cut = np.zeros((n, size), np.int16)
            self.value = np.full((n, size), np.nan)
        else:
            k = n * size * 2
            self.feature = np.frombuffer(raw[:k], np.int16).reshape(n, size).copy()
            self.cut = np.frombuffer(raw[k:2 * k], np.int16).reshape(n, size).copy()
            self.value = np.frombuffer(raw[2 * k:], np.float64).reshape(n, size).copy()

    def pack(self) -> bytes:
        return self.feature.tobytes() + self.cut.tobytes() + self.value.tobytes()

    def place(self, x: np.ndarray, depth: int) -> np.ndarray:
        """(rows, trees) heap place after at most ``depth`` splits."""
        t = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(depth):
            f = self.feature[t, at]
            right = x[rows, np.maximum(f, 0)] > self.cut[t, at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees); an empty leaf answers with its nearest counted ancestor."""
        at = self.place(x, DEPTH)
        t = np.arange(len(self.feature))[None, :]
        out = self.value[t, at]
        while np.isnan(out).any() and (at > 0).any():
            at = np.where(np.isnan(out), np.maximum((at - 1) // 2, 0), at)
            out = np.where(np.isnan(out), self.value[t, at], out)
        return out


def counts(trees: Trees, task: Task, ids: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, level: int,
           seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells that have rows, and their weight, sum and sum of squares (cells, 3).
    A cell is ((tree * nodes + node) * drawn features + feature) * BINS + bin; the
    last level only needs the nodes, so one feature and bin."""
    n = 2 ** level
    at = trees.place(x, level) - (n - 1)
    rows, t = np.nonzero((w > 0) & (at >= 0))
    pair, weight, value = t * n + at[rows, t], w[rows, t], y[rows]
    cells = [pair * BINS]
    if level < DEPTH:
        active, which = np.unique(pair, return_inverse=True)
        feats = drawn(task, ids[active // n], active % n + n - 1, seed)[which]
        s = feats.shape[1]
        cells = [(pair * s + k) * BINS + x[rows, feats[:, k]] for k in range(s)]
    sums = np.tile(np.stack([weight, weight * value, weight * value ** 2], axis=1), (len(cells), 1))
    return merged(np.concatenate(cells), sums)


def merged(cells: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(cells, kind="stable")
    cells, first = np.unique(cells[order], return_index=True)
    return cells, np.add.reduceat(sums[order], first, axis=0) if len(cells) else sums[:0]


def split(trees: Trees, task: Task, ids: np.ndarray, cells: np.ndarray, sums: np.ndarray, level: int, seed: int) -> None:
    """Value and best split of every node of the level that has rows."""
    n, s = 2 ** level, 1 if level == DEPTH else max(1, int(np.sqrt(len(task.columns))))
    active, which = np.unique(cells // (s * BINS), return_inverse=True)
    if not len(active):
        return
    total = np.zeros((3, len(active) * s * BINS))
    total[:, which * s * BINS + cells % (s * BINS)] = sums.T
    total = total.reshape(3, len(active), s, BINS)
    tree, place = active // n, active % n + n - 1
    whole = total[:, :, 0].sum(axis=-1)                    # every drawn feature counts all rows
    trees.value[tree, place] = whole[1] / whole[0]
    if level == DEPTH:
        return
    left = np.cumsum(total, axis=3)
    right = left[..., -1:] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - (whole[1] ** 2 / whole[0])[:, None, None]
    gain = np.where((left[0] >= MIN_LEAF) & (right[0] >= MIN_LEAF), gain, 0.0).reshape(len(active), -1)
    best = gain.argmax(axis=1)
    # a fall within the rounding of the sums is none
    some = gain[np.arange(len(active)), best] > 1e-9 * np.maximum(whole[2], 1e-300)
    feats = drawn(task, ids[tree], place, seed)
    trees.feature[tree, place] = np.where(some, feats[np.arange(len(active)), best // BINS], -1)
    trees.cut[tree, place] = np.where(some, best % BINS, 0)


def _filled(x: np.ndarray, medians: list[int]) -> np.ndarray:
    return np.where(x == MISSING, np.array(medians, np.uint8)[None, :], x)


def _blocks(df: DataFrame, id_col: str, features: Sequence[str], targets: Sequence[str], fold: str,
            medians: DataFrame) -> DataFrame:
    """(lane, ids, h, x, y, fold): rows in blocks, features as bins."""
    p = len(features)
    vals = [finite_or_null(F.col(f"`{c}`")) for c in features]
    cuts = cut_lineage(df.select(F.lit(0).alias("one"), *[v.alias(f"f{i}") for i, v in enumerate(vals)]))
    edges = group_quantiles(cuts, ["one"], [f"f{i}" for i in range(p)], [i / (BINS - 1) for i in range(1, BINS - 1)])
    edges = edges.first()                                  # BINS numbers a feature
    edges = [np.unique(np.array(edges[f"f{i}_q"] or [], float)) for i in range(p)] if edges else [np.empty(0)] * p
    held = {r["cv"]: [0.0 if r[f"f{i}_q"] is None else r[f"f{i}_q"][0] for i in range(p)] for r in medians.collect()}
    codes = {cv: [int(np.searchsorted(edges[i], m[i], "left")) for i in range(p)] for cv, m in held.items()}

    def bins(batches):
        for batch in batches:
            x = np.full((batch.num_rows, p), MISSING, np.uint8)
            for i in range(p):
                v = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
                x[:, i] = np.where(np.isnan(v), MISSING, np.searchsorted(edges[i], v, "left"))
            yield pa.RecordBatch.from_arrays([*batch.columns[p:], pa.array([r.tobytes() for r in x], pa.binary())],
                                             names=[*batch.schema.names[p:], "x"])

    h = F.xxhash64(F.col(id_col).cast("string"))
    rows = df.select(*[v.alias(f"f{i}") for i, v in enumerate(vals)], F.col(id_col).cast("string").alias("id"), h.alias("h"),
                     F.array(*[F.col(f"`{t}`").cast("double") for t in targets]).alias("y"), F.col(fold).cast("int").alias("fold"))
    n_blocks = max(1, -(-df.count() // BLOCK_ROWS))
    rows = rows.mapInArrow(bins, "id string, h long, y array<double>, fold int, x binary")
    b = rows.groupBy(F.pmod("h", F.lit(n_blocks)).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("h", "id", "x", "y", "fold"))).alias("s"))
    out = b.select(F.pmod("block", F.lit(LANES)).cast("int").alias("lane"), *[F.col(f"s.{c}").alias(c) for c in ("h", "id", "x", "y", "fold")])
    return cut_lineage(out), codes


def fit_forests(df: DataFrame, id_col: str, features: Sequence[str], targets: Sequence[str], fold: str,
                sets: dict[str, Sequence[str]], folds: int, trees: int = 100, seed: int = 42) -> DataFrame:
    """Forests of every target, feature set and held-out fold (and one of all
    rows, fold -1). Rows with a null target or a null fold are predicted, not
    trained on. Returns (target, feature_set, held, id, prediction): rows of the
    fold for held-out forests, all rows for fold -1."""
    features, targets = list(features), list(targets)
    tasks = [Task(i, t, tuple(features.index(c) for c in cols), held) for i, (t, cols, held) in enumerate(
        (t, cols, held) for t in range(len(targets)) for cols in sets.values() for held in range(-1, folds))]
    names = [(t, s, held) for t in targets for s in sets for held in range(-1, folds)]
    trains = F.filter(F.array(*[F.lit(h) for h in range(-1, folds)]), lambda h: h != F.col(fold))
    seen = df.filter(F.col(fold).isNotNull()).select(F.explode(trains).alias("cv"), *[
        finite_or_null(F.col(f"`{c}`")).alias(f"f{i}") for i, c in enumerate(features)])
    medians = group_quantiles(cut_lineage(seen), ["cv"], [f"f{i}" for i in range(len(features))], [0.5])
    blocks, codes = _blocks(df, id_col, features, targets, fold, medians)
    p = len(features)
    chunks = [(t.number, at, min(GROUP_TREES, trees - at)) for t in tasks for at in range(0, trees, GROUP_TREES)]

    def rows_of(row):
        x = np.frombuffer(b"".join(row["x"]), np.uint8).reshape(-1, p)
        h = np.array(row["h"], np.int64).view(np.uint64)
        y = np.array([[np.nan if v is None else v for v in r] for r in row["y"]], float)
        return x, h, y, np.array([-2 if v is None else v for v in row["fold"]])

    def group_of(row):
        task = tasks[row["task"]]
        ids = np.uint64(task.number * 1_000_003) + np.arange(row["first"], row["first"] + row["n"]).astype(np.uint64)
        return task, ids, Trees(row["n"], row["state"])

    def grow(level):
        def partial(batches):
            held, size = {}, 0

            def rows_held():
                for (task, first), (cells, sums, row) in held.items():
                    yield pa.RecordBatch.from_pydict({
                        "task": pa.array([task], pa.int32()), "first": pa.array([first], pa.int32()),
                        "n": pa.array([row["n"]], pa.int32()), "state": [row["state"]], "cells": [cells.astype(np.int64).tobytes()],
                        "sums": [sums.tobytes()]})
            for batch in batches:
                for row in batch.to_pylist():
                    task, ids, group = group_of(row)
                    x, h, y, of = rows_of(row)
                    keep = (of > -2) & (of != task.held) & ~np.isnan(y[:, task.target])
                    x, h, y = x[keep], h[keep], y[keep, task.target]
                    cells, sums = counts(group, task, ids, _filled(x, codes.get(task.held, [0] * p)), y,
                                         poisson(h, ids, seed), level, seed)
                    key = row["task"], row["first"]
                    if key in held:
                        size -= len(held[key][0])
                        cells, sums = merged(np.concatenate([held[key][0], cells]), np.concatenate([held[key][1], sums]))
                    held[key] = cells, sums, row
                    size += len(cells)
                    if size > HELD_CELLS:
                        yield from rows_held()
                        held, size = {}, 0
            yield from rows_held()

        def update(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            task, ids, group = group_of(rows[0])
            cells, sums = merged(np.concatenate([np.frombuffer(r["cells"], np.int64) for r in rows]),
                                 np.concatenate([np.frombuffer(r["sums"], np.float64).reshape(-1, 3) for r in rows]))
            split(group, task, ids, cells, sums, level, seed)
            return pa.table({"task": table["task"].slice(0, 1), "first": table["first"].slice(0, 1), "n": table["n"].slice(0, 1),
                             "state": pa.array([group.pack()], pa.binary())})
        return partial, update

    def first(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([Trees(n).pack() for n in batch.column(2).to_pylist()], pa.binary())],
                                             names=[*batch.schema.names, "state"])

    # every block meets every group of trees, at the group's slot of the block's lane
    blocks = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    lanes = F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("lane")
    slot = F.pmod(F.col("task") + F.floor(F.col("first") / GROUP_TREES), F.lit(SLOTS)).cast("int").alias("slot")
    kind = "task int, first int, n int, state binary"
    groups = df.sparkSession.createDataFrame(chunks, "task int, first int, n int").repartition(LANES).mapInArrow(first, kind)
    for level in range(DEPTH + 1):
        partial, update = grow(level)
        groups = (blocks.join(groups.select("*", lanes, slot), ["lane", "slot"]).mapInArrow(partial, kind + ", cells binary, sums binary")
                  .groupBy("task", "first").applyInArrow(update, kind))
    groups = cut_lineage(groups)

    def answer(batches):
        for batch in batches:
            for row in batch.to_pylist():
                task, _, group = group_of(row)
                x, _, _, of = rows_of(row)
                mine = np.flatnonzero(of == task.held) if task.held >= 0 else np.arange(len(x))
                if len(mine):
                    got = group.predict(_filled(x[mine], codes.get(task.held, [0] * p))).sum(axis=1)
                    t, s, held = names[task.number]
                    k = len(mine)
                    yield pa.RecordBatch.from_pydict({
                        "target": [t] * k, "feature_set": [s] * k, "held": pa.array(np.full(k, held, np.int32)),
                        "id": [row["id"][i] for i in mine], "total": pa.array(got), "n": pa.array(np.full(k, row["n"], np.int32))})

    parts = blocks.join(groups.select("*", lanes, slot), ["lane", "slot"]).mapInArrow(
        answer, "target string, feature_set string, held int, id string, total double, n int")
    return (parts.groupBy("target", "feature_set", "held", "id")
            .agg((F.sum("total") / F.sum("n")).alias("prediction")))
