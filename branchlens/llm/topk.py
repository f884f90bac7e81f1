"""Exact top-k inner-product search.

Vectors are processed by descending length. An orthogonal rotation from the
singular vectors of the whole table (eigenvectors of its d x d Gram matrix)
moves most of the length into the first coordinates, so for a query q and a
vector v

    q.v <= head(q).head(v) + |tail(q)| |tail(v)|        (Cauchy-Schwarz)

and a vector is left out as soon as that bound is below the query's current
k-th best score; whole levels of lengths are left out when |q| times their
longest vector is. Survivors are scored with integers, so results are exact:
bounds only ever remove vectors that cannot enter the result.

Spark deals the work out as cells (length level, salt, query chunk): vectors
are repeated once per query chunk, queries only for the levels they can reach.
In a cell the vectors are held (at most about CELL_VECTORS) and the queries
stream through. What reaches the driver has a fixed size: the Gram matrix
(d x d), the level bounds and counts (LEVELS values).

Defined results: vectors that are null or hold null or non-finite components,
and rows without an id, take no part; shorter vectors count as padded with
zeros; equal scores go to the smaller id; a query never meets rows that carry
its own id, and repeated ids among the queries are ranked together; an empty
table gives an empty result. Scores are 64-bit integers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 32
CELL_VECTORS = 32_768
CHUNK_QUERIES = 32_768
STRIDE = 1 << 20
SCALE = 1024


def quantise(vec: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) per component, x as double; null where the vector takes
    no part."""
    x = vec.cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(vec.isNotNull() & ~bad, F.transform(x, lambda c: F.floor(c * scale)))


def _stack(col, d: int) -> np.ndarray:
    out = np.zeros((len(col), d), dtype=np.int64)
    for i, v in enumerate(col):
        out[i, : len(v)] = v
    return out


def _rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Orthogonal d x d matrix, strongest direction first. Per task one Gram
    matrix, summed by Spark; d x d values reach the driver."""
    def gram(batches):
        g = np.zeros((d, d))
        for pdf in batches:
            x = _stack(pdf["v"], d).astype(np.float64)
            g += x.T @ x
        yield pd.DataFrame({"i": np.arange(d), "row": list(g)})

    parts = vectors.select("v").mapInPandas(gram, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    g = np.zeros((d, d))
    for r in cells.toLocalIterator():
        g[r["i"], r["j"]] = r["x"]
    _, v = np.linalg.eigh((g + g.T) / 2)
    return np.ascontiguousarray(v[:, ::-1])


class _Cell:
    """The vectors of one cell, longest first, and the pruned search."""

    SUB, PAIRS = 1024, 65_536

    def __init__(self, ids, x, rot, k):
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        order = np.lexsort((ids, -norm))
        self.ids, self.x, self.norm, self.k, self.rot = ids[order], x[order], norm[order], k, rot
        self.h = max(1, x.shape[1] // 4)
        r = self.x.astype(np.float64) @ rot
        self.head = r[:, : self.h]
        self.tail = np.sqrt((r[:, self.h:] ** 2).sum(1))

    def search(self, qid, q, floor):
        """Best k rows of the cell for each query whose score can reach
        ``floor`` (a score the query already has k of)."""
        r = q.astype(np.float64) @ self.rot
        head, tail = r[:, : self.h], np.sqrt((r[:, self.h:] ** 2).sum(1))
        norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        floor = floor.astype(np.float64)
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in qid]
        for at in range(0, len(self.ids), self.SUB):
            sub = slice(at, at + self.SUB)
            slack = 1e-6 + 1e-9 * norm * self.norm[at]
            live = np.flatnonzero(norm * self.norm[at] + slack >= floor)
            if not len(live):
                break  # lengths only fall from here on
            bound = head[live] @ self.head[sub].T + np.outer(tail[live], self.tail[sub])
            ok = bound + slack[live, None] >= floor[live, None]
            ok &= qid[live][:, None] != self.ids[sub][None, :]
            a, b = np.nonzero(ok)
            score = np.empty(len(a), np.int64)
            for p in range(0, len(a), self.PAIRS):
                c = slice(p, p + self.PAIRS)
                score[c] = np.einsum("ij,ij->i", q[live[a[c]]], self.x[sub][b[c]])
            cut = np.searchsorted(a, np.arange(len(live) + 1))
            for j, i in enumerate(live):
                s, e = cut[j], cut[j + 1]
                if s == e:
                    continue
                sc = np.concatenate([best[i][0], score[s:e]])
                vi = np.concatenate([best[i][1], self.ids[sub][b[s:e]]])
                top = np.lexsort((vi, -sc))[: self.k]
                best[i] = sc[top], vi[top]
                if len(top) == self.k:
                    floor[i] = max(floor[i], best[i][0][-1])
        return best


def _searcher(rot: np.ndarray, k: int, d: int):
    """Streams cells: the vectors of a cell come first, then its queries."""
    def run(batches):
        key, ids, xs, cell = None, [], [], None
        for pdf in batches:
            cells = (pdf["part"].to_numpy() * 1_000_003 + pdf["chunk"].to_numpy()) * 2 + pdf["kind"].to_numpy()
            edges = np.flatnonzero(np.diff(cells)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(pdf)]):
                if lo == hi:
                    continue
                g = pdf.iloc[lo:hi]
                now = (g["part"].iat[0], g["chunk"].iat[0])
                if now != key:
                    key, ids, xs, cell = now, [], [], None
                if g["kind"].iat[0] == 0:
                    ids.append(g["id"].to_numpy())
                    xs.append(_stack(g["v"], d))
                    continue
                if not ids:
                    continue
                if cell is None:
                    cell = _Cell(np.concatenate(ids), np.concatenate(xs), rot, k)
                for at in range(0, len(g), 256):
                    h = g.iloc[at:at + 256]
                    qid = h["id"].to_numpy()
                    got = cell.search(qid, _stack(h["v"], d), h["floor"].to_numpy())
                    n = [len(s) for s, _ in got]
                    if sum(n):
                        yield pd.DataFrame({"query_id": np.repeat(qid, n),
                                            "vec_id": np.concatenate([v for _, v in got]),
                                            "score": np.concatenate([s for s, _ in got])})
    return run


def _search(vectors: DataFrame, queries: DataFrame, rot, k: int, d: int) -> DataFrame:
    """vectors(part, chunk, id, v, norm) and queries(part, chunk, id, v, norm,
    floor): partial results of every cell."""
    cols = ("part", "chunk", "kind", "id", "v", "norm", "floor")
    both = vectors.withColumn("kind", F.lit(0)).withColumn("floor", F.lit(0.0)).select(*cols).unionByName(
        queries.withColumn("kind", F.lit(1)).select(*cols))
    return (both.repartition("part", "chunk").sortWithinPartitions("part", "chunk", "kind", F.desc("norm"), "id")
            .drop("norm").mapInPandas(_searcher(rot, k, d), "query_id long, vec_id long, score long"))


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
                vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """For every row where ``is_query`` holds, the k rows with the highest
    integer inner product: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    v = (vectors.select(vectors[id_col].cast("long").alias("id"), quantise(vectors[vec_col], scale).alias("v"),
                        F.coalesce(is_query, F.lit(False)).alias("q"))
         .where("id IS NOT NULL AND v IS NOT NULL")
         .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))))
    cuts = [i / LEVELS for i in range(LEVELS - 1, 0, -1)]
    stats = v.agg(F.max(F.size("v")).alias("d"), F.percentile_approx("norm", cuts, 10_000).alias("cuts"),
                  F.sum(F.col("q").cast("long")).alias("q")).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not stats["q"]:
        return spark.createDataFrame([], empty)
    d = max(1, stats["d"])
    rot = _rotation(v, d)
    # level 0 holds the longest vectors; the bounds are LEVELS - 1 numbers
    bounds = F.array(*[F.lit(float(c)) for c in stats["cuts"]])
    v = v.withColumn("level", F.size(F.filter(bounds, lambda c: c > F.col("norm"))))
    per = {r["level"]: r for r in v.groupBy("level").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()}
    salts = [-(-per[i]["n"] // CELL_VECTORS) if i in per else 0 for i in range(LEVELS)]
    tops = [float(per[i]["top"]) if i in per else 0.0 for i in range(LEVELS)]
    chunks = -(-stats["q"] // CHUNK_QUERIES)
    n_salts = F.array(*[F.lit(int(s)) for s in salts])
    v = v.withColumn("part", F.col("level").cast("long") * STRIDE
                     + F.pmod(F.xxhash64("id", "v"), F.greatest(n_salts[F.col("level")], F.lit(1))))
    q = (v.where("q").select("id", "v", "norm")
         .withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")))
    each = v.select("part", "id", "v", "norm",
                    F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))

    # 1: a first floor per query from one cell of the longest vectors
    first = min(per)
    seed = _search(each.where(F.col("part") == first * STRIDE),
                   q.withColumn("part", F.lit(first * STRIDE).cast("long")).withColumn("floor", F.lit(float("-inf"))),
                   rot, k, d)
    floors = (seed.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
              .where(F.col("n") == k).select(F.col("query_id").alias("id"), F.col("low").cast("double").alias("floor")))

    # 2: every level whose longest vector can reach the floor
    q = q.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    slack = 1e-6 + 1e-9 * F.abs("floor")
    reach = F.filter(F.arrays_zip(F.sequence(F.lit(0), F.lit(LEVELS - 1)).alias("level"),
                                  F.array(*[F.lit(t) for t in tops]).alias("top"), n_salts.alias("salts")),
                     lambda c: (c["salts"] > 0) & (c["top"] * F.col("norm") + slack >= F.col("floor")))
    spread = (q.select("id", "v", "norm", "chunk", "floor", F.explode(reach).alias("c"))
              .select("id", "v", "norm", "chunk", "floor", F.col("c.level").alias("level"),
                      F.explode(F.sequence(F.lit(0), F.col("c.salts") - 1)).alias("salt"))
              .withColumn("part", F.col("level").cast("long") * STRIDE + F.col("salt")))
    found = _search(each, spread, rot, k, d)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
      FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""
