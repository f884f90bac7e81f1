"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text train a linear model over
binned text statistics by minimising the non-negative unbiased risk

    prior * E_P[l(z)] + max(0, E_U[l(-z)] - prior * E_P[l(-z)])

with the sigmoid loss. The class prior is estimated from the two samples: a
discriminator of positives and unlabelled text is fitted first (two folds, each scored by the other's fit), and the prior
is the smallest ratio of their upper tails, because the unlabelled tail holds
at least the prior's share of the positive one. Labels of value 0 are not used.

Both samples are bounded (SAMPLE rows each, chosen by hash among rows that are
not held out); Spark computes their statistics, the driver gets SAMPLE rows of
numbers. Scoring is one narrow pass over all whole texts.

Defined results: null, empty and wordless texts score 0; without a positive
label every score is 0; repeated rows are independent; extra columns pass
through; an empty table gives an empty result."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchlens.llm.common import free_name, held_out

SAMPLE = 6000
SEED = 50_021
BINS = 16
ENDS = np.array([0.002, 0.005, 0.01, 0.02, 0.03, 0.04])
STEPS = 400
PREDICT = 0.3

_UPPER = np.arange(65, 91)
_LOWER = np.arange(97, 123)
_DIGIT = np.arange(48, 58)
_SYMBOL = np.frombuffer(b"#*$%&|<>{}[]\\^~_=+@/", np.uint8)
_STOP = np.frombuffer(b".!?", np.uint8)
_CLAUSE = np.frombuffer(b",;:", np.uint8)
STATS = ("log_words", "word_length", "distinct", "top_word", "same_next", "same_pair", "upper", "digit", "symbol",
         "shout", "stops", "clauses", "pipes", "high", "line_words", "dup_lines", "packed", "ends", "long_word", "bare_word")


def statistics(text: bytes | None) -> list[float]:
    """Text statistics in the order of STATS, of a text in UTF-8."""
    t = text or b""
    w = t.split()
    n = len(w)
    if not n:
        return [0.0] * len(STATS)
    c = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
    size = float(len(t))
    letters = max(1.0, float(c[_UPPER].sum() + c[_LOWER].sum()))
    count: dict[bytes, int] = {}
    for x in w:
        count[x] = count.get(x, 0) + 1
    pairs = len(set(zip(w, w[1:]))) if n > 1 else 1
    lines = [x for x in t.split(b"\n") if x.strip()]
    return [
        np.log(n), sum(map(len, w)) / n, np.log(len(count) + 1) / np.log(n + 1), max(count.values()) / n,
        sum(map(bytes.__eq__, w, w[1:])) / n, 1 - pairs / max(1, n - 1), c[_UPPER].sum() / letters,
        c[_DIGIT].sum() / size, c[_SYMBOL].sum() / n, c[33] / n, c[_STOP].sum() / n, c[_CLAUSE].sum() / n,
        c[124] / n, c[128:].sum() / size, np.log(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
        len(zlib.compress(t, 1)) / size, float(t.rstrip()[-1:] in b".!?"), max(map(len, w)) / 10.0,
        count.get(w[0], 0) / n]


class Model:
    def __init__(self, edges, weights, bias):
        self.edges, self.weights, self.bias = edges, weights, bias

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, (e, w) in enumerate(zip(self.edges, self.weights)):
            z += w[np.searchsorted(e, x[:, j], side="right")]
        return np.where(np.isneginf(x[:, 0]) | (x[:, 1] == 0), 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _one_hot(x, edges):
    return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]


def _scores(bins, weights, bias):
    return bias + sum(w[b] for w, b in zip(weights, bins))


def _descend(loss_slopes, bins, edges, steps, rate=0.05, decay=1e-2):
    """Adam on the summed tables; ``loss_slopes(z)`` gives d risk / d z."""
    weights = [np.zeros(len(e) + 1) for e in edges]
    bias = 0.0
    m = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    mb = [0.0, 0.0]
    for t in range(1, steps + 1):
        g = loss_slopes(_scores(bins, weights, bias))
        fix1, fix2 = 1 - 0.9 ** t, 1 - 0.99 ** t
        for w, b, s in zip(weights, bins, m):
            d = np.bincount(b, weights=g, minlength=len(w)) + decay * w / len(weights)
            s[0] = 0.9 * s[0] + 0.1 * d
            s[1] = 0.99 * s[1] + 0.01 * d * d
            w -= rate * (s[0] / fix1) / (np.sqrt(s[1] / fix2) + 1e-8)
        d = g.sum()
        mb = [0.9 * mb[0] + 0.1 * d, 0.99 * mb[1] + 0.01 * d * d]
        bias -= rate * (mb[0] / fix1) / (np.sqrt(mb[1] / fix2) + 1e-8)
    return weights, bias


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Smallest ratio of the upper tails of two score samples."""
    cuts = np.quantile(positive, np.linspace(0.05, 0.7, 27))
    ratio = [np.mean(unlabelled >= c) / max(np.mean(positive >= c), 1e-9) for c in cuts]
    return float(np.clip(min(ratio), 0.05, 0.99))


def fit(p: np.ndarray, u: np.ndarray, steps: int = STEPS):
    """Model and class prior from statistics of positives and unlabelled."""
    x = np.concatenate([p, u])
    # equal shares, and finer cuts at both ends, where the odd texts are
    cuts = np.unique(np.concatenate([np.linspace(0, 1, BINS + 1)[1:-1], ENDS, 1 - ENDS]))
    edges = [np.unique(np.quantile(x[:, j], cuts)) for j in range(x.shape[1])]
    bins = _one_hot(x, edges)
    is_p = np.arange(len(x)) < len(p)
    np_, nu = max(1, len(p)), max(1, len(u))

    # each half is scored by a discriminator that has not seen it
    half = np.arange(len(x)) % 2 == 0
    z = np.empty(len(x))
    for own in (half, ~half):
        def discriminate(z, own=own):
            s = _sigmoid(z)
            return np.where(own, np.where(is_p, (s - 1) / np_, s / nu), 0.0)
        z[~own] = _scores(bins, *_descend(discriminate, bins, edges, steps // 2))[~own]
    prior = class_prior(z[is_p], z[~is_p])

    def risk(z):
        s = _sigmoid(z)
        slope = s * (1 - s)  # d l(-z) / dz, and minus d l(z) / dz
        rest = s[~is_p].mean() - prior * s[is_p].mean()
        positive = np.where(is_p, -prior * slope / np_, 0.0)
        negative = np.where(is_p, -prior * slope / np_, slope / nu)
        # below zero the estimate of the negative risk is overfitted: step back
        return positive + negative if rest >= 0 else -negative

    weights, bias = _descend(risk, bins, edges, steps)
    return Model(edges, weights, bias), prior


def _with_statistics(df: DataFrame, text_col: str, model=None, name: str = "stats") -> DataFrame:
    """``df`` plus its statistics (array<double>), or the model's score."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = T.ArrayType(T.DoubleType()) if model is None else T.DoubleType()

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            x = [statistics(t.as_buffer().to_pybytes() if t.is_valid else None) for t in texts]
            got = pa.array(x, pa.list_(pa.float64())) if shared.value is None else pa.array(
                shared.value.score(np.array(x).reshape(len(x), len(STATS))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def train(docs: DataFrame, labels: DataFrame, n: int = SAMPLE):
    """(model, prior) from at most ``n`` trusted positives and ``n`` unlabelled
    documents, one row of each id; None without positives."""
    def chosen(ids, flag):
        return (ids.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.lit(flag).alias("p"))
                .orderBy(F.xxhash64("doc_id", F.lit(SEED + flag)), "doc_id").limit(n))

    ids = F.broadcast(chosen(labels.where("quality = 1"), 1).union(chosen(docs, 0)))
    rows = docs.select("doc_id", "text").join(ids, "doc_id")
    rows = _with_statistics(rows, "text").groupBy("doc_id", "p").agg(F.min("stats").alias("stats")).collect()
    rows.sort(key=lambda r: (r["p"], r["doc_id"], r["stats"]))
    x = {f: np.array([r["stats"] for r in rows if r["p"] == f]).reshape(-1, len(STATS)) for f in (0, 1)}
    return fit(x[1], x[0]) if len(x[1]) and len(x[0]) else None


def score_quality(df: DataFrame, model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` plus a score from 0 to 1 under ``out`` or a free variant of it."""
    name = free_name(df, out)
    if model is None:
        return df.withColumn(name, F.lit(0.0))
    return _with_statistics(df, text_col, model, name)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    got = train(docs, labels)
    scored = score_quality(docs.select("doc_id", "text"), got[0] if got else None)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= PREDICT, 1).otherwise(0).alias("predicted"))
