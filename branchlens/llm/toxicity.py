"""Toxic spans with a linear-chain conditional random field.

Tags are O and T. Labels exist per document only, so tokens are labelled from
them first: in a toxic training document a token is T when one of its features
(the word, its first four to six letters) is frequent in toxic and practically
absent from clean training documents. The field (feature weights for T, four
transition weights) is then fitted to these token labels by gradient ascent on
the conditional likelihood; expected counts come from forward-backward.

Scoring runs forward-backward over the whole text of every document. Tokens
without a weighted feature are all alike, so between distant weighted tokens
the messages sit at their fixed point; only stretches around weighted tokens
are stepped through. The document score is the highest marginal of T; spans of
tokens with a marginal of at least one half are the offending offsets (code
points).

The training sample is bounded: at most SAMPLE documents of each label, chosen
by hash among rows that are not held out; its ids are broadcast (two times
SAMPLE rows), its texts are fitted on the driver.

Defined results: null, empty and wordless texts score the field's background
marginal; without any labelled document of both kinds every score is 0;
repeated rows are independent; conflicting labels of one id count as toxic;
extra columns pass through; an empty table gives an empty result."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchlens.llm.common import free_name, held_out

SAMPLE = 1000
SEED = 90_001
STEPS = 60
#: A feature marks a token of a toxic document when it occurs in at least
#: MIN_DOCS and this share of the toxic documents, and at least RATIO times as
#: often as in clean ones.
MIN_DOCS, MIN_SHARE, RATIO = 3, 0.02, 30.0
#: Background tokens after which messages have reached their fixed point.
SETTLE = 24
#: Tokens whose weight a task remembers (about 200 bytes each).
MEMO = 100_000
#: Tokens of one training sequence.
PIECE = 64

_LETTERS = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\S+")


def features(token: str) -> tuple[str, ...]:
    """The word itself and its longer prefixes."""
    w = "".join(_LETTERS.findall(token.lower()))
    if not w:
        return ()
    return ("w=" + w, *(f"p{k}=" + w[:k] for k in (4, 5, 6) if len(w) >= k))


class Field:
    """weights: feature -> weight for T; trans[a, b]: from tag a to b."""

    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray):
        self.weights, self.bias = weights, bias
        self.a = np.exp(trans)
        self.memo: dict[str, float] = {}
        self.rest_f = self.rest_b = 1.0
        for _ in range(500):
            self.rest_f = self._forward(self.rest_f, 0.0)
            self.rest_b = self._backward(self.rest_b, 0.0)

    def _forward(self, r: float, e: float) -> float:
        """Odds of T after one more token with weight e."""
        a = self.a
        return np.exp(e + self.bias) * (r * a[1, 1] + a[0, 1]) / (r * a[1, 0] + a[0, 0])

    def _backward(self, r: float, e: float) -> float:
        """Odds of T from what follows, when the next token has weight e."""
        a = self.a
        x = r * np.exp(e + self.bias)
        return (a[1, 1] * x + a[1, 0]) / (a[0, 1] * x + a[0, 0])

    def weight(self, token: str) -> float:
        got = self.memo.get(token)
        if got is None:
            got = sum(self.weights.get(f, 0.0) for f in features(token))
            if len(token) <= 64:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[token] = got
        return got

    @property
    def background(self) -> float:
        odds = self.rest_f * self.rest_b
        return float(odds / (1 + odds))

    def marginals(self, e: np.ndarray, whole: bool = False) -> np.ndarray:
        """P(T) of every token. Chains begin and end in the background, so
        both directions start at the fixed point."""
        p = np.full(len(e), self.background)
        hot = np.arange(len(e)) if whole else np.flatnonzero(e)
        if not len(hot):
            return p
        cuts = np.flatnonzero(np.diff(hot) > 2 * SETTLE) + 1
        for part in np.split(hot, cuts):
            lo, hi = max(part[0] - SETTLE, 0), min(part[-1] + SETTLE + 1, len(e))
            f, b = np.empty(hi - lo), np.empty(hi - lo)
            r = self.rest_f
            for i in range(lo, hi):
                f[i - lo] = r = self._forward(r, e[i])
            r = self.rest_b
            for i in range(hi - 1, lo - 1, -1):
                b[i - lo] = r
                r = self._backward(r, e[i])
            odds = f * b
            p[lo:hi] = odds / (1 + odds)
        return p

    def score(self, text: str | None):
        """(score, [(start, end, marginal)])."""
        tokens = (text or "").split()
        get = self.memo.get
        e = np.array([w if (w := get(t)) is not None else self.weight(t) for t in tokens])
        if not e.any():
            return self.background, []
        p = self.marginals(e)
        spans = []
        if p.max() >= 0.5:
            for i, m in enumerate(_TOKEN.finditer(text)):
                if p[i] >= 0.5:
                    if spans and last == i - 1:
                        spans[-1] = (spans[-1][0], m.end(), max(spans[-1][2], float(p[i])))
                    else:
                        spans.append((m.start(), m.end(), float(p[i])))
                    last = i
        return float(p.max()), spans


def _tagged(docs: list[tuple[str, int]]):
    """Token features and distant tags of the training documents."""
    memo: dict[str, tuple[str, ...]] = {}
    seqs = []
    copies = set()
    for text, y in docs:
        tokens = (text or "").split()
        # of a group of copies one counts: the smallest shingle hash names it
        group = min((zlib.crc32(" ".join(tokens[i:i + 4]).encode()) for i in range(max(1, len(tokens) - 3))), default=0)
        if (group, y) in copies:
            continue
        copies.add((group, y))
        for t in tokens:
            if t not in memo:
                memo[t] = features(t)
        seqs.append(([memo[t] for t in tokens], y))
    seen = ({}, {})
    for s, y in seqs:
        for f in {f for t in set(s) for f in t}:
            seen[y][f] = seen[y].get(f, 0) + 1
    bad, good = max(1, sum(y for _, y in seqs)), max(1, sum(1 - y for _, y in seqs))
    telling = {f for f, n in seen[1].items() if n >= max(MIN_DOCS, MIN_SHARE * bad)
               and n / bad >= RATIO * (seen[0].get(f, 0) + 0.25) / good}
    # from here on only telling features matter
    few = {s: tuple(f for f in s if f in telling) for s in memo.values()}
    seqs = [([few[t] for t in s], y) for s, y in seqs]
    tags = [[int(y and len(t) > 0) for t in s] for s, y in seqs]
    return [s for s, _ in seqs], tags, telling


def fit(docs: list[tuple[str, int]], steps: int = STEPS) -> Field | None:
    """Fit the field to (text, toxic) pairs; None without both kinds."""
    if not any(y for _, y in docs) or all(y for _, y in docs):
        return None
    seqs, tags, telling = _tagged(docs)
    index = {f: i for i, f in enumerate(sorted(telling))}
    if not index:
        return None
    # training pieces as padded matrices; features as (row, position) pairs.
    # Pieces without a telling feature differ in length only: one row each,
    # weighted by their number.
    pieces, plain = [], {}
    for s, t in zip(seqs, tags):
        for k in range(0, len(s), PIECE):
            part = s[k:k + PIECE]
            if not any(part):
                plain[len(part)] = plain.get(len(part), 0) + 1
            else:
                pieces.append((part, t[k:k + PIECE]))
    weight = np.concatenate([np.ones(len(pieces)), np.array([plain[k] for k in sorted(plain)], float)])
    pieces += [([()] * k, [0] * k) for k in sorted(plain)]
    n, width = len(pieces), max(len(s) for s, _ in pieces)
    y, mask = np.zeros((n, width)), np.zeros((n, width), bool)
    at, which = [], []
    for r, (s, t) in enumerate(pieces):
        y[r, :len(t)], mask[r, :len(t)] = t, True
        for c, fs in enumerate(s):
            for f in fs:
                if f in index:
                    at.append(r * width + c)
                    which.append(index[f])
    at, which = np.array(at, np.int64), np.array(which, np.int64)
    each = weight[:, None]
    theta = np.zeros(len(index) + 5)  # weights, bias, transitions 00 01 10 11
    seen = np.bincount(which, weights=y.ravel()[at], minlength=len(index))
    pair = mask[:, 1:] & mask[:, :-1]
    true = np.concatenate([seen, [y.sum()], [float((each * ((y[:, :-1] == a) & (y[:, 1:] == b) & pair)).sum())
                                             for a in (0, 1) for b in (0, 1)]])
    m1 = np.zeros_like(theta)
    m2 = np.zeros_like(theta)
    for step in range(1, steps + 1):
        a = np.exp(theta[-4:].reshape(2, 2))
        e = np.bincount(at, weights=theta[which], minlength=n * width).reshape(n, width) + theta[-5]
        # odds of T from the left, and from the right
        f, b = np.empty((n, width)), np.ones((n, width))
        r = np.ones(n)
        for i in range(width):
            r = np.exp(e[:, i]) * ((r * a[1, 1] + a[0, 1]) / (r * a[1, 0] + a[0, 0]) if i else 1.0)
            r = np.clip(r, 1e-12, 1e12)
            f[:, i] = r
        for i in range(width - 2, -1, -1):
            x = b[:, i + 1] * np.exp(e[:, i + 1])
            b[:, i] = np.where(mask[:, i + 1], (a[1, 1] * x + a[1, 0]) / (a[0, 1] * x + a[0, 0]), 1.0)
        p = np.where(mask, f * b / (1 + f * b), 0.0)
        # pair marginals: left odds, transition, right odds times own weight
        x = b[:, 1:] * np.exp(e[:, 1:])
        left = f[:, :-1]
        z = a[0, 0] + a[0, 1] * x + left * (a[1, 0] + a[1, 1] * x)
        pairs = [float((each * np.where(pair, v / z, 0.0)).sum()) for v in (np.full_like(z, a[0, 0]), a[0, 1] * x, left * a[1, 0], left * a[1, 1] * x)]
        model = np.concatenate([np.bincount(which, weights=p.ravel()[at], minlength=len(index)), [(each * p).sum()], pairs])
        grad = (true - model) / weight.sum() - 1e-4 * theta
        m1 = 0.8 * m1 + 0.2 * grad
        m2 = 0.95 * m2 + 0.05 * grad ** 2
        theta += 0.4 * (m1 / (1 - 0.8 ** step)) / (np.sqrt(m2 / (1 - 0.95 ** step)) + 1e-9)
    return Field({f: float(theta[i]) for f, i in index.items()}, float(theta[-5]), theta[-4:].reshape(2, 2))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, n: int = SAMPLE) -> DataFrame:
    """At most ``n`` labelled documents of each value that are not held out:
    doc_id, text, y. Ids are chosen first, so only their texts leave the scan; of
    repeated ids the text with the smallest hash counts."""
    ids = (labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull())
           .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    ids = [ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(n) for y in (0, 1)]
    ids = F.broadcast(ids[0].union(ids[1]))
    return (docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "y")
            .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "y"))


def train(docs: DataFrame, labels: DataFrame, n: int = SAMPLE) -> Field | None:
    rows = training_sample(docs, labels, "toxic", n).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return fit([(r["text"], r["y"]) for r in rows])


def score_toxicity(df: DataFrame, field: Field | None, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``df`` plus a struct (score, spans) under ``out`` or a free variant of
    it. Narrow; the field is broadcast (its size is bounded by the sample)."""
    name = free_name(df, out)
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
        T.StructField("marginal", T.DoubleType())])))])
    arrow = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct(
        [("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])))])
    shared = df.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        model = shared.value
        for batch in batches:
            got = []
            for text in batch.column(batch.schema.get_field_index(text_col)):
                s, spans = model.score(text.as_py()) if model else (0.0, [])
                got.append({"score": s, "spans": [{"start": a, "end": b, "marginal": p} for a, b, p in spans]})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, arrow)], names=[*batch.schema.names, name])
        if model:
            model.memo.clear()  # the worker goes on to other stages

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    got = score_toxicity(docs.select("doc_id", "text"), train(docs, labels))
    score = F.col("toxicity.score")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"),
                      F.when(score >= 0.5, 1).otherwise(0).alias("predicted"),
                      F.size("toxicity.spans").alias("n_spans"),
                      F.array_join(F.transform("toxicity.spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
                      .alias("spans"))


def drop_toxic(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """``docs`` without documents that score ``at`` or more."""
    got = score_toxicity(docs, train(docs, labels))
    name = got.columns[-1]
    return got.where(F.col(name)["score"] < at).select(*docs.columns)
