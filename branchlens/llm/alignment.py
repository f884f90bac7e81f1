"""Alignment of two tokenizers' tokens over the same bytes, in lockstep.

A block of documents is encoded by both vocabularies; all token ends lie on one
byte axis. Lanes of ``LANE`` bytes start at every document and at every ``LANE``
bytes within one, so a long document is many lanes and no lane is long. One NumPy
state vector holds a pair of pointers (A token, B token) a lane. In each step every
lane emits the link of its two tokens, emits a cut where both end at one byte,
and moves on the pointer that ends first, or both; finished lanes are compacted
away. A step costs a few vector operations whatever the number of documents, and
at most ``LANE`` steps finish a block.

Counts of linked id pairs need the whole corpus. Per block the links are numbers
into the block's list of distinct pairs, stored compressed with each document;
only the lists are counted, joined with the corpus-wide counts, and brought back
to their block by a cogroup. A block holds at most ``BLOCK_BYTES`` of text (or one
document), so no pair, however frequent, makes a large group.

Defined results: null or empty texts, and texts whose joined token bytes differ
from space + text in either vocabulary, have no tokens: zeros and an empty
digest; ties for the highest count all count as best; repeated rows are
independent and each counts; very long texts are lanes; extra columns are
ignored; an empty table gives an empty result."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchlens.llm.tokens import ByteTokens, PieceTokens, built, read_bytes, read_text
from branchlens.session import cut_lineage

LANE = 1024
BLOCK_BYTES = 4 << 20


class Side:
    """One vocabulary: token strings for joining, decimal ids for the digest."""

    def __init__(self, tokens):
        self.tokens = tokens
        self.strings = pa.array(tokens.strings, pa.large_binary())
        self.sizes = np.array([len(s) for s in tokens.strings], np.int64)


class Pair:
    """Both vocabularies and the table of decimal ids with each separator."""

    SEPARATORS = ",|;"

    def __init__(self, a, b):
        self.a, self.b = Side(a), Side(b)
        top = max(len(self.a.sizes), len(self.b.sizes))
        self.decimal = pa.array([f"{i}{s}".encode() for i in range(top) for s in self.SEPARATORS], pa.large_binary())


def taken(strings: pa.Array, at: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of ``strings[at]`` joined."""
    got = strings.take(pa.array(at))
    offsets = np.frombuffer(got.buffers()[1], np.int64)[: len(at) + 1]
    return offsets, memoryview(got.buffers()[2] or b"").cast("B")


def encoded(side: Side, ids: list[np.ndarray], wanted: list[bytes]) -> np.ndarray:
    """Which documents' token bytes join to ``wanted``."""
    counts = np.array([len(x) for x in ids], np.int64)
    offsets, data = taken(side.strings, np.concatenate(ids) if ids else np.empty(0, np.uint32))
    at = offsets[np.concatenate([[0], np.cumsum(counts)])]
    return np.array([data[at[d]:at[d + 1]] == w for d, w in enumerate(wanted)], bool)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, doc_ends: np.ndarray, lane: int = LANE):
    """Links (A position, B position) in byte order and whether a cut follows
    each. Ends are on one byte axis; every document ends a token of both."""
    size = np.diff(doc_ends, prepend=0)
    per = -(-size // lane)
    doc = np.repeat(np.arange(len(size)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = (doc_ends - size)[doc] + nth * lane
    stop = np.minimum(start + lane, doc_ends[doc])
    i, j = np.searchsorted(ends_a, start, "right"), np.searchsorted(ends_b, start, "right")
    # a link that began before the lane belongs to the lane before
    began_a, began_b = np.where(i > 0, ends_a[i - 1], 0), np.where(j > 0, ends_b[j - 1], 0)
    late = np.maximum(began_a, began_b) < start
    ea, eb = ends_a[i], ends_b[j]
    i, j = i + (late & (ea <= eb)), j + (late & (eb <= ea))
    live = np.flatnonzero(~late | (np.minimum(ea, eb) < stop))
    i, j, stop = i[live], j[live], stop[live]
    emitted = []
    while len(live):
        ea, eb = ends_a[i], ends_b[j]
        emitted.append((live, i, j, ea == eb))
        i, j = i + (ea <= eb), j + (eb <= ea)
        on = np.minimum(ea, eb) < stop
        if not on.all():
            live, i, j, stop = live[on], i[on], j[on], stop[on]
    # the n-th link of a lane was emitted in step n
    length = np.bincount(np.concatenate([e[0] for e in emitted]), minlength=len(start)) if emitted else np.zeros(0, np.int64)
    base = np.cumsum(length) - length
    out_i, out_j, out_cut = (np.empty(int(length.sum()), t) for t in (np.int64, np.int64, bool))
    for step, (lanes, i, j, cut) in enumerate(emitted):
        at = base[lanes] + step
        out_i[at], out_j[at], out_cut[at] = i, j, cut
    return out_i, out_j, out_cut


class Block:
    """Documents aligned together. Positions are those of the block's tokens;
    ``docs`` has one entry (row, tokens of A, tokens of B) a document, those
    without tokens included."""

    def __init__(self, pair: Pair, rows: list[tuple[object, str | None]]):
        self.pair = pair
        texts = [t or "" for _, t in rows]
        wanted = [b" " + t.encode("utf-8") if t else b"" for t in texts]
        self.ids = [r for r, _ in rows]
        a = [pair.a.tokens.ids(" " + t) if t else np.empty(0, np.uint32) for t in texts]
        b = [pair.b.tokens.ids(t) if t else np.empty(0, np.uint32) for t in texts]
        same = encoded(pair.a, a, wanted) & encoded(pair.b, b, wanted)
        a, b = ([x if s else x[:0] for x, s in zip(side, same)] for side in (a, b))
        self.n_a, self.n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        self.a, self.b = np.concatenate(a), np.concatenate(b)
        ends = np.cumsum([len(w) if s else 0 for w, s in zip(wanted, same)])
        self.ends_a, self.ends_b = np.cumsum(pair.a.sizes[self.a]), np.cumsum(pair.b.sizes[self.b])
        self.i, self.j, self.cut = lockstep(self.ends_a, self.ends_b, ends)
        doc_of = np.repeat(np.arange(len(rows)), self.n_a)
        self.doc = doc_of[self.i]
        self.n_links = np.bincount(self.doc, minlength=len(rows))
        self.n_groups = np.bincount(self.doc[self.cut], minlength=len(rows))

    def digests(self) -> list[str]:
        """sha256 of every document's groups, written without a loop over
        tokens: decimal ids with their separators, in order of groups."""
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.i[self.cut]], last_b[self.j[self.cut]] = 1, 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        n = int(last_a.sum())
        in_a, in_b = np.cumsum(np.bincount(group_a, minlength=n)), np.cumsum(np.bincount(group_b, minlength=n))
        order = np.empty(len(self.a) + len(self.b), np.int64)
        width = len(Pair.SEPARATORS)
        order[np.arange(len(self.a)) + np.concatenate([[0], in_b])[group_a]] = self.a.astype(np.int64) * width + last_a
        order[np.arange(len(self.b)) + in_a[group_b]] = self.b.astype(np.int64) * width + 2 * last_b
        offsets, data = taken(self.pair.decimal, order)
        at = offsets[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        return [hashlib.sha256(data[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(at, at[1:])]

    def pairs(self) -> np.ndarray:
        """A id and B id of every link as one number."""
        return (self.a[self.i].astype(np.int64) << 32) | self.b[self.j]


def _blocks(pair: Pair, batches):
    """The rows (id, text) of Arrow batches as blocks of bounded text."""
    rows, held = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append(row)
            held += len(row[1] or "") + 64
            if held >= BLOCK_BYTES:
                yield Block(pair, rows)
                rows, held = [], 0
    if rows:
        yield Block(pair, rows)


def _vocabularies(spark, byte_vocabulary: str, piece_vocabulary: str):
    """A function that builds the pair of vocabularies in a worker."""
    a = spark.sparkContext.broadcast(read_text(byte_vocabulary))
    b = spark.sparkContext.broadcast(read_bytes(piece_vocabulary))

    def pair() -> Pair:
        key = hash(a.value), hash(b.value)
        if key not in _PAIRS:
            _PAIRS[key] = Pair(built(ByteTokens, a), built(PieceTokens, b))
        return _PAIRS[key]
    return pair


_PAIRS: dict = {}


def _selected(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def align(docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Per document: the ids of both vocabularies, the links as parallel arrays
    of token places (``link_a``, ``link_b``) and the byte offsets of the cuts in
    space + text."""
    pair = _vocabularies(docs.sparkSession, byte_vocabulary, piece_vocabulary)

    def run(batches):
        for b in _blocks(pair(), batches):
            zero = np.zeros(1, np.int64)
            from_a, from_b, links, cuts = (np.concatenate([zero, np.cumsum(x)]) for x in
                                           (b.n_a, b.n_b, b.n_links, b.n_groups))
            starts = np.concatenate([zero, b.ends_a])[from_a]
            lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.ids, pa.int64()), lists(from_a, b.a), lists(from_b, b.b), lists(links, b.i - from_a[b.doc]),
                 lists(links, b.j - from_b[b.doc]), lists(cuts, b.ends_a[b.i[b.cut]] - starts[b.doc[b.cut]])],
                names=["doc_id", "a_ids", "b_ids", "link_a", "link_b", "cuts"])

    longs = ", ".join(f"{c} array<long>" for c in ("a_ids", "b_ids", "link_a", "link_b", "cuts"))
    return _selected(docs, id_col, text_col).mapInArrow(run, f"doc_id long, {longs}")


_PASS = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, "
         "pairs array<long>, counts array<long>")


def _first_pass(docs: DataFrame, pair) -> DataFrame:
    """Rows of two kinds: a block's distinct pairs with their numbers of links
    (``pairs`` set), and its documents with their links as compressed numbers
    into that list."""
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [c.split()[0] for c in _PASS.split(", ")]

    def run(batches):
        import zstandard
        press = zstandard.ZstdCompressor(1).compress
        base = TaskContext.get().partitionId() << 32
        for nth, b in enumerate(_blocks(pair(), batches)):
            pairs, link, counts = np.unique(b.pairs(), return_inverse=True, return_counts=True)
            link = link.astype(np.int32)
            at = np.concatenate([[0], np.cumsum(b.n_links)])
            packed = [press(link[x:y].tobytes()) if y > x else b"" for x, y in zip(at, at[1:])]
            n = len(b.ids)
            none = [None] * n
            cols = [[base | nth] * n, b.ids, b.n_a, b.n_b, b.n_groups, b.n_links, b.digests(), packed, none, none]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
            cols = [[base | nth], *[[None]] * 7, [pairs], [counts]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return docs.mapInArrow(run, _PASS)


_REPORT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string")


def _summed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Documents of one block with the sums over their links; ``pairs`` has the
    corpus-wide count of each of the block's pairs and whether it is a best one."""
    import zstandard
    unpress = zstandard.ZstdDecompressor().decompress
    at = pairs["code"].to_numpy()
    count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    count[at], best[at] = pairs["total"].to_numpy(), pairs["best"].to_numpy()
    n_best, sums = [], []
    for packed in docs["links"].to_pylist():
        link = np.frombuffer(unpress(packed), np.int32) if packed else np.empty(0, np.int32)
        n_best.append(int(best[link].sum()))
        sums.append(int(count[link].sum()))
    return pa.table({"doc_id": docs["doc_id"], "n_a": docs["n_a"], "n_b": docs["n_b"], "n_groups": docs["n_groups"],
                     "n_links": docs["n_links"], "n_best": pa.array(n_best, pa.int64()),
                     "count_sum": pa.array(sums, pa.int64()), "groups_sha256": docs["groups_sha256"]})


def alignment_report(docs: DataFrame, byte_vocabulary: str, piece_vocabulary: str) -> DataFrame:
    """The contract's columns, one row per document."""
    pair = _vocabularies(docs.sparkSession, byte_vocabulary, piece_vocabulary)
    seen = cut_lineage(_first_pass(_selected(docs, "doc_id", "text"), pair))
    listed = seen.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("code", "p"))
    listed = listed.select("block", "code", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    totals = listed.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    top = totals.groupBy("b").agg(F.max("total").alias("top"))
    known = cut_lineage(totals.join(top, "b").select("pair", "total", (F.col("total") == F.col("top")).cast("long").alias("best")))
    marked = (listed.select(F.col("block").alias("home"), "code", "pair").join(known, "pair")
              .select("home", "code", "total", "best"))
    rows = seen.where("pairs IS NULL").drop("pairs", "counts")
    return rows.groupBy("block").cogroup(marked.groupBy("home")).applyInArrow(_summed, _REPORT)
