"""Hierarchical packing of documents into windows of several context sizes.

A document is its token ids plus a closing id. Tiers are context sizes, each a
power of two (2048, 1024, 512, 256):

1. Routing: a long document gives whole windows of the largest tier; what is
   left of it, or a shorter document, goes to the smallest tier that holds it.
2. Packing: tiers are packed from the longest to the shortest. The longest
   remainder of a tier opens a window of its size.
3. Gap filling: the gap takes the longest remainder of a shorter tier that fits
   whole, again and again. When none fits, the shortest remainder is cut and its
   rest is routed anew. So a window is always full.
4. Step groups: windows of one size are dealt into groups of about
   ``STEP_TOKENS`` tokens each, equal in number up to one and balanced by
   attention cost (the sum of squared piece lengths): dearest window first, to
   the cheapest group with room.

Nothing is shuffled: a task packs the documents it reads as a stream, in shards
of ``SHARD_TOKENS`` tokens or ``SHARD_DOCS`` documents that bound its memory. Fewer than one window of
tokens pass from a shard to the next; at the end of the task they become windows
of smaller powers of two, so nothing is padded. A retried task packs the same
rows into the same windows.

Defined results: a null text is an empty one, and an empty text is its closing
id alone; words, documents and remainders of any length are cut, never dropped;
ties go by arrival; repeated rows are packed independently; extra columns are
ignored; an empty table gives an empty result."""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchlens.llm.common import pack_ids
from branchlens.llm.tokens import WordTokens, built, read_text

TIERS = (256, 512, 1024, 2048)
CLOSING_ID = 1
SHARD_TOKENS, SHARD_DOCS = 1 << 21, 20_000
STEP_TOKENS = 32 * 2048

PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
          "sequence_tokens int, step_group long")


def tier_of(length: int) -> int:
    """The smallest context size that holds a remainder."""
    return next(t for t in TIERS if t >= length)


class Packer:
    """One task's packing state. ``rest`` holds the remainders as (length, key,
    start), shortest first; ``docs`` their ids by key until the last piece is
    placed."""

    def __init__(self):
        self.docs, self.rest = {}, []
        self.tokens = 0  # of the remainders
        self.shard = 0  # of everything since the last flush
        self.keys = 0
        self.windows = []  # each a list of (key, start, length)

    def add(self, doc_id, ids: bytes) -> None:
        total, key, top = len(ids) // 4, self.keys, TIERS[-1]
        self.keys += 1
        self.docs[key] = doc_id, ids, total
        whole = total // top * top
        self.windows += [[(key, at, top)] for at in range(0, whole, top)]
        if whole < total:
            insort(self.rest, (total - whole, key, whole))
            self.tokens += total - whole
        self.shard += total

    def fill(self, size: int) -> None:
        """One full window of ``size`` tokens out of the remainders, which hold
        at least as many: the longest that fits, else a piece of the shortest."""
        window, gap, rest = [], size, self.rest
        while gap:
            i = bisect_right(rest, (gap, float("inf")))
            length, key, start = rest.pop(i - 1) if i else rest.pop(0)
            if length > gap:
                insort(rest, (length - gap, key, start + gap))
                length = gap
            window.append((key, start, length))
            gap -= length
        self.tokens -= size
        self.windows.append(window)

    def pack(self, last: bool) -> None:
        while self.rest and (size := tier_of(self.rest[-1][0])) <= self.tokens:
            self.fill(size)
        while last and self.tokens:
            self.fill(1 << (self.tokens.bit_length() - 1))


def step_groups(windows: list, first: int) -> tuple[list[int], int]:
    """Group number of every window, and the next free number."""
    by_size: dict[int, list] = {}
    for at, window in enumerate(windows):
        by_size.setdefault(sum(n for _, _, n in window), []).append((sum(n * n for _, _, n in window), at))
    group = [0] * len(windows)
    for size, found in sorted(by_size.items()):
        n = -(-len(found) * size // STEP_TOKENS)
        room = -(-len(found) // n)
        heap = [(0, first + g, 0) for g in range(n)]
        for cost, at in sorted(found, key=lambda x: (-x[0], x[1])):
            load, g, used = heap[0]
            group[at] = g
            if used + 1 < room:
                heapq.heapreplace(heap, (load + cost, g, used + 1))
            else:
                heapq.heappop(heap)
        first += n
    return group, first


def _rows(packer: Packer, first_window: int, groups: list[int], base: int) -> pa.RecordBatch:
    cols = [[] for _ in range(9)]
    for w, window in enumerate(packer.windows):
        offset, size = 0, sum(n for _, _, n in window)
        for key, start, length in window:
            doc_id, ids, total = packer.docs[key]
            for col, value in zip(cols, (doc_id, start, length, ids[4 * start:4 * (start + length)], total,
                                         base + first_window + w, offset, size, base + groups[w])):
                col.append(value)
            offset += length
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      names=[p.split()[0] for p in PIECES.split(", ")])


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document: its ids (little-endian unsigned 32-bit),
    place in the document, window, place in the window, window size and step
    group."""
    shared = docs.sparkSession.sparkContext.broadcast(read_text(vocabulary))
    closing = pack_ids([CLOSING_ID])

    def run(batches):
        encode = built(WordTokens, shared).ids
        base = TaskContext.get().partitionId() << 40
        packer, windows, groups = Packer(), 0, 0

        def flush(last):
            nonlocal windows, groups
            packer.pack(last)
            if packer.windows:
                dealt, groups = step_groups(packer.windows, groups)
                yield _rows(packer, windows, dealt, base)
                windows += len(packer.windows)
            packer.windows, packer.shard = [], 0
            packer.docs = {key: packer.docs[key] for _, key, _ in packer.rest}

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                packer.add(doc_id, (encode(text) if text else b"") + closing)
                if packer.shard >= SHARD_TOKENS or len(packer.docs) >= SHARD_DOCS:
                    yield from flush(False)
        yield from flush(True)

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, PIECES)


def packing_report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The contract's columns, one row per piece."""
    return pack(docs, vocabulary).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "sequence_tokens", "step_group")
