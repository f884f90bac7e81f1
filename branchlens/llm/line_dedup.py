"""Line deduplication with a deletion-neighbourhood join.

Symbols are words: two lines are duplicates when their word sequences are
equal, or when both have at least MIN_WORDS words and differ by one word
(replaced, inserted or deleted). A line goes if an earlier line (by document
id, then line number) is its duplicate; so the earliest of every group stays.

The neighbourhood of a line are its variants with one word deleted, as hashed
keys. A replaced word leaves both lines with the same variant at the same
position; an inserted word makes the shorter line a variant of the longer one.
The lines of a key (variant, position) are all within the bound of each other,
so each is held against the earliest of them. A key of the shorter line itself
holds that line and the lines one word longer, which may be two edits from each
other; so the longer ones are held against the shorter line, and that one
against the earliest of them. Either way a line has one partner in a key: no
pairs inside a group are emitted. That pair's edit distance is then verified on
the words.

Only lines that can have a partner get variants: of two lines within one edit,
the first or the last half of the words agrees, so a line whose half keys
nobody shares is done after one narrow aggregation. Lines travel as hashes
(64 bits and the number of words); texts are shuffled by document id only, to cut the
candidate lines and to drop the removed ones.

Defined results: lines without a word are never removed; null and empty texts
stay as they are; a document all of whose worded lines went leaves in
``drop_lines`` (it is a copy) and has ``n_kept`` 0 in the report; rows that agree
in id and text are one document in the order; rows without an id come last; extra columns pass
through; an empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchlens.llm.common import GAP_CHARS

MIN_WORDS = 8
SEED = 40_013


#: Which half of a candidate line may hold the edit, and whether a partner has
#: another length.
TAIL, HEAD, LENGTH = 1, 2, 4


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def neighbourhood(words: list[bytes], flags: int) -> np.ndarray:
    """Keys of a line's deletion neighbourhood, from prefix and suffix sums of
    a polynomial hash: (variant without word i, i) for every i the flags allow,
    and, where a partner may be one word longer or shorter, the variants alone
    and, as the last key, the line itself. Only keys of the second kind are
    odd."""
    import xxhash
    n = len(words)
    h = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in words), np.uint64, n)
    power = np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))
    here = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power)])
    ahead = np.concatenate([np.cumsum((h[1:] * power[:-1])[::-1])[::-1], np.zeros(1, np.uint64)])
    gone = here[:-1] + ahead
    lo = 0 if flags & HEAD else n // 2
    hi = n if flags & TAIL else n - n // 2
    spot = np.arange(n, dtype=np.uint64)
    odd = np.uint64(1)
    keys = [_mix(gone[lo:hi] ^ _mix(spot[lo:hi] * np.uint64(4) + np.uint64(1)) ^ np.uint64(n - 1)) & ~odd]
    if flags & LENGTH:
        keys += [np.unique(_mix(gone[lo:hi] ^ np.uint64((n - 1) * 8 + 2)) | odd),
                 _mix(here[-1:] ^ np.uint64(n * 8 + 2)) | odd]
    return np.concatenate(keys).view(np.int64)


def _cut(text, spots):
    """(words, flags, pos) of the wanted lines of one document."""
    lines = (text or "").encode().split(b"\n")
    return [(lines[s["pos"]].split(), s["flags"], s["pos"]) for s in spots]


def _variants(text_col):
    """Rows (key, id, rid, at) of the wanted lines: at is twice the line's
    number, plus one where the key is the line itself."""
    def run(batches):
        for batch in batches:
            keys, ids, rids, at = [], [], [], []
            for r in batch.to_pylist():
                for w, flags, pos in _cut(r["_row"][text_col], r["spots"]):
                    k = neighbourhood(w, flags)
                    keys.append(k)
                    ids.append(np.full(len(k), r["id"]))
                    rids.append(np.full(len(k), r["rid"]))
                    at.append(np.full(len(k), 2 * pos, np.int32))
                    at[-1][-1] += bool(flags & LENGTH)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, ids, rids, at)],
                                                 names=["key", "id", "rid", "at"])
    return run


def _words_of(text_col):
    def run(batches):
        for batch in batches:
            rows = [(r["rid"], pos, [x.decode() for x in w]) for r in batch.to_pylist()
                    for w, _, pos in _cut(r["_row"][text_col], r["spots"])]
            if rows:
                rid, pos, w = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid, pa.int64()), pa.array(pos, pa.int32()), pa.array(w, pa.list_(pa.string()))],
                    names=["rid", "pos", "w"])
    return run


def within_one(a: Column, b: Column) -> Column:
    """Whether the edit distance of two word arrays is at most one: after the
    first word in which they differ, the rest agrees."""
    short = F.when(F.size(a) <= F.size(b), a).otherwise(b)
    long = F.when(F.size(a) <= F.size(b), b).otherwise(a)
    n = F.size(short)
    p = F.array_position(F.zip_with(short, F.slice(long, F.lit(1), n), lambda x, y: x != y), F.lit(True)).cast("int")
    same_length = F.slice(short, p + 1, n) == F.slice(long, p + 1, n)
    longer = F.slice(short, F.greatest(p, F.lit(1)), n) == F.slice(long, p + 1, n)
    return F.when(F.size(long) - n > 1, False).when(p == 0, True).otherwise(
        F.when(F.size(long) == n, same_length).otherwise(longer))


def _lines(with_halves: bool):
    """Rows (id, rid, text in UTF-8) to their worded lines: number, hash of the
    words, number of words and, where wanted, the hashes of the first and last
    floor(n/2) and ceil(n/2) words; those are null for lines that are compared
    for equality only and for the repeats of an even number of words."""
    def run(batches):
        import xxhash
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            row, at, n, h = [], [], [], []
            halves = ([], [], [], [])
            for i, text in enumerate(batch.column(2).to_pylist()):
                for pos, line in enumerate((text or b"").split(b"\n")):
                    w = line.split()
                    if not w:
                        continue
                    m = len(w)
                    row.append(i)
                    at.append(pos)
                    n.append(m)
                    h.append(digest(b" ".join(w), SEED))
                    if with_halves:
                        for j in (0, 1):
                            k = (m + j) // 2
                            use = m >= MIN_WORDS and (j == 0 or m % 2 == 1)
                            halves[2 * j].append(digest(b" ".join(w[:k]), 4 * k + TAIL) if use else 0)
                            halves[2 * j + 1].append(digest(b" ".join(w[m - k:]), 4 * k + HEAD) if use else 0)
            if not row:
                continue
            row, n = pa.array(row, pa.int32()), np.array(n, np.int32)
            cols = [batch.column(0).take(row), batch.column(1).take(row), pa.array(at, pa.int32()),
                    pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(n)]
            if with_halves:
                none = (n < MIN_WORDS, (n < MIN_WORDS) | (n % 2 == 0))
                cols += [pa.array(np.array(x, np.uint64).view(np.int64), mask=none[i // 2]) for i, x in enumerate(halves)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "rid", "pos", "h", "n", "k0", "k1", "k2", "k3"][:len(cols)])
    return run


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row`` (all columns of ``docs``) and ``gone``, the numbers of the
    lines to drop (null: none), one row per row of ``docs``.

    One plan without a cut: the documents are dealt by row hash once, every
    step that needs texts joins on it, and Spark reuses that exchange and those
    of the lines and variants."""
    base = docs.select(F.struct(*docs.columns).alias("_row"),
                       F.xxhash64(docs[id_col], docs[text_col]).alias("rid"))
    texts = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(2**63 - 1)).alias("id"),
                        F.xxhash64(docs[id_col], docs[text_col]).alias("rid"), docs[text_col].cast("binary").alias("text"))
    # h and n are never null: with no filter on them below it, both uses of the
    # aggregate share one exchange
    cut = "id long, rid long, pos int, h long not null, n int not null"
    first = (texts.mapInArrow(_lines(True), cut + ", k0 long, k1 long, k2 long, k3 long")
             .groupBy("h", "n").agg(F.min(F.struct("id", "rid", "pos", "k0", "k1", "k2", "k3")).alias("o"),
                                    F.count("*").alias("m")))

    # equal lines: everything behind the first occurrence
    again = first.where("m > 1").select(F.col("h").alias("h2"), F.col("n").alias("n2"),
                                        F.struct("o.id", "o.rid", "o.pos").alias("o"))
    equal = (texts.mapInArrow(_lines(False), cut)
             .join(again, (F.col("h") == F.col("h2")) & (F.col("n") == F.col("n2")))
             .where(F.struct("id", "rid", "pos") > F.col("o")).select("rid", "pos"))

    # candidates: lines that share a half key with another line (the condition
    # keeps the aggregate as it is above, so its exchange is reused)
    halves = first.where("m > 0 AND (o.k0 IS NOT NULL OR o.k1 IS NOT NULL)").select(
        "o.id", "o.rid", "o.pos", "n",
        F.explode(F.filter(F.array(*[F.struct(F.col(f"o.k{i}").alias("key"), F.lit((TAIL, HEAD)[i % 2]).alias("side"))
                                     for i in range(4)]), lambda s: s["key"].isNotNull())).alias("k"))
    halves = halves.select("id", "rid", "pos", "n", "k.key", "k.side")
    met = (halves.groupBy("key").agg(F.count("*").alias("m"), F.min("n").alias("a"), F.max("n").alias("b"))
           .where("m > 1").select("key", F.when(F.col("a") < F.col("b"), LENGTH).otherwise(0).alias("more")))
    spots = (halves.join(met, "key").groupBy("id", "rid", "pos")
             .agg(F.bit_or(F.col("side").bitwiseOR(F.col("more"))).cast("int").alias("flags"))
             .groupBy("id", "rid").agg(F.collect_list(F.struct("pos", "flags")).alias("spots")))

    # deletion neighbourhoods: every line against the earliest of its key, or
    # against the line that is the key (an odd key without that line has no pair)
    variants = base.join(spots, "rid").mapInArrow(_variants(text_col), "key long, id long, rid long, at int")
    o, own = F.struct("id", "rid", "at"), F.col("at") % 2 == 1
    lead = (variants.groupBy("key").agg(F.min(o).alias("lead"), F.max(F.when(own, o)).alias("own"),
                                        F.count("*").alias("m"))
            .where("m > 1 AND (key & 1 = 0 OR own IS NOT NULL)").select("key", "lead", "own"))
    partner = F.when(F.col("own").isNull() | own, F.col("lead")).otherwise(F.col("own"))

    def line(x):
        return F.struct(x["id"].alias("id"), x["rid"].alias("rid"), F.shiftright(x["at"], 1).alias("pos"))

    pairs = variants.join(lead, "key").where(o > partner).select(line(o).alias("o"), line(partner).alias("lead")).distinct()
    want = (pairs.select(F.explode(F.array("o", "lead")).alias("x")).select("x.id", "x.rid", "x.pos").distinct()
            .groupBy("id", "rid").agg(F.collect_list(F.struct("pos", F.lit(0).alias("flags"))).alias("spots")))
    text = base.join(want, "rid").mapInArrow(_words_of(text_col), "rid long, pos int, w array<string>")
    text = text.dropDuplicates(["rid", "pos"])
    a, b = (text.select(*[F.col(c).alias(p + c) for c in text.columns]) for p in ("a_", "b_"))
    near = (pairs.join(a, (F.col("o.rid") == F.col("a_rid")) & (F.col("o.pos") == F.col("a_pos")))
            .join(b, (F.col("lead.rid") == F.col("b_rid")) & (F.col("lead.pos") == F.col("b_pos")))
            .where(within_one(F.col("a_w"), F.col("b_w"))).select("o.rid", "o.pos"))

    gone = equal.union(near).groupBy("rid").agg(F.collect_set("pos").alias("gone"))
    return base.join(gone, "rid", "left").select("_row", "gone")


def _rest(text: Column, gone: Column) -> Column:
    """The text without the given lines."""
    kept = F.transform(F.array(F.struct(F.split(text, "\n", -1).alias("l"), gone.alias("g"))), lambda b: F.array_join(
        F.filter(b["l"], lambda line, i: ~F.array_contains(b["g"], i)), "\n"))[0]
    return F.when(gone.isNull(), text).otherwise(kept)


def _worded(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1),
                           lambda x: F.btrim(x, F.lit(GAP_CHARS)) != "")).cast("long")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without duplicate lines; documents that lost every worded line
    leave."""
    got = removed_lines(docs, id_col, text_col)
    got = got.withColumn("_text", _rest(F.col("_row").getField(text_col), F.col("gone")))
    got = got.where(F.col("gone").isNull() | (F.btrim("_text", F.lit(GAP_CHARS)) != ""))
    cols = []
    for c in docs.columns:
        col = F.col("_row").getField(c)
        if c == text_col:
            col = F.col("_text")
        elif c == "n_chars":
            col = F.when(F.col("gone").isNull(), col).otherwise(F.length("_text").cast(docs.schema[c].dataType))
        cols.append(col.alias(c))
    return got.select(*cols)


def line_report(docs: DataFrame) -> DataFrame:
    """One row per document: worded lines, worded lines kept, and the digest of
    the remaining text (a null text as an empty one)."""
    got = removed_lines(docs.select("doc_id", "text"))
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    total = _worded(text)
    return got.select(F.col("_row.doc_id").alias("doc_id"), total.alias("n_lines"),
                      (total - F.coalesce(F.size("gone"), F.lit(0))).alias("n_kept"),
                      F.sha2(_rest(text, F.col("gone")).cast("binary"), 256).alias("text_sha256"))
