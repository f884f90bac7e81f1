"""How far the sources of a language differ in their words, from bitmaps of terms
by count.

1. Counting: documents are cut into terms a batch at a time and counted by
   (language, source, term) and document; partial counts are summed by Spark.
2. Kept terms (in at least ``MIN_DOCS`` documents of the language) are dealt into
   blocks. A block's (group, count) is a bitmap of its terms: one row of a table
   in the shared folder. Terms come sorted by their total, so terms of like counts
   share bitmaps; a block closes at ``BLOCK_TERMS`` terms or, once it fills a
   machine word, at ``BLOCK_ROWS`` counts of groups.
3. A smoothed probability p = 1 + floor(SCALE * (count + 1) / (N + V)) depends on
   the group and the count alone, so f(p, q) of two groups is summed over joint
   cells: AND and population count of two bitmaps give a cell's number of terms.
   The terms a group lacks are the complement of its bitmaps.
4. Cells times f are summed by pair of groups, first in the block, then by Spark.

p is at most SCALE + 1, so (p - q)^2 fits 64 bits, and a pair's sum is below
(SCALE + V)^2; counts reach p through decimals, never through floating point.

The list of groups of a language is sent to every task; the result has its square
as rows, so the list is never larger than the square root of the result. Bitmaps
of a block are bounded by its terms times the groups, whatever the corpus.

Defined results: null text, lang or source are empty strings; a group without
terms has count 0 everywhere; a language without kept terms has value 0 for its
pairs and no term rows; repeated rows each count as a document; ties by UTF-8
order of the item; extra columns are ignored; an empty table gives an empty
result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from branchlens.llm.common import steps
from branchlens.session import cut_lineage

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
BLOCK_TERMS, BLOCK_ROWS, WORD_BITS = 4096, 2048, 64
#: Words of an AND held at once.
CELLS = 1 << 21

#: A-Z to a-z; every other ASCII character than a letter separates terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def _terms(texts: pa.Array) -> pa.ListArray:
    """Terms of every text, with empty strings at separators. The bytes of all
    texts are folded at once; their lengths stay."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")[at[0]:at[-1]]
    folded = bytes(data).translate(_FOLD)
    return pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(folded)))


def _count_step(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(group, term) with occurrences and documents of a few rows."""
    lang, source, text = (pc.fill_null(batch.column(i), "") for i in range(3))
    lists = _terms(text)
    words = lists.flatten().dictionary_encode()
    spelled = words.dictionary
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(text)), np.diff(lists.offsets.to_numpy()))
    blank = pc.index(spelled, pa.scalar("", spelled.type)).as_py()
    if blank >= 0:
        doc, code = doc[code != blank], code[code != blank]
    width = max(len(spelled), 1)
    both, n = np.unique(doc * width + code, return_counts=True)
    group = pa.StructArray.from_arrays([lang, source], ["lang", "source"])
    names = {}
    of_doc = np.array([names.setdefault((g["lang"], g["source"]), len(names)) for g in group.to_pylist()], np.int64)
    key = of_doc[both // width] * width + both % width
    order = np.argsort(key, kind="stable")
    key, first = np.unique(key[order], return_index=True)
    totals = np.add.reduceat(n[order], first) if len(first) else n[:0]
    docs = np.diff(np.append(first, len(order)))
    listed = list(names)
    of_row = pa.array(key // width)
    return pa.RecordBatch.from_arrays(
        [pa.array([g[0] for g in listed], pa.string()).take(of_row), pa.array([g[1] for g in listed], pa.string()).take(of_row),
         spelled.take(pa.array(key % width)), pa.array(totals, pa.int64()), pa.array(docs, pa.int64())],
        names=["lang", "source", "term", "n", "docs"])


def _count(batches):
    for batch in batches:
        yield from map(_count_step, steps(batch, 2))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term) with occurrences ``n`` and documents ``docs``."""
    src = docs.select(*[docs[c].cast("string") for c in ("lang", "source", "text")])
    return (src.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def kept_terms(counts: DataFrame) -> DataFrame:
    """One row per kept term of a language: its total and its (source, n)."""
    return (counts.groupBy("lang", "term")
            .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by_source"))
            .where(F.col("docs") >= MIN_DOCS).select("lang", "term", "total", "by_source"))


def probability(n: Column, total: Column, terms: Column) -> Column:
    """p of a count in a group of ``total`` occurrences over ``terms`` terms."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, (total + terms).cast("decimal(20,0)"))


def groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every occurring group with its occurrences of kept terms, and the kept
    terms of its language with theirs."""
    occurring = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = (kept.select("lang", F.explode("by_source").alias("s")).groupBy("lang", F.col("s.source").alias("source"))
           .agg(F.sum("s.n").alias("group_n")))
    whole = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n"))
    return (occurring.join(own, ["lang", "source"], "left").join(whole, "lang", "left")
            .select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("group_n", "terms", "lang_n")]))


_BITMAP = "lang string, block long, terms int, source string, n long, bits binary"


def _bitmap_rows(batches, block_terms: int):
    """Terms, sorted by language and total within the task, as blocks."""
    base, nth = TaskContext.get().partitionId() << 32, 0
    lang, terms, rows = None, 0, {}

    def closed():
        width = -(-terms // WORD_BITS) * WORD_BITS
        bits = []
        for at in rows.values():
            flags = np.zeros(width, np.uint8)
            flags[at] = 1
            bits.append(np.packbits(flags).tobytes())
        k = len(bits)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * k, pa.string()), pa.array([base | nth] * k, pa.int64()), pa.array([terms] * k, pa.int32()),
             pa.array([s for s, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64()), pa.array(bits, pa.binary())],
            names=["lang", "block", "terms", "source", "n", "bits"])

    for batch in batches:
        for of, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if terms and (of != lang or terms >= block_terms or (terms % WORD_BITS == 0 and len(rows) >= BLOCK_ROWS)):
                yield closed()
                nth, terms, rows = nth + 1, 0, {}
            lang = of
            for g in found:
                rows.setdefault((g["source"], g["n"]), []).append(terms)
            terms += 1
    if terms:
        yield closed()


def bitmaps(kept: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(lang, block, source, n) with the bitmap of the block's terms that occur
    ``n`` times in the group, as a table in the shared folder."""
    rows = kept.sortWithinPartitions("lang", F.desc("total"), "term").select("lang", "by_source")
    return cut_lineage(rows.mapInArrow(lambda batches: _bitmap_rows(batches, block_terms), _BITMAP))


def joint_sums(block: list[np.ndarray], p: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """Sum of f(p, q) over the terms of a block for every ordered pair of
    groups: ``block[g]`` holds the bitmaps of group g (rows of machine words),
    ``p[g]`` their probabilities."""
    first = np.cumsum([0] + [len(x) for x in p[:-1]])
    bits, prob = np.concatenate(block), np.concatenate(p)
    out = np.empty((len(bits), len(p)), np.int64)
    step = max(1, cells // max(1, bits.size))
    for at in range(0, len(bits), step):
        part = slice(at, at + step)
        joint = np.bitwise_count(bits[part, None, :] & bits[None, :, :]).sum(axis=2, dtype=np.int64)
        gap = prob[part, None] - prob[None, :]
        out[part] = np.add.reduceat(joint * (gap * gap // prob[None, :]), first, axis=1)
    return np.add.reduceat(out, first, axis=0)


def pair_sums(maps: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, source, item, value): f summed over all kept terms of the
    language, for every ordered pair of its groups."""
    spark = maps.sparkSession
    listed: dict[str, list] = {}
    for g in sorted(found.collect(), key=lambda g: (g["lang"], g["source"])):  # its square is the result
        listed.setdefault(g["lang"], []).append((g["source"], g["group_n"], g["terms"]))
    shared = spark.sparkContext.broadcast(listed)

    def prob(n: int, total: int, terms: int) -> int:
        return 1 + SCALE * (n + 1) // (total + terms)

    def run(table: pa.Table) -> pa.Table:
        lang, terms = table["lang"][0].as_py(), table["terms"][0].as_py()
        words = -(-terms // WORD_BITS)
        every = np.zeros(words * WORD_BITS, np.uint8)
        every[:terms] = 1
        every = np.packbits(every).view(np.uint64)
        by_source: dict[str, list] = {}
        for s, n, b in zip(*(table[c].to_pylist() for c in ("source", "n", "bits"))):
            by_source.setdefault(s, []).append((n, np.frombuffer(b, np.uint64)))
        block, p = [], []
        names = [s for s, _, _ in shared.value[lang]]
        for s, total, v in shared.value[lang]:
            mine = by_source.get(s, [])
            lacking = every.copy()
            for _, b in mine:
                lacking &= ~b
            block.append(np.array([lacking, *[b for _, b in mine]], np.uint64))
            p.append(np.array([prob(n, total, v) for n in (0, *[n for n, _ in mine])], np.int64))
        value = joint_sums(block, p)
        x, y = np.nonzero(~np.eye(len(names), dtype=bool))
        names = pa.array(names, pa.string())
        return pa.table({"lang": pa.array([lang] * len(x), pa.string()), "source": names.take(pa.array(x)),
                         "item": names.take(pa.array(y)), "value": pa.array(value[x, y], pa.int64())})

    sums = (maps.groupBy("lang", "block").applyInArrow(run, "lang string, source string, item string, value long")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    # pairs of languages without kept terms have no block
    other = found.select(F.col("lang").alias("of"), F.col("source").alias("item"))
    bare = found.where("terms = 0").join(other, (F.col("lang") == F.col("of")) & (F.col("source") != F.col("item")))
    return sums.unionByName(bare.select("lang", "source", "item", F.lit(0).cast("long").alias("value")))


def term_divergence(kept: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, source, item, value): terms that a group uses more than its
    language does."""
    rows = kept.select("lang", F.col("term").alias("item"), "total", F.explode("by_source").alias("s"))
    rows = rows.select("lang", "item", "total", F.col("s.source").alias("source"), F.col("s.n").alias("n"))
    # as many groups as the root of the report's rows
    rows = rows.join(F.broadcast(found), ["lang", "source"])
    rows = (rows.withColumn("p", probability(F.col("n"), F.col("group_n"), F.col("terms")))
            .withColumn("q", probability(F.col("total"), F.col("lang_n"), F.col("terms"))).where("p > q"))
    return rows.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))


def divergence_report(docs: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The contract's columns: part ``pair`` with all ranks, part ``term`` to
    rank ``TOP_TERMS``."""
    kept = cut_lineage(kept_terms(term_counts(docs)))
    found = cut_lineage(groups(docs, kept))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    parts = []
    for name, rows, top in (("pair", pair_sums(bitmaps(kept, block_terms), found), None),
                            ("term", term_divergence(kept, found), TOP_TERMS)):
        ranked = rows.withColumn("rank", F.row_number().over(order))
        ranked = ranked.where(F.col("rank") <= top) if top else ranked
        parts.append(ranked.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank"))
    return parts[0].unionByName(parts[1])


SQL = f"""
WITH src AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM src),
numbered AS (SELECT lang, source, row_number() OVER () AS rid,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM src),
occ AS (SELECT lang, source, rid, unnest(w) AS term FROM numbered),
kept AS (SELECT lang, term, count(*) AS total FROM occ GROUP BY lang, term HAVING count(DISTINCT rid) >= {MIN_DOCS}),
size AS (SELECT lang, count(*) AS V, sum(total) AS N FROM kept GROUP BY lang),
cnt AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM occ o JOIN kept k ON o.lang = k.lang AND o.term = k.term
  GROUP BY o.lang, o.source, o.term),
tot AS (SELECT lang, source, sum(n) AS N FROM cnt GROUP BY lang, source),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total,
  1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.N, 0) + s.V)::HUGEINT AS p,
  1 + ({SCALE}::HUGEINT * (k.total + 1)) // (s.N + s.V)::HUGEINT AS q
  FROM g JOIN kept k ON g.lang = k.lang JOIN size s ON g.lang = s.lang
  LEFT JOIN tot t ON g.lang = t.lang AND g.source = t.source
  LEFT JOIN cnt c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON a.lang = p.lang AND a.source = p.source AND b.source = p.item),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM grid WHERE n > 0 AND p > q),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM every
  UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
