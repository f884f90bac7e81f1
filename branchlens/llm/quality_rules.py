"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a built-in expression over the whole text (no user function,
no shuffle). A rule keeps a text whose metric lies in [low, high]; the verdict
is the conjunction of all rules.

Defined results: a null, empty or blank text has all counts 0 and fails the
base rule; ties and repeated rows are independent rows; extra columns pass
through ``score_rules`` untouched (its own columns are returned as one struct
under a free name); an empty table gives an empty result.

Three-word windows are compared by a 64-bit hash inside one text (odds of a
false match for n words: about n^2 / 2^65)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchlens.llm.common import GAP_CHARS, free_name, trimmed, words

SYMBOLS = "#*$%&|<>"
BULLET = r"^[\x20\x09]*[-*\u2022]"

# fixed values: frequent function words of the four languages
STOP_WORDS = (
    "the be to of and that have with in is was for it on as are this by "
    "der die das und ist von mit zu den ein eine sich des für auf nicht im "
    "le la les de des et un une que dans en du est pour au par sur "
    "el los las del y se por con una para es lo").split()


@dataclass(frozen=True)
class Rule:
    metric: str
    low: float | None = None
    high: float | None = None


#: Metrics a rule may name, from the counts of one text.
METRICS = {
    "n_words": lambda m: m["n_words"],
    "mean_word_length": lambda m: m["word_chars"] / F.greatest(m["n_words"], F.lit(1)),
    "symbol_ratio": lambda m: m["n_symbols"] / F.greatest(m["n_words"], F.lit(1)),
    "repeat_ratio": lambda m: m["n_repeat_words"] / F.greatest(m["n_words"], F.lit(1)),
    "dup_line_ratio": lambda m: m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)),
    "bullet_line_ratio": lambda m: m["n_bullets"] / F.greatest(m["n_lines"], F.lit(1)),
    "upper_ratio": lambda m: m["n_upper"] / F.greatest(m["n_letters"], F.lit(1)),
    "stop_words": lambda m: m["stop_words"],
}

#: Threshold table of the verdict.
RULES = (
    Rule("n_words", 50, None),
    Rule("mean_word_length", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.25),
    Rule("repeat_ratio", None, 0.5),
    Rule("dup_line_ratio", None, 0.5),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("upper_ratio", None, 0.6),
    Rule("stop_words", 2, None),
)


def _repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur at least twice: windows are
    sorted by hash, neighbours with equal hashes are repeats, and the positions
    they cover are counted once. O(n log n)."""
    grams = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("g"), i.alias("p")))

    def covered(s):
        last = F.size(s) - 1
        same = F.filter(
            F.sequence(F.lit(0), last),
            lambda j: F.when((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["g"] == s[j]["g"]), True)
            .otherwise((j < last) & (s[F.least(j + 1, last)]["g"] == s[j]["g"])))
        spots = F.flatten(F.transform(same, lambda j: F.array(s[j]["p"], s[j]["p"] + 1, s[j]["p"] + 2)))
        return F.size(F.array_distinct(spots))

    # transform over a one-element array binds the sorted windows once
    counted = F.transform(F.array(F.sort_array(grams)), covered)[0]
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(counted)


def _counts(text: Column) -> Column:
    """All counts of a text as one struct, words and lines bound once."""
    raw = F.coalesce(text, F.lit(""))
    stops = F.array(*[F.lit(s) for s in sorted(set(STOP_WORDS))])

    def per_text(b):
        w, lines, t = b["w"], b["lines"], b["t"]
        counts = {
            "n_words": F.size(w),
            "word_chars": F.length(F.translate(t, GAP_CHARS, "")),
            "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_bullets": F.size(F.filter(lines, lambda x: x.rlike(BULLET))),
            "n_repeat_words": _repeat_words(w),
            "stop_words": F.size(F.array_intersect(w, stops)),
            "n_upper": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")),
            "n_letters": F.length(F.regexp_replace(t, r"[^\p{L}]+", "")),
        }
        return F.struct(*[c.cast("long").alias(k) for k, c in counts.items()])

    lines = F.filter(F.split(raw, "\n", -1), lambda x: F.btrim(x, F.lit(GAP_CHARS)) != "")
    bound = F.array(F.struct(words(text).alias("w"), lines.alias("lines"), raw.alias("t")))
    return F.transform(bound, per_text)[0]


def _verdict(m: Column, rules) -> Column:
    ok = F.lit(True)
    for r in rules:
        v = METRICS[r.metric](m)
        if r.low is not None:
            ok = ok & (v >= F.lit(r.low))
        if r.high is not None:
            ok = ok & (v <= F.lit(r.high))
    return ok


def score_rules(df: DataFrame, text_col: str = "text", rules=RULES, out: str = "quality") -> DataFrame:
    """``df`` plus one struct column (under ``out`` or a free variant of it)
    with every count, ``base_failed`` and ``kept``."""
    name = free_name(df, out)
    got = df.withColumn(name, _counts(df[text_col]))
    m = F.col(name)
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return got.withColumn(name, m.withField("base_failed", failed)
                          .withField("kept", ~failed & _verdict(m, rules)))


def quality_report(df: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    got = score_rules(df.select("doc_id", "text"))
    q = F.col("quality")
    return got.select("doc_id", *[q[c].alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


_STOPS = ", ".join(f"'{s}'" for s in sorted(set(STOP_WORDS)))
_GAP = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w0 AS (SELECT r, unnest(regexp_split_to_array(trim(t, {_GAP}), '[\\x20\\x09-\\x0D]+')) AS x,
              unnest(range(len(regexp_split_to_array(trim(t, {_GAP}), '[\\x20\\x09-\\x0D]+')))) AS p
       FROM d WHERE trim(t, {_GAP}) <> ''),
tri AS (SELECT r, p, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM w0 WINDOW o AS (PARTITION BY r ORDER BY p)),
rep AS (SELECT r, p, count(*) OVER (PARTITION BY r, x, y, z) AS c FROM tri WHERE z IS NOT NULL),
hit AS (SELECT DISTINCT r, p + k AS p FROM rep, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1),
hits AS (SELECT r, count(*) AS n_repeat_words FROM hit GROUP BY r),
ws AS (SELECT r, count(*) AS n_words, count(DISTINCT CASE WHEN x IN ({_STOPS}) THEN x END) AS stop_words
       FROM w0 GROUP BY r),
l0 AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
ls AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines,
              count(*) FILTER (regexp_matches(l, '^[ \\t]*[-*\u2022]')) AS bullets
       FROM l0 WHERE trim(l, {_GAP}) <> '' GROUP BY r),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words,
             length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             coalesce(stop_words, 0) AS stop_words, coalesce(n_lines, 0) AS n_lines, coalesce(bullets, 0) AS bullets,
             length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS uppers,
             length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS letters
      FROM d LEFT JOIN ws USING (r) LEFT JOIN ls USING (r) LEFT JOIN hits USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2.0 AND 14.0
       AND n_symbols / greatest(n_words, 1) <= 0.25 AND n_repeat_words / greatest(n_words, 1) <= 0.5
       AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND bullets / greatest(n_lines, 1) <= 0.9
       AND uppers / greatest(letters, 1) <= 0.6 AND stop_words >= 2 AS kept
FROM b
"""
