"""Personal data: patterns propose spans, checksums confirm them, context words
adjust a score. DataFrame functions only.

A pattern's matches come from ``regexp_extract_all`` and the gaps between them
from ``split`` with the same pattern; running sums of both lengths give the
offsets (code points, end exclusive). All group loops are possessive and every
candidate is anchored at the start of its run, so very long digit or word runs
cost linear time and no deep recursion.

Base kinds (email, ip, card, phone) are always kept once their validator
passes. The method adds ``iban`` (mod-97) and ``ssn`` (a plain number pattern,
kept only when a context word stands shortly before it).

Defined results: a null or empty text has no spans; repeated rows are
independent; extra columns pass through ``find_pii``; an empty table gives an
empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchlens.llm.common import free_name

# fixed values: span kinds in output order
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

#: The contract's patterns, rewritten without backtracking: a match can only
#: begin at the start of its run or where the previous match ended (\G).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}

#: A text without this plain substring or short pattern cannot match.
GATES = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.contains("+"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
    "ssn": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
}

#: Score of a confirmed match, and words within CONTEXT characters before it
#: that add BOOST; a span of an added kind stays from ACCEPT on.
SCORES = {"email": 1.0, "ip": 0.8, "card": 1.0, "phone": 0.8, "iban": 1.0, "ssn": 0.4}
WORDS = {
    "email": r"(?i)mail|contact", "ip": r"(?i)\bip\b|address|host", "card": r"(?i)card|visa|credit|pay",
    "phone": r"(?i)phone|tel|call|mobile", "iban": r"(?i)iban|account|bank",
    "ssn": r"(?i)ssn|social security|tax id",
}
CONTEXT, BOOST, ACCEPT = 40, 0.3, 0.6


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Luhn sum divisible by ten, over the digits from the right."""
    rev = F.split(F.reverse(_digits(m)), "")

    def step(acc, i):
        d = F.get(rev, i).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(_digits(m)) - 1), F.lit(0), step) % 10 == 0


def _octets(m: Column) -> Column:
    """Every part at most 255, whatever its leading zeros."""
    return F.forall(F.split(m, r"\."), lambda p: F.when(
        F.length(F.ltrim(p, F.lit("0"))) > 3, False).otherwise(
        F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))


def _mod97(m: Column) -> Column:
    """IBAN check: first four characters moved to the end, letters as 10..35,
    remainder 1 modulo 97."""
    flat = F.regexp_replace(m, " ", "")
    moved = F.concat(F.substr(flat, F.lit(5)), F.substring(flat, 1, 4))

    def step(acc, c):
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    rest = F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step)
    return (F.length(flat) >= 15) & (F.length(flat) <= 34) & (rest == 1)


VALID = {
    "email": lambda m: F.lit(True),
    "ip": _octets,
    "card": lambda m: F.length(_digits(m)).between(14, 19) & _luhn(m),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
    "iban": _mod97,
    "ssn": lambda m: ~m.rlike("^(000|666|9)"),
}

_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,score:double,text:string>>"


def _spans(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind in one text."""
    rank = KINDS.index(kind)

    def located(b):
        # offsets: running sums over gap and match lengths
        steps = F.zip_with(b["m"], F.slice(b["g"], 1, F.size(b["m"])),
                           lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap"), F.length(m).alias("n")))
        zero = F.struct(F.lit(0).alias("at"),
                        F.array().cast("array<struct<start:int,m:string>>").alias("got"))

        def step(acc, s):
            start = acc["at"] + s["gap"]
            return F.struct((start + s["n"]).alias("at"),
                            F.concat(acc["got"], F.array(F.struct(start.alias("start"), s["m"].alias("m")))).alias("got"))

        return F.aggregate(steps, zero, step, lambda acc: acc["got"])

    def scored(s):
        end = s["start"] + F.length(s["m"])
        before = F.substr(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1,
                          F.least(s["start"], F.lit(CONTEXT)))
        score = F.lit(SCORES[kind]) + F.when(before.rlike(WORDS[kind]), BOOST).otherwise(0.0)
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                        end.alias("end"), F.least(score, F.lit(1.0)).alias("score"), s["m"].alias("text"))

    bound = F.array(F.struct(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("m"),
                             F.split(text, PATTERNS[kind], -1).alias("g")))
    got = F.filter(F.transform(bound, located)[0], lambda s: VALID[kind](s["m"]))
    got = F.transform(got, scored)
    if kind not in BASE:
        got = F.filter(got, lambda s: s["score"] >= ACCEPT)
    return F.when(GATES[kind](text), got.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def find_pii(df: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``df`` plus an array of spans (start, rank, kind, end, score, text)
    sorted by start, then kind as listed."""
    text = F.coalesce(df[text_col], F.lit(""))
    return df.withColumn(free_name(df, out), F.sort_array(F.concat(*[_spans(text, k) for k in KINDS])))


def pii_report(df: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    got = find_pii(df.select("doc_id", "text")).select("doc_id", "pii")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                    s["end"].cast("string"))), ",")

    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))

    def counted(kind):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(k) for k in BASE]
    return got.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
                      joined(F.col("pii")).alias("spans"))
