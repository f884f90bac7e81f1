"""Training-data operators against brute force on small tables: nulls, empty
and long texts, ties, repeated rows, empty tables, clashing extra columns."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from branchlens.llm import (bpe, line_dedup, mixing, near_dup, pii, quality_classifier, quality_rules, queries, topk,
                            toxicity, warc)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, quality string, pii string"
GAP = re.compile(r"[^\x20\x09-\x0D]+")


def _base(k, n=60):
    return " ".join(f"w{(k * 7 + i * i) % 97}x{k}" for i in range(n))


def _rows():
    a = _base(1)
    texts = [None, "", " \t\n", a, a, a.replace("w8x1", "CHANGED"), _base(2), "one two three", "One two three",
             a + "\nshared line of words that many documents have in common here",
             "shared line of words that many documents have in common there\n" + _base(3), "word " * 5000, "x" * 20000,
             "1" * 3000 + " 2" * 4000, "mail a@b.co ip 10.0.0.1 and 10.0.0.999 card 4539 1488 0343 6467 call +1 (555) 010-9999",
             "iban DE89370400440532013000 ssn 078-05-1120 and far from any such word also the number 078-05-1121"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None if t is None else len(t), "i", "q", "p")
            for i, t in enumerate(texts)]
    return rows + [rows[3], (None, a, None, None, 1, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_quality_counts(docs, none):
    got = {r["doc_id"]: r for r in quality_rules.quality_report(docs).collect()}
    for i, t, *_ in _rows()[:-1]:
        w = GAP.findall(t or "")
        tri = [tuple(w[j:j + 3]) for j in range(len(w) - 2)]
        c = Counter(tri)
        rep = {p for j, g in enumerate(tri) if c[g] > 1 for p in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if GAP.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep))
        assert tuple(got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (len(w) < 50 or 100 * len(rep) > 50 * len(w))
    assert quality_rules.score_rules(docs).columns[-1] == "_quality"
    assert quality_rules.quality_report(none).count() == 0


def _luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def test_pii_spans(docs, none):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
             "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
             "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(k, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m.split(".")),
                "card": 14 <= len(d) <= 19 and _luhn(d), "phone": 10 <= len(d) <= 15}[k]

    got = {r["doc_id"]: r for r in pii.pii_report(docs).collect()}
    for i, t, *_ in _rows()[:-1]:
        spans = sorted((m.start(), j, k, m.end()) for j, k in enumerate(kinds)
                       for m in re.finditer(kinds[k], t or "") if ok(k, m.group()))
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (i, got[i]["spans"])
    assert got[15]["spans"] == "iban:5:27,ssn:32:43"
    assert "_pii" in pii.find_pii(docs).columns
    assert pii.pii_report(none).count() == 0


def test_bpe_round_trip(spark, docs, none):
    Tokenizer = pytest.importorskip("tokenizers").Tokenizer
    path = queries.vocabulary()
    ref = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(1, "a<|endoftext|>b 　 \U0001f600 don't 12ab\n\n  x\x1c y")], "doc_id long, text string")
    for df in (docs, extra):
        got = bpe.encode(df, path)
        for r in got.collect():
            assert list(r[-2]) == ref.encode(r["text"] or "", add_special_tokens=False).ids
            assert r[-1] == (r["text"] or "")
    assert bpe.bpe_report(none, path).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (1 + i % 4)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]
    rows += [(900, None), (901, [float("nan")] * 6), (902, [None] * 6), (None, rows[0][1]), (1000, rows[7][1][:3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") % 100 == 0).collect()]
    v = {i: np.pad(np.floor(1024 * np.array(x)), (0, 6 - len(x))).astype(int) for i, x in rows
         if i is not None and x and None not in x and not np.isnan(x).any()}
    want = []
    for q in sorted(i for i in v if i % 100 == 0):
        best = sorted((-int(v[q] @ x), i) for i, x in v.items() if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(got) == want
    assert topk.exact_top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "hé" * 30000), (2, "http://b", "same"), (5, None, "same"), (3, "u\r\nv", None),
            (4, "x", ""), (None, "n", "alone"), (6, "c", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    warc.write_archives(pages, str(tmp_path / "w"), segment=1000)
    got = {r["page_id"]: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert len(got) == len(rows) and all(r["error"] is None for r in got.values())
    for i, _, h in rows:
        if i in (2, 3):
            continue
        assert bytes(got[i]["payload"]).decode() == (h or "") and got[i]["record_type"] == "response"
    assert (got[2]["record_type"], got[2]["refers_to"], got[2]["payload_bytes"]) == ("revisit", 5, 4)
    assert (got[3]["record_type"], got[3]["refers_to"]) == ("revisit", 4)
    records = warc.read_records(spark, str(tmp_path / "w"))
    damaged = warc.reassemble(records.where("segment IS NULL OR segment <> 2"))
    assert damaged.where("error IS NOT NULL").count() == 1
    assert warc.warc_report(pages.where("false"), str(tmp_path / "e")).count() == 0


def test_mixing(spark, docs, none):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 400)), f"s{min(i % 7, 3)}" if i % 9 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_report(df).toPandas()
    again = mixing.mix_report(df.repartition(7)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert (got.taken <= 2 * got["size"]).all()
    src = {i: s for i, _, s in rows}
    got["source"] = [src[i] or "~" for i in got.doc_id]
    per = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    cap, w = 2.0 * per["size"].to_numpy(), np.array([3, 1, 2, 3, 1][:len(per)], float)
    t, left, open_ = np.zeros(len(per)), 1.5 * per["size"].sum(), np.ones(len(per), bool)
    while left > 1e-9 and open_.any():
        t[open_] += left * w[open_] / w[open_].sum()
        left = np.maximum(t - cap, 0).sum()
        t, open_ = np.minimum(t, cap), t < cap
    assert np.allclose(per.target, t)
    assert (abs(per.taken - per.target) <= 0.01 * per.target + 2 * mixing.BLOCK).all()
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    words = mixed.select(F.sum(F.size(F.expr("filter(split(text, ' '), x -> x <> '')")))).first()[0]
    assert words > 0 and mixing.mix_report(docs).count() == docs.count()
    assert mixing.mix_report(none).count() == 0


def test_mixing_keeps_documents_whole(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 30)
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        lines = [" \t".join(f"d{i}w{k}" for k in range(int(rng.integers(0, 60)))) for _ in range(int(rng.integers(1, 9)))]
        rows.append((i, "\n".join(lines) + "  \n" * (i % 2), f"s{min(i % 25, 3)}"))
    # too few documents to meet the quota without a cut
    rows += [(1000 + i, "\n".join(f" l{j}  d{i} a b c d e f g h" for j in range(200 + 70 * i)), "t") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan = {r["doc_id"]: r for r in mixing.plan_mix(df).collect()}
    report = {r["doc_id"]: r["taken"] for r in mixing.mix_report(df.repartition(5)).collect()}
    texts = {i: t for i, t, _ in rows}
    got, cut = Counter(), Counter()
    for r in mixing.apply_mix(df).collect():
        full = texts[r["doc_id"]]
        got[r["doc_id"]] += len(r["text"].split())
        if r["text"] != full:
            assert full.startswith(r["text"]) and full[len(r["text"])] == "\n"
            cut[r["source"]] += 1
    assert all(report[i] == got[i] for i in report)
    n = Counter(s for *_, s in rows)
    assert cut["t"] == 1 and all(c <= -(-n[s] // 30) for s, c in cut.items())
    for s in n:
        mine = [i for i, _, x in rows if x == s]
        target, shards = plan[mine[0]]["target"], -(-n[s] // 30)
        assert abs(sum(got[i] for i in mine) - target) <= (mixing.BLOCK + 30) * (shards + 1)


def _sainte_lague(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        j = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[j] += 1
    return won


def test_apportionment(spark):
    for votes, seats in (([53, 24, 23], 7), ([1000, 1, 1, 1, 1], 50), ([5, 5, 5], 4), ([90, 9, 1], 1)):
        df = spark.createDataFrame([(1, i, float(v), seats) for i, v in enumerate(votes)], "g int, p int, v double, m long")
        got = {r["p"]: r["quota"] for r in mixing.sainte_lague(df, ["g"], ["p"], "v", "m").collect()}
        assert [got[i] for i in range(len(votes))] == _sainte_lague(votes, seats)


def test_near_dup(docs, none):
    sets = {}
    for i, t, *_ in _rows()[:-1]:
        w = GAP.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = near_dup.near_dup_report(docs).collect()
    for r in got:
        want = comp[3] if r["doc_id"] is None else comp[r["doc_id"]]
        assert r["component_id"] == want
        assert r["n_shingles"] == len(sets[3 if r["doc_id"] is None else r["doc_id"]])
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in comp if comp[i] == i)
    assert near_dup.near_dup_report(none).count() == 0


def test_line_dedup(docs, none):
    got = {r["doc_id"]: r for r in line_dedup.line_report(docs).collect()}
    # 9 carries the text of 3 and a line that 10 has with another last word
    assert got[9]["n_lines"] == 2 and got[9]["n_kept"] == 1
    assert got[10]["n_lines"] == 2 and got[10]["n_kept"] == 1
    assert got[4]["n_kept"] == 0 and got[3]["n_kept"] == 1 and got[5]["n_kept"] == 0
    assert got[7]["n_kept"] == 1 and got[8]["n_kept"] == 1 and got[0]["n_lines"] == 0
    left = line_dedup.drop_lines(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} >= {0, 1, 2, 3, 6, 7, 8}
    assert line_dedup.line_report(none).count() == 0


def test_neighbourhood_meets_within_one():
    words = [b"w%d" % i for i in range(12)]
    every = line_dedup.TAIL | line_dedup.HEAD | line_dedup.LENGTH
    own = set(line_dedup.neighbourhood(words, every).tolist())
    for i in range(12):
        for other in (words[:i] + [b"z"] + words[i + 1:], words[:i] + words[i + 1:], words[:i] + [b"z"] + words[i:]):
            assert own & set(line_dedup.neighbourhood(other, every).tolist())
    assert not own & set(line_dedup.neighbourhood(words[::-1], every).tolist())


def _within_one(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < line_dedup.MIN_WORDS or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_line_dedup_all_orders(spark):
    rng = np.random.default_rng(4)
    lines = []
    for f, order in enumerate(itertools.permutations(range(4))):
        s = [f"f{f}w{i}" for i in range(9)]
        four = [s, *[s[:i] + [f"new{i}"] + s[i:] for i in (1, 4, 8)]]
        lines += [four[i] for i in order]
    for f in range(40):
        s = [f"r{f}w{k}" for k in rng.integers(0, 4, int(rng.integers(7, 12)))]
        family = [s]
        for _ in range(9):
            w = list(family[int(rng.integers(0, len(family)))])
            i, new = int(rng.integers(0, len(w))), [f"r{f}w{rng.integers(0, 4)}"]
            w[i:i + int(rng.integers(0, 2))] = new if rng.integers(0, 3) else []
            family.append(w)
        lines += [family[i] for i in rng.permutation(10)]
    want = {i for i, w in enumerate(lines) if any(_within_one(v, w) for v in lines[:i])}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in line_dedup.line_report(df).collect() if r["n_kept"] < r["n_lines"]}
    assert got == want


def _toxic_docs():
    rng = np.random.default_rng(1)
    plain = [f"ord{i}" for i in range(200)]
    rows = []
    for i in range(400):
        w = [plain[k] for k in rng.integers(0, 200, 40)]
        y = int(i % 4 == 0)
        if y:
            for p in rng.integers(0, 40, 3):
                w[p] = ["vile", "scumbag"][int(rng.integers(0, 2))] + ["", "!"][int(rng.integers(0, 2))]
        rows.append((i, " ".join(w), y))
    return rows


def test_toxicity(spark, docs, none):
    rows = _toxic_docs()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.toxicity_report(df.drop("toxic"), df.drop("text")).collect()
    y = {i: t for i, _, t in rows}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in y if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r["predicted"] == y[r["doc_id"]] for r in held)
    field = toxicity.train(df.drop("toxic"), df.drop("text"))
    text = "é ord1 vile scumbag, " + "ord2 " * 300 + "vile"
    score, spans = field.score(text)
    assert [text[a:b] for a, b, _ in spans] == ["vile scumbag,", "vile"] and score == max(p for *_, p in spans)
    e = np.array([field.weight(t) for t in text.split()])
    assert np.allclose(field.marginals(e), field.marginals(e, whole=True), atol=1e-6)
    scored = toxicity.score_toxicity(docs, field)
    assert scored.count() == docs.count() and scored.where(scored.toxicity.score.isNull()).count() == 0
    labels = df.drop("text").where("false")
    assert toxicity.drop_toxic(docs, labels).count() == docs.count()
    assert toxicity.toxicity_report(none, df.drop("text")).count() == 0


def test_quality_classifier(spark, docs, none):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        n = int(rng.integers(40, 200))
        w = [f"w{k}" for k in rng.integers(0, 500, n)]
        bad = i % 6 == 0
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w) + ".", int(not bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = quality_classifier.quality_scores(df.drop("quality"), df.drop("text")).collect()
    y = {i: q for i, _, q in rows}
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == y[r["doc_id"]] for r in held]) > 0.95
    model, prior = quality_classifier.train(df.drop("quality"), df.drop("text"))
    assert 0.6 < prior < 0.95
    scored = quality_classifier.score_quality(docs, model)
    assert scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert scored.where("doc_id IN (0, 1, 2) AND score <> 0").count() == 0
    assert quality_classifier.quality_scores(none, df.drop("text")).count() == 0


def test_repeated_training_ids(spark):
    """A labelled id that thousands of rows carry is one training document."""
    rows = _toxic_docs()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    hot = next(i for i, _, y in rows if y and zlib.crc32(str(i).encode()) % 5)
    docs = df.drop("toxic").union(spark.range(20_000).select(F.lit(hot).alias("doc_id"), F.concat(F.lit("copy "), F.col("id")).alias("text")))
    labels = df.drop("text")
    sample = toxicity.training_sample(docs, labels, "toxic").collect()
    assert len(sample) == len({r["doc_id"] for r in sample}) == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i, *_ in rows)
    assert quality_classifier.quality_scores(docs, labels.withColumnRenamed("toxic", "quality")).count() == 20_400
    report = toxicity.toxicity_report(df.drop("toxic"), labels).where("n_spans > 0").first()
    assert report["spans"].count(":") == report["n_spans"]


def _same(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name]).fetchall()
    cols = [c[0] for c in con.description]
    got = [tuple(r) for r in queries.QUERIES[name](spark, sf).select(*cols).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    _same(spark, name, "/root/testdata/sf0.001")
