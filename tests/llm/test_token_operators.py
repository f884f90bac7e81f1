"""Packing, alignment of tokenizers and source divergence against brute force:
nulls, empty and long texts, ties, repeated rows, empty tables, clashing
columns."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from branchlens.llm import alignment, bpe, divergence, packing, queries, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n long, ids string, block long, term string"
ODD = [None, "", " ", "  lead", "a  b ", "tab\tand\r\nline ", "\U0001F600 \U0001F600x", "<|endoftext|> <s> <0x41>",
       "▁bad mark", "İstanbul ½ ﬁ ² ΣΑΣ ς", "a\x1cb \x85 c d", "中文 字符 mixed", "don't I'M 12a3", "x" * 3000,
       "word, " * 6000]


def _texts():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)] + ["Élan", "straße", "the", "The", "a-b", "tion."]
    return ODD + [" ".join(rng.choice(words, int(rng.integers(1, 900)))) for _ in range(60)]


def _rows():
    rows = [(i, t, ["en", "de", None][i % 3], ["s", "s", "t", None][i % 4], 1, "x", 5, "y") for i, t in enumerate(_texts())]
    return rows + [rows[-1], (None, "same text again " * 5, "en", "s", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def files():
    return [queries.vocabulary(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model")]


def test_ids_equal_the_libraries(files):
    word, byte = tokens.WordTokens(tokens.read_text(files[0])), tokens.ByteTokens(tokens.read_text(files[1]))
    piece = tokens.PieceTokens(tokens.read_bytes(files[2]))
    for _ in range(2):  # the second time from the memos
        for t in filter(None, _texts()):
            assert np.frombuffer(word.ids(t), "<u4").tolist() == word.library.encode(t, add_special_tokens=False).ids
            assert byte.ids(" " + t).tolist() == byte.library.encode(" " + t, add_special_tokens=False).ids
            assert piece.ids(t).tolist() == piece.library.encode(t)


def test_memo_forgets_but_stays_right(files, monkeypatch):
    word = tokens.WordTokens(tokens.read_text(files[0]))
    word.words.limit = word.parts.limit = 3
    for t in filter(None, _texts()[:30]):
        assert np.frombuffer(word.ids(t), "<u4").tolist() == word.library.encode(t, add_special_tokens=False).ids
        assert len(word.words) <= 3 and len(word.words.old) <= 3


def test_bpe_words_equal_pretokens(files):
    codec = bpe.Codec(tokens.read_text(files[1]))
    for t in filter(None, _texts()):
        if not any(s in t for s in codec.special):
            assert codec.plain(t) == codec.pretokens(t)


def _check_packing(rows, pieces, files):
    library = tokens.WordTokens(tokens.read_text(files[0])).library
    want = Counter()
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want[(i, ids.tobytes())] += 1
    by_doc = {}
    for r in pieces:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], bytes(r["ids"])))
    for (i, ids), n in want.items():
        found = sorted(by_doc[(i, len(ids) // 4)])
        if n == 1:
            assert b"".join(p[2] for p in found) == ids and [p[0] for p in found] == \
                np.cumsum([0] + [p[1] for p in found])[:-1].tolist()
        else:
            assert sum(p[1] for p in found) == n * len(ids) // 4
    windows = {}
    for r in pieces:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_tokens"], r["step_group"]))
    for found in windows.values():
        found.sort()
        size = sum(p[1] for p in found)
        assert [p[0] for p in found] == np.cumsum([0] + [p[1] for p in found])[:-1].tolist()
        assert size <= 2048 and size & (size - 1) == 0 and {p[2:] for p in found} == {(size, found[0][3])}
    return windows


def test_packing(docs, none, files):
    got = packing.pack(docs, files[0]).collect()
    windows = _check_packing([(r[0], r[1]) for r in _rows()], got, files)
    sizes = Counter(sum(p[1] for p in w) for w in windows.values())
    assert sum(n for s, n in sizes.items() if s < 256) <= 8 * 3  # the ends of three tasks
    report = packing.packing_report(docs, files[0])
    assert {(r["doc_id"], r["start"], r["ids_crc32"]) for r in report.collect()} == \
        {(r["doc_id"], r["start"], zlib.crc32(bytes(r["ids"]))) for r in got}
    assert packing.packing_report(none, files[0]).count() == 0


def test_packing_small_shards_and_groups(docs, files, monkeypatch):
    packer = packing.Packer()
    rng, total = np.random.default_rng(1), 0
    dealt, first, windows = [], 0, []
    for n in range(400):
        size = int(rng.integers(1, 5000))
        packer.add(n, bytes(4 * size))
        total += size
        if n % 7 == 0 or n == 399:
            packer.pack(n == 399)
            assert packer.tokens < 2048 and packer.tokens == sum(r[0] for r in packer.rest)
            groups, first = packing.step_groups(packer.windows, first)
            windows += packer.windows
            dealt += groups
            packer.windows = []
    assert sum(p[2] for w in windows for p in w) == total and not packer.rest
    held = Counter()
    for w, g in zip(windows, dealt):
        held[g] += sum(p[2] for p in w)
    assert max(held.values()) <= packing.STEP_TOKENS and set(held) == set(range(first))


def test_step_groups_are_balanced():
    rng = np.random.default_rng(2)
    windows = []
    for k in range(640):
        cuts = np.sort(rng.choice(2047, int(rng.integers(0, 6)), replace=False)) + 1
        windows.append([(k, 0, int(n)) for n in np.diff([0, *cuts, 2048])])
    groups, n = packing.step_groups(windows, 0)
    cost, count = np.zeros(n), np.zeros(n)
    for w, g in zip(windows, groups):
        cost[g] += sum(p[2] ** 2 for p in w)
        count[g] += 1
    assert n == 20 and set(count) == {32} and cost.max() < 1.02 * cost.min()


def _aligned(rows, files):
    """Brute force over tokens: links, groups, corpus-wide counts."""
    from tokenizers import Tokenizer
    import sentencepiece
    a_lib, b_lib = Tokenizer.from_file(files[1]), sentencepiece.SentencePieceProcessor(model_file=files[2])
    a_lib.encode_special_tokens = True
    a_str = tokens.ByteTokens(tokens.read_text(files[1])).strings
    b_str = tokens.PieceTokens(tokens.read_bytes(files[2])).strings
    docs, count = [], Counter()
    for i, t in rows:
        a, b = (a_lib.encode(" " + t, add_special_tokens=False).ids, b_lib.encode(t)) if t else ([], [])
        want = (" " + (t or "")).encode()
        if not t or b"".join(a_str[x] for x in a) != want or b"".join(b_str[x] for x in b) != want:
            docs.append((i, [], [], [], [], ""))
            continue
        ea, eb = np.cumsum([len(a_str[x]) for x in a]), np.cumsum([len(b_str[x]) for x in b])
        sa, sb = ea - [len(a_str[x]) for x in a], eb - [len(b_str[x]) for x in b]
        links = [(x, y) for x in range(len(a)) for y in range(np.searchsorted(eb, sa[x], "right"), len(b)) if sb[y] < ea[x]]
        cuts = sorted(set(ea.tolist()) & set(eb.tolist()))
        text, pa_, pb_ = [], 0, 0
        for c in cuts:
            na, nb = np.searchsorted(ea, c, "right"), np.searchsorted(eb, c, "right")
            text.append(",".join(map(str, a[pa_:na])) + "|" + ",".join(map(str, b[pb_:nb])))
            pa_, pb_ = na, nb
        count.update((a[x], b[y]) for x, y in links)
        docs.append((i, a, b, links, cuts, hashlib.sha256(";".join(text).encode()).hexdigest()))
    return docs, count


def test_alignment(docs, none, files, monkeypatch):
    plain, count = _aligned([(r[0], r[1]) for r in _rows()], files)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    want = []
    for i, a, b, links, cuts, sha in plain:
        ids = [(a[x], b[y]) for x, y in links]
        want.append((i, len(a), len(b), len(cuts), len(ids), sum(count[p] == best[p[1]] for p in ids),
                     sum(count[p] for p in ids), sha))
    got = [tuple(r) for r in alignment.alignment_report(docs, *files[1:]).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(w[1] == 0 for w in want) >= 3
    real = {r["doc_id"]: r for r in alignment.align(docs, *files[1:]).collect()}
    for i, a, b, links, cuts, _ in plain:
        r = real[i]
        assert (r["a_ids"], r["b_ids"], list(zip(r["link_a"], r["link_b"])), r["cuts"]) == (a, b, links, cuts)
    assert alignment.alignment_report(none, *files[1:]).count() == 0


def test_lockstep_lanes():
    """Short lanes, tokens longer than a lane, and documents of one byte."""
    rng = np.random.default_rng(4)
    sizes = [int(x) for x in rng.integers(1, 200, 40)] + [1, 1, 300]
    def side():
        out, at = [], 0
        for n in sizes:
            cuts = np.sort(rng.choice(n, int(rng.integers(0, min(n, 30))), replace=False))
            out += sorted({at + int(c) for c in cuts if c} | {at + n})
            at += n
        return np.array(out)
    a, b, ends = side(), side(), np.cumsum(sizes)
    sa, sb = np.concatenate([[0], a[:-1]]), np.concatenate([[0], b[:-1]])
    want = [(x, y, a[x] == b[y]) for x in range(len(a)) for y in range(len(b)) if sa[x] < b[y] and sb[y] < a[x]]
    for lane in (1, 2, 7, 1024):
        i, j, cut = alignment.lockstep(a, b, ends, lane)
        assert list(zip(i, j, cut)) == want


def _diverged(rows):
    import re
    docs = {}
    for _, t, lang, source, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        docs.setdefault(lang or "", []).append((source or "", re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)))
    out = []
    for lang, found in docs.items():
        df = Counter(w for _, ws in found for w in set(ws))
        kept = {w for w, n in df.items() if n >= 3}
        counts = {s: Counter() for s, _ in found}
        for s, ws in found:
            counts[s].update(w for w in ws if w in kept)
        whole = sum(counts.values(), Counter())
        p = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))
        f = lambda x, y: (x - y) * (x - y) // y
        for s, c in counts.items():
            pairs = [(-sum(f(p(c, w), p(o, w)) for w in kept), i.encode(), i) for i, o in counts.items() if i != s]
            terms = [(-f(p(c, w), p(whole, w)), w.encode(), w) for w in kept if c[w] and p(c, w) > p(whole, w)]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
                out += [(lang, s, part, i, -v, k + 1) for k, (v, _, i) in enumerate(ranked)]
    return out


@pytest.mark.parametrize("block_terms", [5, divergence.BLOCK_TERMS])
def test_divergence(spark, docs, none, block_terms):
    rng = np.random.default_rng(6)
    more = [(900 + k, " ".join(f"t{x}É" for x in rng.zipf(1.3, 300) if x < 400), "fr", f"s{k % 5}", 1, "", 1, "")
            for k in range(30)] + [(990, None, "it", "only", 1, "", 1, ""), (991, "", "pt", "a", 1, "", 1, ""),
                                   (992, "x y", "pt", "b", 1, "", 1, "")]
    rows = _rows() + more
    got = [tuple(r) for r in divergence.divergence_report(
        spark.createDataFrame(rows, SCHEMA).repartition(4), block_terms).collect()]
    assert sorted(got) == sorted(_diverged(rows))
    assert {("pt", "a", "pair", "b", 0, 1), ("pt", "b", "pair", "a", 0, 1)} <= set(got)
    assert divergence.divergence_report(none).count() == 0


def test_joint_sums_in_steps():
    rng = np.random.default_rng(9)
    words, groups = 3, 4
    level = rng.integers(0, 3, (groups, 64 * words))     # every term has a level in every group
    block, p = [], []
    for g in range(groups):
        flags = (level[g] == np.arange(3)[:, None]).astype(np.uint8)
        block.append(np.packbits(flags, axis=1).view(np.uint64))
        p.append(rng.integers(1, 10**9, 3))
    want = [[sum((int(p[g][a]) - int(p[h][b])) ** 2 // int(p[h][b]) for a, b in zip(level[g], level[h]))
             for h in range(groups)] for g in range(groups)]
    for cells in (1, 100, 1 << 21):
        assert divergence.joint_sums(block, p, cells).tolist() == want


def test_large_counts_stay_exact(spark):
    n = 10**13
    df = spark.createDataFrame([(n, 7 * n, 12345)], "n long, total long, terms long")
    got = df.select(divergence.probability(F.col("n"), F.col("total"), F.col("terms"))).first()[0]
    assert got == 1 + 10**9 * (n + 1) // (7 * n + 12345)
