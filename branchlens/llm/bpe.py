"""Byte-pair encoding and decoding with a public byte-level vocabulary.

A text is cut at special tokens, then into pre-tokens; a pre-token's bytes are
a doubly linked list of symbols, and a priority queue of (merge rank, position)
joins the best pair first. Entries whose symbols changed since they were pushed
are stale and skipped, so a pre-token of n symbols costs O(n log n) however
long it is. Decoding concatenates the vocabulary strings of the ids as
bytes.

A single space between two other characters always opens a pre-token, so most
texts fall into words at their spaces. A worker keeps bounded memos of words and
of pre-tokens and merges what is in neither; the ids of a batch are one array,
and its decoded bytes one gather of vocabulary strings.

The vocabulary file is a parameter; the driver reads it and ships its text as
a broadcast variable (a file of about 1.5 MB, whatever the data).

Defined results: a null text is an empty text: no ids, empty decoded text;
bytes that are no UTF-8 cannot occur in a text; repeated rows are independent;
extra columns pass through ``encode``; an empty table gives an empty result."""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchlens.llm.common import Memo, free_name, pack_ids, steps

#: Entries of a memo generation; two memos a worker.
MEMO = 200_000
#: A space next to other white space opens no pre-token by itself.
_RUN = re.compile(r"\s | \s")

# fixed value: the pre-token pattern of byte-level vocabularies
PRETOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character: printable Latin-1 bytes stand for
    themselves, the others follow from code point 256 on in byte order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in table)
    table.update({b: chr(256 + i) for i, b in enumerate(rest)})
    return table


class Codec:
    def __init__(self, spec: str):
        import regex
        model = json.loads(spec)
        self.vocab = model["model"]["vocab"]
        merges = model["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.alphabet = byte_alphabet()
        of = {c: b for b, c in self.alphabet.items()}
        # id -> bytes of its vocabulary string; special tokens stand for themselves
        strings = {i: bytes(of[c] for c in s) for s, i in self.vocab.items() if s not in self.special}
        strings |= {i: s.encode() for s, i in self.special.items()}
        self.strings = pa.array([strings.get(i) for i in range(max(strings) + 1)], pa.large_binary())
        self.find = regex.compile(PRETOKEN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        self.words = Memo(lambda word: self.pretokens(" " + word), MEMO)
        self.parts = Memo(lambda pretoken: pack_ids(self.merge(pretoken)), MEMO)

    def merge(self, pretoken: str) -> list[int]:
        sym = [self.alphabet[b] for b in pretoken.encode("utf-8")]
        n = len(sym)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        rank = self.ranks.get
        queue = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = nxt[i]
            if sym[i] != left or j < 0 or sym[j] != right:
                continue  # stale: one of the symbols was merged meanwhile
            sym[i], sym[j] = left + right, ""
            k = nxt[i] = nxt[j]
            if k >= 0:
                prev[k] = i
                if (r := rank((sym[i], sym[k]))) is not None:
                    heapq.heappush(queue, (r, i, sym[i], sym[k]))
            h = prev[i]
            if h >= 0 and (r := rank((sym[h], sym[i]))) is not None:
                heapq.heappush(queue, (r, h, sym[h], sym[i]))
        return [self.vocab[s] for s in sym if s]

    def pretokens(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self.find(text)))

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if _RUN.search(text):
            return self.pretokens(text)
        head, *tail = text.split(" ")
        return self.pretokens(head) + b"".join(map(self.words.__getitem__, tail))

    def ids(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if not self.cut or not any(s in text for s in self.special):
            return self.plain(text)
        return b"".join([pack_ids([self.special[p]]) if p in self.special else self.plain(p)
                         for p in self.cut.split(text)])

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> pa.StringArray:
        """One text per run of ids: their vocabulary strings, concatenated."""
        got = self.strings.take(pa.array(ids))
        at = np.frombuffer(got.buffers()[1], np.int64)[: len(ids) + 1][offsets].astype(np.int32)
        return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(at), got.buffers()[2])


_CODECS: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One codec per worker process and vocabulary."""
    spec = shared.value
    key = hash(spec)
    if key not in _CODECS:
        _CODECS[key] = Codec(spec)
    return _CODECS[key]


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", ids: str = "ids",
           decoded: str = "decoded") -> DataFrame:
    """``df`` plus the token ids of its texts and the text decoded from them.
    Narrow: no shuffle, batches stream through Python as Arrow."""
    with open(vocabulary, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    ids = free_name(df, ids)
    decoded = free_name(df.withColumn(ids, F.lit(0)), decoded)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False),
                           T.StructField(decoded, T.StringType(), False)])

    def run(batches):
        codec = _codec(shared)
        for whole in batches:
            for batch in steps(whole, whole.schema.get_field_index(text_col)):
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                packed = [codec.ids(t) if t else b"" for t in texts]
                offsets = np.cumsum([0, *[len(p) // 4 for p in packed]]).astype(np.int32)
                flat = np.frombuffer(b"".join(packed), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), codec.decode(offsets, flat)],
                    names=[*batch.schema.names, ids, decoded])

    return df.mapInArrow(run, schema)


def bpe_digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> list:
    """Columns n_tokens, ids_sha256 and decoded_sha256 of an encoded frame."""
    joined = F.concat_ws(",", F.col(ids).cast("array<string>"))
    return [F.size(ids).cast("long").alias("n_tokens"),
            F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
            F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256")]


def bpe_report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The contract's columns, one row per document."""
    got = encode(docs.select("doc_id", "text"), vocabulary)
    return got.select("doc_id", *bpe_digests(got))
