"""Public tokenizers inside tasks: ids of whole texts at the price of a dictionary
lookup a word.

All three vocabularies cut a text at places no merge crosses, so the ids of a
text are the ids of its words in a row, and a worker merges each distinct word
once while it remembers it. Texts for which that cut is not proven (special
token strings, unusual separators, scripts whose character classes depend on a
Unicode version) go through the tokenizer library as a whole. Vocabulary files
are parameters; the driver reads them and ships their content."""

from __future__ import annotations

import json
import re

import numpy as np

from branchlens.llm.bpe import PRETOKEN, byte_alphabet
from branchlens.llm.common import Memo, pack_ids

#: Beyond Latin, character classes are left to the tokenizer library.
_BEYOND = re.compile("[^\x00-ɏ]")
#: str.split() cuts at \x1c-\x1f, the word vocabulary does not; "<|" may open a
#: special token.
_WHOLE = re.compile("[\x1c-\x1f]|<\\|")

#: Marks that often follow a word.
_TAIL = ".,;:!?)"

# fixed value: the pre-token pattern of the word vocabulary
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordTokens:
    """Ids of the lower-casing word vocabulary as little-endian unsigned
    32-bit integers."""

    def __init__(self, spec: str):
        import regex
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(spec)
        self.model = self.library.model
        self.bytes = byte_alphabet()
        self.find = regex.compile(WORD_PATTERN).findall
        self.words = Memo(self._word)
        self.parts = Memo(self._part)

    def _whole(self, text: str) -> bytes:
        return pack_ids(self.library.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        if _BEYOND.search(word):
            return self._whole(word)
        low = word.lower()
        core = low.rstrip(_TAIL)
        if core.isalpha():  # the pattern gives the letters and the marks behind them
            return self.parts[core] + (self.parts[low[len(core):]] if len(core) < len(low) else b"")
        return b"".join([self.parts[p] for p in self.find(low)])

    def _part(self, part: str) -> bytes:
        level = part if part.isascii() else part.encode("utf-8").decode("latin-1")
        return pack_ids([t.id for t in self.model.tokenize(level.translate(self.bytes))])

    def ids(self, text: str) -> bytes:
        if _WHOLE.search(text):
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, text.split()))


class ByteTokens:
    """Ids of the byte-level vocabulary, special token strings being plain
    text. The rank merges of tiktoken give the ids of the vocabulary file."""

    def __init__(self, spec: str):
        import tiktoken
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(spec)
        self.library.encode_special_tokens = True
        model = json.loads(spec)
        special = {t["content"] for t in model.get("added_tokens", [])}
        of = {c: b for b, c in byte_alphabet().items()}
        ranks = {bytes(of[c] for c in s): i for s, i in model["model"]["vocab"].items() if s not in special}
        self.strings = [b""] * (max(ranks.values()) + 1)
        for s, i in ranks.items():
            self.strings[i] = s
        self.fast = tiktoken.Encoding("byte level", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if _BEYOND.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


class PieceTokens:
    """Ids of the piece vocabulary. No piece holds a space behind another
    character, so a text falls into words at its single spaces; the library
    puts the space back in front of each."""

    def __init__(self, proto: bytes):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.strings = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)
        self.words = Memo(lambda w: pack_ids(self.library.encode(w)), 150_000)

    def ids(self, text: str) -> np.ndarray:
        if (not self.by_word or "  " in text or text[0] == " " or text[-1] == " " or "▁" in text
                or _BEYOND.search(text)):
            return np.array(self.library.encode(text), np.uint32)
        return np.frombuffer(b"".join(map(self.words.__getitem__, text.split(" "))), np.uint32)


def read_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_BUILT: dict = {}


def built(kind, shared):
    """One tokenizer per worker process and vocabulary."""
    key = kind, hash(shared.value)
    if key not in _BUILT:
        _BUILT[key] = kind(shared.value)
    return _BUILT[key]
