"""Exact ids of a ``tokenizers`` file, with two bounded caches in front of the BPE model.

Corpora repeat words, so a text is cut at spaces (where the pre-tokenizer cuts as well), each word's ids are looked
up, and only unseen words reach the library.  The cut is used only for the two pre-tokenizer layouts for which it is
exact; every other layout, and every text or word in which the cut could differ, goes to ``Tokenizer.encode`` whole.
"""

from __future__ import annotations

import json
import os
from array import array

from .shared import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Fixed value: the documented split pattern of byte-level BPE.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[int, int]:
    """Byte -> printable code point of byte-level BPE: printable bytes stand for themselves, the rest follow from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class _Memo(dict):
    """Memo of at most ``most`` keys.

    A key is kept from its second miss on, since words that occur once would fill it, and a full memo keeps what it has,
    the early and so frequent words, until ``8 * most`` further misses suggest that the texts have changed.
    """

    def __init__(self, make, most: int):
        self.make, self.most = make, most
        self.seen, self.mask = bytearray(1 << 22), (1 << 22) - 1
        self.missed = 0

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) < self.most:
            at = hash(key) & self.mask
            if self.seen[at]:
                self[key] = value
            else:
                self.seen[at] = 1
        else:
            self.missed += 1
            if self.missed > 8 * self.most:
                self.clear()
                self.seen, self.missed = bytearray(1 << 22), 0
        return value


class Encoder:
    """``encode(text)`` returns the ids as little-endian unsigned 32-bit integers in one ``bytes`` object."""

    def __init__(self, path: str, most_words: int = 600_000):
        import re

        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.layout, pattern = self._layout(spec)
        self.normalizer = self.tok.normalizer
        self.alphabet = _byte_alphabet()
        # Letters beyond these, control characters, odd spaces and what special tokens start with: the library itself decides.
        starts = {x["content"][0] for x in spec.get("added_tokens", []) if x.get("content")}
        usual = "".join(c for c in map(chr, [*range(9, 14), *range(32, 127), *range(0xA1, 0x250)]) if c not in starts)
        self.plain = re.compile(f"[{re.escape(usual)}]*").fullmatch
        self.risky = re.compile(r" (?:\s|\Z)").search
        self.find = regex.compile(pattern).findall if pattern else None
        self.pieces = _Memo(self._piece, most_words // 2)
        self.first = _Memo(lambda w: self._word(w, ""), most_words)
        self.later = self.first if self.layout == "drops" else _Memo(lambda w: self._word(w, " "), most_words)

    @property
    def vocabulary(self) -> int:
        return self.tok.get_vocab_size(with_added_tokens=True)

    @staticmethod
    def _layout(spec: dict) -> tuple[str, str | None]:
        model, pre, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or spec.get("post_processor"):
            return "whole", None
        if pre.get("type") == "ByteLevel" and norm is None and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            return "leads", BYTE_LEVEL
        parts = pre.get("pretokenizers") or []
        if pre.get("type") == "Sequence" and [p.get("type") for p in parts] == ["Split", "ByteLevel"]:
            split, level = parts
            norms = [n.get("type") for n in (norm or {}).get("normalizers", [])]
            spaces = [n.get("content") for n in (norm or {}).get("normalizers", []) if n.get("type") == "Replace"]
            if split.get("behavior") == "Removed" and split.get("invert") and not level.get("use_regex", True) and not level.get("add_prefix_space") and norms == ["NFC", "Replace", "Lowercase"] and spaces == [" "]:
                return "drops", split["pattern"]["Regex"]
        return "whole", None

    def _library(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.lstrip(" ").isalnum():
            piece = piece.replace(" ", "Ġ")
        else:
            piece = piece.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _word(self, word: str, lead: str) -> bytes:
        if not self.plain(word):
            return self._library(lead + word)
        if self.layout == "drops":
            word = word.lower() if word.isascii() else self.normalizer.normalize_str(word)
        if word.isalpha():
            return self.pieces[lead + word]
        return b"".join(map(self.pieces.__getitem__, self.find(lead + word)))

    def encode(self, text: str) -> bytes:
        if self.layout == "whole":
            return self._library(text)
        words = text.split(" ")
        if self.layout == "drops":
            return b"".join(map(self.first.__getitem__, words))
        if self.risky(text):
            return self._library(text)
        return self.first[words[0]] + b"".join(map(self.later.__getitem__, words[1:]))


def encoder(path: str, most_words: int = 600_000) -> Encoder:
    """One encoder per Python worker, file and size of memo (600,000 words: some 300 MB), until the worker turns to another operator."""
    return held("encoders", (path, most_words), lambda: Encoder(path, most_words))


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
