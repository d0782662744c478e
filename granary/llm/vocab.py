"""Encoders over public vocabulary files. The file's path is a parameter; workers keep one encoder for each path."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import regex
import tiktoken

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
#: Fixed value: how byte-level BPE of this kind splits a text before merging.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: how the word vocabulary splits a text, after lower-casing.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def path(name: str) -> str:
    """Where a vocabulary file of that name lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself if printable, else from U+0100 on in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _spec(file: str) -> tuple[dict[str, int], dict[str, int]]:
    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    return spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}


class ByteEncoder:
    """Byte-level BPE: equal to the tokenizers library on whole texts, special strings included."""

    def __init__(self, file: str):
        vocab, special = _spec(file)
        chars = _byte_of_char()
        ranks = {bytes(chars[c] for c in k): v for k, v in vocab.items() if k not in special}
        self._plain = tiktoken.Encoding(file, pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = special
        self.splitter = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        size = max(max(ranks.values()), *special.values()) + 1 if special else max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in ranks.items():
            self.bytes_of[i] = b
        for s, i in special.items():
            self.bytes_of[i] = s.encode()
        self.length_of = np.array([len(b) for b in self.bytes_of], np.int64)
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"

    def encode_plain(self, text: str) -> list[int]:
        """A text without special strings."""
        return self._plain.encode_ordinary(text)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class WordEncoder(dict):
    """Word-end BPE, one word at a time through a bounded cache: word -> its ids as little-endian uint32.

    White space separates words and is dropped, so a text's ids are those of
    its words in order. A merge table on bytes gives the same merges once each
    split-off word carries a mark byte for its end. Words with characters
    outside printable Latin go through the tokenizers library, as do texts with
    special strings, whole.
    """

    LIMIT = 300_000
    _simple = re.compile(r"[!-~¡-¬®-įı-ɏ]+")

    def __init__(self, file: str):
        super().__init__()
        from tokenizers import Tokenizer

        vocab, special = _spec(file)
        chars = _byte_of_char()
        ranks = {}
        for k, v in vocab.items():
            if k not in special:
                stem, end = (k[:-4], b"\x01") if k.endswith("</w>") else (k, b"")
                ranks[bytes(chars[c] for c in stem) + end] = v
        self._marked = tiktoken.Encoding(file, pat_str=r"[^\x01]*\x01", mergeable_ranks=ranks, special_tokens={})
        self._split = regex.compile(WORD_PATTERN)
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        self._whole = Tokenizer.from_file(file)
        self._whole.no_truncation()
        self._whole.no_padding()

    def __missing__(self, word: str) -> bytes:
        if self._simple.fullmatch(word):
            parts = self._split.findall(word.lower())
            ids = self._marked.encode_ordinary("\x01".join(parts) + "\x01") if parts else []
        else:
            ids = self._whole.encode(word, add_special_tokens=False).ids
        out = np.array(ids, "<u4").tobytes()
        if len(self) < self.LIMIT:
            self[word] = out
        return out

    _odd = re.compile("[\x1c-\x1f]")
    _words = re.compile(r"[^ \t\n\r\x0b\x0c]+")

    def encode(self, text: str) -> bytes:
        """All ids of ``text`` as little-endian uint32."""
        if self._special and self._special.search(text):
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = self._words.findall(text) if self._odd.search(text) else text.split()
        return b"".join(map(self.__getitem__, words))


@lru_cache(maxsize=4)
def byte_encoder(file: str) -> ByteEncoder:
    return ByteEncoder(file)


@lru_cache(maxsize=4)
def word_encoder(file: str) -> WordEncoder:
    return WordEncoder(file)
