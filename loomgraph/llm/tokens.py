"""Byte-level BPE of whole texts, with a bounded cache of words."""

from __future__ import annotations

import json
from array import array

import numpy as np
import regex


#: Words that a worker remembers; then it starts anew.
CACHE_WORDS = 400_000
#: The splitting rule of the byte-level vocabularies (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with characters beyond these blocks are left to ``tokenizers``, since Unicode tables may differ.
PLAIN = regex.compile("[\\x00-\\u024F\\u2010-\\u2027]*")
#: White space next to a space, or other than space and line feed, may join it in one piece.
JOINED = ("  ", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0")
MARKS = ".,;:!?"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def ranks(path: str) -> dict[bytes, int] | None:
    """bytes -> id, if the merges of the vocabulary file come in the order of their ids; else None."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged) or model["vocab"].keys() & {""}:
        return None
    letters, last = byte_alphabet(), max(merged, default=255)
    return {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if i <= last and all(c in letters for c in t)}


class Words(dict):
    """word -> the ids of a space and the word, as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.marks: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        if core != word and core.isalpha():  # letters and the marks after them are pieces of their own
            tail = word[len(core) :]
            if tail not in self.marks:
                self.marks[tail] = self.encode(tail)
            return self[core] + self.marks[tail]
        ids = self.encode(" " + word)
        if len(word) <= 48:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """``encode(text)``: the ids that tokenizers gives for the whole text, as little-endian bytes.

    A text is split at single spaces, since a word after one is tokenized alike
    wherever it stands; words are remembered.  New words go through the same
    merges in tiktoken, where the vocabulary allows it, else tokenizers itself;
    so do texts with other white space, special tokens or rare characters.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        known = ranks(path)
        self.plain = self.whole
        if known is not None:
            import tiktoken

            core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})._core_bpe
            self.plain = lambda text: array("I", core.encode_ordinary(text)).tobytes()
        self.words = Words(self.plain)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self.whole(text)
        if any(s in text for s in JOINED) or text[:1].isspace() or text[-1:].isspace():
            return self.plain(text)
        first, *rest = text.split(" ")
        return b"".join([self.plain(first) if first else b"", *map(self.words.__getitem__, rest)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
