"""Token ids as the tokenizers library gives them, fast enough for a corpus.

For tokenizers whose words end at white space and give it no ids, a text's ids are those of its chunks between
spaces, one after the other. A chunk in plain Latin letters is split into words here and only new words go to the
library's BPE model; any other chunk goes to the library as it is. What a chunk gave is remembered, within a bound.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
from collections.abc import Callable

import numpy as np

#: Chunks, and words, in each of the two generations of an encoder's memory. A bound on memory only: results are the same.
REMEMBERED = 1 << 18
#: Longer chunks and words aren't remembered.
LONGEST = 48

#: Visible characters below U+0250 but the dotted capital I: each is its own NFC form and has a lower case of one character.
PLAIN = re.compile("[!-~\xa1-įı-ɏ]+")


PLAIN_TEXT = re.compile("[\n -~\xa1-įı-ɏ]*+")
#: Signs that are words of their own after a word's letters.
ENDS = frozenset(".,;:!?")


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 characters for themselves, the other bytes in turn from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


def spelled(word: str) -> str:
    """A word in the letters of a byte-level vocabulary."""
    return word if word.isascii() else "".join(map(byte_letters().__getitem__, word.encode()))


def word_pattern(path: str) -> str | None:
    """The pattern of the words, if the file is a lower-casing byte-level BPE that drops white space; else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norms = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if norms != ["NFC", "Replace", "Lowercase"] or [s.get("type") for s in steps] != ["Split", "ByteLevel"]:
        return None
    split, level = steps
    pattern = split["pattern"].get("Regex", "")
    added = spec.get("added_tokens", [])
    fits = split["invert"] and split["behavior"] == "Removed" and pattern.endswith(r"[^\s\p{L}\p{N}]+") and not level["add_prefix_space"] and not level["use_regex"]
    return pattern if fits and spec["model"]["type"] == "BPE" and all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in added) else None


class Memory(dict):
    """What a function gave for a key; forgets the keys that two generations of new ones haven't used."""

    def __init__(self, make: Callable[[str], bytes], most: int = REMEMBERED):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if (value := self.old.get(key)) is None:
            value = self.make(key)
            if len(key) > LONGEST:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """ids(text): the text's ids without added special tokens, as unsigned 32-bit numbers."""

    def __init__(self, path: str):
        import regex

        self.tokenizer = load_tokenizer(path)
        self.model = self.tokenizer.model
        pattern = word_pattern(path)
        self.split = regex.compile(pattern).findall if pattern else None
        self.words, self.chunks = Memory(self.word), Memory(self.chunk)
        self.plain = False  # whether the text at hand is known to be plain

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(spelled(word))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if not self.plain and (not PLAIN.fullmatch(chunk) or "<|" in chunk):
            return self.whole(chunk)
        low = chunk if self.plain else chunk.lower()
        if low.isalpha():
            return self.words[low]
        if low[:-1].isalpha() and low[-1] in ENDS:
            return self.words[low[:-1]] + self.words[low[-1]]
        return b"".join(map(self.words.__getitem__, self.split(low)))

    def ids(self, text: str) -> np.ndarray:
        if self.split is None:
            return np.frombuffer(self.whole(text), "<u4")
        self.plain = bool(PLAIN_TEXT.fullmatch(text)) and "<|" not in text
        if self.plain:
            text = text.lower()
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" "))), "<u4")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
