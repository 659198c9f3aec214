"""Exact token counts by dynamic programming over prefixes.

For each new word the number of tokens of every prefix is computed once, the prefix taken as a word of its own as it would be
if the text ended there, and is remembered. A text's counts at every prefix are then sums over its words: totals, the
longest prefix within a budget and the cost of any cut need no encoding again.

Chunks of other characters than plain Latin ones are brought into their normal form first, in stretches that no mark joins across,
so that each of their prefixes has a place in it; where a cut parts a letter from its marks, the table goes on from the last word
before with the letter as it then is. Words that few others share their length with fill the table alone, a byte at a time.

Null text counts as empty: no bytes, no tokens. Rows are independent: repeated rows repeat, null ids pass through, an
empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import read, slices
from corpusloom.llm.lattice import Vocabulary, Walk, by_length
from corpusloom.llm.tokens import ENDS, LONGEST, PLAIN, PLAIN_TEXT, REMEMBERED, byte_letters, load_tokenizer, word_pattern

#: Texts whose new words are computed together.
TEXTS = 1024
#: Fewer words of one length than this fill their tables one by one.
FEW_WORDS = 32


def byte_vocabulary(path: str) -> tuple[Vocabulary, int]:
    """The vocabulary over bytes, numbered from 1, and what is added to a byte that ends a word."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model.get("end_of_word_suffix") or ""
    number = {c: b + 1 for b, c in enumerate(byte_letters())}
    closing = 256 if end else 0

    def symbols(piece: str) -> tuple[int, ...]:
        if end and piece.endswith(end):
            own = [number[c] for c in piece[: -len(end)]]
            return (*own[:-1], own[-1] + closing)
        return tuple(number[c] for c in piece)

    names = sorted(model["vocab"], key=model["vocab"].get)
    at = {name: k for k, name in enumerate(names)}
    merges = {}
    for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
        merges[at[a], at[b]] = (rank, at[a + b])
    return Vocabulary([symbols(n) for n in names], merges), closing


@functools.cache
def joining() -> frozenset[str]:
    """Characters that a character before them can take up in the composed normal form, or that can change places with a mark before them."""
    found = {chr(c) for c in range(0x300, 0x20000) if unicodedata.combining(chr(c))}
    for c in range(0xC0, 0x20000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(chr(int(parts[1], 16)))
    return frozenset(found | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})  # vowels and ends of Hangul syllables


def lowered(text: str) -> str:
    """Composed and in lower case, each character by itself."""
    return "".join(map(str.lower, unicodedata.normalize("NFC", text)))


class TokenCounter:
    """Counts for one tokenizers file. A file whose words don't end at white space is counted by the library itself, prefix by prefix."""

    def __init__(self, path: str):
        import regex

        self.tokenizer = load_tokenizer(path)
        pattern = word_pattern(path)
        self.split = regex.compile(pattern).findall if pattern else None
        if pattern:
            self.vocabulary, self.closing = byte_vocabulary(path)
            self.walk = Walk(self.vocabulary, self.closing)
            self.find_words = regex.compile(pattern).finditer
            with open(path, encoding="utf-8") as f:
                added = sorted((t["content"] for t in json.load(f).get("added_tokens", [])), key=len, reverse=True)
            self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.words: list[dict[str, bytes]] = [{}, {}]
        self.chunks: list[dict[str, int]] = [{}, {}]

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _recall(memory: list[dict], keys: Iterable[str]) -> dict:
        new, old = memory
        return {k: v for k in keys if (v := new.get(k, old.get(k))) is not None}

    @staticmethod
    def _keep(memory: list[dict], found: dict) -> None:
        if len(memory[0]) > REMEMBERED:
            memory[:] = [{}, memory[0]]
        memory[0].update((k, v) for k, v in found.items() if len(k) <= LONGEST)

    def word_prefixes(self, words: Iterable[str]) -> dict[str, bytes]:
        """For each lower-case word the counts at its prefixes of 1, 2, ... code points, as unsigned 32-bit numbers."""
        words = dict.fromkeys(words)
        found = self._recall(self.words, words)
        new = [w for w in words if w not in found]
        fresh: dict[str, bytes] = {}
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        for part, rows in by_length(raw):
            if len(part) < FEW_WORDS:
                fresh |= {new[i]: self.walked(new[i]) for i in part}
                continue
            _, _, closed = self.vocabulary.last_pieces(rows + 1, self.closing)
            closed = closed[:, 1:].astype("<u4")
            for i, counts in zip(part, closed, strict=True):
                if len(raw[i]) != len(new[i]):  # keep the counts where a code point ends
                    counts = counts[[*np.flatnonzero(np.frombuffer(raw[i], np.uint8)[1:] & 0xC0 != 0x80), len(counts) - 1]]
                fresh[new[i]] = counts.tobytes()
        for w in new:
            if w[0] == "'" and len(w) == 3 and w[1].isalpha():  # cut short, a contraction is a sign and a letter
                fresh[w] = fresh[w][:4] + b"\2\0\0\0" + fresh[w][8:]
        self._keep(self.words, fresh)
        return found | fresh

    def walked(self, word: str) -> bytes:
        walk, counts = self.walk, []
        walk.start()
        for c in word:
            for byte in c.encode("utf-8", "surrogatepass"):
                walk.add(byte)
            counts.append(walk.closed())
        return np.array(counts, "<u4").tobytes()

    def pieces_of(self, chunk: str) -> tuple[list[str], int]:
        """The words of a chunk, and how many added tokens stand between them."""
        n = 0
        if chunk and (not PLAIN.fullmatch(chunk) or "<|" in chunk):
            parts = self.added.split(chunk)
            if len(parts) > 1:
                return [w for p in parts for w in self.pieces_of(p)[0]], len(parts) - 1
            low = self.tokenizer.normalizer.normalize_str(chunk)
            return self.split(low), n
        low = chunk.lower()
        if low.isalpha():
            return [low], n
        return ([low[:-1], low[-1]], n) if low[:-1].isalpha() and low[-1] in ENDS else (self.split(low), n)

    def chunk_counts(self, chunks: Iterable[str]) -> dict[str, int]:
        parts = {c: self.pieces_of(c) for c in chunks}
        known = self.word_prefixes(w for p, _ in parts.values() for w in p)
        total = {w: int.from_bytes(raw[-4:], "little") for w, raw in known.items()}
        return {c: n + sum(map(total.__getitem__, p)) for c, (p, n) in parts.items()}

    @staticmethod
    def chunks_of(text: str) -> list[str]:
        """What stands between spaces and line feeds; in lower case if that changes no place."""
        low = text.lower() if PLAIN_TEXT.fullmatch(text) and "<|" not in text else text
        return low.replace("\n", " ").split(" ")

    def known_counts(self, split: list[list[str]]) -> dict[str, int]:
        """A mapping that has the count of every chunk of the lists."""
        known = self.chunks[0]
        if len(known) > REMEMBERED:
            self.chunks = [{}, {c: n for c, n in known.items() if len(c) <= LONGEST}]
            known = self.chunks[0]
        missing = set().union(*split).difference(known)
        if missing:
            known.update(self._recall(self.chunks, missing))
            known.update(self.chunk_counts(missing.difference(known)))
        return known

    def counts(self, texts: list[str], budget: int | None = None) -> list[tuple[int, int]]:
        """The number of tokens of each text, and the length of its longest prefix within the budget."""
        if self.split is None:
            return [(n, len(t) if budget is None or n <= budget else self.fit(t, budget)) for t, n in zip(texts, self.whole(texts), strict=True)]
        out: list[tuple[int, int]] = []
        for k in range(0, len(texts), TEXTS):
            part = texts[k : k + TEXTS]
            split = [self.chunks_of(t) for t in part]
            count = self.known_counts(split).__getitem__
            for text, chunks in zip(part, split, strict=True):
                n = sum(map(count, chunks))
                out.append((n, len(text) if budget is None or n <= budget else self._fit(chunks, [*map(count, chunks)], budget)))
        return out

    def prefix_counts(self, text: str) -> np.ndarray:
        """The number of tokens of text[:k] for k from 0 to its length."""
        if self.split is None:
            return np.array(self.whole([text[:k] for k in range(len(text) + 1)]), np.int64)
        out, base = [np.zeros(1, np.int64)], 0
        for n, chunk in enumerate(self.chunks_of(text)):
            if n:
                out.append(np.array([base]))  # the space or line feed
            own = self.chunk_prefixes(chunk)
            out.append(base + own)
            base += int(own[-1]) if len(own) else 0
        return np.concatenate(out)

    def chunk_prefixes(self, chunk: str) -> np.ndarray:
        """The number of tokens of chunk[:k] for k from 1 to its length."""
        if chunk and (not PLAIN.fullmatch(chunk) or "<|" in chunk):
            out, base, at = [np.empty(0, np.int64)], 0, 0
            for m in self.added.finditer(chunk):  # cut short, an added token is text
                own = self.odd_prefixes(chunk[at : m.end()])
                before = m.start() - at
                own[-1] = (own[before - 1] if before else 0) + 1
                out.append(base + own)
                base, at = int(out[-1][-1]), m.end()
            return np.concatenate([*out, base + self.odd_prefixes(chunk[at:])])
        words, _ = self.pieces_of(chunk)
        known, out, base = self.word_prefixes(words), [np.empty(0, np.int64)], 0
        for w in words:
            out.append(base + np.frombuffer(known[w], "<u4").astype(np.int64))
            base = int(out[-1][-1])
        return np.concatenate(out)

    def odd_prefixes(self, text: str) -> np.ndarray:
        """The number of tokens of text[:k] for k from 1 to its length, for text of any characters without added tokens."""
        if not text:
            return np.empty(0, np.int64)
        joins = joining()
        cuts = [0, *(k for k in range(1, len(text)) if text[k] not in joins), len(text)]
        forms = [lowered(text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        whole = "".join(forms)
        if re.sub(r"\s+", " ", whole) != re.sub(r"\s+", " ", self.tokenizer.normalizer.normalize_str(text)):
            return np.array(self.whole([text[:k] for k in range(1, len(text) + 1)]), np.int64)  # characters that the library's tables know otherwise
        spans = [(m.start(), m.end(), m[0]) for m in self.find_words(whole)]
        known = self.word_prefixes(w for _, _, w in spans)
        count, word_at = np.zeros(len(whole) + 1, np.int64), np.arange(len(whole) + 1)
        base = 0
        for start, end, w in spans:
            count[start] = base
            count[start + 1 : end + 1] = base + np.frombuffer(known[w], "<u4")
            word_at[start + 1 : end + 1] = start
            base = int(count[end])
            count[end + 1 :] = base
        places = np.cumsum([len(f) for f in forms])
        out = np.zeros(len(text), np.int64)
        out[np.array(cuts[1:]) - 1] = count[places]
        inner: dict[int, list[tuple[int, int, str]]] = {}
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if b - a > 1:
                at = int(places[k - 1]) if k else 0
                start = int(word_at[at])
                for j in range(a + 1, b):  # the letter as it is with some of its marks
                    inner.setdefault(start, []).append((at, j - 1, lowered(text[a:j])))
        for start, branches in inner.items():
            self._branch(whole, start, count, word_at, branches, out)
        return out

    def _branch(self, whole: str, start: int, count: np.ndarray, word_at: np.ndarray, branches: list[tuple[int, int, str]], out: np.ndarray) -> None:
        """out[j] for branches (place, j, form): the tokens of what stands before start, of the word from there to the place and of the form after it."""
        walk, at, base = self.walk, start, int(count[start])
        walk.start()
        rest: list[tuple[int, int, list[str]]] = []
        for place, j, form in branches:  # in the order of their places
            for byte in whole[at:place].encode("utf-8", "surrogatepass"):
                walk.add(byte)
            at = place
            mark = len(walk.data)
            tail = whole[max(start, place - 4) : place]  # enough to tell what kind of word it is
            if len(whole[start:place]) <= 1 and start and whole[start - 1] == "'" and word_at[start] == start - 1:  # a sign by itself may begin a contraction
                rest.append((j, int(count[start - 1]), self.split(whole[start - 1 : place] + form)))
                continue
            words = self.split(tail + form)
            if tail:  # the first word goes on with what the form adds to it
                first, words = words[0][len(tail) :], words[1:]
                for byte in first.encode("utf-8", "surrogatepass"):
                    walk.add(byte)
                rest.append((j, base + walk.closed(), words))
                walk.cut(mark)
            else:
                rest.append((j, base, words))
        known = self.word_prefixes(w for _, _, words in rest for w in words)
        for j, n, words in rest:
            out[j] = n + sum(int.from_bytes(known[w][-4:], "little") for w in words)

    def fit(self, text: str, budget: int) -> int:
        """The length of the longest prefix of at most so many tokens."""
        if self.split is None:
            return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])
        chunks = self.chunks_of(text)
        return self._fit(chunks, [*map(self.known_counts([chunks]).__getitem__, chunks)], budget)

    def _fit(self, chunks: list[str], counts: list[int], budget: int) -> int:
        sums = np.cumsum(counts)
        k = min(int(np.searchsorted(sums, budget, side="right")), len(chunks) - 1)  # the chunk in which the budget ends
        start = sum(map(len, chunks[:k])) + k
        own = (int(sums[k - 1]) if k else 0) + self.chunk_prefixes(chunks[k])
        return start + int((np.flatnonzero(own <= budget) + 1).max(initial=0))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(df: DataFrame, tokenizer: str, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens), and fit_chars, the longest prefix within the budget if there is one. tokenizer: path of a tokenizers file."""
    kind = df.select(F.col(f"`{id_col}`").alias("id")).schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            counts = own.counts(texts, budget)
            columns = [batch.column(0), batch.column(1), pa.array([n for n, _ in counts], pa.int64())]
            if budget is not None:
                columns.append(pa.array([length for _, length in counts], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_tokens", *["fit_chars"] * (budget is not None)])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    schema = f"id {kind}, n_bytes bigint, n_tokens bigint" + ", fit_chars bigint" * (budget is not None)
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


LIMIT = 2048


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), LIMIT)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fit_chars")
