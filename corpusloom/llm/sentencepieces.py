"""SentencePiece encoding and decoding with a batched lattice in numpy.

A text is cut into units at its spaces and at symbols that no piece holds; new units of one length advance together
through the lattice: hashes of their substrings are looked up in the sorted hashes of the pieces, each prefix gets its last
piece as back pointer, and the back pointers are followed from the end. For unigram models the last piece is the one
with the largest sum of scores. For merge models the largest sum of scores isn't the encoding; there the last piece is the one
that fits the piece before it under the merges, and is unique, so the result is the library's own for either kind.

Null text counts as empty: no ids. Rows are independent: repeated rows repeat, null ids pass through, an
empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import read, slices
from corpusloom.llm.lattice import Vocabulary, by_length
from corpusloom.llm.tokens import REMEMBERED

SPACE = "\u2581"
#: Longer units aren't remembered.
LONGEST_UNIT = 64
#: Texts whose new units are encoded together.
TEXTS = 1024
#: What a unigram model's unknown symbol costs below its worst piece.
UNKNOWN_COST = 10.0

_UNITS = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6
_UNIGRAM, _BPE = 1, 2


class Codec:
    """Encoder and decoder of one .model file of merge or unigram kind, without own normalisation."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        self.kind = model.trainer_spec.model_type
        types = {p.type for p in model.pieces}
        if self.kind not in (_UNIGRAM, _BPE) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or 4 in types:
            raise ValueError("only merge and unigram models without normalisation and user symbols are encoded here")
        if any(SPACE in p.piece.lstrip(SPACE) or "\n" in p.piece for p in model.pieces if p.type == _NORMAL):
            raise ValueError("a piece reaches across a space or line feed")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == _BYTE}
        self.unknown = next(k for k, p in enumerate(model.pieces) if p.type == _UNKNOWN)
        normal = [k for k, p in enumerate(model.pieces) if p.type == _NORMAL]
        self.ids = np.array([*normal, -1], np.int64)
        texts = [model.pieces[k].piece for k in normal]
        pieces = [tuple(ord(c) + 1 for c in t) for t in texts]
        self.adjacent = {t[k : k + 2] for t in texts for k in range(len(t) - 1)}
        scores = [model.pieces[k].score for k in normal]
        self.scores = np.array([*scores, 0.0], np.float32)
        self.table = [b""] * len(model.pieces)
        for k, t in zip(normal, texts, strict=True):
            self.table[k] = t.replace(SPACE, " ").encode()
        for b, k in self.bytes.items():
            self.table[k] = bytes([b])
        self.table[self.unknown] = " \u2047 ".encode()
        self.vocabulary = Vocabulary(pieces, self._merges(pieces, scores) if self.kind == _BPE else None)
        self.memory: list[dict[str, bytes]] = [{"": b""}, {}]

    @staticmethod
    def _merges(pieces: list[tuple[int, ...]], scores: list[float]) -> dict[tuple[int, int], tuple[int, int]]:
        """Any two pieces that make a piece may merge; the better its score, the sooner."""
        number = {p: k for k, p in enumerate(pieces)}
        ranks = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        merges = {}
        for k, p in enumerate(pieces):
            for j in range(1, len(p)):
                a, b = number.get(p[:j]), number.get(p[j:])
                if a is not None and b is not None:
                    merges[a, b] = (ranks[scores[k]], k)
        return merges

    def _units(self, units: list[str]) -> dict[str, bytes]:
        """Ids by unit, as unsigned 32-bit numbers; and by what units were cut into. A last symbol that never follows the one before it in a piece is a unit of its own."""
        cut = {u: (u[:-1], u[-1]) for u in units if len(u) > 2 and u[-2:] not in self.adjacent}
        needed = dict.fromkeys(u for u in units if u not in cut) | dict.fromkeys(p for pair in cut.values() for p in pair)
        new, old = self.memory
        known = {p: ids for p in needed if (ids := new.get(p, old.get(p))) is not None}
        known |= self._lattice([p for p in needed if p not in known])
        return known | {u: known[head] + known[tail] for u, (head, tail) in cut.items()}

    def _lattice(self, units: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        odd = [u for u in units if u.startswith(SPACE * 2)] if self.kind == _BPE else []  # runs of spaces merge at one rank, which the lattice can't order
        if odd:
            cut = 1 if self.prefix else 0
            found = self.library.encode([u[cut:].replace(SPACE, " ") for u in odd], num_threads=1)
            out = {u: np.array(ids, "<u4").tobytes() for u, ids in zip(odd, found, strict=True)}
        units = [u for u in units if u not in out]
        for part, rows in by_length([u.encode("utf-32-le") for u in units], width=4):
            rows = rows + 1
            if self.kind == _BPE:
                last = self.vocabulary.last_pieces(rows)[0]
            else:
                last = self.vocabulary.best_pieces(rows, self.scores, float(self.scores[:-1].min(initial=0.0)) - UNKNOWN_COST)
            numbers = self.vocabulary.trace(last)
            held = numbers >= 0
            raw = self.ids[numbers[held]].astype("<u4").tobytes()
            ends = (4 * np.cumsum(held.sum(1))).tolist()
            out.update(zip([units[i] for i in part], map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
            for row in np.flatnonzero((numbers == self.vocabulary.size - 1).any(1)).tolist():
                unit = units[part[row]]
                out[unit] = np.array(self._with_unknown(unit, numbers[row][held[row]].tolist()), "<u4").tobytes()
        return out

    def _with_unknown(self, unit: str, numbers: list[int]) -> list[int]:
        """Symbols that no piece has become their bytes or, in a model without bytes, one unknown for each run of them."""
        ids, at = [], 0
        for k in numbers:
            if k < self.vocabulary.size - 1:
                ids.append(int(self.ids[k]))
            elif self.bytes:
                ids += [self.bytes[b] for b in unit[at].encode()]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
            at += int(self.vocabulary.lengths[k])
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for k in range(0, len(texts), TEXTS):
            split = [_UNITS.findall((self.prefix + t).replace(" ", SPACE)) if t else [] for t in texts[k : k + TEXTS]]
            new, old = self.memory
            if len(new) > REMEMBERED:
                self.memory = new, old = [{}, {u: ids for u, ids in new.items() if len(u) <= LONGEST_UNIT}]
            missing = set().union(*split).difference(new)
            if missing:
                new.update((u, ids) for u in missing if (ids := old.get(u)) is not None)
                new.update(self._units([u for u in missing if u not in new]))
            out += [np.frombuffer(b"".join(map(new.__getitem__, units)), "<u4") for units in split]
        if not self.bytes:  # neighbouring unknown symbols are one, across units too
            out = [x[np.r_[True, (x[1:] != self.unknown) | (x[:-1] != self.unknown)]] if len(x) else x for x in out]
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _map(df: DataFrame, column: str, make, fields: list[tuple[str, pa.DataType, str]], id_col: str) -> DataFrame:
    kind = df.select(F.col(f"`{id_col}`").alias("id")).schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = make(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, (_, t, _) in zip(made, fields, strict=True)]], names=["id", *[n for n, _, _ in fields]])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{column}`").alias("x"))
    return rows.mapInArrow(run, ", ".join([f"id {kind}", *[f"{n} {s}" for n, _, s in fields]])).withColumnRenamed("id", id_col)


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>)."""
    return _map(df, text_col, lambda texts: [[x.tolist() for x in codec(model).encode([t or "" for t in texts])]], [("ids", pa.list_(pa.int32()), "array<int>")], id_col)


def decode(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text); null ids give an empty text."""
    return _map(df, ids_col, lambda rows: [[codec(model).decode(np.array(r or [], np.int64)) for r in rows]], [("text", pa.string(), "string")], id_col)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's pieces by number and checksum of the ids (unsigned, little-endian unsigned 32-bit), and whether decoding gives its text back."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")

    def digest(texts: list[str | None]) -> list[list]:
        own = codec(model)
        texts = [t or "" for t in texts]
        ids = own.encode(texts)
        return [[len(x) for x in ids], [zlib.crc32(x.tobytes()) for x in ids], [own.decode(x) == t for x, t in zip(ids, texts, strict=True)]]

    fields = [("n_pieces", pa.int64(), "bigint"), ("ids_crc32", pa.int64(), "bigint"), ("round_trip", pa.bool_(), "boolean")]
    return _map(read(spark, sf_dir, "documents"), "text", digest, fields, "doc_id")
