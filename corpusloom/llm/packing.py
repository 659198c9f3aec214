"""Packing of tokenised documents into training sequences by Karmarkar-Karp multiway differencing.

Each task tokenises its own rows and packs them in groups of bounded size, so nothing is shuffled and no key can
become hot. In a group, whole windows are cut from long documents first; the remaining pieces are spread over the fewest
windows that could hold them by differencing: a heap holds partial partitions, the two with the largest spread are merged so
that the heavy sides of one meet the light sides of the other, and the last one left is the assignment. Where a window exceeds
the capacity the window count rises and the pieces are differenced again, so no piece is cut to fit; pieces are halved only
where more than one window in 64 would have to be added. The windows are then near-equal and nearly full: the pieces of the few
lightest fill what room is left in the others (cuts are free), and what is left of them, less than a window, goes on to the
next group. At the end of a task the rest becomes windows whose lengths are powers of two, which need no padding.

Null text counts as empty; every document ends with the separator id, so each has a piece. Repeated rows
and repeated or null ids are packed as rows of their own; very long texts are cut; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import read, slices
from corpusloom.llm.tokens import encoder

#: Rows that are packed together at most; a bound on memory and on the work of one differencing, at every size.
GROUP_DOCS = 1024
#: A group also ends when it holds so many tokens.
GROUP_TOKENS = 1 << 22

#: Windows more than the fewest that could do, one in so many, before pieces are halved.
MORE_WINDOWS = 64

Piece = tuple[int, int, int]


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """The indices of sizes, dealt into that many near-equal parts."""
    if ways == 1:
        return [list(range(len(sizes)))]
    # a partial partition: its sums in descending order, relative to the smallest, and the parts in the same order; absent parts are empty
    heap = [(-size, k, [size], [[k]]) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    tag = len(sizes)
    while len(heap) > 1:
        _, _, a, parts_a = heapq.heappop(heap)
        _, _, b, parts_b = heapq.heappop(heap)
        if len(a) + len(b) <= ways:
            sums, parts = a + b, parts_a + parts_b
        else:  # the heaviest of b meets the lightest of a
            sums, parts = list(a) + [0] * (ways - len(a)), list(parts_a) + [[] for _ in range(ways - len(a))]
            for j in range(len(b)):
                sums[ways - 1 - j] += b[j]
                parts[ways - 1 - j] = parts[ways - 1 - j] + parts_b[j]
        order = sorted(range(len(sums)), key=lambda i: -sums[i])
        least = sums[order[-1]] if len(sums) == ways else 0
        sums = [sums[i] - least for i in order]
        heapq.heappush(heap, (-sums[0], tag, sums, [parts[i] for i in order]))
        tag += 1
    parts = heap[0][3]
    return parts + [[] for _ in range(ways - len(parts))]


def halved(pieces: list[Piece], most: int) -> list[Piece]:
    """The pieces, those over that length as two."""
    out: list[Piece] = []
    for doc, start, n in pieces:
        out += [(doc, start, n)] if n <= most else [(doc, start, n // 2), (doc, start + n // 2, n - n // 2)]
    return out


def spread(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """The pieces in near-equal windows of at most the capacity, none cut to fit one."""
    least = -(-sum(n for _, _, n in pieces) // capacity)
    ways, most = least, capacity // 2
    while True:
        pieces = sorted(pieces, key=lambda p: (-p[2], p))
        parts = differencing([n for _, _, n in pieces], ways)
        if max(sum(pieces[i][2] for i in part) for part in parts) <= capacity:
            return [[pieces[i] for i in part] for part in parts]
        if ways <= least + least // MORE_WINDOWS:
            ways += 1
        else:
            pieces, ways, most = halved(pieces, most), least, max(1, most // 2)


def fill(window: list[Piece], room: int, spare: list[Piece]) -> None:
    """Take room from the spare pieces, the last of them first, and cut the one that is too long."""
    while room:
        doc, start, n = spare.pop()
        window.append((doc, start, min(n, room)))
        if n > room:
            spare.append((doc, start + room, n - room))
        room -= min(n, room)


def full_windows(pieces: list[Piece], capacity: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows, and what is left: pieces of less than a window in all."""
    windows: list[list[Piece]] = []
    rest: list[Piece] = []
    for doc, start, n in pieces:
        whole = n - n % capacity
        windows += [[(doc, start + s, capacity)] for s in range(0, whole, capacity)]
        if n > whole:
            rest.append((doc, start + whole, n - whole))
    total = sum(n for _, _, n in rest)
    if total < capacity:
        return windows, rest
    parts = sorted(spread(rest, capacity), key=lambda part: -sum(n for _, _, n in part))
    full = total // capacity
    spare = [p for part in parts[full:] for p in part]
    for part in parts[:full]:
        fill(part, capacity - sum(n for _, _, n in part), spare)
    return windows + parts[:full], spare


def last_windows(spare: list[Piece]) -> list[list[Piece]]:
    """What is left at the end, in windows whose lengths are powers of two."""
    windows: list[list[Piece]] = []
    while spare:
        windows.append([])
        fill(windows[-1], 1 << (sum(n for _, _, n in spare).bit_length() - 1), spare)
    return windows


def pack_group(lengths: list[int], capacity: int) -> list[list[Piece]]:
    """Windows, each a list of (document, start, length); together they hold each id of each document once."""
    windows, spare = full_windows([(doc, 0, n) for doc, n in enumerate(lengths)], capacity)
    return windows + last_windows(spare)


def pack_documents(
    df: DataFrame, tokenizer: str, capacity: int = 4096, separator: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset; and its token ids if keep_ids. tokenizer: path of a tokenizers file."""
    kind = df.select(F.col(f"`{id_col}`").alias("id")).schema["id"].dataType.simpleString()
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer).ids
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        base = part << 40
        keys: list = []
        docs: list[np.ndarray] = []
        pieces: list[Piece] = []
        total = new = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal base, total
            windows, spare = full_windows(pieces, capacity)
            if last:
                windows, spare = windows + last_windows(spare), []
            rows: list[tuple] = []
            for k, window in enumerate(windows):
                offset = 0
                for doc, start, n in window:
                    ids = docs[doc][start : start + n]
                    rows.append((doc, start, n, zlib.crc32(ids.tobytes()), len(docs[doc]), base + k, offset, ids))
                    offset += n
            base += len(windows)
            columns = list(zip(*rows, strict=True)) or [()] * 8
            out = [pa.array([keys[d] for d in columns[0]], id_type), *[pa.array(c, pa.int64()) for c in columns[1:7]]]
            if keep_ids:
                out.append(pa.array([x.tolist() for x in columns[7]], pa.list_(pa.int64())))
            # what is left goes on, with the documents that it is of
            held = sorted({doc for doc, _, _ in spare})
            at = {doc: k for k, doc in enumerate(held)}
            keys[:], docs[:] = [keys[d] for d in held], [docs[d] for d in held]
            pieces[:] = [(at[doc], start, n) for doc, start, n in spare]
            total = sum(n for _, _, n in pieces)
            return pa.RecordBatch.from_arrays(out, names=["id", *names, *["ids"] * keep_ids])

        for batch in slices(batches):
            id_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(separator))
                keys.append(key)
                pieces.append((len(docs), 0, len(ids)))
                docs.append(ids)
                total += len(ids)
                new += 1
                if new >= GROUP_DOCS or total >= GROUP_TOKENS:
                    yield flush(False)
                    new = 0
        if pieces:
            yield flush(True)

    schema = f"id {kind}, {', '.join(f'{n} bigint' for n in names)}" + ", ids array<bigint>" * keep_ids
    packed = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(pack, schema)
    return packed.withColumnRenamed("id", id_col)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
