"""Byte-pair encoding by dynamic programming over prefixes, for many words at once.

A merge vocabulary gives one encoding of a string. If every two neighbours in a sequence of pieces are what the vocabulary
makes of the two together, the sequence is what it makes of the whole. So the last piece of each prefix is the one that
fits the last piece of the prefix before it, and a table of last pieces, filled from left to right, holds the encoding
of every prefix. Words of equal length advance together; hashes of their substrings are looked up in the sorted hashes of the pieces.

Two pieces fit if no merge joins them across their border while both are being made. A piece's right edge is a
chain of ever longer pieces, from its last symbol to itself, each with the rank of the merge that made it; so is its left edge.
A merge across happens if its rank comes before both the right edge's next merge and the left edge's next one.
"""

from __future__ import annotations

import numpy as np

#: Rank of a merge that never comes.
NEVER = np.int64(1) << 40
#: Substring hashes are polynomials in this odd number modulo 2^64; symbols are numbered from 1.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Places of the memory of pairs that fit.
PAIRS = 1 << 20
#: Words are taken in groups of at most so many symbols, a bound on memory.
GROUP_SYMBOLS = 1 << 18


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, np.uint64)]), dtype=np.uint64)


class Vocabulary:
    """pieces: their symbols as tuples of positive ints, single symbols among them. merges: (left, right) piece numbers to (rank, made piece number); None for scored pieces."""

    def __init__(self, pieces: list[tuple[int, ...]], merges: dict[tuple[int, int], tuple[int, int]] | None):
        scored, merges = merges is None, merges or {}
        self.pieces, self.merges = pieces, merges
        n = len(pieces)
        self.size = n + 1  # the last number stands for a symbol that no piece has
        self.longest = max(map(len, pieces), default=1)
        pairs = np.array(list(merges), np.int64).reshape(-1, 2)
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in merges.values()], np.int64)[order]
        self._edges()
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        ok = np.arange(n) if scored else np.flatnonzero(self.whole[:n])  # a piece that its own merges don't make is in no encoding
        order = ok[np.argsort(hashes[ok], kind="stable")]
        self.hashes, self.numbers = hashes[order], order
        if len(np.unique(self.hashes)) < len(self.hashes):
            raise ValueError("two pieces have one hash")
        self.maybe = np.zeros(1 << 20, bool)  # most substrings are no pieces, and this tells so at once
        self.maybe[self.hashes >> np.uint64(44)] = True
        self.lengths = np.array([len(p) for p in pieces] + [1], np.int64)
        self.memory = np.full(PAIRS, -1, np.int64)
        self.fit_memory = np.zeros(PAIRS, bool)

    @staticmethod
    def _hash(symbols: tuple[int, ...]) -> int:
        h, base = 0, int(BASE)
        for s in symbols:
            h = (h * base + s) & 0xFFFFFFFFFFFFFFFF
        return h

    def merge(self, row: list[int]) -> tuple[list[int], list[tuple[int, int, int]]]:
        """The encoding of a sequence of pieces, and the merges done: (left, right, made); the lowest rank first, then the leftmost."""
        row, done = list(row), []
        while len(row) > 1:
            found = min(((self.merges[p][0], k) for k, p in enumerate(zip(row, row[1:], strict=False)) if p in self.merges), default=None)
            if found is None:
                break
            k = found[1]
            made = self.merges[row[k], row[k + 1]][1]
            done.append((row[k], row[k + 1], made))
            row[k : k + 2] = [made]
        return row, done

    def _edges(self) -> None:
        """Right and left edges of each piece, padded; each entry's end is the rank of the edge's next merge."""
        single = {p[0]: k for k, p in enumerate(self.pieces) if len(p) == 1}
        n = len(self.pieces)
        split: list[tuple[int, int] | None] = [None] * n
        self.whole = np.zeros(n + 1, bool)
        self.whole[n] = True
        for k, p in enumerate(self.pieces):
            if len(p) == 1:
                self.whole[k] = True
            elif all(s in single for s in p):
                row, done = self.merge([single[s] for s in p])
                if row == [k]:
                    self.whole[k] = True
                    split[k] = done[-1][:2]
        chains: list[list[list[int]]] = [[], []]
        ends: list[list[list[int]]] = [[], []]
        for side in (0, 1):
            for k in range(n):
                chain, end, at, last = [], [], k, int(NEVER)
                while True:
                    chain.append(at)
                    end.append(last)
                    if split[at] is None:
                        break
                    last = self.merges[split[at]][0]
                    at = split[at][1 - side]
                chains[side].append(chain[::-1])
                ends[side].append(end[::-1])
            chains[side].append([n])
            ends[side].append([int(NEVER)])

        def pad(rows: list[list[int]]) -> np.ndarray:
            width = max(map(len, rows))
            return np.array([r + [r[-1]] * (width - len(r)) for r in rows], np.int64)

        self.right, self.left = pad(chains[0]), pad(chains[1])
        self.right_end, self.left_end = pad(ends[0]), pad(ends[1])

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.size + b
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER) if len(self.pair_keys) else np.full(len(keys), NEVER)

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Walk both edges in the order of their merges, and look for one across."""
        fits = np.ones(len(a), bool)
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        while len(live):
            la, lb, li, lj = a[live], b[live], i[live], j[live]
            r, e = self.rank(self.right[la, li], self.left[lb, lj]), self.right_end[la, li]
            f = self.left_end[lb, lj]
            across = (r < e) & (r <= f) & (r < NEVER)
            fits[live[across]] = False
            right_first = e <= f
            i[live] += right_first
            j[live] += ~right_first
            live = live[~across & (np.minimum(e, f) < NEVER)]
        return fits

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece a then piece b is what the two together give."""
        keys = a * self.size + b
        place = ((keys.astype(np.uint64) * BASE) >> np.uint64(44)).astype(np.int64)
        known = self.memory[place] == keys
        out = self.fit_memory[place]
        new = np.flatnonzero(~known)
        if len(new):
            fresh, at = np.unique(keys[new], return_inverse=True)
            fits = self._fit(fresh // self.size, fresh % self.size)
            out[new] = fits[at]
            place = ((fresh.astype(np.uint64) * BASE) >> np.uint64(44)).astype(np.int64)
            self.memory[place] = fresh
            self.fit_memory[place] = fits
            # two new pairs may share a place: the later one wins both arrays, so the two stay in step
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers by hash, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int64)
        some = np.flatnonzero(self.maybe[hashes >> np.uint64(44)])
        if len(self.hashes) and len(some):
            sought = hashes[some]
            at = np.searchsorted(self.hashes, sought)
            at[at == len(self.hashes)] = 0
            out[some] = np.where(self.hashes[at] == sought, self.numbers[at], -1)
        return out

    def candidates(self, hashes: np.ndarray, sizes: np.ndarray, end: int, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, piece, start) of the pieces that end here and fit what stands before them."""
        found = self.find(hashes.ravel()).reshape(hashes.shape)
        row, col = np.nonzero(found >= 0)
        piece, start = found[row, col], end - sizes[col]
        good = start == 0
        check = np.flatnonzero(~good)
        good[check] = self.fit(last[row[check], start[check]], piece[check])
        return row[good], piece[good], start[good]

    def last_pieces(self, words: np.ndarray, closing: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """For words of one length, a row of symbols each: the last piece of every prefix, and the number of pieces of every prefix (column 0: the empty one).

        closing: where a word's last symbol has another number, what is added to it; then also the number of pieces of every prefix as a word of its own.
        """
        n, length = words.shape
        power = _powers(length)
        prefix = np.zeros((n, length + 1), np.uint64)
        for k in range(length):
            prefix[:, k + 1] = prefix[:, k] * BASE + words[:, k].astype(np.uint64)
        last = np.full((n, length + 1), -1, np.int64)
        count = np.zeros((n, length + 1), np.int64)
        closed = np.zeros((n, length + 1), np.int64) if closing else None
        for end in range(1, length + 1):
            sizes = np.arange(min(self.longest, end), 0, -1)
            hashes = prefix[:, end, None] - prefix[:, end - sizes] * power[sizes][None, :]
            row, piece, start = self.candidates(hashes, sizes, end, last)
            last[row, end], count[row, end] = piece, count[row, start] + 1
            none = np.flatnonzero(last[:, end] < 0)  # a symbol that no piece has
            last[none, end], count[none, end] = self.size - 1, count[none, end - 1] + 1
            if closed is not None:
                row, _, start = self.candidates(hashes + np.uint64(closing), sizes, end, last)
                closed[row, end] = count[row, start] + 1
        return last, count, closed

    def best_pieces(self, words: np.ndarray, scores: np.ndarray, unknown: float) -> np.ndarray:
        """For a vocabulary of scored pieces without merges: the last piece of the best split of every prefix, by the largest sum of scores."""
        n, length = words.shape
        power = _powers(length)
        prefix = np.zeros((n, length + 1), np.uint64)
        for k in range(length):
            prefix[:, k + 1] = prefix[:, k] * BASE + words[:, k].astype(np.uint64)
        last = np.full((n, length + 1), -1, np.int64)
        best = np.zeros((n, length + 1), np.float32)  # sums as the library rounds them, so that ties fall alike
        for end in range(1, length + 1):
            sizes = np.arange(min(self.longest, end), 0, -1)
            hashes = prefix[:, end, None] - prefix[:, end - sizes] * power[sizes][None, :]
            found = self.find(hashes.ravel()).reshape(n, -1)
            sums = best[:, end - sizes] + np.where(found >= 0, scores[found], np.where(sizes[None, :] == 1, np.float32(unknown), np.float32(-np.inf)))
            at = sums.argmax(1)
            best[:, end] = sums[np.arange(n), at]
            piece = found[np.arange(n), at]
            last[:, end] = np.where(piece >= 0, piece, self.size - 1)
        return last

    def trace(self, last: np.ndarray) -> np.ndarray:
        """The pieces of each word in its row, along the back pointers; -1 before the first of the shorter rows."""
        n, width = last.shape
        at = np.full(n, width - 1)
        steps = []
        while (at > 0).any():
            piece = np.where(at > 0, last[np.arange(n), at], -1)
            steps.append(piece)
            at = at - np.where(at > 0, self.lengths[piece], 0)
        return np.stack(steps[::-1], axis=1) if steps else np.empty((n, 0), np.int64)


class Walk:
    """The same table of last pieces for one string that grows, a byte at a time, and can be cut back: for long words, and for branches from one of their prefixes.

    vocabulary: over bytes, numbered from 1; closing as for last_pieces.
    """

    def __init__(self, vocabulary: Vocabulary, closing: int):
        self.vocabulary, self.closing = vocabulary, closing
        self.open, self.closed_pieces = ({}, {})
        for k in vocabulary.numbers.tolist():
            piece = vocabulary.pieces[k]
            if closing and piece[-1] > closing:
                self.closed_pieces[bytes([*(x - 1 for x in piece[:-1]), piece[-1] - closing - 1])] = k
            else:
                self.open[bytes(x - 1 for x in piece)] = k
        # an ending of no piece ends the search for longer ones
        self.endings = {p[k:] for p in self.open for k in range(len(p))}
        self.closed_endings = {p[k:] for p in self.closed_pieces for k in range(len(p))}
        self.known: dict[tuple[int, int], bool] = {}
        self.start()

    def start(self) -> None:
        self.data, self.last, self.count = bytearray(), [-1], [0]

    def fits(self, a: int, b: int) -> bool:
        if (found := self.known.get((a, b))) is None:
            v = self.vocabulary
            right, ends, left, stops = (x.tolist() for x in (v.right[a], v.right_end[a], v.left[b], v.left_end[b]))
            i = j = 0
            while True:
                e, f = ends[i], stops[j]
                r = v.merges[right[i], left[j]][0] if (right[i], left[j]) in v.merges else NEVER
                if r < e and r <= f and r < NEVER:
                    found = False
                    break
                if min(e, f) >= NEVER:
                    found = True
                    break
                if e <= f:
                    i += 1
                else:
                    j += 1
            if len(self.known) >= PAIRS:
                self.known.clear()
            self.known[a, b] = found
        return found

    def _ending(self, pieces: dict[bytes, int], endings: set[bytes]) -> tuple[int, int]:
        """The piece that ends the string and fits what stands before it, and the number of pieces then."""
        data, end = self.data, len(self.data)
        best = (self.vocabulary.size - 1, self.count[end - 1] + 1)
        for size in range(1, min(self.vocabulary.longest, end) + 1):
            tail = bytes(data[end - size :])
            if tail not in endings:
                break
            piece = pieces.get(tail)
            if piece is not None and (size == end or self.fits(self.last[end - size], piece)):
                best = (piece, self.count[end - size] + 1)
                break
        return best

    def add(self, byte: int) -> None:
        self.data.append(byte)
        piece, n = self._ending(self.open, self.endings)
        self.last.append(piece)
        self.count.append(n)

    def closed(self) -> int:
        """The number of pieces of the string as a word of its own."""
        if not self.closing or not self.data:
            return self.count[-1]
        return self._ending(self.closed_pieces, self.closed_endings)[1]

    def cut(self, length: int) -> None:
        del self.data[length:], self.last[length + 1 :], self.count[length + 1 :]


def by_length(words: list[bytes], width: int = 1):
    """(indices, array of words) for groups of words of one length; width: bytes of a symbol."""
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    for length, indices in groups.items():
        step = max(1, GROUP_SYMBOLS * width // max(1, length))
        for k in range(0, len(indices), step):
            part = indices[k : k + step]
            rows = np.frombuffer(b"".join([words[i] for i in part]), "<u4" if width == 4 else np.uint8)
            yield part, rows.astype(np.int64).reshape(len(part), length // width)
