"""Near copies by similarity: what simhash.near_duplicates does where a similarity is asked for.

A text's set is its shingles of five words in lower case, hashed to 64 bits; a text with fewer words is one shingle. Equal sets
are merged first. Three tests follow one another, each on what the one before left:

- Buckets. A radius wide enough for a similarity of 0.8 spans most tiles of a short fingerprint, so tiles by bits set can't hold
  the pairs together; buckets do. Each set has 32 keys of four minima; two sets of similarity s share none with probability
  (1 - s^4)^32, that is 5e-8 at 0.8 and less above.
- Fingerprints. In a bucket, 512-bit SimHash fingerprints are compared in full by exclusive-or and bit counts. The radius lies
  6.5 standard deviations beyond the bits in which sets at the threshold differ, and 15 bits further for sets of under six shingles.
- Sets. Only pairs whose full sets overlap by the threshold are linked, whatever the tests before say, so nothing else is merged.

A group's pairs aren't all made: at first each member of a bucket meets a few that are drawn, the same in all buckets, and then the
members of a bucket that are still in different components meet. Those of small buckets meet in a join; those of large ones in blocks
of bounded size, tile by tile, and only links that span what was found leave a block. The components are those of all pairs that
share a bucket, lie within the radius and reach the threshold.

Null text counts as empty; texts without words are copies of each other. Repeated rows are rows of their own; ids must not be
null. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import slices, stage_table
from corpusloom.operators.components import contracted
from corpusloom.operators.storage import parts_for

WIDTH = 5
THRESHOLD = 0.8
BANDS, MINIMA = 32, 4
#: 64-bit parts of a fingerprint.
PARTS = 8
#: Rounds in which a bucket's members meet a few of them before what is left meets in full.
ROUNDS = 1
#: Members of a bucket that its others meet in a round.
LEADERS = 3
#: The members of a bucket of up to so many meet in a join, those of larger ones by numpy, in blocks of about so many and in tiles.
SMALL_BUCKET = 32
BLOCK_ROWS = 1024
TILE = 256
#: Shingles in one table of a product.
COLUMNS = 1 << 13
#: Shingles whose minima and bits are taken at a time.
PART = 1 << 12
#: Bytes of a text whose words are hashed at a time, or one word if it is longer.
STRETCH = 1 << 16
#: Sets of fewer shingles have a wider radius by SHORT_SLACK bits.
SHORT_SET, SHORT_SLACK = 6, 15
_RNG = np.random.default_rng(42)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPREAD = _RNG.integers(0, 1 << 63, PARTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.cache
def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def radius_for(threshold: float) -> int:
    """Bits within which fingerprints of sets of that similarity lie: those of the angle between them, and 6.5 standard deviations."""
    share = math.acos(2 * threshold / (1 + threshold)) / math.pi
    bits = 64 * PARTS
    return math.ceil(bits * share + 6.5 * math.sqrt(bits * share * (1 - share)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


#: A number for each byte, the same for a capital and its small letter, and whether it separates words.
_BYTES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
_GAPS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    base = 0x9E3779B97F4A7C15
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word in lower case: sums of its bytes' numbers times powers by place, from running sums over the text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    edges = np.flatnonzero(np.diff(_GAPS[raw], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):  # a stretch of whole words at a time
        end = max(k + 1, int(np.searchsorted(ends, starts[k] + STRETCH, "right")))
        first, last = int(starts[k]), int(ends[end - 1])
        up, down = _powers(max(STRETCH, 1 << (last - first - 1).bit_length()))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[raw[first:last]] * up[: last - first], dtype=np.uint64)])
        at = starts[k:end] - first
        out[k:end] = (sums[ends[k:end] - first] - sums[at]) * down[at]
        k = end
    return _mixed(out)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted different hashes of the text's shingles, each from the hashes of its words in their order."""
    hashes = word_hashes(text)
    if not len(hashes):
        return np.empty(0, np.uint64)
    size = min(width, len(hashes))
    n = len(hashes) - size + 1
    out = np.full(n, size, np.uint64)
    for k, factor in enumerate(_factors(width)[:size]):
        out += hashes[k : k + n] * factor
    out = np.sort(_mixed(out))
    return out[np.diff(out, prepend=~out[:1]) != 0]


def bucket_keys(found: np.ndarray) -> list[int]:
    """A signed key for each band; none for an empty set."""
    import xxhash

    if not len(found):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), PART):
        least = np.minimum(least, np.multiply.outer(_FACTORS, found[k : k + PART]).min(axis=1))
    raw = least.astype("<u8").tobytes()
    step = 8 * MINIMA
    return np.array([xxhash.xxh64_intdigest(raw[b * step : (b + 1) * step], b) for b in range(BANDS)], np.uint64).view(np.int64).tolist()


def wide_fingerprint(found: np.ndarray) -> list[int]:
    """Bits set in over half of what the set's hashes spread to, as signed 64-bit parts."""
    count = np.zeros(64 * PARTS, np.int64)
    for k in range(0, len(found), PART):
        x = _mixed(np.multiply.outer(found[k : k + PART], _SPREAD))
        count += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(2 * count > len(found)).view(np.int64).tolist()


def _print(found: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes())


def _sketches(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, print, n, fp, keys): a row per input row; print is the same for equal sets."""
    kind = df.schema[id_col].dataType.simpleString()
    many = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            columns = [pa.array([_print(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())]
            columns += [pa.array([f(s) for s in sets], many) for f in (wide_fingerprint, bucket_keys)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "print", "n", "fp", "keys"])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, print binary, n bigint, fp array<bigint>, keys array<bigint>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(k, s): the sets of texts (k, text) whose print is k; repeated rows repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            sets = [(k, s) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if _print(s := shingles(t, width)) == k]
            columns = [pa.array([k for k, _ in sets], pa.binary()), pa.array([s.view(np.int64) for _, s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "s"])

    return texts.select("k", "text").mapInArrow(run, "k binary, s array<bigint>")


def _may_link(threshold: float) -> Column:
    """Whether the sizes na, nb and the fingerprints fa, fb allow the threshold."""
    bits = sum((F.bit_count(F.get("fa", F.lit(k)).bitwiseXOR(F.get("fb", F.lit(k)))) for k in range(1, PARTS)), F.bit_count(F.get("fa", F.lit(0)).bitwiseXOR(F.get("fb", F.lit(0)))))
    least = F.least("na", "nb")
    slack = F.when(least < SHORT_SET, SHORT_SLACK).otherwise(0)
    return (least >= threshold * F.greatest("na", "nb")) & (bits <= radius_for(threshold) + slack)


def merged(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The labels after what the pairs (u, v) of places connect."""
    while (apart := label[u] != label[v]).any():
        u, v = u[apart], v[apart]
        lu, lv = label[u], label[v]
        np.minimum.at(label, np.maximum(lu, lv), np.minimum(lu, lv))
        while (label != label[label]).any():
            label = label[label]
    return label


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set on the left shares with each on the right, as a product of tables of the shingles that both sides have."""
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)

    def table(values: np.ndarray, sets: list[np.ndarray], cut: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(cut, values), len(cut) - 1)
        found = cut[at] == values
        made = np.zeros((len(sets), len(cut)), np.float32)
        made[row[found], at[found]] = 1
        return made

    for k in range(0, len(shared), COLUMNS):
        cut = shared[k : k + COLUMNS]
        out += table(a, left, cut) @ table(b, right, cut).T
    return out


def linked(sets: list[np.ndarray], prints: np.ndarray, of: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float) -> np.ndarray:
    """The labels of the components (of: each set's) after all links between sets of the first and the second places.

    Sets are tiled by size; tile pairs whose sizes differ too much are skipped, the others' fingerprints are compared by exclusive-or and bit counts,
    and where any two are within the radius and in different components so far, overlaps decide.
    """
    label = np.arange(int(of.max(initial=-1)) + 1)
    n = np.array([len(s) for s in sets], np.int64)
    radius = radius_for(threshold)
    tiles = [[part[k : k + TILE] for k in range(0, len(part), TILE)] for part in (first[np.argsort(n[first], kind="stable")], second[np.argsort(n[second], kind="stable")])]
    for i in tiles[0]:
        for j in tiles[1]:
            if n[i[0]] * 1.0 > n[j[-1]] / threshold or n[j[0]] * 1.0 > n[i[-1]] / threshold:
                continue
            small, large = np.minimum(n[i][:, None], n[j][None, :]), np.maximum(n[i][:, None], n[j][None, :])
            fits = (small >= threshold * large) & (label[of[i]][:, None] != label[of[j]][None, :])
            if fits.any():
                bits = sum(np.bitwise_count(prints[i, p][:, None] ^ prints[j, p][None, :]).astype(np.int16) for p in range(PARTS))
                fits &= bits <= radius + SHORT_SLACK * (small < SHORT_SET)
            if fits.any():
                both = overlaps([sets[k] for k in i], [sets[k] for k in j])
                r, c = np.nonzero(fits & (both >= threshold * (n[i][:, None] + n[j][None, :] - both)))
                label = merged(label, of[i[r]], of[j[c]])
    return label


def _clusters(members: DataFrame, large: DataFrame, comps: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (ca, cb) between the components of sets that meet in large buckets.

    Large buckets of one family of texts hold much the same members, so buckets that share a member are put together first, and each
    member goes to a cluster's blocks once instead of to every bucket. In a pair of blocks all sets are compared; only links that span
    what was found leave the task. large: key, center; comps: a, ca, fa.
    """
    spark = members.sparkSession
    of = contracted(members.join(large, "key").select("a", "center"), "a", "center")
    sizes = of.groupBy("root").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    sizes = stage_table(sizes, "cluster-sizes", parts_for(spark, of.count(), 64))
    placed = of.join(sizes, "root").join(comps.withColumnRenamed("a", "node"), "node")
    placed = placed.join(sets.withColumnRenamed("k", "node"), "node").withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    placed = placed.select("root", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "ca", "fa", "s")
    placed = placed.select("root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "ca", "fa", "s")

    def compare(group: pa.Table) -> pa.Table:
        own, x, y = group.column("own").to_numpy(), group.column("x")[0].as_py(), group.column("y")[0].as_py()
        found = group.column("s").combine_chunks()
        flat, ends = found.flatten().to_numpy().view(np.uint64), np.cumsum(found.value_lengths().to_numpy())
        # sorted again, as unsigned numbers
        sets = [np.sort(flat[a:b]) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]
        prints = group.column("fa").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, PARTS)
        names = group.column("ca").combine_chunks().dictionary_encode()
        label = linked(sets, prints, names.indices.to_numpy(), np.flatnonzero(own == x), np.flatnonzero(own == y), threshold)
        away = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"ca": names.dictionary.take(away), "cb": names.dictionary.take(label[away])})

    return placed.groupBy("root", "x", "y").applyInArrow(compare, "ca binary, cb binary")


def _meetings(members: DataFrame, small: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ca, cb) that may link, of all members of the small buckets that are in different components."""
    left = members.join(small, "key")
    other = left.select("key", *[F.col(f"{c}a").alias(f"{c}b") for c in "ncf"], F.col("a").alias("b"))
    return left.join(other, "key").filter((F.col("ca") < F.col("cb")) & _may_link(threshold)).select("a", "b", "ca", "cb").distinct()


def _near(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b, ca, cb), the components (ca, cb) of those whose sets overlap by the threshold."""
    one = lambda c: sets.select(F.col("k").alias(c), F.col("s").alias(f"s{c}"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(one("a"), "a").join(one("b"), "b").filter(both / (F.size("sa") + F.size("sb") - both) >= threshold).select("ca", "cb").distinct()


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(id, component): component is the smallest id whose text is reached by steps of at least that Jaccard similarity."""
    spark = df.sparkSession
    rows = stage_table(_sketches(df, id_col, text_col, width), "sketches")
    total = rows.count()
    parts = lambda row_bytes: parts_for(spark, total, row_bytes)
    # a set's print names it: the rows of a repeated id may have different texts
    firsts = rows.groupBy(F.col("print").alias("k")).agg(F.min("id").alias("first"), *[F.first(c).alias(c) for c in ("n", "fp", "keys")])
    firsts = stage_table(firsts, "sets-merged", parts(8 * (BANDS + PARTS) + 64))
    each = firsts.select("k", F.explode("keys").alias("key"))
    full = stage_table(each.groupBy("key").count().filter("count > 1").select("key"), "buckets", parts(8 * BANDS))
    met = stage_table(each.join(full, "key"), "met", parts(32 * BANDS))
    wanted = stage_table(met.select("k").distinct().join(firsts.select("k", "first", "n", "fp"), "k"), "wanted", parts(8 * PARTS + 64))
    # the rows of an id may have several texts, and several rows may have one; links come out once all the same
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(wanted.select("k", F.col("first").alias("id")), "id")
    sets = stage_table(_sets(texts, width), "sets")
    named = wanted.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("fp").alias("fa")).withColumn("k", F.col("a"))
    named = stage_table(met.join(named, "k").drop("k"), "members", parts((8 * PARTS + 48) * BANDS))
    root = None
    for turn in range(ROUNDS + 1):
        members = named.withColumn("ca", F.col("a")) if root is None else named.join(root.select(F.col("k").alias("a"), "root"), "a", "left").withColumn("ca", F.coalesce("root", "a")).drop("root")
        members = stage_table(members, "named", parts((8 * PARTS + 64) * BANDS)) if root is not None else members
        drawn = [F.min(F.struct(F.xxhash64("a", F.lit(turn), F.lit(j)).alias("h"), F.col("a").alias("b"), F.col("na").alias("nb"), F.col("ca").alias("cb"), F.col("fa").alias("fb"))) for j in range(LEADERS if turn < ROUNDS else 1)]
        open_ = members.groupBy("key").agg(F.array_distinct(F.array(*drawn)).alias("drawn"), F.count("*").alias("members"), F.min("ca").alias("low"), F.max("ca").alias("high"))
        open_ = stage_table(open_.filter("low <> high").select("key", "members", "drawn"), "open", parts(BANDS * (8 * PARTS + 64)))
        if open_.isEmpty():
            break
        if turn < ROUNDS:
            leaders = open_.select("key", F.explode("drawn").alias("m")).select("key", "m.b", "m.nb", "m.cb", "m.fb")
            pairs = members.join(leaders, "key").filter((F.col("ca") != F.col("cb")) & _may_link(threshold)).groupBy("a", "ca", "cb").agg(F.min("b").alias("b"))
        else:
            pairs = _meetings(members, open_.filter(F.col("members") <= SMALL_BUCKET).select("key"), threshold)
        found = _near(stage_table(pairs.select("a", "b", "ca", "cb"), "pairs", parts(BANDS * 64)), sets, threshold)
        large = open_.filter(F.col("members") > SMALL_BUCKET).select("key", F.get("drawn", F.lit(0))["b"].alias("center"))
        if turn == ROUNDS and not large.isEmpty():
            comps = wanted.select(F.col("k").alias("a"), F.col("fp").alias("fa"))
            comps = comps.withColumn("ca", F.col("a")) if root is None else comps.join(root.select(F.col("k").alias("a"), "root"), "a", "left").withColumn("ca", F.coalesce("root", "a"))
            found = found.union(_clusters(members, large, comps.select("a", "ca", "fa"), sets, threshold))
        step = stage_table(contracted(found, "ca", "cb"), "roots", parts(64))
        # names of components are merged, so each round's links are few
        if root is None:
            root = step.select(F.col("node").alias("k"), "root")
        else:
            up = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            moved = root.join(up, "root", "left").select("k", F.coalesce("next", "root").alias("root"))
            new = step.select(F.col("node").alias("k"), "root").join(root.select("k"), "k", "left_anti")
            root = stage_table(moved.union(new), "roots", parts(64))
    of = firsts.select("k", "first")
    of = of.withColumn("root", F.col("k")) if root is None else of.join(root, "k", "left").withColumn("root", F.coalesce("root", "k"))
    of = stage_table(of.select("k", "root", "first"), "of", parts(64))
    least = stage_table(of.groupBy("root").agg(F.min("first").alias("component")), "least", parts(64))
    of = stage_table(of.join(least, "root").select(F.col("k").alias("print"), "component"), "components", parts(64))
    return rows.select("id", "print").join(of, "print").select(F.col("id").alias(id_col), "component")
