"""SimHash near-duplicates by tiled exact comparison.

Two fingerprints that differ in at most r bits agree in all but r of any blocks that the 64 bits are cut into, so each fingerprint
goes to the bucket of every choice of blocks that may agree: three copies for two bits, at any number of fingerprints. In a
bucket, fingerprints with the same number of set bits form a tile; tile pairs whose counts differ beyond the radius are skipped, and
all other pairs are compared in full by exclusive-or and bit counts. Equal fingerprints are merged first, small buckets share a
task, a large bucket is cut into blocks of bounded size that meet pair by pair, and a task gives the links that span what it found,
not all pairs: components stay whole and output stays linear.

Null text counts as empty; texts without words have fingerprint zero and are linked like any other. Repeated rows
are rows of their own with the same fingerprint; null ids get a component like others and never name one unless all
of its ids are null. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import read, slices, stage_table
from corpusloom.llm.components import components
from corpusloom.llm.nearcopies import merged, near_copies

#: Fingerprints in one block of a large bucket, about; small buckets share tasks of four times that size.
TILE_ROWS = 2048
#: Beyond so many fingerprints, and again beyond each further time that many, there is one block more: buckets stay small and copies grow by a step.
STEP_ROWS = 1 << 29


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Bits set in over half the 64-bit hashes of the text's shingles, repeats included."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) > width:
        shingles = map(b" ".join, zip(*[words[k:] for k in range(width)], strict=False))
    else:
        shingles = iter([b" ".join(words)])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64)
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # a long text's bits are spread out a part at a time
        count += np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, bits): a row per input row; bits is the fingerprint as a signed 64-bit number."""
    kind = df.select(F.col(f"`{id_col}`").alias("id")).schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bits = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], names=["id", "bits"])

    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, bits bigint")


def masks(radius: int, blocks: int) -> list[int]:
    """The bits of each choice of blocks in which two fingerprints within the radius may agree, as signed numbers."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    of = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    found = [sum(of[k] for k in choice) for choice in itertools.combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in found]


def spanning(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what pairs of a and b within the radius connect: each member of a component with one of them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    order_a, order_b = np.argsort(np.bitwise_count(a), kind="stable"), np.argsort(np.bitwise_count(b), kind="stable")
    a, left = a[order_a], at[: len(a)][order_a]
    b, right = b[order_b], at[len(a) :][order_b]
    ones, others = np.bitwise_count(a).astype(np.int64), np.bitwise_count(b).astype(np.int64)
    label = np.arange(len(nodes))
    k = 0
    while k < len(a):  # a tile, or a part of one, meets the tiles near it
        end = min(int(np.searchsorted(ones, ones[k], "right")), k + max(1, (1 << 20) // max(1, len(b))))
        low, high = np.searchsorted(others, ones[k] - radius, "left"), np.searchsorted(others, ones[k] + radius, "right")
        r, c = np.nonzero(np.bitwise_count(a[k:end, None] ^ b[None, low:high]) <= radius)
        label = merged(label, left[r + k], right[c + low])
        k = end
    away = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[away], nodes[label[away]]


def spanning_runs(keys: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for many small buckets at once: the pairs of values that share a key. Sorted by key and bits set, each value meets the next, the one after, and so on, as long as key and tile allow."""
    ones = np.bitwise_count(values).astype(np.int64)
    order = np.lexsort((ones, keys))
    keys, values, ones = keys[order], values[order], ones[order]
    nodes, at = np.unique(values, return_inverse=True)
    label = np.arange(len(nodes))
    live, step = np.arange(len(values)), 1
    while len(live := live[live + step < len(values)]):
        live = live[(keys[live] == keys[live + step]) & (ones[live + step] - ones[live] <= radius)]
        near = live[np.bitwise_count(values[live] ^ values[live + step]) <= radius]
        label = merged(label, at[near], at[near + step])
        step += 1
    away = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[away], nodes[label[away]]


def near_links(bits: DataFrame, radius: int = 2, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) between different fingerprints that connect the same components as all pairs within the radius do. bits: distinct, not null."""
    blocks = radius + 1 + bits.count() // STEP_ROWS
    keys = [F.xxhash64(F.lit(k), F.col("bits").bitwiseAND(F.lit(m))) for k, m in enumerate(masks(radius, min(64, blocks)))]
    each = bits.select("bits", F.explode(F.array(*keys)).alias("key"))
    sizes = stage_table(each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    shared = stage_table(each.join(sizes, "key"), "shared")
    total = shared.filter(F.col("n") <= tile_rows).count()
    groups = max(1, total // (4 * tile_rows))
    schema = "a bigint, b bigint"
    linked = lambda a, b: pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})
    values = lambda group: group.column("bits").to_numpy().view(np.uint64)

    def compare_small(group: pa.Table) -> pa.Table:
        return linked(*spanning_runs(group.column("key").to_numpy(), values(group), radius))

    small = shared.filter(F.col("n") <= tile_rows).select(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(groups)).alias("task"), "key", "bits")
    # block x of a large bucket meets block y: a row goes to every pair of blocks that has its own
    large = shared.filter(F.col("n") > tile_rows).withColumn("blocks", F.ceil(F.col("n") / tile_rows).cast("int"))
    large = large.withColumn("own", F.pmod(F.xxhash64("bits", F.lit(7)), F.col("blocks")).cast("int"))
    large = large.select("key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "bits")
    large = large.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "bits")

    def compare_large(group: pa.Table) -> pa.Table:
        own, x, y = group.column("own").to_numpy(), group.column("x")[0].as_py(), group.column("y")[0].as_py()
        found = values(group)
        return linked(*spanning(found[own == x], found[own == y], radius))

    return small.groupBy("task").applyInArrow(compare_small, schema).union(large.groupBy("key", "x", "y").applyInArrow(compare_large, schema))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, width: int = 3, seed: int = 42, similarity: float | None = None) -> DataFrame:
    """(id, bits, component): component is the smallest id whose fingerprint is reached by steps of at most radius differing bits.

    With a similarity the fingerprints are wide ones, their radius follows from it, and links are checked against the full sets
    of shingles: (id, component), as nearcopies says.
    """
    if similarity is not None:
        return near_copies(df, id_col, text_col, width, similarity)
    rows = stage_table(fingerprints(df, id_col, text_col, width, seed), "documents")
    firsts = stage_table(rows.groupBy("bits").agg(F.min("id").alias("first")), "distinct")
    roots = components(near_links(firsts.select("bits"), radius))
    # the smallest id of a component, of which the distinct fingerprints alone take part
    named = stage_table(firsts.join(roots.select(F.col("node").alias("bits"), "root"), "bits", "left").select("bits", F.coalesce("root", "bits").alias("root"), "first"), "named")
    least = stage_table(named.groupBy("root").agg(F.min("first").alias("component")), "least")
    of = stage_table(named.select("bits", "root").join(least, "root").select("bits", "component"), "components")
    return rows.join(of, "bits").select(F.col("id").alias(id_col), "bits", "component")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
