"""Corpus statistics of terms and n-grams in long form: (document, term, count) tables, never a dense matrix."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.relational import beside
from corpusloom.operators.storage import saved

# Fixed value: the tokens of term statistics.
TOKEN = r"\b[a-zA-Z][a-zA-Z'-]{1,}\b"
#: Function words that carry no topic; negations and modals stay in.
STOP_WORDS = tuple("a an the and or of to in on at by for from with as is are was were be been it its this that these those i we you he she they them his her their my our your".split())


def counted_grams(df: DataFrame, key: str, tokens: Column, sizes: Sequence[int] = (1,), groups: Sequence[str] = ()) -> DataFrame:
    """(key, groups, term, tf) from token arrays that are already computed."""
    grams = F.concat(*[tokens if n == 1 else X.ngrams(tokens, n) for n in sizes])
    return df.select(key, *groups, F.explode(grams).alias("term")).groupBy(key, *groups, "term").agg(F.count("*").alias("tf"))


def term_table(df: DataFrame, key: str, text: Column, sizes: Sequence[int] = (1,), stop: Sequence[str] = STOP_WORDS, groups: Sequence[str] = ()) -> DataFrame:
    """(key, groups, term, tf): n-grams after stop words are gone. Tokens are hashed to no ids: the terms are the rows."""
    tokens = F.filter(X.words(text, TOKEN), lambda t: ~t.isin(*stop)) if stop else X.words(text, TOKEN)
    rows = df.select(F.col(key), *groups, F.inline(F.array(F.struct(tokens.alias("tokens")))))
    return counted_grams(rows, key, F.col("tokens"), sizes, groups)


def tfidf(terms: DataFrame, n_docs: int, key: str, min_df: int = 1, max_df: float = 1.0, max_terms: int | None = None) -> DataFrame:
    """(key, term, weight): 1 + ln tf times smoothed idf, of length one a document; terms kept by document frequency, then the most frequent."""
    stats = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if max_terms is not None:
        stats = stats.orderBy(F.desc("cf"), "term").limit(max_terms)
    idf = F.log((1 + n_docs) / (1 + F.col("df"))) + 1
    weighed = terms.join(stats.select("term", idf.alias("idf")), "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norms = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def mean_tfidf(weights: DataFrame, n_docs: int, top: int = 100) -> DataFrame:
    return weights.groupBy("term").agg((F.sum("weight") / n_docs).alias("mean_tfidf"), F.count("*").alias("df")).orderBy(F.desc("mean_tfidf"), "term").limit(top)


def keyness(terms: DataFrame, group: str, a: str, b: str, prior: float = 1000.0) -> DataFrame:
    """(term, count_a, count_b, z): log odds with an informative prior, standardised."""
    counts = terms.groupBy("term").agg(F.sum("tf").alias("c"), *[F.coalesce(F.sum(F.when(F.col(group) == v, F.col("tf"))), F.lit(0)).alias(f"count_{s}") for s, v in (("a", a), ("b", b))])
    totals = counts.agg(F.sum("c").alias("c_all"), F.sum("count_a").alias("n_a"), F.sum("count_b").alias("n_b"))
    x = beside(counts, totals)
    alpha = F.col("c") * prior / F.col("c_all")
    clip = lambda c: F.greatest(F.lit(1e-12), c)
    odds = lambda y, n: F.log(clip(y + alpha)) - F.log(clip(n + prior - y - alpha))
    delta = odds(F.col("count_a"), F.col("n_a")) - odds(F.col("count_b"), F.col("n_b"))
    variance = 1 / clip(F.col("count_a") + alpha) + 1 / clip(F.col("count_b") + alpha)
    return x.select("term", "count_a", "count_b", (delta / F.sqrt(variance)).alias("z"))


def ngram_frequencies(terms: DataFrame, min_df: int = 2) -> DataFrame:
    return terms.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("df")).filter(F.col("df") >= min_df)


#: Words that are looked at together; buckets of n-grams' hashes by their first bits; bits of the map of n-grams that may be frequent, in a bucket.
SLICE_WORDS, BUCKETS_LOG, BITS_LOG = 1 << 20, 10, 18


def word_slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """(first row, one past the last, row of each word, number of each word, words by number), of bounded size but for a longer text."""
    ends = np.cumsum(batch.column("t").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        start = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, start + SLICE_WORDS, "right")))
        lists = batch.column("t").slice(lo, hi - lo)
        coded = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(hi - lo), lists.value_lengths().to_numpy(zero_copy_only=False))
        yield lo, hi, row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        lo = hi


def gram_hashes(row: np.ndarray, code: np.ndarray, words: pa.Array, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, place of the first word, 42-bit hash) of the n-grams within a row."""
    each = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object))[code] if len(code) else np.empty(0, np.uint64)
    for n in sizes:
        m = max(0, len(code) - n + 1)
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h ^ each[k : m + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        at = np.flatnonzero(row[:m] == row[n - 1 : m + n - 1])
        yield n, at, h[at] >> np.uint64(22)


def gram_map(rows: DataFrame, sizes: Sequence[int], min_df: int) -> np.ndarray:
    """A map of bits, by hash, of at least all n-grams in min_df rows or more. Only hashes cross the shuffle, about three bytes for an n-gram of a row."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, row, code, words in word_slices(batch):
                # one of each hash a row, and no more than are asked for
                both = np.concatenate([np.stack([h, row[at].astype(np.uint64)]) for _, at, h in gram_hashes(row, code, words, sizes)], axis=1)
                h, r = both[:, np.lexsort((both[1], both[0]))]
                h = h[np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])])] if len(h) else h
                h = h[np.arange(len(h)) - np.searchsorted(h, h) < min_df]
                cuts = np.searchsorted(h, np.arange((1 << BUCKETS_LOG) + 1, dtype=np.uint64) << np.uint64(32))
                # byte by byte: the sorted first bytes take next to nothing
                parts = [(b, h[x:y].astype(">u4").view(np.uint8).reshape(-1, 4).T.tobytes()) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if x < y]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["bucket", "hashes"])

    def count(group: pa.Table) -> pa.Table:
        h = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint8).reshape(4, -1).T.copy().view(">u4").ravel().astype(np.uint32) for x in group.column("hashes")]))
        often = h[: max(0, len(h) - min_df + 1)][h[: max(0, len(h) - min_df + 1)] == h[min_df - 1 :]]
        bits = np.zeros(1 << BITS_LOG, bool)
        bits[often >> np.uint32(32 - BITS_LOG)] = True
        return pa.table({"bucket": group.column("bucket").slice(0, 1), "bits": pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())})

    found = np.zeros((1 << BUCKETS_LOG, (1 << BITS_LOG) // 8), np.uint8)
    for r in rows.select("t").mapInArrow(deal, "bucket int, hashes binary").groupBy("bucket").applyInArrow(count, "bucket int, bits binary").toLocalIterator():
        found[r.bucket] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return found.ravel()


def frequent_ngrams(df: DataFrame, key: str, tokens: Column, sizes: Sequence[int], min_df: int = 2) -> DataFrame:
    """(term, n, df): n-grams with their occurrences and the number of keys that have them, for those of min_df keys or more.

    Hashes tell first which n-grams can be as frequent; only those are counted as texts, row by row before they cross the shuffle. A hash that several n-grams
    share lets more through and changes no count. Rows that share a key are counted by key instead; rows without one add to n alone.
    """
    rows = df.select(F.col(key).alias("k"), F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: t.isNotNull()).alias("t"))
    held = df.sparkSession.sparkContext.broadcast(gram_map(rows, sizes, min_df))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            for _, _, row, code, words in word_slices(batch):
                for n, at, h in gram_hashes(row, code, words, sizes):
                    spot = h >> np.uint64(32 - BITS_LOG)
                    at = at[(bits[spot >> np.uint64(3)] >> (np.uint64(7) - (spot & np.uint64(7))).astype(np.uint8)) & 1 > 0]
                    if not len(at):
                        continue
                    gram = code[at]
                    for k in range(1, n):
                        gram = np.unique(gram * len(words) + code[at + k], return_inverse=True)[1]
                    terms, first, gram, uses = np.unique(gram, return_index=True, return_inverse=True, return_counts=True)
                    held_by = np.bincount(np.unique(gram * (row[-1] + 1) + row[at]) // (row[-1] + 1), minlength=len(terms))
                    texts = [words.take(pa.array(code[at[first] + k])) for k in range(n)]
                    yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(*texts, " ").cast(pa.string()), pa.array(uses.astype(np.int64)), pa.array(held_by.astype(np.int64))], names=["term", "n", "df"])

    odd = saved(rows.groupBy("k").count().filter("count > 1 or k is null").select("k"))
    if odd.isEmpty():
        parts = rows.select("t").mapInArrow(tell, "term string, n bigint, df bigint")
    else:
        single = rows.filter("k is not null").join(odd, "k", "left_anti")
        several = rows.filter("k is not null").join(odd, "k", "left_semi").select("k", "t").union(rows.filter("k is null"))
        counted = counted_grams(several, "k", F.col("t"), sizes).groupBy("term").agg(F.sum("tf").alias("n"), F.count("k").alias("df"))
        parts = single.select("t").mapInArrow(tell, "term string, n bigint, df bigint").union(counted)
    return parts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).filter(F.col("df") >= min_df)


def repeated_phrases(df: DataFrame, case: str, sentences: Column, sizes: Sequence[int] = (3, 4, 5), min_cases: int = 2) -> DataFrame:
    """N-grams within one sentence that several cases share."""
    units = df.select(F.col(case).alias("case"), F.explode(sentences).alias("s"))
    units = units.select("case", F.inline(F.array(F.struct(X.words(F.col("s")).alias("t")))))
    out = None
    for n in sizes:
        one = units.select("case", F.lit(n).alias("n"), F.explode(X.ngrams(F.col("t"), n)).alias("phrase"))
        out = one if out is None else out.union(one)
    return out.groupBy("n", "phrase", "case").count().groupBy("n", "phrase").agg(F.sum("count").alias("uses"), F.count("*").alias("cases")).filter(F.col("cases") >= min_cases)


def per_ten_thousand(counts: DataFrame, n: str, total: Column, least: int = 20) -> DataFrame:
    return counts.filter(F.col(n) >= least).withColumn("per_10k", F.col(n) * 10_000 / total)


def top_terms(weights: DataFrame, group: str, n: int) -> DataFrame:
    means = weights.groupBy(group, "term").agg(F.sum("weight").alias("score"))
    return means.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "term"))).filter(F.col("r") <= n)


def paired_cosine(weights: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(a, b, cosine) of pairs, from unit vectors in long form; pairs without a shared term get 0."""
    left = pairs.join(weights.select(F.col(key).alias("a"), "term", F.col("weight").alias("wa")), "a")
    dots = left.join(weights.select(F.col(key).alias("b"), "term", F.col("weight").alias("wb")), ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return pairs.join(dots, ["a", "b"], "left").fillna({"cosine": 0.0})


def one_row_a_key(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(k, t): the tokens of each key; rows that share one are put together, all others stay where they are."""
    rows = df.select(F.col(key).alias("k"), F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: t.isNotNull()).alias("t"))
    odd = saved(rows.groupBy("k").count().filter("count > 1").select(F.col("k").alias("o")))
    if odd.isEmpty():
        return rows
    several = rows.join(odd, F.col("k").eqNullSafe(F.col("o")), "left_semi").groupBy("k").agg(F.flatten(F.collect_list("t")).alias("t"))
    return rows.join(odd, F.col("k").eqNullSafe(F.col("o")), "left_anti").union(several)


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(term, df) of rows (k, t), one a key; counted slice by slice before they cross the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, row, code, words in word_slices(batch):
                seen = np.unique(row * max(1, len(words)) + code) % max(1, len(words))
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(np.bincount(seen, minlength=len(words)).astype(np.int64))], names=["term", "df"])

    return rows.select("t").mapInArrow(count, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


#: Terms whose weights every task holds; the others, each in few documents, are joined as rows.
COMMON_TERMS = 1 << 17


def text_cosines(rows: DataFrame, n_docs: int, pairs: DataFrame, common: int = COMMON_TERMS) -> DataFrame:
    """(a, b, cosine) of pairs of keys of rows (k, t), one a key: cosines of the vectors that tfidf gives, over all terms; pairs without a shared term get 0.

    A document's common terms stay in one row, as numbers with their counts, and only such rows meet; a rare term crosses the shuffle for its weight.
    """
    counts = saved(document_frequencies(rows))
    idf = F.log((1 + n_docs) / (1 + F.col("df"))) + 1
    top = counts.orderBy(F.desc("df"), "term").limit(common).select("term", idf.alias("idf")).collect()
    held = rows.sparkSession.sparkContext.broadcast((pa.array([r.term for r in top], pa.string()), np.array([r.idf for r in top])))

    def lists(row: np.ndarray, n: int, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), values)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight = held.value
        for batch in batches:
            for lo, hi, row, code, words in word_slices(batch):
                number = pc.fill_null(pc.index_in(words.cast(pa.string()), value_set=terms), -1).to_numpy(zero_copy_only=False)
                both, tf = np.unique(row * max(1, len(words)) + code, return_counts=True)
                r, c = both // max(1, len(words)), both % max(1, len(words))
                at, often = number[c], number[c] >= 0
                square = np.bincount(r[often], weights=((1 + np.log(tf[often])) * weight[at[often]]) ** 2, minlength=hi - lo)
                ints = lambda x: pa.array(x.astype(np.int32))
                parts = [lists(r[often], hi - lo, ints(at[often])), lists(r[often], hi - lo, ints(tf[often])), pa.array(square.astype(float)), lists(r[~often], hi - lo, words.take(pa.array(c[~often])).cast(pa.string())), lists(r[~often], hi - lo, ints(tf[~often]))]
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(lo, hi - lo), *parts], names=["k", "ids", "tfs", "square", "rare", "rare_tfs"])

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight = held.value
        for batch in batches:
            n = batch.num_rows

            def flat(side: str, n: int = n, batch: pa.RecordBatch = batch) -> tuple[np.ndarray, np.ndarray]:
                ids, tfs = batch.column(f"ids_{side}"), batch.column(f"tfs_{side}")
                place = np.repeat(np.arange(n), ids.value_lengths().to_numpy(zero_copy_only=False)) * max(1, len(terms))
                return place + ids.flatten().to_numpy(zero_copy_only=False), 1 + np.log(tfs.flatten().to_numpy(zero_copy_only=False))

            (xa, wa), (xb, wb) = flat("a"), flat("b")
            shared, at_a, at_b = np.intersect1d(xa, xb, assume_unique=True, return_indices=True)
            sums = np.bincount(shared // max(1, len(terms)), weights=wa[at_a] * wb[at_b] * weight[shared % max(1, len(terms))] ** 2, minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sums.astype(float))], names=["a", "b", "dot"])

    kind = dict(rows.dtypes)["k"]
    parts = saved(rows.mapInArrow(split, f"k {kind}, ids array<int>, tfs array<int>, square double, rare array<string>, rare_tfs array<int>"))
    each = parts.select("k", F.inline(F.arrays_zip("rare", "rare_tfs"))).select("k", F.col("rare").alias("term"), (1 + F.log("rare_tfs")).alias("w"))
    weighed = saved(each.join(counts, "term").select("k", "term", "df", (F.col("w") * idf).alias("w")))
    norms = saved(parts.select("k", "square").union(weighed.select("k", F.col("w") * F.col("w"))).groupBy("k").agg(F.sqrt(F.sum("square")).alias("norm")))
    side = lambda d, s, *c: d.select(F.col("k").alias(s), *[F.col(x).alias(f"{x}_{s}") for x in c])
    met = pairs.join(side(parts, "a", "ids", "tfs"), "a").join(side(parts, "b", "ids", "tfs"), "b").mapInArrow(dot, f"a {dict(pairs.dtypes)['a']}, b {dict(pairs.dtypes)['b']}, dot double")
    again = weighed.filter("df > 1").select("k", "term", "w")
    left = pairs.join(again.select(F.col("k").alias("a"), "term", F.col("w").alias("w_a")), "a").join(again.select(F.col("k").alias("b"), "term", F.col("w").alias("w_b")), ["b", "term"])
    dots = met.union(left.select("a", "b", F.col("w_a") * F.col("w_b"))).groupBy("a", "b").agg(F.sum("dot").alias("dot"))
    found = dots.join(side(norms, "a", "norm"), "a").join(side(norms, "b", "norm"), "b")
    found = found.select("a", "b", F.when(F.col("dot") > 0, F.col("dot") / (F.col("norm_a") * F.col("norm_b"))).otherwise(0.0).alias("cosine"))
    return pairs.join(found, ["a", "b"], "left").fillna({"cosine": 0.0})
