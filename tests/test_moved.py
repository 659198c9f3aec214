"""How much operators shuffle for what they are given; and that they lose nothing by it."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import duplicates as U
from corpusloom.operators import textstats as T


def moved(spark, run):
    """Bytes written to the shuffle while run() runs, and its result."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {x.stageId(): x.shuffleWriteBytes() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages)}

    before = total()
    result = run()
    return sum(n for k, n in total().items() if k not in before), result


def near_texts(n=300, size=400):
    random.seed(5)
    texts, boiler = [], [f"b{j}" for j in range(30)]
    for k in range(n):
        w = [f"w{random.randrange(10**6)}" for _ in range(size)] + boiler
        texts.append((4 * k, w))
        if k % 10 == 0:
            texts += [(4 * k + 1, [*w[:200], "zz", *w[201:]]), (4 * k + 2, w[: size - 60]), (4 * k + 3, w)]
    return texts


def test_similar_links_move_few_shingles(spark):
    texts = near_texts()
    df = spark.createDataFrame(texts, "id bigint, w array<string>")
    size, found = moved(spark, lambda: U.shingle_pairs(df, "id", F.col("w"), threshold=0.8).collect())
    # before: each shingle crossed the shuffle twice and each set three times
    assert size < 8 * sum(len(w) - 4 for _, w in texts)
    sets = {}
    for i, w in texts:
        sets.setdefault(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)), i)
    want = {(i, j): len(s & t) / len(s | t) for s, i in sets.items() for t, j in sets.items() if i < j and len(s & t) / len(s | t) >= 0.8}
    got = {(r.a, r.b): r.jaccard for r in found}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got) and len(want) > 20


def test_hot_shingles_come_last(spark):
    sets = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]), (2, [-5, 2, 4])], "k bigint, s array<bigint>")
    rows = lambda hot: sorted((r.k, r.n, r.h) for r in U.first_shingles(sets, 0.8, np.array(hot, np.int64)).collect())
    assert rows([]) == [(1, 10, 1), (1, 10, 2), (1, 10, 3), (2, 3, -5)]
    assert rows([-5, 2, 11]) == [(1, 10, 1), (1, 10, 3), (1, 10, 4), (2, 3, 4)]


def test_frequent_ngrams_move_hashes(spark):
    random.seed(6)
    docs = [(k, [f"word{int(random.paretovariate(0.3)) % 5000}" for _ in range(300)]) for k in range(400)]
    size, found = moved(spark, lambda: T.frequent_ngrams(spark.createDataFrame(docs, "id bigint, w array<string>"), "id", F.col("w"), (2, 3), 5).collect())
    uses, held = Counter(), Counter()
    for _, w in docs:
        grams = [" ".join(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)]
        uses.update(grams)
        held.update(set(grams))
    assert {(r.term, r.n, r.df) for r in found} == {(g, uses[g], n) for g, n in held.items() if n >= 5} and len(found) > 50
    # before: about 30 bytes for each n-gram of a document
    assert size < 8 * sum(held.values())


def test_text_cosines_move_numbers(spark):
    random.seed(7)
    docs = [(k, [f"word{int(random.paretovariate(0.6)) % 5000}" for _ in range(300)]) for k in range(300)]
    df = spark.createDataFrame(docs, "k bigint, t array<string>")
    pairs = df.select(F.col("k").alias("a"), (F.col("k") + 1).alias("b"))
    want = {(r.a, r.b): r.cosine for r in T.paired_cosine(T.tfidf(T.counted_grams(df, "k", F.col("t")), 300, "k"), pairs, "k").collect()}
    for common in (20, 1 << 17):
        size, found = moved(spark, lambda: T.text_cosines(df, 300, pairs, common).collect())  # noqa: B023
        assert len(found) == len(want) and all(abs(r.cosine - want[r.a, r.b]) < 1e-12 for r in found)
    # before: each term of a document crossed the shuffle several times as text
    assert size < 16 * sum(len(set(t)) for _, t in docs)
