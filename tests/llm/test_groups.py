import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import components, langid, simhash, topk


def union_find(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    random.seed(4)
    n = 60
    links = {"path": [(k, k + 1) for k in range(n)], "star": [(0, k) for k in range(1, n)], "random": [(random.randrange(n), random.randrange(n)) for _ in range(40)], "none": []}[shape]
    found = components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    want = union_find({x for e in links for x in e}, links)
    groups = {}
    for r in found:
        groups.setdefault(r.root, set()).add(r.node)
    expected = {}
    for node, root in want.items():
        expected.setdefault(root, set()).add(node)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)


def brute_components(rows):
    prints = [(i, brute.fingerprint(t)) for i, t in rows]
    first = {}
    for i, f in prints:
        first[f] = min((x for x in (first.get(f), i) if x is not None), default=None)
    values = list(first)
    links = [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if bin(a ^ b).count("1") <= 2]
    root = union_find(values, links)
    least = {}
    for f, r in root.items():
        ids = [x for x in (least.get(r), first[f]) if x is not None]
        least[r] = min(ids) if ids else None
    return sorted((str(i), f, str(least[root[f]])) for i, f in prints)


def test_simhash_rows(spark):
    docs = brute.documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.bits & (2**64 - 1), str(r.component)) for r in found) == brute_components(rows)
    assert simhash.near_duplicates(brute.empty(spark)).count() == 0


@pytest.mark.parametrize("tile_rows", [1, 8, 2048])
def test_near_links_span_all_pairs(spark, tile_rows):
    rng = np.random.default_rng(7)
    seeds = rng.integers(0, 2**63, 12, dtype=np.uint64)
    values = set(map(int, seeds))
    for s in seeds:
        for _ in range(15):  # chains of near values, some beyond the radius of their seed
            s = np.uint64(int(s) ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))))
            values.add(int(s))
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "bits bigint"), 2, tile_rows).collect()
    got = union_find(signed, [(r.a, r.b) for r in links])
    close = [(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2]
    assert got == union_find(signed, close)


def test_top_k_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), rng.normal(0, 0.2, 8).tolist()) for k in range(300)]
    rows += [(50, rows[50][1]), (400, rows[3][1]), (401, None), (402, [float("nan")] * 8), (403, [1.0, None] * 4), (None, rows[1][1]), (404, [0.5] * 3), (450, [0.0] * 8), (500, [])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("x"))
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0, 5).collect())
    sound = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, w in {(i, tuple(v)) for i, v in sound if i % 50 == 0}:
        scored = sorted((-int(np.dot(v, w)), i) for i, v in sound if i != q and len(v) == len(w))
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
    assert found == sorted(want)
    assert topk.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("depth", [1, 7, 500])
def test_threshold_search_stops_only_when_safe(depth):
    rng = np.random.default_rng(depth)
    rows, queries = rng.integers(-3, 4, (400, 5)), rng.integers(-3, 4, (20, 5))
    ids = rng.permutation(400)
    got = topk.threshold_search(queries, np.arange(20), rows, ids, 4, depth)
    want = []
    for q in range(20):
        want += [(q, i, -s) for s, i in sorted((-int(s), int(i)) for s, i in zip(rows @ queries[q], ids, strict=True) if i != q)[:4]]
    assert got == want


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.filter(~langid.held_out("doc_id")), "doc_id", "text", "lang")
    found = langid.identify(docs, model, carry=["doc_id", "lang"]).filter(langid.held_out("doc_id"))
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right > 0.98 and n > 200


def test_language_of_odd_rows(spark):
    docs = brute.documents(spark)
    model = langid.train(docs, "doc_id", "text", "lang")
    rows = langid.identify(docs, model, carry=["doc_id", "text", "kept"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in {"en", "fr", "de"} and 0 <= r.score <= 1
    none = langid.train(brute.empty(spark), "doc_id", "text", "lang")
    assert {r.lang_pred for r in langid.identify(docs, none, carry=[]).collect()} == {"und"}
    assert langid.identify(brute.empty(spark), model).count() == 0


def test_grams_in_parts(monkeypatch):
    text = "Étion dans, çouelle un 12 éonierç le ch" * 6
    whole = langid.count_grams(text)
    monkeypatch.setattr(langid, "PART", 16)
    assert (langid.count_grams(text) == whole).all()


def odd_texts():
    r = random.Random(1)
    return [
        "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(3000)),
        " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(300)),
        "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(3000)),
        "Все люди рождаются свободными и равными в своем достоинстве и правах. " * 20,
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. " * 4,
    ]


def test_gibberish_and_unknown_languages_are_rejected_and_clean_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.train(docs.filter(~langid.held_out("doc_id")), "doc_id", "text", "lang")
    assert all(rejected for _, _, rejected in model.predict(odd_texts()))
    for language, text in (("en", "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience."), ("fr", "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience.")):
        assert model.predict([text])[0][0::2] == (language, False)
    found = langid.identify(docs, model, carry=["doc_id", "lang"]).filter(langid.held_out("doc_id"))
    right, rejected, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int")), F.count("*")).first()
    assert right > 0.99 and rejected < 0.002 and n > 3000
    sizes = np.bincount(np.unique(model.languages, return_inverse=True)[1])
    assert (sizes == langid.CENTROIDS).all()


def test_rare_languages_are_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    rare = [(-k, t, "xx") for k, t in enumerate(["zug zug gruk ma buk zug " * 30, "gruk buk zug ma ma zug " * 30, "zug buk buk gruk gruk ma " * 30], 1)]
    model = langid.train(docs.union(spark.createDataFrame(rare, docs.schema)), "doc_id", "text", "lang", most=300)
    assert set(model.languages) == {"de", "en", "es", "fr", "xx"}
    assert model.predict(["gruk zug buk ma zug gruk " * 20])[0][0] == "xx"
    assert langid.quotas({"a": 3, "b": 1000, "c": 900}, 303) == {"a": 3, "c": 150, "b": 150}
    assert langid.quotas({"a": 5, "b": 5}, 1) == {"a": 1, "b": 1}


def test_centroids_and_cosines_by_hand():
    import math

    texts = ["der hund und die katze", "die katze und der hund", "ein hund", "the dog and the cat", "a cat and a dog", "the dog"]
    languages = ["de"] * 3 + ["en"] * 3
    counts = [langid.count_grams(t).tolist() for t in texts]
    model = langid.fit(languages, np.array(counts, np.float32), centroids=1)
    df = [sum(c[j] > 0 for c in counts) for j in range(langid.PLACES)]

    def vector(c):
        v = [math.log1p(x) * (math.log((1 + len(texts)) / (1 + d)) + 1) for x, d in zip(c, df, strict=True)]
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm for x in v]

    vectors = [vector(c) for c in counts]
    means = {}
    for name in ("de", "en"):
        total = [sum(xs) for xs in zip(*[v for v, k in zip(vectors, languages, strict=True) if k == name], strict=True)]
        norm = math.sqrt(sum(x * x for x in total))
        means[name] = [x / norm for x in total]
    for text in [*texts, "der dog", "xyz"]:
        v = vector(langid.count_grams(text).tolist())
        cosine = {k: sum(a * b for a, b in zip(v, m, strict=True)) for k, m in means.items()}
        got, score, _ = model.predict([text])[0]
        assert got == max(sorted(cosine), key=cosine.get) and score == pytest.approx(max(cosine.values()), abs=1e-4)


def test_columns_named_like_made_ones_are_left_out(spark):
    docs = brute.documents(spark).withColumn("score", F.lit("mine"))
    model = langid.train(docs, "doc_id", "text", "lang")
    assert langid.identify(docs, model).columns == [*brute.documents(spark).columns, "lang_pred", "score", "rejected"]


def test_any_two_near_fingerprints_share_a_bucket():
    rng = random.Random(6)
    for radius, blocks in ((2, 3), (2, 4), (2, 5), (1, 2), (4, 5)):
        found = simhash.masks(radius, blocks)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for _ in range(radius):
                b ^= 1 << rng.randrange(64)
            assert any((a ^ b) & m & (2**64 - 1) == 0 for m in found)


def test_spanning_by_blocks_and_runs():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    values = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) for _ in range(12)]))
    close = [(int(a), int(b)) for k, a in enumerate(values) for b in values[k + 1 :] if bin(int(a) ^ int(b)).count("1") <= 2]
    want = union_find([int(v) for v in values], close)
    for a, b in (simhash.spanning(values, values, 2), simhash.spanning_runs(np.zeros(len(values), np.int64), values, 2)):
        assert union_find([int(v) for v in values], zip(a.tolist(), b.tolist(), strict=True)) == want
    assert len(simhash.spanning_runs(values.view(np.int64), values, 2)[0]) == 0
