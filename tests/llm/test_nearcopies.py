import random

import brute
import pytest

import corpus_pipeline
from corpusloom.llm import nearcopies


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = brute.WS.findall(words)
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows, threshold=0.8):
    """The smallest id that each row reaches over pairs of at least that Jaccard similarity."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s == sets[j] or len(s & sets[j]) >= threshold * len(s | sets[j]) > 0:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, least[find(i)]) for i, (k, _) in enumerate(rows))


def planted():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = []
    for _ in range(6):
        words = [word() for _ in range(150)]
        for _ in range(12):  # each a few words from the one before: chains, and pairs on both sides of the threshold
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.choice([1, 2, 3, 6, 9])):
                words[rng.randrange(150)] = word()
    texts += [texts[3].upper(), texts[3], "", None, " \n", "one two", "One  two", "two one"]
    rng.shuffle(texts)
    return [(int(k), t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("rounds", [0, 4])
def test_components_are_those_of_all_pairs(spark, monkeypatch, rounds):
    monkeypatch.setattr(nearcopies, "ROUNDS", rounds)
    rows = [*planted(), (3, "an id twice with another text")]
    found = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.component) for r in found) == brute_components(rows)
    assert nearcopies.near_copies(brute.empty(spark)).count() == 0


def test_stage_drops_near_copies_beyond_two_bits(spark):
    rows = planted()
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == sorted({c for _, c in brute_components(rows)})


def test_words_are_hashed_in_stretches(monkeypatch):
    rng = random.Random(1)
    for stretch in (1 << 16, 8):
        monkeypatch.setattr(nearcopies, "STRETCH", stretch)
        seen = {}
        for _ in range(1500):
            text = "".join(rng.choice(["a", "B", "b", "é", " ", "\n", "  ", "\t", "xyz", "É", "\x0b"]) for _ in range(rng.randrange(60)))
            got, want = tuple(nearcopies.shingles(text).tolist()), frozenset(shingles(text))
            assert len(got) == len(want) and seen.setdefault(want, got) == got
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize(("small", "block", "tile"), [(32, 1024, 256), (1, 8, 4)])
def test_large_buckets_meet_in_blocks(spark, monkeypatch, small, block, tile):
    for name, value in (("ROUNDS", 0), ("SMALL_BUCKET", small), ("BLOCK_ROWS", block), ("TILE", tile)):
        monkeypatch.setattr(nearcopies, name, value)
    rows = planted()
    found = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.component) for r in found) == brute_components(rows)


def test_radius_lies_beyond_similar_sets():
    rng = random.Random(5)
    hashes = lambda n: [rng.getrandbits(64) for _ in range(n)]
    for size in (5, 6, 15, 40, 150, 1000):
        for _ in range(40):
            gone = size // 5
            shared, own = hashes(size - gone), rng.randrange(gone + 1)
            sets = [nearcopies.np.unique(nearcopies.np.array(shared + hashes(n), nearcopies.np.uint64)) for n in (own, gone - own)]
            a, b = (nearcopies.np.array(nearcopies.wide_fingerprint(s)).view(nearcopies.np.uint64) for s in sets)
            bits = int(nearcopies.np.bitwise_count(a ^ b).sum())
            assert bits <= nearcopies.radius_for(0.8) + (nearcopies.SHORT_SLACK if min(map(len, sets)) < nearcopies.SHORT_SET else 0)
