"""Fingerprints, Golay keys, near-duplicate groups and components against brute force."""

import random
from itertools import combinations

import numpy as np
import xxhash

from plinth.llm import golay, simhash
from plinth.llm.components import connected_components


def naive_fingerprint(text, k=3):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, w = [], ""
    for c in t + " ":
        if c in " \t\n\x0b\x0c\r":
            words, w = words + [w] if w else words, ""
        else:
            w += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


TEXTS = ["", None, " \n", "One two", "one TWO", "Ünï Çode Straße é x y", "a b c", "a  b\tc", "a b c a b c a b c", "x " * 500, "the quick brown fox jumps over the lazy dog and runs away"]


def test_fingerprint_is_that_of_the_definition(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    for t in TEXTS:
        assert simhash.fingerprint(t or "") == naive_fingerprint(t or "")
    df = spark.createDataFrame([(k, t, "extra") for k, t in enumerate(TEXTS)], "doc_id long, text string, fp string")
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(df).collect()}
    assert got == {k: naive_fingerprint(t or "") for k, t in enumerate(TEXTS)}


def test_golay_code_is_perfect_and_neighbours_share_a_codeword():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    rows, nearest = golay.near_indices(words, 3)
    assert (rows == np.arange(3000)).all()  # exactly one codeword within three bits
    flipped = words ^ (1 << rng.integers(0, 23, 3000))
    rows, around = golay.near_indices(flipped, 4)
    for k in range(3000):
        assert nearest[k] in around[rows == k]


def _fps(seed, centre_copies=400):
    rng = random.Random(seed)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    base = [rng.getrandbits(64) for _ in range(150)] + [0, (1 << 64) - 1]
    near = [flip(rng.choice(base), rng.choice((1, 2, 2, 3))) for _ in range(200)]
    centre = rng.getrandbits(64)  # a group large enough for its keys not to be joined
    return list({*base, *near, *(flip(centre, rng.choice((1, 2, 3, 4))) for _ in range(centre_copies))})


def test_links_have_the_components_of_all_pairs(spark):
    fps = _fps(5)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    want = roots(signed, [(signed[i], signed[j]) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2])
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    links = [(r.a, r.b) for r in simhash.fingerprint_links(df).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in links)
    assert roots(signed, links) == want
    assert len(links) < 66 * len(fps)


def test_groups_of_documents(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    texts += [t + " tail" for t in texts[:30]] + texts[:10] + TEXTS
    ids = list(range(7, 7 + len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    fp = {i: naive_fingerprint(t or "") for i, t in zip(ids, texts)}
    want = roots(ids, [(a, b) for a, b in combinations(ids, 2) if (fp[a] ^ fp[b]).bit_count() <= 2])
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_chain_a_star_and_a_loop(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(5000, k) for k in range(200, 500)] + [(1, 2), (2, 3), (3, 1), (7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in connected_components(df, "a", "b").collect()}
    nodes = {x for p in links if p[0] != p[1] for x in p}
    assert got == roots(nodes, [p for p in links if p[0] != p[1]])
    assert connected_components(df.limit(0), "a", "b").count() == 0
