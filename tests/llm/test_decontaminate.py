"""Spaced seeds: coverage of the masks, planted passages, clean documents."""

import math
import random
import time
from itertools import combinations

from plinth.llm import decontaminate as d


def test_masks_hit_every_stretch_that_counts():
    for n in range(10, 21):
        allowed = n - math.ceil(d.SHARE * n)
        places = [sum(1 << (o + k) for k, c in enumerate(m) if c == "1") for m, _ in d.masks_for([n]) for o in range(n - len(m) + 1)]
        for changed in combinations(range(n), allowed):
            bits = sum(1 << c for c in changed)
            assert any(not p & bits for p in places), (n, changed)


def naive_leaks(docs, items):
    """Best stretch of every alignment of every pair."""
    out = {}
    for i, item in items.items():
        need = min(d.STRETCH, len(item))
        for k, words in docs.items():
            best = None
            for shift in range(-len(item), len(words)) if need else ():
                for at in range(len(item) - need + 1):
                    first = at + shift
                    if first >= 0 and first + need <= len(words):
                        equal = sum(item[at + j] == words[first + j] for j in range(need))
                        if equal >= (need if need < d.SPAN else d.SHARE * need) and (best is None or (-equal, first) < best):
                            best = (-equal, first)
            if best:
                out[k, i] = (-best[0] / need, best[1], best[1] + need - 1)
    return out


def test_equals_all_alignments(spark):
    """Few words, so that nearly everything nearly matches; ties, repeats, items of every small size."""
    rng = random.Random(3)
    words = lambda n, k: [rng.choice("abcdefghijklmnop"[:k]) for _ in range(n)]
    items = {n: words(n, 3 + n % 4) for n in (1, 4, 9, 10, 11, 12, 13, 15, 16, 19, 20, 21, 26)} | {50: ["a"] * 25, 51: ["a", "b"] * 8}
    docs = {k: words(rng.randint(0, 60), rng.choice([2, 3, 4, 8])) for k in range(60)}
    for k, (i, item) in enumerate(items.items()):
        passage = list(item)
        for c in rng.sample(range(len(item)), len(item) // 5):
            passage[c] = "z"
        docs[100 + k] = [*words(k % 7, 8), *passage, *words(k % 5, 8)]
    docs[200] = ["a"] * 70
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r.first_word, r.last_word) for r in d.leaks(df, bench).collect()}
    assert got == naive_leaks(docs, items)


def test_one_word_repeated(spark):
    """Hits don't multiply: a long run of one word against a long item of it."""
    df = spark.createDataFrame([(1, "ther " * 20_000), (2, "ther " * 10 + "x y z " * 6)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "ther " * 400)], "item_id long, text string")
    start = time.time()
    assert [tuple(r) for r in d.leaks(df, bench).collect()] == [(1, 1, 1.0, 400, 0, 19)]
    assert time.time() - start < 30


def _corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    text = lambda n: [word() for _ in range(n)]
    items = [text(n) for n in (40, 25, 20, 12, 9, 4, 200)]
    docs, want = {}, set()
    for k in range(60):
        docs[k] = text(rng.randint(5, 300))
    for k, (i, changes) in enumerate([(0, 0), (1, 5), (2, 4), (3, 0), (3, 2), (4, 0), (5, 0), (6, 30)]):
        passage = list(items[i])
        for c in rng.sample(range(len(passage)), min(changes, len(passage) // 5)):
            passage[c] = word()
        at = rng.randint(0, 50)
        docs[100 + k] = [*text(at), *passage, *text(20)]
        want.add((100 + k, i))
    docs[200] = [*text(30), *items[0][:8], *text(30)]  # too little of it
    docs[201] = [*text(3), *items[4][:8], "other", *text(3)]  # short items must be whole
    docs[202] = [*items[0], *items[1], *items[0]]
    want |= {(202, 0), (202, 1)}
    return items, docs, want


def test_planted_passages(spark):
    items, docs, want = _corpus()
    cased = {k: " ".join(w.upper() if j % 3 == 0 else w for j, w in enumerate(t)).replace(" ", ", ", 2) for k, t in docs.items()}
    df = spark.createDataFrame([*((k, t, 1.0) for k, t in cased.items()), (300, None, 0.0), (301, "", 0.0), (100, cased[100], 0.0), (None, cased[100], 0.0), (None, cased[0], 0.0)], "doc_id long, text string, matched double")
    bench = spark.createDataFrame([*((i, " ".join(t)) for i, t in enumerate(items)), (50, None), (51, ""), (52, "!!")], "item_id long, text string")
    got = d.leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert len(got) == len(want)
    assert all(r.matched >= 0.8 for r in got)
    kept = d.remove_leaking(df, bench)
    assert kept.columns == df.columns
    kept = kept.collect()
    assert {r.doc_id for r in kept} == {*docs, 300, 301, None} - {k for k, _ in want}
    assert [r.text for r in kept if r.doc_id is None] == [cased[0]]  # rows without an id are searched too


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    assert d.leaks(df.limit(0), bench).count() == 0
    assert d.leaks(df, bench.limit(0)).count() == 0
    assert d.leaks(df, bench).count() == 1
