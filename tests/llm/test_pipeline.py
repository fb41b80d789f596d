"""Similarity groups and the whole pipeline against brute force on a small corpus."""

import random
from itertools import combinations

import numpy as np
import public_tokenizers
import sentencepiece
import pytest

import corpus_pipeline
from plinth.llm import pii, similarity
from tests.llm.test_simhash import roots


def naive_set(text, k=5):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} or ({b" ".join(words)} if words else set())


def naive_groups(rows, least=0.8):
    sets = {i: naive_set(t or "") for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if (len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) if sets[a] or sets[b] else True)]
    return roots(list(sets), links)


def _texts(seed=1, n=80):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    return rng, word, ["\n".join(" ".join(word() for _ in range(rng.randint(6, 15))).capitalize() + "." for _ in range(rng.randint(4, 12))) for _ in range(n)]


def _edited(rng, word, text, n):
    w = text.split(" ")
    for k in rng.sample(range(len(w)), min(n, len(w))):
        w[k] = word()
    return " ".join(w)


def test_similar_groups(spark):
    rng, word, texts = _texts()
    texts += [_edited(rng, word, t, n) for n in (1, 2, 6) for t in texts[:25]]
    texts += [_edited(rng, word, texts[0], 1) for _ in range(40)] + texts[:5] + ["", None, " ", "one two", "one two", "one three"]
    rows = list(enumerate(texts, 10))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    want = naive_groups(rows)
    got = {r.doc_id: r.component_id for r in similarity.similar_groups(df).collect()}
    # a pair just above the threshold may share no key or head; one below never links
    assert np.mean([got[i] == want[i] for i in want]) > 0.95
    assert all(want[i] == want[got[i]] for i in got)
    repeated = df.union(df.where("doc_id < 12"))
    kept = similarity.keep_one(repeated)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in got.items() if i == c)
    assert similarity.similar_groups(df.limit(0)).count() == 0


def test_star_groups_near_the_threshold(spark):
    """Copies of an original that are similar to it, but not to each other, in one group; brute force on all pairs that share a key."""
    rng, word, _ = _texts(3, 0)
    rows, sizes = [], (20, 100, 1000)
    for n in sizes:
        original = [word() for _ in range(204)]
        star = [" ".join(original)]
        while len(star) <= n:
            copy, at = list(original), rng.randint(0, 4)
            for k in range(4):
                copy[min(203, 4 + at + 50 * k + rng.randint(0, 35))] = word()
            star.append(" ".join(copy))
        rng.shuffle(star)
        rows += list(enumerate(star, len(rows)))
    sets = [similarity.shingle_set(t, 5) for _, t in rows]
    keys = [set(similarity.band_keys(s).tolist()) for s in sets]
    sets = [set(s.tolist()) for s in sets]
    start, links, true = 0, [], []
    for n in sizes:
        for i, j in combinations(range(start, start + n + 1), 2):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                true.append((i, j))
                if keys[i] & keys[j]:
                    links.append((i, j))
        start += n + 1
    want, whole = roots(list(range(len(rows))), links), roots(list(range(len(rows))), true)
    assert len(true) < 40 * len(rows) and len(set(whole.values())) <= 6  # stars, not cliques
    got = {r.doc_id: r.component_id for r in similarity.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert np.mean([got[i] == whole[i] for i in whole]) > 0.995


@pytest.fixture
def corpus(spark, tmp_path):
    rng, word, texts = _texts(7, 300)
    bench = [" ".join(word() for _ in range(30)) for _ in range(5)]
    docs, labels, junk, leaky = [], [], set(), set()
    for i, t in enumerate(texts):
        if i % 4 == 3:
            t = t.upper().replace(" ", "!! ")
            junk.add(i)
        elif i % 10 == 0:
            t = t + "\n" + bench[i % 5] + "\n" + t
            leaky.add(i)
        elif i % 10 == 1:
            t += f" {word()}@example.com +1 (988) 555-2485"
        docs.append((i, t, "en", "s", len(t)))
        labels.append((i, int(i not in junk), 0))
    clean = [i for i in range(300) if i not in junk and i not in leaky]
    docs += [(1000 + i, docs[i][1] if i % 2 else _edited(rng, word, docs[i][1], 1), "en", "s", 1) for i in clean[:20]]
    docs += [(2000, None, "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs, junk, leaky, clean


def test_stages_and_run(spark, corpus):
    folder, docs, junk, leaky, clean = corpus
    text = {d[0]: d[1] for d in docs}
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    after = dict(zip(names, (f for _, f in corpus_pipeline.STAGES)))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    good = after["quality"](spark, frame, folder)
    assert good.columns == frame.columns and not ids(good) & junk and ids(good) >= set(clean) | leaky
    one = after["near_duplicates"](spark, frame, folder)
    groups = naive_groups([(d[0], d[1]) for d in docs])
    assert one.columns == frame.columns and ids(one) == {i for i, c in groups.items() if i == c}
    rest = after["decontamination"](spark, frame, folder)
    assert rest.columns == frame.columns and ids(rest) == set(text) - leaky
    hidden = after["pii"](spark, frame, folder)
    assert hidden.columns == frame.columns and hidden.count() == len(docs)
    for r in hidden.collect():
        assert not pii.base_spans(r.text or "") and r.n_chars == (None if r.text is None else len(r.text))
        assert ("[EMAIL]" in (r.text or "")) == ("@example.com" in (text[r.doc_id] or ""))
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = corpus_pipeline.run(spark, folder).collect()
    # an edited copy just above the threshold may stay
    assert {r.doc_id for r in out if r.doc_id < 1000} == set(clean)
    assert sum(1000 <= r.doc_id < 2000 for r in out) <= 3
    for r in out:
        assert r.ids == sp.encode(r.decoded) and r.n_tokens == len(r.ids)


def test_recall_of_all_links_on_documents(spark):
    """All pairs of whole shingle sets, found through an inverted index, on the given table."""
    from tests.llm.test_simhash import roots

    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    sets = {i: naive_set(t or "") for i, t in rows}
    at, links = {}, []
    for i, s in sets.items():
        both = {}
        for x in s or [b""]:
            for j in at.get(x, ()):
                both[j] = both.get(j, 0) + 1
            at.setdefault(x, []).append(i)
        links += [(j, i) for j, n in both.items() if n >= 0.8 * (max(1, len(s)) + max(1, len(sets[j])) - n)]
    want = roots(list(sets), links)
    got = {r.doc_id: r.component_id for r in similarity.similar_groups(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    found = sum(got[i] == got[j] for i, j in links)
    assert len(links) > 50 and found >= 0.99 * len(links)
    assert all(want[i] == want[got[i]] for i in got)


def test_rows_of_one_id(spark):
    """Rows that share an id, null or not, are decided by their own texts; columns may have the names used inside."""
    rng, word, texts = _texts(11, 4)
    rows = [(1, texts[0], "a", 1), (1, texts[1], "b", 2), (None, texts[2], "c", 3), (None, texts[3], "d", 4), (5, texts[1], "e", 5), (None, texts[0], "f", 6), (1, texts[0], "g", 7), (6, None, "h", 8), (7, "", "i", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, h int")
    kept = similarity.keep_one(df)
    assert kept.columns == df.columns
    got = sorted((r.id for r in kept.collect()))
    assert [x for x in got if x not in ("a", "g")] == ["b", "c", "d", "h"] and len(got) == 5
    groups = similarity.similar_groups(df).collect()
    assert len(groups) == len(rows) and sorted({r.component_id for r in groups if r.component_id}) == [1, 6]


def test_stages_with_columns_of_internal_names(spark):
    """Other columns may have any name, those that a stage uses for itself included."""
    from plinth.llm import decontaminate

    names = ("_h", "_id", "_leaking", "id", "h", "root", "item", "doc", "stays", "n", "kept")
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(1, text, *names), (2, text, *names), (3, "another text of few words", *names), (3, "a third one here", *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = similarity.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r["_h"]) for r in kept.collect()) == [(1, "_h"), (3, "_h"), (3, "_h")]
    clean = decontaminate.remove_leaking(df, spark.createDataFrame([(0, text)], "item_id long, text string"))
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == [3, 3]
