"""Quality and toxicity: held-out accuracy on invented texts, and the edge cases."""

import random
import zlib

import numpy as np

from plinth.llm import quality, toxicity


def _docs(n=600, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    docs, labels = [], []
    for i in range(n):
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        lines = [" ".join(word() for _ in range(rng.randint(4, 14))).capitalize() + "." for _ in range(rng.randint(2, 10))]
        if not good:
            lines = [x.upper().replace(" ", "!! ") for x in lines] if rng.random() < 0.5 else [lines[0]] * 12
        if toxic:
            k = rng.randrange(len(lines))
            lines[k] = lines[k].replace(" ", f" {rng.choice(['zzfool', 'zzscum'])} ", 1)
        docs.append((i, "\n".join(lines), "src"))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def _frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = _docs()
    df, lab = _frames(spark, docs, labels)
    for out, k, fold, rest in ((quality.quality_scores(df, lab), 1, 3, 1), (toxicity.toxicity_scores(df, lab), 2, 5, 0)):
        rows = {r.doc_id: r for r in out.collect()}
        assert len(rows) == len(docs)
        assert all(r.held_out == (zlib.crc32(str(i).encode()) % fold == rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in rows.items())
        held = [(y[k], rows[y[0]].predicted) for y in labels if rows[y[0]].held_out]
        assert np.mean([a == b for a, b in held]) > 0.95


def test_held_out_labels_are_never_used(spark):
    docs, labels = _docs(300)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    df, lab = _frames(spark, docs, labels)
    _, other = _frames(spark, docs, flipped)
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        a, b = ({r.doc_id: round(r.score, 9) for r in f(df, x).collect()} for x in (lab, other))
        assert a == b


def test_nulls_empties_repeats_and_missing_classes(spark):
    docs, labels = _docs(200)
    docs += [(None, "abc def", "n"), (900, None, "n"), (901, "", "n"), (902, "x " * 50_000, "n"), (0, docs[0][1], "again")]
    df, lab = _frames(spark, docs, labels + [(900, None, None), (0, 1, 1), (None, 1, 1)])
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        assert f(df, lab).count() == len(docs)
        one = {round(r.score, 6) for r in f(df, lab.where("quality = 1 and toxic = 1")).collect()}
        assert one == {1.0}
        none = f(df, lab.limit(0)).collect()
        assert len(none) == len(docs) and len({r.score for r in none}) == 1
        assert f(df.limit(0), lab).count() == 0
    kept = quality.keep_good(df, lab)
    assert kept.columns == df.columns and 0 < kept.count() < len(docs)


def test_noisy_or_finds_the_sentence(spark):
    docs, labels = _docs()
    df, lab = _frames(spark, docs, labels)
    model = toxicity.fit(df, lab)
    assert {"|zzfool|", "|zzscum|"} <= set(model.index)
    found = {r.doc_id: r.offending for r in toxicity.toxicity_scores(df, lab, model=model).collect()}
    for i, t, _ in docs:
        for s in found[i]:
            assert "zz" in t[s["start"] : s["end"]]
        assert bool(found[i]) == ("zz" in t)


def test_statistics_are_finite():
    for t in ("", " ", "a", "A" * 10, "é" * 10, "日本", "1\n2\n3", "\x00", "|||", "x" * 200_000):
        v = quality.text_statistics(t)
        assert len(v) == len(quality.FEATURES) and np.isfinite(v).all()


def test_toxic_stems_count_in_words_never_seen(spark):
    """Beginnings of words carry over to compounds; a very long text is scored to its end; other columns don't matter."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n)) + ". "
    docs = [(i, "".join(sentence(8) for _ in range(5)) + (f"{word()} vilex{word()} vilex{word()} {word()}. " if i % 5 == 2 else "")) for i in range(800)]
    lab = spark.createDataFrame([(i, int(i % 5 == 2)) for i, _ in docs], "doc_id long, toxic int")
    df = spark.createDataFrame([(*d, 0.5, "x") for d in docs], "doc_id long, text string, score double, label string")
    model = toxicity.fit(df, lab)
    got = toxicity.toxicity_scores(df, lab, model=model).collect()
    out = [(r.doc_id % 5 == 2, r.predicted) for r in got if r.held_out]
    assert len(out) > 100 and sum(a != b for a, b in out) <= 0.03 * len(out)
    long = sentence(8) * 20_000
    ends = spark.createDataFrame([(1, long), (2, long + "a vilexab vilexcd b.")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.toxicity_scores(ends, lab, model=model).collect()} == {1: 0, 2: 1}


def test_best_threshold():
    p = np.array([0.9, 0.8, 0.7, 0.4, 0.4, 0.1])
    assert 0.4 < toxicity.best_threshold(p, np.array([1, 1, 1, 0, 0, 0])) < 0.7
    assert 0.1 < toxicity.best_threshold(p, np.array([1, 1, 1, 1, 1, 0])) < 0.4
