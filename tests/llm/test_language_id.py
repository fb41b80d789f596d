"""Kernels against sets of n-grams, held-out accuracy, and the edge cases."""

import random
import zlib

import numpy as np

from plinth.llm import language_id as li
from plinth.llm import queries

LETTERS = {"xa": "abcdefgh", "xb": "efghijkl", "xc": "klmnopñé", "xd": "абвгдежз"}


def _texts(n=400, seed=2):
    rng, rows = random.Random(seed), []
    for k in range(n):
        lang = rng.choice([*LETTERS, "xa", "xa"])
        word = lambda: "".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(1, 8)))  # noqa: B023, E731
        rows.append((k, rng.choice([" ", ", ", "\n"]).join(word() for _ in range(rng.randint(3, 120))).capitalize(), lang))
    return rows


def _sets(text):
    x = " ".join("".join(c.lower()[0] if c.isalpha() else " " for c in text).split())
    x = f" {x} "
    return [{x[i : i + n] for i in range(len(x) - n + 1)} - ({" "} if n == 1 else set()) for n in li.ORDERS] if x.strip() else [set() for _ in li.ORDERS]


def _unpacked(g, n):
    return {"".join(chr(int(v) >> 21 * (n - 1 - j) & 0x1FFFFF) for j in range(n)) for v in g}


def test_grams_are_those_of_the_text(monkeypatch):
    texts = ["", "123 !", "a", "Hello, World", "ÀÉ  ñ\n\n漢字 😀 x", "a1b2", "İstanbul", *(t for _, t, _ in _texts(20))]
    for window in (1 << 18, 1, 2, 3, 7):
        monkeypatch.setattr(li, "WINDOW", window)
        for t in texts:
            assert [_unpacked(g, n) for g, n in zip(li.grams(t), li.ORDERS)] == _sets(t), (window, t)


def test_kernel_rows_equal_sets(monkeypatch):
    texts = [t for _, t, _ in _texts(40)] + ["123"]
    found = [li.grams(t) for t in texts]
    kernel = li.Kernel.of(found[:9])
    want = [[np.mean([len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b))) for a, b in zip(_sets(x), _sets(y))]) for y in texts[:9]] for x in texts]
    for grams in (li.BATCH_GRAMS, 50):
        monkeypatch.setattr(li, "BATCH_GRAMS", grams)
        assert np.allclose(kernel.rows(found), want, atol=1e-5)
    right = np.random.default_rng(0).normal(size=(9, 3))
    assert np.allclose(kernel.times(right).rows(found), np.array(want) @ right, atol=1e-4)


def test_fit_is_kernel_ridge_on_nystroem_features(spark):
    """Enough landmarks for all distinct texts: the values are those of weighted kernel ridge with a constant."""
    rows = [r for r in _texts(60) if zlib.crc32(str(r[0]).encode()) % 5]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.fit(df, landmarks=400, ridge=1e-2)
    found = [li.grams(t) for _, t, _ in rows]
    gram, langs = li.Kernel.of(found).rows(found), model.languages
    gram = (gram + gram.T) / 2
    size = {x: sum(r[2] == x for r in rows) for x in langs}
    w = np.array([1 / size[r[2]] for r in rows])
    y = np.array([[1.0 if r[2] == x else -1.0 for x in langs] for r in rows])
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-6 * values[-1]
    phi = np.hstack([gram @ (vectors[:, keep] / np.sqrt(values[keep])), np.ones((len(rows), 1))])
    beta = np.linalg.solve((phi * w[:, None]).T @ phi + 1e-2 * len(langs) * np.eye(phi.shape[1]), (phi * w[:, None]).T @ y)
    assert np.allclose(model.kernel.rows(found) + model.constant, phi @ beta, atol=2e-3)


def test_held_out_accuracy_and_labels(spark):
    rows = _texts()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    out = {r.doc_id: r for r in li.languages(df).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 for k, r in out.items())
    held = [(lang, out[k].lang_pred) for k, _, lang in rows if out[k].held_out]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95
    flipped = [(k, t, "xa" if out[k].held_out else lang, "x") for k, t, lang in rows]
    again = {r.doc_id: r for r in li.languages(spark.createDataFrame(flipped, df.schema)).collect()}
    assert all(again[k].lang_pred == r.lang_pred and abs(again[k].score - r.score) < 1e-6 for k, r in out.items())


def test_edges(spark):
    rows = [(*r,) for r in _texts(80)]
    odd = [(900, None, "xa"), (901, "", "xb"), (902, "12 !? 34", "xc"), (903, "abc " * 200_000, None), (None, "abgh fed", "xa"), (0, rows[0][1], rows[0][2]), (0, rows[0][1], rows[0][2])]
    schema = "doc_id long, text string, lang string"
    out = li.languages(spark.createDataFrame(rows + odd, schema)).collect()
    assert len(out) == len(rows) + len(odd)
    by = {r.doc_id: r for r in out}
    assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (900, 901, 902)) and by[903].lang_pred == "xa" and by[None].lang_pred == "xa" and not by[None].held_out
    nobody = li.languages(spark.createDataFrame([(k, t, None) for k, t, _ in rows], schema)).collect()
    assert {(r.lang_pred, r.score) for r in nobody} == {("und", 0.0)}
    assert {r.lang_pred for r in li.languages(spark.createDataFrame([(k, t, "xa") for k, t, _ in rows], schema)).collect()} == {"xa"}
    assert li.languages(spark.createDataFrame([], schema)).count() == 0


def test_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.QUERIES["op13_language_id"](spark, sf).collect()
    assert len(rows) == len(lang)
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in rows if r.held_out]) > 0.98
