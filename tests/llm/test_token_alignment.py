"""Groups, links and counts against a plain version on the libraries' own tokens."""

import hashlib
from collections import Counter

import public_tokenizers as P
from plinth.llm import queries
from plinth.llm import token_alignment as ta
from tests.llm.test_token_ops import TEXTS

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
MORE = ["\n starts", "ends \n", "a  b   c d", "x▁y z", "<unk> a", "<s>", "'s 't don't", "\x1c a \x85b c", " lead", "trail ", "word " * 50_000, "é" * 3000]


def _tokens(aligner, text):
    """Ids and byte ends of both sides; nothing if they don't give the bytes."""
    if not text:
        return None
    sides = []
    for ids, known in ((aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.a_bytes), (aligner.b.encode(text), aligner.b_bytes)):
        parts, ends, at = [known[i] for i in ids], {}, 0
        if b"".join(parts) != (" " + text).encode():
            return None
        for k, x in enumerate(parts):
            at += len(x)
            ends[at] = k
        sides.append((ids, ends))
    return sides


def _plain(texts):
    aligner, rows, counts = ta.load_aligner(A, B), [], Counter()
    for t in texts:
        found = _tokens(aligner, t)
        if found is None:
            rows.append(None)
            continue
        (a, ends_a), (b, ends_b) = found
        la = lb = 0
        groups, links = [], []
        for e in sorted(ends_a.keys() & ends_b.keys()):
            ra, rb = ends_a[e] + 1, ends_b[e] + 1
            groups.append(",".join(map(str, a[la:ra])) + "|" + ",".join(map(str, b[lb:rb])))
            links.append((a[ra - 1], b[rb - 1]))
            la, lb = ra, rb
        counts.update(links)
        rows.append((len(a), len(b), ";".join(groups), links))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [(0, 0, 0, 0, "", 0, 0) if r is None else (r[0], r[1], len(r[3]), len(r[3]), r[2], sum(counts[x] == most[x[1]] for x in r[3]), sum(counts[x] for x in r[3])) for r in rows]


def test_equals_a_plain_version(spark):
    texts = [*TEXTS, *MORE, *MORE[:6], *(t.replace("▁", "_") for t in TEXTS if t)]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, row string").repartition(4)
    want = _plain(texts)
    assert sum(w[0] == 0 for w in want) > 4 and sum(w[0] > 0 for w in want) > 40
    for hot_share in (ta.HOT_SHARE, 3, 1):  # all pairs looked up, a few, none
        out = ta.with_counts(ta.align(df, A, B), A, B, hot_share).orderBy("doc_id").collect()
        assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in out] == want
    empty = ta.token_alignment(df.limit(0), A, B)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    nothing = ta.token_alignment(spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string"), A, B).collect()
    assert len(nothing) == 3 and all(r.n_a == r.count_sum == 0 and r.groups == "" for r in nothing)


def test_identity_map_and_paths():
    aligner = ta.load_aligner(A, B)
    at = {x: i for i, x in enumerate(aligner.b_bytes)}
    held = [i for i, j in enumerate(aligner.identity) if j >= 0]
    assert len(held) > 10_000 and all(aligner.b_bytes[aligner.identity[i]] == aligner.a_bytes[i] for i in held)
    assert all(aligner.a_bytes[i] not in at for i in range(1000) if aligner.identity[i] < 0)
    # few pieces kept, then forgotten: same results
    aligner.kept.clear()
    first = aligner.aligned(["the cat sat", "on the mat " * 30])
    aligner.kept.clear()
    assert [aligner.aligned([t])[0] for t in ("the cat sat", "on the mat " * 30)] == first
    assert all(len(p) <= ta.KEPT_CHARS for p in aligner.kept)
    aligner.kept.clear()


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = _plain([r.text for r in docs])
    out = queries.QUERIES["op12_token_alignment"](spark, sf).orderBy("doc_id").collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    assert [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in out] == [(d.doc_id, *w[:4], digest(w[4]), *w[5:]) for d, w in zip(docs, want)]
