"""Token counts and the SentencePiece codec against the libraries themselves."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F

from plinth.llm import sentencepiece_codec, token_counts

BPE, PIECE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
NASTY = ["", None, " ", "  ", "a ", "a  ", " a", "▁", "a▁b", "▁ ▁", "\n\n x\t y", "don't we'll", "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", "<s> </s> <unk> <0x0A>", "日本語 テキスト", "é ½ ﬁ    x", "😀 ok\x00z", "a" * 5000, " " * 3000, "ab " * 4000, "1234567890" * 300, "<|endoftext|>" * 200]


def _noise(seed, n):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "the", "ing", "'re", "'", "12", "é", "語", "<|endoftext|>", "<|endo", "text|>", "▁", "\t ", "!!", "Ünd", " ", "😀"]
    return "".join(rng.choice(parts) for _ in range(n))


TEXTS = NASTY + [_noise(k, 400) for k in range(40)]


@pytest.mark.parametrize("chunk,overlap", [(40, 4), (64, 16), (300, 30)])
def test_splicing_equals_whole_text(chunk, overlap):
    tok, margin = token_counts.load_tokenizer(BPE)
    for t in TEXTS:
        ids = [i for part in token_counts.encode_spliced(tok, margin, t or "", chunk, overlap) for i in part]
        assert ids == tok.encode(t or "", add_special_tokens=False).ids, repr(t)[:80]


def test_text_without_boundaries_is_read_a_few_times():
    tok, margin = token_counts.load_tokenizer(BPE)

    class Counting:
        read = 0

        def encode(self, text, **options):
            self.read += len(text)
            return tok.encode(text, **options)

    for text in ("abcdefghij" * 20_000, "x" * 200_000, "word " * 40_000):
        counting = Counting()
        ids = [i for part in token_counts.encode_spliced(counting, margin, text, 1000, 16) for i in part]
        assert ids == tok.encode(text, add_special_tokens=False).ids
        assert counting.read < 10 * len(text)


def test_token_counts_rows(spark):
    tok, _ = token_counts.load_tokenizer(BPE)
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(0, "", "again"), (None, "hello", "n")], "doc_id long, text string, n_tokens string")
    rows = token_counts.token_counts(df, BPE, chunk=64, overlap=8).collect()
    want = sorted((-1 if k is None else k, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False))) for k, t in [*enumerate(TEXTS), (0, ""), (None, "hello")])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)
    assert token_counts.token_counts(df.limit(0), BPE).count() == 0


def test_codec_equals_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    df = spark.createDataFrame([(k, t, [1]) for k, t in enumerate(TEXTS)], "doc_id long, text string, ids array<int>")
    rows = sentencepiece_codec.sentencepiece_codec(df, PIECE).orderBy("doc_id").collect()
    assert len(rows) == len(TEXTS)
    for r, t in zip(rows, TEXTS):
        assert r.ids == sp.encode(t or ""), repr(t)[:80]
        assert r.decoded == sp.decode(r.ids)
    assert sentencepiece_codec.sentencepiece_codec(df.limit(0), PIECE).count() == 0
    # blocks of few texts, more tasks, a change of order between the passes: still the library's ids
    small = sentencepiece_codec.sentencepiece_codec(df.repartition(5), PIECE, block_chars=500)
    assert {r.doc_id: r.ids for r in small.collect()} == {r.doc_id: r.ids for r in rows}


def test_each_distinct_word_is_segmented_once(spark):
    texts = [(k, f"the cat {k % 3} sat on the mat") for k in range(40)] + [(99, None), (100, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    lists = sentencepiece_codec.word_lists(df.fillna(""), 3, 200)
    ids = sentencepiece_codec.word_ids(lists, PIECE, 3)
    made = {(r.part, r.block, r.bucket): r.ids for r in ids.collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    seen = set()
    for r in lists.collect():
        words = sentencepiece_codec.unpacked_words(bytes(r.words))
        seen |= set(words)
        assert sentencepiece_codec.unpacked_ids(bytes(made[r.part, r.block, r.bucket])) == [sentencepiece_codec.id_bytes(sp.encode(w[1:])) for w in words]
    assert seen == {"▁the", "▁cat", "▁0", "▁1", "▁2", "▁sat", "▁on", "▁mat"}


def test_texts_other_than_the_table_was_made_from():
    codec = sentencepiece_codec.load_codec(PIECE)
    words = ["▁a", "▁", "▁bcd"]
    want = codec.segment(words)
    right = sentencepiece_codec.words_digest(sentencepiece_codec.packed_words(words))
    stale = [(0, right + 1, sentencepiece_codec.packed_ids([b"", b"", b""])), (7, right, b"")]
    for stored in ([], stale, [(0, right, sentencepiece_codec.packed_ids(want))]):
        table = sentencepiece_codec.WordTable(stored, words, 1, codec)
        texts = [np.array(x, np.int32) for x in ([2, 0, 2], [], [1], [])]
        ids, ends = table.ids(texts)
        assert [ids[a:b].astype(np.uint32).tobytes() for a, b in zip(ends[:-1], ends[1:])] == [b"".join(want[k] for k in t) for t in texts]
    for ids in ([[1, 70_000], [], [3]], [[1, 2], [], [3]], []):
        found = [sentencepiece_codec.id_bytes(x) for x in ids]
        assert sentencepiece_codec.unpacked_ids(sentencepiece_codec.packed_ids(found)) == found
    assert sentencepiece_codec.unpacked_words(sentencepiece_codec.packed_words(["", "é\x00", "b"])) == ["", "é\x00", "b"]


def test_digests(spark):
    df = spark.createDataFrame([([1, 20], ""), ([], "")], "ids array<int>, t string")
    got = [r[0] for r in df.select(F.sha2(F.array_join("ids", ","), 256)).collect()]
    assert got == [hashlib.sha256(b"1,20").hexdigest(), hashlib.sha256(b"").hexdigest()]
