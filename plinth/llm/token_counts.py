"""Token counts of whole texts, with overlap resynchronisation for huge ones.

Ordinary texts go to the tokenizer as they are.  A huge text is encoded in
overlapping chunks with offsets, so memory stays bounded by the chunk wherever
the text has boundaries.  Two
chunks are spliced at a *proven* common boundary: a place where a word of the
tokenizer's own split begins in both, and which lies so far before the end of
the left chunk that nothing behind that end can have moved it.  What follows
such a place doesn't depend on what stands before it, so the right chunk's ids
from there on are the ids of the whole text.  If the overlap holds no such
place (one very long word, say) the overlap is doubled, up to the left
chunk's start, where it always succeeds; a text that is one word without any
boundary is so encoded as a whole in the end, which exact counts need.  An
overlap longer than a chunk brings as much new text, so such a text is encoded
in pieces that double, in time in proportion to its length.

Nulls count as the empty text, which has no tokens.  Repeated rows are counted
each on its own, an empty table gives an empty result, and columns other than
the two named ones are not read.
"""

from __future__ import annotations

import functools
import os
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.memory import giving_back

#: Characters of a chunk, and of the first overlap tried.
CHUNK_CHARS, OVERLAP_CHARS = 65536, 256


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    # a word's end is settled once this many characters behind it are visible: the longest special string, and the longest look-ahead of the split pattern
    return tok, max([4, *map(len, added)]) + 4


def _words(enc, at: int) -> tuple[list[int], list[int]]:
    """Text positions at which words begin, and the index of each one's first token."""
    places, firsts, last = [], [], None
    offsets = enc.offsets
    for k, w in enumerate(enc.word_ids):
        if w != last:
            places.append(at + offsets[k][0])
            firsts.append(k)
            last = w
    return places, firsts


def encode_spliced(tok, margin: int, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
    """Yields the ids of ``text`` in lists, each from one chunk up to its splice."""
    n = len(text)
    start, end = 0, min(n, chunk)
    enc = tok.encode(text[start:end], add_special_tokens=False)
    places, firsts = _words(enc, start)
    begin = 0  # first token of this chunk that counts
    origin = 0  # the boundary at which that token begins
    while end < n:
        width = overlap
        while True:
            left = max(origin, end - width)
            right = min(n, end + max(chunk, end - left))  # an overlap wider than a chunk brings as much that is new, so a text without boundaries is read a few times only
            nxt = tok.encode(text[left:right], add_special_tokens=False)
            nplaces, nfirsts = _words(nxt, left)
            proven = {p: f for p, f in zip(places, firsts) if origin <= p and p + margin <= end}
            proven[origin] = begin
            common = [p for p in nplaces if p in proven]
            if common:
                break
            width *= 2
        at = common[-1]
        yield enc.ids[begin : proven[at]]
        begin, origin = nfirsts[bisect_left(nplaces, at)], at
        enc, places, firsts, end = nxt, nplaces, nfirsts, right
    yield enc.ids[begin:]


def token_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, max_tokens: int = 1024) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for each row; ``tokenizer`` is the path of a tokenizer file that every executor has."""
    kind = df.schema[id_col].dataType.simpleString()

    def count(batches):
        tok, margin = load_tokenizer(tokenizer)
        for b in batches:
            texts = b.column(1).to_pylist()
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            counts = [0] * len(texts)
            for lo in range(0, len(short), 256):
                part = short[lo : lo + 256]
                for i, e in zip(part, tok.encode_batch_fast([texts[i] for i in part], add_special_tokens=False)):
                    counts[i] = len(e)
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    counts[i] = sum(len(x) for x in encode_spliced(tok, margin, t, chunk, overlap))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(id_col, text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(giving_back(count), f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > max_tokens)
