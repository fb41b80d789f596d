"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often they do in a corpus.

Both tokenizers cut the same bytes, a space and the text.  Byte offsets at
which tokens of both end cut them into groups; the last tokens of a group's
two sides are linked.  The count of a pair of ids is the number of links that
hold it, corpus-wide.

*   Fast path.  An array of the first vocabulary's length gives the id of the
    same bytes in the second.  Groups of one token to its array entry are
    *same*: they are counted in a vector of the vocabulary's length, one for
    each task, and looked up in the summed vector again.
*   All other groups are *odd*.  Only their links are shuffled as pairs, summed
    within each document first.  Pairs that very many documents hold are looked
    up in a broadcast table (how many there can be is bounded by how few rows
    the others may have), the others in a join by pair.

Tokens of both vocabularies never cross a space that stands between two
characters other than white space, so a text is cut there, and what a piece
gives is kept for its next occurrence in a task (up to a bound of pieces).  A
piece whose tokens don't give its bytes sends its whole text to the libraries.

Texts that are null, empty, or whose tokens don't join to the same bytes have
no tokens: zeros and an empty list of groups.  Very long texts are whole.
Repeated rows count each on its own, an empty table gives an empty result.
Columns other than the named two aren't read, whatever their names.
"""

from __future__ import annotations

import functools
import json
import os
import re
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.session import shared_path

#: Pieces that a task keeps at once (and so many before them), and the longest of them.
KEPT_PIECES, KEPT_CHARS = 200_000, 64
#: Characters of texts that a task holds as results before it hands them on, about.
OUT_CHARS = 1_000_000
#: Pairs may be broadcast if more than one in so many of all rows of odd links hold them; so there are at most so many.
HOT_SHARE = 50_000
#: Space between two characters other than white space.
_CUT = re.compile(r" (?<=\S )(?=\S)")


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligner:
    """Both vocabularies' bytes, the identity map between them, and the alignment of texts."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"]
        if spec["normalizer"] is not None or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
            raise ValueError("pieces between spaces are only known to be independent for plain byte-level vocabularies")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        names = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces of this model cross spaces")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        first = {}
        for i, x in enumerate(self.b_bytes):
            if not (self.b.is_control(i) or self.b.is_unknown(i)) and (x not in first or self.b.is_byte(first[x])):
                first[x] = i
        #: For each id of the first vocabulary the id of the same bytes in the second, or -1.
        self.identity = np.array([first.get(x, -1) for x in self.a_bytes], np.int32)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        #: Decimal ids with what may stand behind them.
        self.width = max(len(self.a_bytes), len(self.b_bytes))
        self.said = [f"{i}{mark}" for mark in (",", "|", ";", "\n") for i in range(self.width)]
        #: What pieces gave, and what they gave before there were too many.
        self.kept: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def align(self, texts: list[str]) -> list:
        """For each text, given without the space before it, ``n_a, n_b, groups, same ids, odd pairs (a << 32 | b), groups as text``; None if tokens and bytes differ."""
        if not texts:
            return []
        data = [f" {t}".encode("utf-8", "surrogatepass") for t in texts]
        joined = " ".join(texts)
        ia = np.array(self.a.encode_batch_fast([f" {joined}"], add_special_tokens=False)[0].ids, np.int64)
        ib = np.array(self.b.encode(joined, num_threads=1), np.int64)
        text_ends, whole = np.cumsum([len(x) for x in data]), b"".join(data)
        n_a, n_b = self._numbers(whole, text_ends, ia, self.a_sizes, self.a_bytes), self._numbers(whole, text_ends, ib, self.b_sizes, self.b_bytes)
        if n_a is None or n_b is None:
            half = len(texts) // 2
            return [None] if not half else self.align(texts[:half]) + self.align(texts[half:])
        return self._groups(text_ends, ia, ib, n_a, n_b)

    def _numbers(self, whole: bytes, text_ends: np.ndarray, ids: np.ndarray, sizes: np.ndarray, known: list[bytes]) -> np.ndarray | None:
        """Tokens of each text; None unless tokens join to the bytes and end where texts do."""
        if b"".join(map(known.__getitem__, ids.tolist())) != whole:
            return None
        ends = np.cumsum(sizes[ids])
        last = np.searchsorted(ends, text_ends)
        return np.diff(last, prepend=-1) if np.array_equal(ends[last], text_ends) else None

    def _groups(self, text_ends: np.ndarray, ia: np.ndarray, ib: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list:
        # tokens have bytes, so ends are distinct
        ends, at_a, at_b = np.intersect1d(np.cumsum(self.a_sizes[ia]), np.cumsum(self.b_sizes[ib]), assume_unique=True, return_indices=True)
        last_a, last_b = ia[at_a], ib[at_b]
        same = (np.diff(at_a, prepend=-1) == 1) & (np.diff(at_b, prepend=-1) == 1) & (self.identity[last_a] == last_b)
        of_text = np.searchsorted(text_ends, ends)
        # places of all tokens in the written groups: those of the first side, then those of the second
        group_a, group_b = np.searchsorted(at_a, np.arange(len(ia))), np.searchsorted(at_b, np.arange(len(ib)))
        codes = np.empty(len(ia) + len(ib), np.int64)
        codes[np.arange(len(ia)) + np.append(0, at_b + 1)[group_a]] = ia + self.width * np.isin(np.arange(len(ia)), at_a)
        stop = np.zeros(len(ib), np.int64)
        stop[at_b] = np.where(ends == text_ends[of_text], 3, 2)
        codes[np.arange(len(ib)) + (at_a + 1)[group_b]] = ib + self.width * stop
        written = "".join(map(self.said.__getitem__, codes.tolist())).split("\n")
        groups = np.bincount(of_text, minlength=len(text_ends)).tolist()
        sames, odds = last_a[same].astype(np.int32), last_a[~same] << 32 | last_b[~same]
        cut_same, cut_odd = (np.cumsum(np.append(0, np.bincount(of_text[m], minlength=len(text_ends)))).tolist() for m in (same, ~same))
        sames, odds = sames.tobytes(), odds.tobytes()
        return list(zip(n_a.tolist(), n_b.tolist(), groups, (sames[4 * x : 4 * y] for x, y in pairwise(cut_same)), (odds[8 * x : 8 * y] for x, y in pairwise(cut_odd)), written))

    def aligned(self, texts: list[str]):
        """``align`` of each text, piece by piece; texts without tokens give zeros."""
        nothing = (0, 0, 0, b"", b"", "")
        cut = [_CUT.split(t) if t else [] for t in texts]
        wanted = dict.fromkeys(chain.from_iterable(cut))
        missing = [p for p in wanted if p not in self.kept]
        if len(self.kept) + len(missing) > KEPT_PIECES:  # those met again since the last time stay
            self.old, self.kept, missing = self.kept, {}, list(wanted)
        self.kept.update((p, self.old[p]) for p in missing if p in self.old)
        fresh = [p for p in missing if p not in self.kept]
        # together, pieces are independent only if white space neither begins nor ends them
        alone = [p for p in fresh if p[0].isspace() or p[-1].isspace()]
        self.kept.update((p, self.align([p])[0]) for p in alone)
        fit = [p for p in fresh if p not in self.kept] if alone else fresh
        for lo in range(0, len(fit), 1000):
            part = fit[lo : lo + 1000]
            self.kept.update(zip(part, self.align(part)))
        out = []
        for t, ps in zip(texts, cut):
            found = list(map(self.kept.__getitem__, ps))
            if None in found:
                out.append(self.align([t])[0] or nothing)
            elif found:
                n_a, n_b, n, same, odd, said = zip(*found)
                out.append((sum(n_a), sum(n_b), sum(n), b"".join(same), b"".join(odd), ";".join(said)))
            else:
                out.append(nothing)
        for p in [p for p in fresh if len(p) > KEPT_CHARS]:
            self.kept.pop(p, None)
        return out


@functools.lru_cache(maxsize=2)
def load_aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0), kind))


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row ``row, id_col, n_a, n_b, n_groups, n_links, groups`` and its same ids and odd pairs with their numbers
    (``same, same_n, odd, odd_n``); and, with a null ``row``, the vector of same ids of each task."""
    field = df.schema[id_col]
    columns = f"row long, `{id_col}` {field.dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups string, same array<int>, same_n array<long>, odd array<long>, odd_n array<long>"

    def run(batches):
        from pyspark import TaskContext

        aligner = load_aligner(a_path, b_path)
        row, vector = TaskContext.get().partitionId() << 33, np.zeros(len(aligner.a_bytes), np.int64)
        names = ["row", id_col, "n_a", "n_b", "n_groups", "n_links", "groups", "same", "same_n", "odd", "odd_n"]

        def batch(keys, rows, found, same, odd):
            columns = [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1, 2, 2)]
            lists = [_lists([x[k] for x in parts], kind) for parts, first in ((same, pa.int32()), (odd, pa.int64())) for k, kind in ((0, first), (1, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), keys, *columns, pa.array([x[5] for x in found], pa.string()), *lists], names=names)

        for b in batches:
            texts = b.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= OUT_CHARS):
                    size += len(texts[hi])
                    hi += 1
                found = aligner.aligned(texts[lo:hi])
                same = [np.unique(np.frombuffer(x[3], np.int32), return_counts=True) for x in found]
                odd = [np.unique(np.frombuffer(x[4], np.int64), return_counts=True) for x in found]
                vector += np.bincount(np.frombuffer(b"".join([x[3] for x in found]), np.int32), minlength=len(vector))
                yield batch(b.column(0).slice(lo, hi - lo), list(range(row, row + hi - lo)), found, same, odd)
                row, lo = row + hi - lo, hi
        aligner.kept, aligner.old = {}, {}  # workers outlive their tasks
        held = np.flatnonzero(vector)
        if len(held):
            yield batch(pa.nulls(1, kind), [None], [(0, 0, 0, b"", b"", "")], [(held, vector[held])], [(held[:0], held[:0])])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(field.dataType)
    return df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, columns)


def pair_counts(aligned: DataFrame, identity: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Counts of same ids and of odd pairs over all rows, each with ``best``, whether no other pair of the second id has more.

    ``a, n, best`` for same ids, no more rows than the vocabulary; ``odd, held, n, best`` for odd pairs, with the rows that hold them.
    """
    spark = aligned.sparkSession
    ids = spark.createDataFrame([(a, int(b)) for a, b in enumerate(identity) if b >= 0], "a int, b int")  # bounded by the vocabulary
    same = aligned.where("row is null").select(F.explode(F.arrays_zip("same", "same_n")).alias("x")).groupBy(F.col("x.same").alias("a")).agg(F.sum("x.same_n").alias("n")).join(F.broadcast(ids), "a")
    odd = aligned.where("row is not null").select(F.explode(F.arrays_zip("odd", "odd_n")).alias("x")).groupBy(F.col("x.odd").alias("odd")).agg(F.count(F.lit(1)).alias("held"), F.sum("x.odd_n").alias("n"))
    odd = _written(odd.withColumn("b", F.col("odd").bitwiseAND((1 << 32) - 1).cast("int")), "pairs")
    same = _written(same, "same")
    # a row for each id of the second vocabulary at most
    most = F.broadcast(same.select("b", "n").unionByName(odd.select("b", "n")).groupBy("b").agg(F.max("n").alias("most")))
    best = (F.col("n") == F.col("most")).cast("long").alias("best")
    return same.join(most, "b").select("a", "n", best), odd.join(most, "b").select("odd", "held", "n", best)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def with_counts(aligned: DataFrame, a_path: str, b_path: str, hot_share: int = HOT_SHARE) -> DataFrame:
    """The rows of ``align`` with ``n_best`` and ``count_sum`` over their links in place of same ids and odd pairs.

    ``aligned`` is written first, and is shuffled once for the sums; where it has a digest in place of its groups, it is small.
    """
    aligned = _written(aligned, "alignment")
    identity = load_aligner(a_path, b_path).identity
    same, odd = pair_counts(aligned, identity)
    counts, best = np.zeros((2, len(identity)), np.int64)
    for r in same.collect():  # no more rows than the vocabulary
        counts[r.a], best[r.a] = r.n, r.best

    def looked_up(batches):
        for b in batches:
            sizes = [len(x) for x in b.column(1)]
            doc = np.repeat(np.arange(len(sizes)), sizes)
            at, n = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2))
            sums = []
            for v in (counts, best):
                total = np.zeros(len(sizes), np.int64)
                np.add.at(total, doc, v[at] * n)
                sums.append(pa.array(total, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *sums], names=["row", "count_sum", "n_best"])

    rows = aligned.where("row is not null")
    odd = _written(odd, "pairs")
    total = odd.agg(F.sum("held")).first()[0] or 0
    is_hot = F.col("held") > total // hot_share
    hot, cold = F.broadcast(odd.where(is_hot).drop("held")), odd.where(~is_hot).drop("held")  # at most hot_share hot pairs
    links = rows.select("row", F.explode(F.arrays_zip("odd", "odd_n")).alias("x")).select("row", F.col("x.odd").alias("odd"), F.col("x.odd_n").alias("times"))
    sums = (F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.col("times") * F.col("best")).alias("n_best"))
    parts = [
        rows.select("row", "same", "same_n").mapInArrow(looked_up, "row long, count_sum long, n_best long"),
        links.join(hot, "odd").groupBy("row").agg(*sums),
        links.join(hot, "odd", "left_anti").join(cold, "odd").groupBy("row").agg(*sums),
    ]
    each = functools.reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("same", "same_n", "odd", "odd_n").join(each, "row").drop("row")


def token_alignment(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, groups, n_best, count_sum`` for each row; ``groups`` is ``a1,a2|b1;a3|b2,b3``."""
    return with_counts(align(df, a_path, b_path, id_col, text_col), a_path, b_path)
