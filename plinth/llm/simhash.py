"""SimHash fingerprints, and near-duplicate groups by Golay-code fuzzy hashing.

Fingerprints.  A-Z are lower-cased, words are what ASCII white space leaves,
shingles are runs of words joined by one space (a shorter text: all its words
once; no words: fingerprint zero).  A bit of the fingerprint is 1 if it is set
in more than half of the shingles' XXH64 values, repeats included.

Links.  Two fingerprints link when at most two bits differ.  The 64 bits are
cut into segments of 22, 21 and 21 bits.  With two errors or fewer, some
segment i of the ring 1-2-3 is free of errors while the segment after it has
at most one.  So a key is the whole of segment i with a codeword index of the
next segment: one side has the index of the codeword nearest to it, the other
those of all codewords within four bits, and by the code's perfection two
segments that differ in one bit meet.  An equality join on the keys gives all
candidates, and the bits that differ are then counted.

Only distinct fingerprints are joined.  A key with very many of them (a large
group of near copies) isn't joined, as the pairs would grow with its square:
its members are expanded to the 64 fingerprints one bit away and themselves.
Two fingerprints differ in at most two bits exactly if they share one of
those, and any two that share one differ in at most two, so hanging each on
the least of its group gives the same components with 65 rows a member.

Null texts are empty texts; very long ones are taken whole, in blocks of
shingles; repeated rows count each; columns other than the two named ones are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.components import connected_components
from plinth.llm.golay import LENGTH, near_indices
from plinth.llm.memory import giving_back
from plinth.session import checkpointed

#: (shift, bits) of the segments of a fingerprint.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
BLOCK = 1 << 17


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a text as an unsigned number."""
    from xxhash import xxh64_digest

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < words:
        return int.from_bytes(xxh64_digest(b" ".join(found), seed), "big")
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    whole = b" ".join(found)
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(first), BLOCK):
        digests = b"".join([xxh64_digest(whole[i:j], seed) for i, j in zip(first[at : at + BLOCK], last[at : at + BLOCK])])
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(first)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``id_col, fp long`` for each row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    rows = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(giving_back(run), f"`{id_col}` {kind}, fp long")


def _keys(batches):
    """Keys of each fingerprint: near true for the nearest codeword, false for those within four bits (the nearest is among them)."""
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        bits = fps.view(np.uint64)
        segments = [((bits >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
        for i in range(3):
            exact, fuzzy = segments[i], segments[(i + 1) % 3]
            head = (i << 60) | exact << 12
            for radius in (3, 4):
                rows, index = near_indices(fuzzy, radius)
                yield pa.RecordBatch.from_arrays([pa.array(head[rows] | index), pa.array(fps[rows]), pa.array(np.full(len(rows), radius == 3))], names=["key", "fp", "nearest"])


def _ball(batches):
    """A fingerprint and those one bit away."""
    flips = np.concatenate([[0], 1 << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 2048):
            part = fps[at : at + 2048]
            around = part.view(np.uint64)[:, None] ^ flips[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(around.reshape(-1).view(np.int64)), pa.array(np.repeat(part, 65))], names=["around", "fp"])


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """``a, b``: links among distinct fingerprints (column ``fp``) whose components are those of all pairs within two bits."""
    assert all(n <= LENGTH for _, n in SEGMENTS)
    keys = distinct.select("fp").mapInArrow(giving_back(_keys), "key long, fp long, nearest boolean")
    sizes = keys.groupBy("key").agg(F.sum(F.col("nearest").cast("long")).alias("n"), F.sum((~F.col("nearest")).cast("long")).alias("m")).where("n > 0 and m > 1")
    # a key whose pairs would be more than the rows of its members' balls
    sizes = checkpointed(sizes.select("key", (F.col("n") * F.col("m") > 65 * F.col("m") + 65).alias("large")))
    met = checkpointed(keys.join(sizes, "key"))
    few = met.where("not large")
    pairs = (
        few.where("nearest").select("key", F.col("fp").alias("a"))
        .join(few.where("not nearest").select("key", F.col("fp").alias("b")), "key")
        .where("a <> b and bit_count(a ^ b) <= 2").select("a", "b")
    )
    many = met.where("large and not nearest").select("fp").distinct()
    around = many.mapInArrow(giving_back(_ball), "around long, fp long")
    hung = checkpointed(around.groupBy("around").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("around", "a"))
    stars = around.join(hung, "around").where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``id_col, fp, component_id`` for each row; ``component_id`` is the least id reachable over links."""
    docs = checkpointed(fingerprints(df, id_col, text_col, words, seed))
    firsts = checkpointed(docs.groupBy("fp").agg(F.min(id_col).alias("first")))
    roots = connected_components(fingerprint_links(firsts), "a", "b")
    named = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = checkpointed(named.groupBy("root").agg(F.min("first").alias("component_id")))
    groups = checkpointed(named.join(least, "root").select("fp", "component_id"))
    return docs.join(groups, "fp").select(id_col, "fp", "component_id")
