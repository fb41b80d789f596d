"""SentencePiece encoding and decoding through a distinct-chunk table.

A marked word is a run of whitespace markers and the characters up to the next
marker.  When no piece of the vocabulary has a marker behind another character
(checked on the model itself), merges never cross the start of a marked word,
so each distinct marked word is segmented once, and the ids of a text are the
ids of its marked words by position.

1.  Each task lists the distinct words of its texts, block by block of bounded
    size, dealt by their hashes to buckets: of a block, a bucket gets one row.
    Occurrences aren't shuffled, only these lists.
2.  A bucket's task segments each distinct word of all blocks once, and gives
    every block the ids of its words in the order in which they came.
3.  The ids of a block are written as one file in the shared folder, and the
    tasks that read the texts again put the ids in place by position: they
    number a block's words, read its file bucket by bucket into one buffer and
    gather each text's ids from there.  The texts themselves aren't held.

A block's file says by a digest which words its ids belong to.  Should a task
meet other texts than those its file was made from (rows that come in another
order when they are computed again), it segments the words on the spot, so the
result never depends on that.

Nulls count as the empty text (no ids, decoded to the empty text).  Very long
texts are blocks of their own.  Repeated rows are encoded each on its own, an
empty table gives an empty result, and columns other than the named two aren't
read, whatever their names.
"""

from __future__ import annotations

import functools
import re
import struct
from array import array
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.memory import giving_back
from plinth.session import shared_path

#: Characters of a block of texts, and distinct words of a bucket, about.
BLOCK_CHARS, BUCKET_WORDS = 16_000_000, 250_000
#: Bytes of ids that a task holds before it hands them on, about.
OUT_BYTES = 4_000_000
MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def marked_words(text: str) -> list[str]:
    return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []


class Codec:
    """Segments marked words with the library."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        crossing = [p for p in pieces if MARK in p.lstrip(MARK)]
        identity = all(self.sp.normalize(x) == MARK + x.replace(" ", MARK) for x in ("a  b", " ½ﬁ\n\t", "é "))
        if crossing or not identity:
            raise ValueError("pieces of this model cross whitespace markers, or it changes its input; a table of marked words can't represent it")
        self.lone = id_bytes([self.sp.piece_to_id(MARK)])

    def segment(self, words: list[str]) -> list[bytes]:
        """Ids of marked words.  The library puts one marker before what it is given, so a word goes in without its first one."""
        out = []
        for lo in range(0, len(words), 10_000):
            part = words[lo : lo + 10_000]
            found = self.sp.encode([w[1:].replace(MARK, " ") for w in part], num_threads=1)
            out += [self.lone if w == MARK else id_bytes(ids) for w, ids in zip(part, found)]
        return out


def id_bytes(ids) -> bytes:
    """Ids as four bytes each, the form that tables of words hold: a third of the memory of lists."""
    return array("I", ids).tobytes()


@functools.lru_cache(maxsize=2)
def load_codec(model: str) -> Codec:
    return Codec(model)


def packed_words(words: list[str]) -> bytes:
    """Lengths, then the words; what ``unpacked_words`` reads."""
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    return struct.pack("<I", len(data)) + np.array([len(x) for x in data], np.uint32).tobytes() + b"".join(data)


def unpacked_words(data: bytes) -> list[str]:
    (n,) = struct.unpack_from("<I", data)
    ends = np.cumsum(np.frombuffer(data, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    starts = [4 + 4 * n, *ends[:-1].tolist()] if n else []
    return [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts, ends.tolist())]


def packed_ids(found: list[bytes]) -> bytes:
    """Numbers of ids, then the ids in two bytes where these do; what ``unpacked_ids`` reads."""
    flat = np.frombuffer(b"".join(found), np.uint32)
    kind = np.uint16 if not len(flat) or flat.max() < 1 << 16 else np.uint32
    return struct.pack("<II", len(found), np.dtype(kind).itemsize) + np.array([len(ids) // 4 for ids in found], np.uint32).tobytes() + flat.astype(kind).tobytes()


def ids_arrays(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ids of the words, and the ids of all of them."""
    n, width = struct.unpack_from("<II", data)
    sizes = np.frombuffer(data, np.uint32, n, 8).astype(np.int64)
    return sizes, np.frombuffer(data, {2: np.uint16, 4: np.uint32}[width], int(sizes.sum()), 8 + 4 * n)


def unpacked_ids(data: bytes) -> list[bytes]:
    sizes, flat = ids_arrays(data)
    flat = flat.astype(np.uint32).tobytes()
    ends = (4 * np.cumsum(sizes)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def words_digest(packed: bytes) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(packed)).view(np.int64))


def _rows(batches, block_chars: int):
    """(number of the block, id, text) of each row; a block is consecutive rows that hold about so many characters."""
    number, size = 0, 0
    for b in batches:
        for key, text in zip(b.column(0), b.column(1)):
            text = text.as_py()
            if size and size + len(text) > block_chars:
                number, size = number + 1, 0
            size += len(text)
            yield number, key.as_py(), text


class Numbering(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _buckets(words: list[str], buckets: int) -> dict[int, list[int]]:
    """The places of distinct words by bucket."""
    from xxhash import xxh32_intdigest

    out: dict = {}
    for k, w in enumerate(words):
        out.setdefault(xxh32_intdigest(w.encode("utf-8", "surrogatepass")) % buckets, []).append(k)
    return out


def distinct_words(rows: DataFrame) -> int:
    """About how many distinct words the texts have."""
    words = rows.select(F.explode(F.split("text", f"[ {MARK}]+")).alias("word"))
    return words.agg(F.approx_count_distinct("word")).first()[0]


def word_lists(rows: DataFrame, buckets: int, block_chars: int) -> DataFrame:
    """``part, block, bucket, words`` of the rows' tasks."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, block in groupby(_rows(batches, block_chars), itemgetter(0)):
            seen: dict = {}
            for _, _, text in block:
                seen.update(dict.fromkeys(marked_words(text)))
            words = list(seen)
            del seen
            found = sorted((k, packed_words([words[i] for i in places])) for k, places in _buckets(words, buckets).items())
            del words
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(found), pa.int32()), pa.array([number] * len(found), pa.int32()), pa.array([k for k, _ in found], pa.int32()), pa.array([w for _, w in found], pa.binary())], names=["part", "block", "bucket", "words"])

    return rows.mapInArrow(giving_back(run), "part int, block int, bucket int, words binary")


def word_ids(lists: DataFrame, model: str, buckets: int) -> DataFrame:
    """``part, block, bucket, digest, ids``: for each list the ids of its words, each distinct word segmented once."""

    def run(batches):
        def batch(out):
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["part", "block", "bucket", "digest", "ids"])

        codec, at, table, out, size = load_codec(model), None, {}, [], 0
        for b in batches:
            for part, block, bucket, data in zip(*b.columns):
                if bucket.as_py() != at:
                    at, table = bucket.as_py(), {}
                data = data.as_py()
                words = unpacked_words(data)
                fresh = [w for w in words if w not in table]
                table.update(zip(fresh, codec.segment(fresh)))
                out.append((part.as_py(), block.as_py(), at, words_digest(data), packed_ids([table[w] for w in words])))
                size += len(out[-1][-1])
                if size > OUT_BYTES:
                    yield batch(out)
                    out, size = [], 0
        if out:
            yield batch(out)

    # a bucket is in one task, its rows one after the other
    dealt = lists.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(giving_back(run), "part int, block int, bucket int, digest long, ids binary")


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def write_tables(ids: DataFrame, folder: str) -> None:
    """One file for each block: its lists' buckets, digests and ids.  An attempt writes a name of its own and moves it, so that a file is always whole."""

    def write(table: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        where, top = _filesystem(folder)
        part, block = table.column("part")[0].as_py(), table.column("block")[0].as_py()
        where.create_dir(top, recursive=True)
        name = f"{top}/{part}-{block}"
        own = f"{name}.{TaskContext.get().taskAttemptId()}"
        with where.open_output_stream(own, compression=None) as f, pa.ipc.new_file(f, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table, max_chunksize=1)  # read bucket by bucket
        where.move(own, name)
        return pa.table({"n": pa.array([table.num_rows], pa.int64())})

    ids.groupBy("part", "block").applyInArrow(write, "n long").agg(F.sum("n")).collect()  # one number


def _stored(where, name: str):
    """(bucket, digest, ids) of a block's file, one bucket in memory at a time; nothing if there is no file."""
    if where is None:
        return
    try:
        f = where.open_input_file(name)
    except FileNotFoundError:
        return
    with f:
        reader = pa.ipc.open_file(f)
        for k in range(reader.num_record_batches):
            b = reader.get_batch(k)
            for bucket, digest, ids in zip(b.column("bucket"), b.column("digest"), b.column("ids")):
                yield bucket.as_py(), digest.as_py(), ids.as_py()


class WordTable:
    """Ids of a block's numbered words in one buffer, from the block's file as far as that was made from the same words."""

    def __init__(self, stored, words: list[str], buckets: int, codec: Codec):
        by_bucket = _buckets(words, buckets)
        self.starts, self.sizes, parts, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0

        def put(places, sizes, ids):
            nonlocal at
            self.sizes[places] = sizes
            self.starts[places] = at + np.cumsum(sizes) - sizes
            parts.append(ids.astype(np.int32))
            at += len(ids)

        for bucket, digest, ids in stored:
            places = by_bucket.get(bucket)
            if places is not None and digest == words_digest(packed_words([words[k] for k in places])):
                put(places, *ids_arrays(ids))
                del by_bucket[bucket]
        for places in by_bucket.values():
            put(places, *ids_arrays(packed_ids(codec.segment([words[k] for k in places]))))
        self.flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def ids(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts given by their words' numbers, and where each text's ids end, a zero first."""
        numbers = np.concatenate(texts)
        sizes = self.sizes[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        places = np.repeat(self.starts[numbers] - ends[:-1], sizes) + np.arange(ends[-1])
        return self.flat[places], ends[np.cumsum([0, *map(len, texts)])]


def sentencepiece_codec(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 1_000_000, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``id_col, ids array<int>, decoded string`` for each row; ``model`` is the path of a model file that every executor has.

    The table of words is made when this is called, the texts are encoded when the result is read.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType
    rows = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = distinct_words(rows)
    buckets = max(1, -(-words // BUCKET_WORDS), min(2 * spark.sparkContext.defaultParallelism, -(-words // 10_000)))
    folder = shared_path(spark, "words")
    write_tables(word_ids(word_lists(rows, buckets, block_chars), model, buckets), folder)

    def run(batches):
        from pyspark import TaskContext

        part, codec = TaskContext.get().partitionId(), load_codec(model)
        where, top = _filesystem(folder)
        for number, block in groupby(_rows(batches, block_chars), itemgetter(0)):
            numbers, keys, texts, chars = Numbering(), [], [], []
            for _, key, text in block:
                found = marked_words(text)
                keys.append(key)
                chars.append(len(text))
                texts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
            words = list(numbers)
            del numbers
            table = WordTable(_stored(where, f"{top}/{part}-{number}"), words, buckets, codec)
            del words
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + chars[hi] <= batch_chars):
                    size += chars[hi]
                    hi += 1
                ids, ends = table.ids(texts[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                decoded = codec.sp.decode([ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])], num_threads=1)
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo:hi], kinds), lists, pa.array(decoded, pa.string())], names=[id_col, "ids", "decoded"])
                lo = hi

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = to_arrow_type(kind)
    return rows.mapInArrow(giving_back(run), f"`{id_col}` {kind.simpleString()}, ids array<int>, decoded string")
