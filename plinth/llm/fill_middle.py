"""Fill-in-middle transformation on a roaring-style set of unit boundaries.

A text is cut into units; the code point behind each unit is a boundary.  The
boundaries of a text are a compressed set: positions are split by their high
bits into containers of 65,536 code points, and each container takes the
smallest of three forms, an array (scattered boundaries), a bitmap (dense
ones) or runs (scripts in which each character is a unit).  Cumulative
cardinalities of the containers turn the k-th boundary into a search for its
container and a selection inside it, which gives both cuts of a document.

Texts are read window by window, a container each, so beside the text itself
only its compressed set is held.  Texts are never cut between their units, and
the text is rebuilt from output and form alone (``restored``).

Nulls count as the empty text: no units, form plain, both lengths null.  A null
id draws as the empty string does.  Repeated rows draw alike, an empty table
gives an empty result, very long texts are whole, and columns other than the
named two aren't read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of a container, and what marks prefix, suffix and middle in an output.
CONTAINER, MARKS = 1 << 16, ("<P>", "<S>", "<M>")


class ArrayContainer:
    """Sorted low bits."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """One bit for each code point, with the counts of set bits before each word of 64."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(CONTAINER, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1]])

    def select(self, k: int) -> int:
        w = bisect_right(self.before, k) - 1
        word, left = int(self.words[w]), k - int(self.before[w])
        for _ in range(left):
            word &= word - 1
        return 64 * w + (word & -word).bit_length() - 1


class RunContainer:
    """First position of each run, with the counts of positions before it."""

    def __init__(self, low: np.ndarray):
        first = np.flatnonzero(np.diff(low, prepend=-2) > 1)
        self.starts, self.before = low[first], first

    def select(self, k: int) -> int:
        r = bisect_right(self.before, k) - 1
        return int(self.starts[r]) + k - int(self.before[r])


def container(low: np.ndarray):
    """The container of the smallest size for sorted low bits: 2 bytes a position, 8,192 for a bitmap, 4 a run."""
    runs = int(np.count_nonzero(np.diff(low, prepend=-2) > 1))
    sizes = ((4 * runs, RunContainer), (2 * len(low), ArrayContainer), (CONTAINER // 8, BitmapContainer))
    return min(sizes, key=lambda x: x[0])[1](low)


class BoundarySet:
    """Sorted positions, added container by container."""

    def __init__(self):
        self.high, self.containers, self.total = [], [], []

    def add(self, high: int, low: np.ndarray) -> None:
        if len(low):
            self.high.append(high)
            self.containers.append(container(low))
            self.total.append(len(self) + len(low))

    def __len__(self) -> int:
        return self.total[-1] if self.total else 0

    def select(self, k: int) -> int:
        """The position that has ``k`` positions before it."""
        c = bisect_right(self.total, k)
        return self.high[c] * CONTAINER + self.containers[c].select(k - (self.total[c - 1] if c else 0))


def _letters(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((points | 32) - 97).astype(np.uint32) < 26


def boundaries(text: str) -> BoundarySet:
    """Code points behind each unit, a unit being a run of ASCII letters or one other character.  Positions are those of units' last code points."""
    out = BoundarySet()
    for high, at in enumerate(range(0, len(text), CONTAINER)):
        letter = _letters(text[at : at + CONTAINER + 1])
        follows = np.append(letter[1:], False)[: min(CONTAINER, len(letter))]
        out.add(high, np.flatnonzero(~(letter[:CONTAINER] & follows)))
    return out


def cuts(text: str, h1: int, h2: int) -> tuple[int, int, int]:
    """Units of ``text``, and the code points before its two cuts."""
    ends = boundaries(text)
    n = len(ends)
    places = [0 if k == 0 else ends.select(k - 1) + 1 for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
    return n, *places


def draws(id_col: Column, seed: int = 1) -> list[Column]:
    """Four unsigned numbers from the SHA-256 of seed and decimal id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """``id_col, n, form, prefix_chars, middle_chars, output`` for each row.

    The numbers drawn decide the cuts (first and second), whether the text stays plain (third) and the order of the
    parts (fourth).  Texts that are empty or hold a mark are plain.
    """
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains(text, F.lit(m))
    form = F.when((text == "") | marked | (h3 % 100 >= 100 - plain_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = df.select(id_col, text.alias("text"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [cuts(t.as_py(), x, y) for t, x, y in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist())]
            n, first, second = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), *(pa.array(x, pa.int64()) for x in (n, first, second))], names=[id_col, "text", "form", "n", "first", "second"])

    out = rows.mapInArrow(run, f"`{id_col}` {kind}, text string, form string, n long, first long, second long")
    part = lambda a, size: F.substring("text", (a + 1).cast("int"), size.cast("int"))
    prefix, middle = part(F.lit(0), F.col("first")), part(F.col("first"), F.col("second") - F.col("first"))
    suffix = part(F.col("second"), F.lit(2**31 - 1))
    p, s, m = map(F.lit, MARKS)
    psm, spm = F.concat(p, prefix, s, suffix, m, middle), F.concat(s, suffix, p, prefix, m, middle)
    cut = F.col("form") != "plain"
    return out.select(
        id_col, "n", "form", F.when(cut, F.col("first")).alias("prefix_chars"), F.when(cut, F.col("second") - F.col("first")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from; its parts hold no marks, so each mark's first place is its own."""
    p, s, m = MARKS
    between = lambda a, b: F.substring_index(F.substring(output, len(a) + 1, 2**31 - 1), b, 1)
    behind = lambda a: F.substring(output, (F.position(F.lit(a), output) + len(a)).cast("int"), F.lit(2**31 - 1))
    middle = behind(m)
    psm = F.concat(between(p, s), middle, F.substring_index(behind(s), m, 1))
    spm = F.concat(F.substring_index(behind(p), m, 1), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
