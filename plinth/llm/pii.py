"""Personal data: high-recall generators, boosted trees, calibrated thresholds.

Four base formats (email, ip, card, phone) are always spans.  Generators
propose further, overlapping candidates: addresses with spelled-out signs,
phone numbers without a country sign, cards and addresses with unusual
separators.  Boosted trees score them by format and context, and per-kind
thresholds, set on examples held back from training so that the wanted
precision holds there, select what is added; of candidates that overlap the
likeliest stays, and none may touch a base span.

The labels are weak ones from the table itself.  Base spans, written in another
way and put back into their own surroundings, are personal data; what looks
like a card or an address there but fails its own check isn't.  Strings drawn by
rule, of both kinds, in surroundings from the table, make up for what the table
lacks.  The sample is bounded and documented: at most ``max_docs`` texts, those
with the least hashed ids, texts with a digit or an at sign first, each searched
whole, and at most ``max_windows`` spans of each.  Detection has no bound.

All scans are linear in the text, and choosing among candidates takes a sort.
Nulls are empty texts without spans, very long texts are searched whole,
repeated rows each on its own, and an empty table gives an empty result.  Other
columns are not read, whatever their names.  Offsets are code points, ends
exclusive.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.boosting import BoostedTrees, fit_trees
from plinth.llm.memory import giving_back

KINDS = ("email", "ip", "card", "phone")
MAX_DOCS, MAX_WINDOWS, EXAMPLES, PRECISION = 400, 8, 6000, 0.98
#: Characters of the surroundings of a span that examples keep on either side.
AROUND = 60

# A match of these never begins inside a run of digits, and what is possessive needs no way back, so scans stay linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) < 4 and (not s or int(s) <= 255)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base formats, leftmost and not overlapping within a kind, in that order."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    if _DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    out.sort()
    return out


#: Full-width signs and what they stand for, one for one, so that offsets stay.
_WIDE = re.compile("[０-９＠＋．]")
_NARROW = str.maketrans("０１２３４５６７８９＠＋．", "0123456789@+.")

# any few signs around a word or sign for "at" and "dot"
_AT = re.compile(r"[\W_]{1,3}(?:[Aa][Tt]|æt)[\W_]{1,3}|\s?[(\[{<]?\s?@\s?[)\]}>]?\s?")
_DOT = r"(?:\.|\s\.\s|\s?[(\[{<]\s?\.\s?[)\]}>]\s?|[\W_]{1,3}[Dd][Oo][Tt][\W_]{1,3})"
_SPELLED_DOMAIN = re.compile(rf"[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*(?:{_DOT}[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*)+")
_GENERATORS = (
    (1, re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:{_DOT}|\W?[.·•]\W?)[0-9]{{1,3}}){{3}}(?![0-9])")),
    (1, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[\W_]{1,3}[0-9]{4}){2,3}(?:[\W_]{1,3}[0-9]{1,3})?(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")),
    (3, re.compile(r"(?<![0-9A-Za-z+(])\(?[0-9]{1,5}\)?(?:[^\w\n,;$€£%]{1,2}[0-9]{1,5}){1,7}(?![0-9A-Za-z])")),
    (3, re.compile(r"(?<![0-9A-Za-z+])0[0-9]{8,14}(?![0-9A-Za-z])")),
    (3, re.compile(r"(?<![0-9A-Za-z+])[2-9][0-9]{9}(?![0-9A-Za-z])")),
)


_DOT_BEFORE = re.compile(r"[\W_]{1,3}[Dd][Oo][Tt][\W_]{1,3}\Z")


def _local_start(text: str, end: int, least: int) -> int:
    """Where what may be the local part of an address, with spelled dots in it, begins."""
    start = end
    while True:
        here = start
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        # a word, then a spelled dot before it, then a word again
        dot = _DOT_BEFORE.search(text[max(least, start - 9) : start]) if start < here else None
        at = start - len(dot[0]) if dot else 0
        if not dot or at <= least or text[at - 1] not in _LOCAL:
            return start
        start = at


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, generator) of everything that may be personal data beyond the base formats."""
    out, last = [], 0
    if _WIDE.search(text):  # what would be a base format in ordinary signs
        text = text.translate(_NARROW)
        out = [(s, kind, e, len(_GENERATORS) + 1) for s, kind, e in base_spans(text)]
    for m in _AT.finditer(text):
        start = _local_start(text, m.start(), last)
        last = m.end()
        d = _SPELLED_DOMAIN.match(text, last) if start < m.start() else None
        if d:
            out.append((start, 0, d.end(), 0))
    if _DIGITS.search(text):
        for k, (kind, pattern) in enumerate(_GENERATORS, 1):
            out += [(m.start(), kind, m.end(), k) for m in pattern.finditer(text)]
    return list({c[:3]: c for c in reversed(out)}.values())[::-1]  # each span of a kind once, by its first generator


#: Words near a span that speak for a kind, and for none.
CUES = (
    ("mail", "email", "e-mail", "contact", "write", "reach", "correo", "courriel", "adresse"),
    ("ip", "host", "server", "address", "login", "client", "addr", "from"),
    ("card", "visa", "mastercard", "credit", "debit", "payment", "pan", "karte", "carte", "tarjeta"),
    ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "whatsapp", "sms", "telefon", "anruf", "llame", "appel"),
    ("order", "invoice", "version", "isbn", "issn", "page", "section", "chapter", "id", "ref", "serial", "pages", "vol", "doi", "date", "total", "price", "build", "release", "table", "figure", "row", "score"),
)
_CUE = {w: k for k, ws in enumerate(CUES) for w in ws}
_NEAR = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
_DATE = re.compile(r"(?:19|20)\d\d[./ -]\d{1,2}[./ -]\d{1,2}\Z|\d{1,2}[./ -]\d{1,2}[./ -](?:19|20)?\d\d\Z")


def candidate_features(text: str, start: int, kind: int, end: int, generator: int) -> list[float]:
    s = text[start:end].translate(_NARROW)
    groups = re.findall(r"[0-9]+", s)
    digits, between = "".join(groups), re.findall(r"(?<=[0-9])[^0-9]+(?=[0-9])", s)
    before, after = text[max(0, start - 48) : start], text[end : end + 24]
    cues = [0.0] * len(CUES)
    for w in [*_NEAR.findall(before.lower())[-5:], *_NEAR.findall(after.lower())[:2]]:
        if w in _CUE:
            cues[_CUE[w]] = 1.0
    letters = sum(map(str.isalpha, s))
    tld = s[-6:].lower().replace("]", " ").replace(")", " ").replace(".", " ").split()
    return [
        *(float(kind == k) for k in range(len(KINDS))), *(float(generator == g) for g in range(len(_GENERATORS) + 2)), *cues, len(s), len(digits), letters, len(set(digits)), len(groups), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, max(map(len, groups), default=0),
        float(luhn(digits)) if digits else 0.0, float(all(map(_octet, groups))), float("(" in s or "[" in s or "{" in s), float(s.startswith("0")), float(bool(_DATE.fullmatch(s))), float(bool(_DATE.match(s))), float(" " in s), float("." in s), float("-" in s), float("/" in s), float("dot" in s.lower()), len(set(between)), max(map(len, between), default=0), float(any(map(str.isspace, between))), float("@" in s),
        float(bool(tld) and tld[-1] in ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "co")), float(bool(re.search(r"[(\[{<]\s?(?:at|AT|@)", s))), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before.rstrip()[-1:] in "$€£#:="), float(after.lstrip()[:1] in "%€$"), float(before[-1:] == "\n" or not before), float(s.lower().endswith(".")),
    ]


def draw(r: random.Random, contexts: list[str]) -> tuple[str, int, int, int]:
    """A text with one drawn string in it: text, start, end, and the kind of personal data that the string is, -1 if none."""
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["an", "be", "cor", "da", "el", "fi", "go", "ha", "in", "jo", "ka", "lu", "mi", "no", "ra", "su", "ti"]) for _ in range(r.randint(2, 4)))

    def card():
        body = r.choice("3456") + n(r.choice([14, 14, 14, 13]))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def grouped(s, sep):
        return sep.join(s[k : k + 4] for k in range(0, len(s), 4))

    tld = r.choice(["com", "org", "net", "edu", "io", "de", "fr", "es", "co.uk", "info"])
    local = word() + r.choice(["", ".", "_", "-"]).join(["", r.choice([word(), n(2), ""])])
    at, dot = r.choice([(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" at ", " dot "), (" AT ", " DOT "), ("[at]", "."), ("(@)", "."), (" {at} ", " {dot} "), (" at ", ".")])
    area, sep = r.choice("23456789") + n(2), r.choice([" ", "-", ".", " "])
    number = r.choice([f"({area}) {n(3)}-{n(4)}", f"{area}{sep}{n(3)}{sep}{n(4)}", f"0{n(3)} {n(3)} {n(4)}", f"0{n(2)} {n(4)} {n(4)}", f"0{n(2)}/{n(7)}", f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"00{n(2)} {n(3)} {n(3)} {n(4)}", f"1-{area}-{n(3)}-{n(4)}", area + n(7)])
    octets = [str(r.randint(1, 254)) for _ in range(4)]
    good = [
        lambda: (f"{local}{at}{word()}{dot}{tld}", 0), lambda: (f"{local}{at}{word()}{dot}{tld}", 0), lambda: (number, 3), lambda: (number, 3), lambda: (r.choice(["[.]", "(.)", "[dot]"]).join(octets), 1),
        lambda: (":".join(f"{r.randint(1, 65535):x}" for _ in range(8)), 1), lambda: (grouped(card(), r.choice([".", "_", "/", " ", "–"])), 2),
    ]
    year = str(r.randint(1950, 2030))
    bad = [
        lambda: (f"{year}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", 4), lambda: (f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{year}", 4), lambda: (f"{r.randint(1, 12)}/{r.randint(1, 28)}/{year}", 4), lambda: (f"{year}-{int(year) + r.randint(1, 9)}", 4), lambda: (f"{r.randint(10, 999)} {n(3)} {n(3)}", 4), lambda: (f"{n(2)} {n(2)}", 4),
        lambda: (f"978-{n(1)}-{n(3)}-{n(5)}-{n(1)}", 4), lambda: (n(r.choice([13, 14, 15, 16, 18])), 4), lambda: (n(10), 4), lambda: (f"{n(2)}.{n(2)}.{n(2)}", 4), lambda: (f"{n(3)}-{n(4)}", 4), lambda: (f"{word()} at {word()}.{word().capitalize()}", 4), lambda: (f"{word()} at {word()}.", 4), lambda: (f"{n(4)}/{n(2)}", 4),
        lambda: (grouped(n(16), r.choice([".", "_", "/"])), 4), lambda: (f"{n(3)}.{n(3)}", 4), lambda: (f"{n(2)} {n(3)} {n(4)} {n(2)}", 4),
    ]
    positive = r.random() < 0.5
    s, kind = r.choice(good if positive else bad)()
    cue = r.choice(CUES[kind]) + r.choice(["", ":", " is", " at"]) + " " if r.random() < (0.5 if positive else 0.35) else ""
    left, right = r.choice(contexts), r.choice(contexts)
    left = left[-60:].rsplit(" ", 1)[0] + r.choice([" ", " ", ". "])
    text = left + cue + s + r.choice([" ", ". ", ", ", "\n"]) + right[:60]
    return text, len(left + cue), len(left + cue + s), kind if positive else -1


@dataclass
class Detector:
    trees: BoostedTrees
    thresholds: list

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(start, kind, end, score) of selected candidates, clear of base spans and of each other."""
        found = _clear(candidates(text), base)
        if not found:
            return []
        scores = np.concatenate([self.trees.probability(np.array([candidate_features(text, *c) for c in found[k : k + 1024]], float)) for k in range(0, len(found), 1024)])
        taken: list = []
        starts: list = []  # of what is taken, sorted, with the ends at the same places
        ends: list = []
        for k in np.argsort(-scores, kind="stable").tolist():
            s, kind, e, _ = found[k]
            if scores[k] < self.thresholds[kind]:
                continue
            at = bisect_left(starts, e)  # taken spans don't overlap, so only the last one that begins before this end can touch
            if not at or ends[at - 1] <= s:
                taken.append((s, kind, e, float(scores[k])))
                starts.insert(at, s)
                ends.insert(at, e)
        return taken

    def spans(self, text: str) -> list[tuple[int, int, int, bool, float]]:
        """(start, kind, end, base, score), sorted."""
        base = base_spans(text)
        return sorted([(s, k, e, True, 1.0) for s, k, e in base] + [(s, k, e, False, p) for s, k, e, p in self.added(text, base)])


def _clear(found, base):
    """Candidates that touch no base span, by one sweep."""
    if not found or not base:
        return found
    starts = np.array([s for s, _, _ in base])
    furthest = np.maximum.accumulate([e for _, _, e in base])
    at = np.searchsorted(starts, [c[2] for c in found], side="left") - 1
    return [c for c, k in zip(found, at) if k < 0 or furthest[k] <= c[0]]


def windows(text: str, most: int) -> list[tuple[str, str, str, int, bool]]:
    """(left, string, right, kind, whether it is personal data) of base spans, and of candidates that fail their kind's own check, at most so many, evenly chosen, and the text's middle (kind -1) for surroundings alone."""
    base = base_spans(text)
    found = [(s, k, e, True) for s, k, e in base]
    for s, k, e, _ in _clear(candidates(text), base):
        groups = re.findall(r"[0-9]+", text[s:e])
        if k == 2 and not luhn("".join(groups)) or k == 1 and ":" not in text[s:e] and not all(map(_octet, groups)):
            found.append((s, k, e, False))
    found = [found[i * len(found) // min(most, len(found))] for i in range(min(most, len(found)))]
    middle = len(text) // 2
    found.append((middle, -1, middle, False))
    return [(text[max(0, s - AROUND) : s], text[s:e], text[e : e + AROUND], k, good) for s, k, e, good in found]


#: Signs around spelled words.
_SIGNS = (("_", "_"), (" _", "_ "), ("-", "-"), (" <", "> "), ("<", ">"), (" /", "/ "), (" ", " "))
_BROAD = {narrow: wide for wide, narrow in _NARROW.items() if chr(narrow) != "."}


def disguised(r: random.Random, s: str, kind: int) -> str:
    """A base span's own data in another way of writing, one that the base formats don't match."""
    digits = "".join(_DIGITS.findall(s))
    if r.random() < 0.1:
        return s.translate(_BROAD)
    if kind == 0:
        at, dot = r.choice([(" @ ", "."), ("@ ", " . "), (" [at] ", " [dot] "), ("[at]", "."), (" (at) ", " (dot) "), ("(at)", "."), (" at ", " dot "), (" AT ", " DOT "), ("(@)", "."), (" {at} ", " {dot} "), (" at ", ".")])
        if r.random() < 0.3:
            left, right = r.choice(_SIGNS)
            at, dot = f"{left}{r.choice(['at', 'AT', 'At'])}{right}", f"{left}{r.choice(['dot', 'DOT', 'Dot'])}{right}"
        local, _, domain = s.partition("@")
        return (local.replace(".", dot) if r.random() < 0.3 and dot.strip(" .") else local) + at + domain.replace(".", dot)
    if kind == 1:
        return s.replace(".", r.choice(["[.]", "(.)", "[dot]", " (dot) ", " dot ", ". "]))
    if kind == 2:
        return r.choice([".", "_", "/", " - ", ", ", " / "]).join(digits[k : k + 4] for k in range(0, len(digits), 4))
    tail = digits[-10:]
    a, b, c = tail[:-7], tail[-7:-4], tail[-4:]
    return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"0{a} {b} {c}", f"00{digits[:-10]} {a} {b} {c}", f"00{digits}", f"{a}/{b}/{c}", *(r.choice([" ", "-", ".", "/"]).join(digits[k : k + n] for k in range(0, len(digits), n)) for n in (2, 3))])


def example(r: random.Random, known: list, contexts: list[str]) -> tuple[str, int, int, int]:
    """A text with one string in it that is known or drawn, as ``draw`` gives it."""
    if known and r.random() < 0.5:
        left, s, right, kind, good = r.choice(known)
        if good:
            s = disguised(r, s, kind)
        return left + s + right, len(left), len(left + s), kind if good else -1
    return draw(r, contexts)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS, max_windows: int = MAX_WINDOWS, examples: int = EXAMPLES) -> Detector:
    """Trees and thresholds; what comes to the driver is at most ``max_docs * (max_windows + 1)`` spans with their surroundings."""

    def found(batches):
        for b in batches:
            rows = [w for t in b.column(0) for w in windows(t.as_py(), max_windows)]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["left", "s", "right", "kind", "good"])

    # ids first, so that no text but the chosen ones leaves its task
    texts = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0))
    chosen = texts.select((~F.col(text_col).rlike("[0-9@]")).alias("bare"), F.xxhash64(id_col).alias("h"), id_col).orderBy("bare", "h", id_col).limit(max_docs).select(id_col)
    texts = texts.join(F.broadcast(chosen), id_col, "left_semi").select(text_col)
    seen = sorted({tuple(w) for w in texts.mapInArrow(giving_back(found), "left string, s string, right string, kind int, good boolean").collect()})
    known, contexts = [w for w in seen if w[3] >= 0], [left + right for left, _, right, k, _ in seen if k < 0] or ["and so on as it was said before "]
    # examples for the thresholds come from spans that train no tree
    parts = [w for k, w in enumerate(known) if k % 4 == 0], [w for k, w in enumerate(known) if k % 4]
    r = random.Random(9)
    x, y, kinds, held = [], [], [], []
    for k in range(examples):
        text, start, end, kind = example(r, parts[bool(k % 4)], contexts)
        for c in candidates(text):
            if c[0] < end and start < c[2]:
                x.append(candidate_features(text, *c))
                y.append(float(c[:3] == (start, kind, end)))
                kinds.append(c[1])
                held.append(k % 4 == 0)
    x, y, kinds, held = np.array(x, float), np.array(y), np.array(kinds), np.array(held)
    trees = fit_trees(x[~held], y[~held], rounds=60, depth=4)
    return Detector(trees, calibrate(trees.probability(x[held]), y[held], kinds[held]))


def calibrate(scores: np.ndarray, y: np.ndarray, kinds: np.ndarray, precision: float = PRECISION) -> list[float]:
    """For each kind the least threshold, 0.5 or more, above which held-out precision is as wanted."""
    out = []
    for k in range(len(KINDS)):
        s, t = scores[kinds == k], y[kinds == k]
        order = np.argsort(-s)
        good = np.cumsum(t[order]) / np.arange(1, len(s) + 1)
        ok = np.nonzero(good >= precision)[0]
        out.append(max(0.5, float(s[order][ok[-1]])) if len(ok) else 2.0)
    return out


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"


def detect(docs: DataFrame, model: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, spans`` for each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "base": f, "score": p} for s, k, e, f, p in model.spans(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, shape)], names=[id_col, "spans"])

    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(giving_back(run), f"`{id_col}` {kind}, spans {SPANS}")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans in their order, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact_text(text: str, spans) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for s, k, e, *_ in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redacted(model: Detector, text: Column) -> Column:
    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else redact_text(t, model.spans(t)))

    return redact(text)
