"""Stored pages to flat records.  Fetching isn't part of the library: pages are a table."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Where a listing page keeps its parts (class names and ids), and the words of damage categories in order.
PRICE, TITLE, LOCATION, DETAILS, INFO, DESCRIPTION, FEE, DAMAGE = "desktop-information-price", "product-name-container", "product-location", "product-properties-details", "tab-car-information", "tab-description", "tramer-info", "car-damage-info"
ITEM, KEY, VALUE, SECTION, DAMAGE_ITEM, SHORT = "property-item", "property-key", "property-value", "tab-content-car-information-container", "car-damage-info-item", "KısaBilgi"
CATEGORIES = ("Değişmiş", "Lokal", "Boyalı")


class Element:
    __slots__ = ("tag", "attrs", "items")

    def __init__(self, tag, attrs):
        self.tag, self.attrs, self.items = tag, attrs, []

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.items))
        return "".join(out)

    def find_all(self, test):
        stack = list(reversed(self.items))
        while stack:
            x = stack.pop()
            if not isinstance(x, str):
                if test(x):
                    yield x
                stack.extend(reversed(x.items))

    def by_class(self, name, tag=None):
        return self.find_all(lambda x: name in x.attrs.get("class", "").split() and tag in (None, x.tag))

    def by_tag(self, tag):
        return self.find_all(lambda x: x.tag == tag)

    def inner(self) -> str:
        """The element's content as markup."""
        out, stack = [], list(reversed(self.items))
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                out.append(x[0])
            elif isinstance(x, str):
                out.append(html.escape(x, quote=False))
            else:
                out.append(f"<{x.tag}" + "".join(f' {k}="{html.escape(v)}"' for k, v in x.attrs.items()) + ">")
                stack += [(f"</{x.tag}>" if x.tag not in VOID else "",), *reversed(x.items)]
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        x = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].items.append(x)
        if tag not in VOID:
            self.open.append(x)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].items.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1].items.append(data)


_TAG = re.compile(r"(<[^>]*>)")
_PLAIN = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z][a-z-]*="[^"&<>]*")*)>|</([a-z][a-z0-9]*)>')
_PAIR = re.compile(r' ([a-z-]+)="([^"]*)"')
#: Elements whose content isn't markup, or not always.
RAW = frozenset("script style textarea title iframe noembed noframes noscript plaintext xmp svg math".split())
_MOST_TAGS = 10_000
_tags: dict[str, tuple | None] = {}


def _tag(text: str) -> tuple | None:
    """Name, attributes (None: an end tag) of a tag in the plainest way of writing; None for any other."""
    m = _PLAIN.fullmatch(text)
    if m is None or (m[1] or m[3]) in RAW:
        return None
    return (m[3], None) if m[3] else (m[1], dict(_PAIR.findall(m[2])))


def _plain_tree(page: str) -> Element | None:
    """The tree of a page whose tags are all plain, each text of a tag being read once; None if one isn't, so that the parser must read it."""
    root, is_tag = Element("", {}), False
    open_, items, known = [root], root.items, _tags
    for piece in _TAG.split(page):  # texts and tags by turns
        if not is_tag:
            is_tag = True
            if piece:
                if "<" in piece:
                    return None
                items.append(html.unescape(piece) if "&" in piece else piece)
            continue
        is_tag = False
        try:
            found = known[piece]
        except KeyError:
            if len(known) >= _MOST_TAGS:
                known.clear()
            found = known[piece] = _tag(piece)
        if found is None:
            return None
        name, attrs = found
        if attrs is not None:
            x = Element(name, attrs)
            items.append(x)
            if name not in VOID:
                open_.append(x)
                items = x.items
        elif open_[-1].tag == name and len(open_) > 1:
            open_.pop()
            items = open_[-1].items
        else:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == name:
                    del open_[k:]
                    items = open_[-1].items
                    break
    return root


def tree(page: str) -> Element:
    plain = _plain_tree(page)
    if plain is not None:
        return plain
    b = _Builder()
    b.feed(page)
    b.close()
    return b.root


def record(page: str) -> dict:
    """Title, price, location, labelled attributes, damage entries and fee of a listing page; what isn't there is null or empty."""
    root, by_class, by_id = tree(page), {}, {}
    stack = [root]
    while stack:
        x = stack.pop()
        if x.attrs:
            for c in x.attrs.get("class", "").split():
                by_class.setdefault(c, x)
                by_class.setdefault((c, x.tag), x)
            if "id" in x.attrs:
                by_id.setdefault(x.attrs["id"], x)
        stack += [i for i in reversed(x.items) if i.__class__ is Element]
    first = lambda found: next(iter(found), None)
    text = lambda x: x.text().strip() if x is not None else None
    place = by_class.get(LOCATION)
    spans = list(place.by_tag("span")) if place else []
    attributes = {}
    box = by_class.get((DETAILS, "div"))
    for item in box.by_class(ITEM, "div") if box else ():
        k, v = text(first(item.by_class(KEY, "div"))), text(first(item.by_class(VALUE, "div")))
        if k is not None:
            attributes[f"{SHORT} - {k}"] = v
    info = by_id.get(INFO)
    for section in info.by_class(SECTION, "div") if info else ():
        name = text(first(section.by_tag("h3")))
        for li in section.by_tag("li"):
            k, v = text(first(li.by_class(KEY, "span"))), text(first(li.by_class(VALUE, "span")))
            if k is not None:
                attributes[f"{name} - {k}"] = v
    description = by_id.get(DESCRIPTION)
    fee_box = by_class.get((FEE, "div"))
    note = text(first(fee_box.by_tag("p"))) if fee_box else None
    damage = []
    damage_box = by_class.get((DAMAGE, "div"))
    for item in damage_box.by_class(DAMAGE_ITEM, "div") if damage_box else ():
        category = text(first(item.by_tag("p"))) or ""
        damage += [f"{t}: {category}" for t in (text(li) for li in item.by_tag("li")) if t != "-"]
    return {
        "price": text(by_class.get(PRICE)), "title": text(by_class.get(TITLE)), "location": text(spans[-1] if spans else place), "attributes": list(attributes.items()), "description": description.inner() if description else None,
        "note": note, "fee_text": text(first(fee_box.by_class(VALUE, "span"))) if fee_box else None, "damage": damage,
    }


RECORD = "price string, title string, location string, attributes map<string,string>, description string, note string, fee_text string, damage array<string>"
_RECORD = [("price", pa.string()), ("title", pa.string()), ("location", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("description", pa.string()), ("note", pa.string()), ("fee_text", pa.string()), ("damage", pa.list_(pa.string()))]


def extract_records(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One record for each page, in Arrow batches."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [record(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[n] for r in found], t) for n, t in _RECORD)], names=[id_col, *(n for n, _ in _RECORD)])

    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, {RECORD}")


def damage_counts(damage: str | Column = "damage") -> list[Column]:
    """Number of entries of each category; an entry counts for the first category whose word it holds."""
    entries, taken, out = F.col(damage) if isinstance(damage, str) else damage, [], []
    for name, word in zip(("count_changed", "count_local_painted", "count_painted"), CATEGORIES):
        earlier = tuple(taken)

        def test(x, word=word, earlier=earlier):
            category = F.substring_index(x, ": ", -1)
            ok = F.contains(category, F.lit(word))
            for w in earlier:
                ok = ok & ~F.contains(category, F.lit(w))
            return ok

        out.append(F.size(_filtered(entries, test)).alias(name))
        taken.append(word)
    return out


def _filtered(entries, test):
    return F.filter(entries, lambda x: test(x))


_SPACE = re.compile(r"\s+")


def visible_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col, text``: text nodes joined by one space, white space collapsed, lower case; scripts and styles have none."""
    kind = pages.schema[id_col].dataType.simpleString()

    def text(page):
        if page is None:
            return None
        out, stack = [], [tree(page)]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in ("script", "style"):
                stack.extend(reversed(x.items))
        return _SPACE.sub(" ", " ".join(out)).strip().lower()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text(t.as_py()) for t in b.column(1)], pa.string())], names=[id_col, "text"])

    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct absolute URLs of anchors; one that begins with a slash belongs to its page's host."""
    host = F.regexp_extract(url_col, r"^([a-z]+://[^/?#]+)", 1)
    found = pages.select(host.alias("host"), F.explode(F.regexp_extract_all(html_col, F.lit(r'<a [^>]*href="([^"]+)"'), F.lit(1))).alias("href"))
    return found.select(F.when(F.col("href").startswith("/"), F.concat("host", "href")).otherwise(F.col("href")).alias("url")).distinct()
