"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

A page becomes a tree of its block elements; runs of inline text inside one are
text leaves.  Each node has features of its subtree (text, density of tags and
links, sentence marks), of its attributes' tokens, its depth and its siblings.
Boosted trees give each node the odds that it holds main text.  Decoding picks
the set of kept nodes with the highest total log odds among the consistent
ones, in which a kept node's ancestors are kept and nothing below a dropped
node is: one pass up the tree and one down.

Training uses at most ``max_pages`` pages of the table (a documented bound), of
those of at most ``max_chars`` characters the ones whose hashes are least.  They
are taken whole, and their ``article`` elements serve as labels.  With them go
layouts drawn by rule, in which the main text stands in other elements and
beside the other parts that pages have.  Either source has half of the total
weight, so neither outvotes the other.

Nulls are empty pages; they and pages without main text give the empty text.
Repeated rows are extracted each on its own, very long pages as whole, and an
empty table gives an empty result, from trees of the layouts.  Other columns
are not read, whatever their names.  Nothing of a text is cut off.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.boosting import BoostedTrees, fit_trees

MAX_PAGES, MAX_CHARS, MAX_TAGS, LAYOUTS = 500, 16_384, 2_000, 500

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input button select option".split())
CLOSED_BY_BLOCK = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
BARRIER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
TAG_GROUPS = (("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "dt", "dd"), ("ul", "ol", "dl", "menu"), ("td", "th", "tr", "table", "tbody", "thead"), ("div",), ("section",), ("article", "main"), ("nav",), ("header", "footer"), ("aside",), ("form", "fieldset"), ("blockquote", "pre", "figure", "figcaption"), ("body", "html"), ("#text",))
TOKEN_GROUPS = (
    ("article", "content", "entry", "main", "post", "story", "text", "body", "page"),
    ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc"),
    ("ad", "ads", "advert", "advertisement", "banner", "promo", "promoted", "sponsor", "sponsored"),
    ("comment", "comments", "discussion", "replies", "reply", "respond", "thread"),
    ("consent", "cookie", "cookies", "gdpr", "notice", "notices", "alert", "modal", "popup", "overlay"),
    ("aside", "sidebar", "widget", "widgets", "rail"),
    ("related", "recommended", "share", "sharing", "social", "more", "tags", "popular"),
    ("footer", "header", "copyright", "masthead", "legal", "colophon", "top", "bottom"),
    ("form", "login", "newsletter", "search", "signup", "subscribe", "subscription"),
)
_TOKEN_GROUP = {t: k for k, ts in enumerate(TOKEN_GROUPS) for t in ts}
_TAG_GROUP = {t: k for k, ts in enumerate(TAG_GROUPS) for t in ts}
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[a-z]+")
_SENTENCE_END = re.compile(r"[.!?](?=\s|$)")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "text", "links", "inline", "depth")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children, self.text, self.links, self.inline = [], "", 0, 0
        self.depth = parent.depth + 1 if parent else 0


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)} if source.strip(" /\n\t\r") else {}


def parse(page: str) -> Node:
    """The tree of block elements; text leaves hold their text in one line."""
    root = Node("html", {}, None)
    path, open_at = [root], {}  # open elements, and the places of each tag among them
    here, pieces, inline, in_link, link_chars = root, [], 0, 0, 0
    at, n = 0, len(page)

    def flush():
        nonlocal pieces, inline, link_chars
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                leaf = Node("#text", {}, here)
                leaf.text, leaf.links, leaf.inline = text, link_chars, inline
                here.children.append(leaf)
        pieces, inline, link_chars = [], 0, 0

    def nearest(tags) -> int:
        """The place of the innermost open element of these tags; 0 if there is none."""
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def leave(place: int) -> Node:
        for node in path[place:]:
            open_at[node.tag].pop()
        del path[place:]
        return path[-1]

    def enter(node: Node) -> Node:
        node.parent.children.append(node)
        open_at.setdefault(node.tag, []).append(len(path))
        path.append(node)
        return node

    while at < n:
        m = _MARKUP.search(page, at)
        if m is None:
            pieces.append(page[at:])
            link_chars += in_link and n - at
            break
        if m.start() > at:
            pieces.append(page[at : m.start()])
            link_chars += in_link and m.start() - at
        at = m.end()
        if m[2] is None or not m[4]:  # a comment or declaration, or a tag that the page's end cuts off
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not closing:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
                pieces.append(" ")
            continue
        if tag in INLINE:
            if tag in ("br", "img", "input", "button", "select", "option"):
                pieces.append(" ")
            if not closing:
                inline += 1
            if tag == "a":
                in_link = 0 if closing else 1
            continue
        flush()
        in_link = 0
        if tag in VOID:
            continue
        if tag in ("html", "body"):
            if not closing and tag == "body":
                leave(1)
                here = enter(Node("body", _attributes(m[3]), root))
            continue
        if closing:
            here = leave(nearest((tag,)) or len(path))
            continue
        if tag in CLOSED_BY_BLOCK:
            place = nearest(("p", "td", "th", "table", "li"))
            if place and path[place].tag == "p":
                here = leave(place)
        if tag in SAME:
            place = nearest((*SAME[tag], *BARRIER.get(tag, ())))
            if place and path[place].tag in SAME[tag]:
                here = leave(place)
        here = enter(Node(tag, _attributes(m[3]), here))
    flush()
    return root


def ordered(root: Node) -> list[Node]:
    """All nodes in page order, without recursion: pages nest as deep as they like."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


N_TAGS, N_TOKENS, N_NUMBERS = len(TAG_GROUPS) + 1, len(TOKEN_GROUPS), 20
N_FEATURES = N_TAGS + 2 * N_TOKENS + N_NUMBERS


def _own_tokens(attrs: dict[str, str]) -> int:
    """Token groups among the attributes, as bits."""
    bits = 0
    for key in ("class", "id", "role", "itemprop", "aria-label"):
        if key in attrs:
            for t in _TOKEN.findall(attrs[key].lower()):
                if t in _TOKEN_GROUP:
                    bits |= 1 << _TOKEN_GROUP[t]
    return bits


def node_rows(nodes: list[Node]) -> list[tuple]:
    """For each node of a page in page order: tag groups and token groups as bits, then numbers."""
    n = len(nodes)
    place = {id(x): k for k, x in enumerate(nodes)}
    ups = [place[id(x.parent)] if x.parent is not None else 0 for x in nodes]
    chars, words, links, ends, tags, commas, leaves = ([0] * n for _ in range(7))
    for k in range(n - 1, -1, -1):
        x = nodes[k]
        t = x.text
        if t:
            chars[k] += len(t)
            words[k] += t.count(" ") + 1
            links[k] += min(x.links, len(t))
            ends[k] += len(_SENTENCE_END.findall(t))
            commas[k] += t.count(",")
            leaves[k] += 1
        tags[k] += 1 + x.inline
        if k:
            up = ups[k]
            chars[up] += chars[k]
            words[up] += words[k]
            links[up] += links[k]
            ends[up] += ends[k]
            tags[up] += tags[k]
            commas[up] += commas[k]
            leaves[up] += leaves[k]
    sib = [(0, 0, 0, 0, 0)] * n
    for x in nodes:
        if x.children:
            m, same, sizes = len(x.children), Counter(c.tag for c in x.children), [chars[place[id(c)]] for c in x.children]
            for j, c in enumerate(x.children):
                sib[place[id(c)]] = j, m, same[c.tag], sizes[j - 1] if j else 0, sizes[j + 1] if j + 1 < m else 0
    total, log, out = max(1, chars[0]), math.log1p, []
    own, above = [0] * n, [0] * n
    for k, x in enumerate(nodes):
        up, group = ups[k], x.parent if x.tag == "#text" else x
        tag = 1 << _TAG_GROUP.get(x.tag, N_TAGS - 1)
        if group is not x:
            tag |= 1 << _TAG_GROUP.get(group.tag, N_TAGS - 1)
        own[k] = _own_tokens(group.attrs) if group.attrs else 0
        above[k] = own[up] | above[up] if k else 0
        c, w, t = chars[k], max(1, words[k]), tags[k]
        j, m, same, before, after = sib[k]
        out.append((
            tag, own[k], above[k], log(c), log(words[k]), c / w, links[k] / max(1, c), t / w, ends[k] / w, commas[k] / w, c / max(1, leaves[k]), c / total, c / max(1, chars[up]),
            links[up] / max(1, chars[up]), log(leaves[k]), x.depth, j, m, j / max(1, m), same / max(1, m), log(before), log(after), k / n,
        ))
    return out


def matrix(rows: list[tuple]) -> np.ndarray:
    """Rows of ``node_rows`` with a column for each bit."""
    x = np.array(rows, float).reshape(-1, 3 + N_NUMBERS)
    bits = [(x[:, k].astype(np.int64)[:, None] >> np.arange(n) & 1).astype(float) for k, n in ((0, N_TAGS), (1, N_TOKENS), (2, N_TOKENS))]
    return np.concatenate([*bits, x[:, 3:]], axis=1)


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the consistent choice with the highest total log odds."""
    place = {id(x): k for k, x in enumerate(nodes)}
    best = odds.copy()
    for k in range(len(nodes) - 1, 0, -1):
        best[place[id(nodes[k].parent)]] += max(0.0, best[k])
    keep = np.zeros(len(nodes), bool)
    keep[0] = best[0] > 0
    for k in range(1, len(nodes)):
        keep[k] = best[k] > 0 and keep[place[id(nodes[k].parent)]]
    return keep


def main_texts(pages, model: BoostedTrees, batch_nodes: int = 20_000):
    """The main text of each page; pages are scored together up to about ``batch_nodes`` nodes."""

    def texts():
        odds, at = model.margin(matrix(rows)), 0
        for nodes in waiting:
            keep = decode(nodes, odds[at : at + len(nodes)])
            at += len(nodes)
            yield "\n\n".join(x.text for x, k in zip(nodes, keep) if k and x.text)

    waiting, rows = [], []
    for page in pages:
        nodes = ordered(parse(page))
        waiting.append(nodes)
        rows += node_rows(nodes)
        if len(rows) >= batch_nodes:
            yield from texts()
            waiting, rows = [], []
    if waiting:
        yield from texts()


def _labels(nodes: list[Node], wanted) -> np.ndarray:
    """1 for text leaves that ``wanted`` picks and all nodes above them."""
    place = {id(x): k for k, x in enumerate(nodes)}
    y = np.zeros(len(nodes))
    for k in range(len(nodes) - 1, -1, -1):
        if nodes[k].text and wanted(nodes[k]):
            y[k] = 1
        if y[k] and nodes[k].parent is not None:
            y[place[id(nodes[k].parent)]] = 1
    return y


def _below(node: Node, test) -> bool:
    while node is not None:
        if test(node):
            return True
        node = node.parent
    return False


def article_labels(nodes: list[Node]) -> np.ndarray:
    side = ("nav", "aside", "footer", "form")
    return _labels(nodes, lambda x: _below(x, lambda y: y.tag == "article") and not _below(x, lambda y: y.tag in side or any(_TOKEN_GROUP.get(t, 0) >= 1 for t in _TOKEN.findall((y.attrs.get("class", "") + " " + y.attrs.get("id", "")).lower()))))


def layout(seed: int) -> str:
    """A page drawn by rule; its main blocks carry the attribute ``data-main``, which is no feature."""
    r = random.Random(seed)
    sounds = [a + b for a in "b d f g k l m n p r s t v".split() for b in "a e i o u en or".split()]
    word = lambda: "".join(r.choice(sounds) for _ in range(r.randint(1, 4)))
    phrase = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize()
    sentence = lambda: phrase(4, 18).replace(" ", ", ", r.randint(0, 1)) + "."
    text = lambda a, b: " ".join(sentence() for _ in range(r.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{phrase(1, 4)}</a>'
    links = lambda a, b: "".join(f"<li>{link()}</li>" for _ in range(r.randint(a, b)))
    named = lambda *names: r.choice([f' class="{x}"' for x in names] + [f' id="{x}"' for x in names])

    def block():
        k = r.random()
        inner = text(1, 6) if r.random() < 0.8 else phrase(1, 3)
        if r.random() < 0.2:
            inner = f"<b>{inner}" + r.choice(["</b>", "<br>", "</b><br>"])
        if r.random() < 0.25:
            inner += f" <a href='/{word()}'>{phrase(1, 3)}</a> {text(1, 1)}"
        if k < 0.7:
            return f"<p data-main>{inner}" + r.choice(["</p>", "</p>", ""])
        if k < 0.8:
            return f"<h{r.randint(2, 4)} data-main>{phrase(2, 7)}</h2>"
        if k < 0.87:
            return "<ul>" + "".join(f"<li data-main>{text(1, 2)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if k < 0.92:
            return f"<blockquote data-main>{inner}</blockquote>"
        if k < 0.96:
            return f"<div{named('ad', 'advert', 'promo', 'sponsored')}>{text(1, 2)}</div>"
        return f"<pre data-main>{text(1, 3)}</pre>"

    def comments():
        each = "".join(f"<div{named('comment', 'reply')}><p>{text(1, 4)}</p></div>" for _ in range(r.randint(1, 6)))
        return f"<{(t := r.choice(['div', 'section']))}{named('comments', 'discussion', 'comments-area')}><h3>{phrase(1, 3)}</h3>{each}</{t}>"

    article = f"<h1 data-main>{phrase(1, 14)}</h1>" + "".join(block() for _ in range(r.randint(1, 12)))
    if r.random() < 0.25:
        article += comments()
    wrap = r.choice(['article', 'article', 'main', 'div class="content"', 'div id="main-content"', 'div class="post-body"', 'section class="story"', 'div class="entry text"', "div", "section"])
    article = f"<{wrap}>{article}</{wrap.split()[0]}>"
    extras = [
        f"<nav><ul>{links(3, 9)}</ul></nav>", f"<div{named('menu', 'navbar', 'breadcrumbs')}><ul>{links(2, 7)}</ul></div>", f"<header><a href='/'>{phrase(1, 3)}</a> <p>{phrase(2, 8)}</p></header>",
        f"<div{named('ad', 'ads', 'banner', 'sponsored', 'promo')}>{text(1, 3)}</div>", f"<div{named('cookie-notice', 'consent', 'gdpr', 'notice', 'popup')}><p>{text(1, 3)}</p><button>{word()}</button></div>",
        f"<form><label>{phrase(1, 3)}</label><input><p>{text(0, 2)}</p><button>{word()}</button></form>", f"<div{named('newsletter', 'subscribe', 'search')}><form><p>{text(1, 2)}</p><input></form></div>",
    ]
    after = [
        f"<aside><h3>{phrase(1, 3)}</h3><p>{text(1, 4)}</p></aside>", f"<div{named('sidebar', 'widget', 'right-rail')}><h3>{phrase(1, 3)}</h3><ul>{links(2, 8)}</ul><p>{text(0, 3)}</p></div>",
        f"<div{named('related', 'recommended', 'share', 'social')}>{phrase(1, 3)}<ul>{links(2, 6)}</ul></div>", comments(), *extras[3:],
    ]
    foot = r.choice([f"<footer>&copy; {phrase(1, 3)} &middot; {text(1, 3)}</footer>", f"<div{named('footer', 'copyright')}>{text(1, 2)} {link()} {link()}</div>", ""])
    top = "".join(r.sample(extras, r.randint(0, 4)))
    end = "".join(r.sample(after, r.randint(0, 4)))
    body = top + article + end if r.random() < 0.8 else top + end + article
    if r.random() < 0.3:
        body = f'<div class="{r.choice(["page", "wrapper", "container"])}">{body}</div>'
    return f"<html><head><title>{phrase(2, 8)}</title><style>p{{}}</style></head><body>{body}{foot}</body></html>"


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = MAX_PAGES, max_chars: int = MAX_CHARS, max_tags: int = MAX_TAGS, layouts: int = LAYOUTS) -> BoostedTrees:
    """Trees from the features of a bounded sample's nodes; features are made where the pages are.

    The sample's rows are put in an order of their own before training, so the model doesn't depend on partitions.
    """

    def packed(key, page, wanted):
        nodes = ordered(parse(page))
        return key, matrix(node_rows(nodes)).tobytes(), wanted(nodes).tobytes()

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found) if found else [[]] * 3, (pa.int64(), pa.binary(), pa.binary()))], names=["key", "x", "y"])

    def rows(batches):
        for b in batches:
            yield batch([packed(k.as_py(), t.as_py(), article_labels) for k, t in zip(b.column(0), b.column(1))])

    def drawn_rows(batches):
        for b in batches:
            yield batch([packed(k, layout(k), lambda nodes: _labels(nodes, lambda n: _below(n, lambda up: "data-main" in up.attrs))) for k in b.column(0).to_pylist()])

    def gathered(source, of):
        found = sorted((r.key, bytes(r.x), bytes(r.y)) for r in source.mapInArrow(of, "key long, x binary, y binary").collect())
        x = np.frombuffer(b"".join(r[1] for r in found)).reshape(-1, N_FEATURES)
        return x, np.frombuffer(b"".join(r[2] for r in found))

    spark = pages.sparkSession
    fits = F.col(id_col).isNotNull() & F.contains(F.col(html_col), F.lit("<article")) & (F.length(html_col) <= max_chars) & (F.length(html_col) - F.length(F.replace(html_col, F.lit("<"), F.lit(""))) <= max_tags)
    key = F.xxhash64(F.col(id_col), F.col(html_col))
    # keys first, so that no page but the chosen ones leaves its task
    chosen = pages.where(fits).select(key.alias("key")).distinct().orderBy("key").limit(max_pages)
    sample = pages.where(fits).select(key.alias("key"), F.col(html_col).alias("html")).join(F.broadcast(chosen), "key", "left_semi").dropDuplicates(["key"])
    (x, y), (x2, y2) = gathered(sample, rows), gathered(spark.range(0, layouts, 1, 8), drawn_rows)
    n, m = len(y), len(y2)
    weights = np.concatenate([np.full(n, (n + m) / (2 * n) if m else 1.0) if n else np.zeros(0), np.full(m, (n + m) / (2 * m) if n else 1.0) if m else np.zeros(0)])
    return fit_trees(np.concatenate([x, x2]), np.concatenate([y, y2]), rounds=60, depth=5, weights=weights)


def extract(pages: DataFrame, model: BoostedTrees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars`` for each row."""

    def run(batches):
        for b in batches:
            texts = list(main_texts((t.as_py() for t in b.column(2)), model))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    rows = pages.select(id_col, url_col, F.coalesce(html_col, F.lit("")).alias("html"))
    return rows.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
