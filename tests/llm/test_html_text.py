"""Main text of pages: parsing, consistent decoding, pages with known text, held-out layouts."""

import numpy as np
import pytest

from plinth.llm import html_text as h

PAGE = "<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Alpha</a></li><li><a href='/b'>Beta</a></li></ul></nav><div class='ad'>Buy this now.</div>{}<footer>&copy; someone &middot; Words of a footer here.</footer></body></html>"
ARTICLE = "<article><h1>A title of the page</h1><p><b>First words, of a paragraph.<br>And more &amp; more of it.\n  Here.</b></p><p>Second one, with a <a href='/x'>link</a> in it. It goes on.<p>Third paragraph follows here, and ends.</article>"
TEXT = "A title of the page\n\nFirst words, of a paragraph. And more & more of it. Here.\n\nSecond one, with a link in it. It goes on.\n\nThird paragraph follows here, and ends."


def leaves(page):
    return [n.text for n in h.ordered(h.parse(page)) if n.text]


@pytest.mark.parametrize("page,want", [
    ("", []), ("plain &lt;text&gt;", ["plain <text>"]), ("<p>a<p>b", ["a", "b"]), ("a < b and c", ["a < b and c"]), ("<!-- x > y --><p>z</p>", ["z"]), ("<!-- open <p>z</p>", []), ("<script>if (a</b) '</p>'", []),
    ("<ul><li>one<li>two</ul>three", ["one", "two", "three"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("x<br>y<br/>z", ["x y z"]), ("<b>bo</b>ld", ["bold"]), ("<p>cut off<di", ["cut off"]), ("<p title='a > b'>c</p>", ["c"]),
    ("&eacute;&#233;&#xe9;&nbsp;&bogus;", ["ééé &bogus;"]), ("<textarea>no</textarea><p>yes</p>", ["yes"]), ("</p></div>stray", ["stray"]), ("<P CLASS=a>Up</P>", ["Up"]),
])
def test_parse(page, want):
    assert leaves(page) == want


def test_deep_pages_need_no_recursion():
    assert leaves("<div>" * 30_000 + "x") == ["x"]


def test_unclosed_elements_and_stray_ends_take_time_in_proportion():
    import time

    took = []
    for n in (20_000, 160_000):
        began = time.process_time()
        assert len(h.ordered(h.parse("<div>" * n + "x" + "</p>" * n + "</b></div>"))) == n + 2
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 1  # 8 in proportion, 64 with its square


def test_decoding_is_consistent_and_best():
    rng = np.random.default_rng(0)
    for seed in range(5):
        nodes = h.ordered(h.parse(h.layout(seed)))
        odds = rng.normal(size=len(nodes))
        keep = h.decode(nodes, odds)
        place = {id(n): k for k, n in enumerate(nodes)}
        assert all(not k or n.parent is None or keep[place[id(n.parent)]] for k, n in zip(keep, nodes))
        for _ in range(200):  # no consistent choice drawn at random is better
            other = np.zeros(len(nodes), bool)
            for k, n in enumerate(nodes):
                other[k] = rng.random() < 0.7 and (n.parent is None or other[place[id(n.parent)]])
            assert odds[other].sum() <= odds[keep].sum() + 1e-9


def test_extraction(spark):
    rows = [(k, f"u{k}", PAGE.format(ARTICLE.replace("title", f"title{k}"))) for k in range(80)]
    rows += [(900, "n", None), (901, None, ""), (902, "t", "<nav><a href=/x>Only</a></nav>"), (0, "u0", rows[0][2])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, text int")
    model = h.fit(df, max_pages=60, layouts=150)
    got = {r.page_id: r for r in h.extract(df, model).collect()}
    assert all(got[k].text == TEXT.replace("title", f"title{k}") and got[k].n_chars == len(got[k].text) for k in range(80))
    assert got[900].text == got[901].text == ""
    assert h.extract(df, model).count() == len(rows)
    assert h.extract(df.limit(0), model).count() == 0
    shares = []
    for seed in range(10_000, 10_080):
        nodes = h.ordered(h.parse(h.layout(seed)))
        y = h._labels(nodes, lambda n: h._below(n, lambda up: "data-main" in up.attrs)) > 0
        keep = h.decode(nodes, model.margin(h.matrix(h.node_rows(nodes))))
        n = np.array([len(x.text) for x in nodes])
        shares.append(2 * n[keep & y].sum() / max(1, n[keep].sum() + n[y].sum()))
    assert np.mean(shares) > 0.9


def test_model_does_not_depend_on_partitions(spark):
    """Whole pages of a sample chosen by hash, in an order of their own; pages past the bound train nothing."""
    rows = [(k, f"u{k}", PAGE.format(ARTICLE.replace("title", f"title{k}" * (1 + k % 3)))) for k in range(60)]
    rows += [(100, "long", PAGE.format("<article>" + "<p>Word.</p>" * 3000 + "</article>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    models = [h.fit(d, max_pages=40, layouts=40) for d in (df.repartition(1), df.repartition(13), df.where("page_id < 100"))]
    for m in models[1:]:
        assert all((a == b).all() for x, y in ((models[0].features, m.features), (models[0].cuts, m.cuts), (models[0].leaves, m.leaves)) for a, b in zip(x, y))
    assert h.fit(df.limit(0), layouts=40).features
