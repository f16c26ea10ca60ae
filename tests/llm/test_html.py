import html as entities
import re
from collections import Counter, defaultdict
from math import log

import pytest

from genoweave.llm import html as H
from genoweave.llm.html import blocks_of, extract, op12_site_style_tree, style_tree, text_of


def text(page):
    return text_of(page, frozenset())[0]


def test_supplied_pages(spark, sf_dir):
    """The generated pages hold their text in one article of plain paragraphs."""
    rows = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op12_site_style_tree(spark, sf_dir).collect()
    assert sorted(r.page_id for r in got) == sorted(rows)
    for r in got:
        page = rows[r.page_id].html
        inside = re.sub("</?b>", "", page[page.index("<article>") + 9 : page.index("</article>")])
        blocks = (" ".join(entities.unescape(x).split()) for x in re.split("<[^>]*>", inside))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == rows[r.page_id].url


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b</p>c", "a\nb\nc"), ("<p>a\n \t b<br>c</p>", "a b c"),
    ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", "a\nb\nc\nd"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<p>x <b>y</b><i>z</i>&#x41;&lt;p&gt;&nbsp;&eacute</p>", "x yzA<p> é"), ("<!-- <p>no</p> --><p>yes<!-- a > b -->!</p>", "yes!"),
    ("<script>var a='</p>';<p>no</p></script><style>p{}</style><p>yes", "yes"), ("<p title='a > b' data-x=\"<p>\">t</p>", "t"), ("a < b and <3 c", "a < b and <3 c"),
    ("<head><title>no</title><p>body begins", "body begins"), ("<html><head><meta charset=u><body class=ad><p>x", "x"), ("</div></p><p>x</b></section>y", "xy"),
    ("<nav>m</nav><header><h1>site</h1></header><main><article><header><h1>t</h1></header><p>x</p><footer>by</footer></article><aside>s</aside></main><footer>f</footer>", "t\nx"),
    ("<div class='page with-sidebar'><article><p>x</p><div class=share-buttons>s</div><section id=comments><article class=comment>c</article></section></article></div>", "x"),
    ("<div class='cookie-banner'>c</div><div id=mainMenu>m</div><div role=navigation>n</div><form><p>f</form><p>x <span class='ad'>buy</span>y</p>", "x y"),
    ("<div>a<b>b<div>c</div>d</b>e</div>", "a\nb\nc\nd\ne"), ("<p>é 漢 \U0001f600</p>", "é 漢 \U0001f600"), ("<article></article><p>x", "x"), ("<p>a<script>", "a"), ("<p>a<!-- b", "a"),
])
def test_markup(page, want):
    assert text(page) == want


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "x" + "<p>y" * 10
    assert text(deep) == "\n".join("x" + "y" * 10)
    assert max(n[3] for n in blocks_of(deep)[1]) <= H.DEPTH
    assert text("<p>" + "word " * 200_000) == ("word " * 200_000).strip()
    assert text("<b>" * 5000 + "x") == "x"


def site(n, host="h.example", same=()):
    pages = []
    for i in range(n):
        body = f"<div><div><a>Home</a> <a>News</a></div><div class=b><h1>Title {i}</h1><p>Text of {i * 7}.</p><p>More {i} text</p></div><div>All rights kept {2020}</div></div>"
        pages.append((i, f"https://{host}:80/{i}", body))
    return pages + list(same)


def test_tree_removes_what_a_site_repeats(spark):
    rows = site(12, same=[(90, "http://u@H.example/x", site(1)[0][2]), (91, None, None), (92, "odd", "<div>alone</div>")])
    rows += [(200 + i, "http://two.example/", site(2)[i][2]) for i in range(2)]
    df = spark.createDataFrame([(*r, "e", 5) for r in rows], "page_id long, url string, html string, text string, of_host int").repartition(3)
    got = {r.page_id: r for r in extract(df).collect()}
    assert set(got) == {r[0] for r in rows} and {r.of_host for r in got.values()} == {5}
    for i in range(12):
        assert (got[i].text, got[i].n_removed) == (f"Title {i}\nText of {i * 7}.\nMore {i} text", 2)
    assert got[90].text == got[0].text and got[91].text == "" and got[92].text == "alone"
    assert got[200].text.startswith("Home News\nTitle 0")  # two pages are too few to judge a site by


def test_both_ways_of_removal_agree(spark, monkeypatch):
    df = spark.createDataFrame(site(9), "page_id long, url string, html string")
    want = sorted(map(tuple, extract(df).collect()))
    monkeypatch.setattr(H, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, extract(df).collect())) == want


def test_copies_of_an_article_stay(spark):
    page = "<body><nav>m {}</nav><article><h1>t</h1><p>same text</p></article></body>"
    df = spark.createDataFrame([(i, "http://c.example/", page.format(i)) for i in range(20)], "page_id long, url string, html string")
    assert {r.text for r in extract(df).collect()} == {"t\nsame text"}
    plain = spark.createDataFrame([(i, "http://d.example/", f"<div title={i}>only this</div>") for i in range(20)], "page_id long, url string, html string")
    assert {r.text for r in extract(plain).collect()} == {"only this"}


def test_importances_against_a_plain_tree(spark):
    """Composite importances by recursion over one dictionary."""
    rows = site(7) + [(50 + i, "http://h.example/", f"<div><p>x{i % 2}</p><ul><li>a<li>b{i}</ul></div>") for i in range(5)]
    values, within = defaultdict(Counter), {}
    for page in {r[2] for r in rows}:
        for node, style, value, _, kids in blocks_of(page)[1]:
            values[node][value, kids] += 1
            within[node] = style

    def importance(node):
        c = list(values[node].values())
        m = sum(c)
        own = 1 - sum(x * log(x) for x in c) / (m * log(m)) if m > 1 else 1.0
        inner = {k: n for k, n in values[node].items() if k[1]}
        if not inner:
            return own
        lacks = sum(n * sum(1 - importance(x) for x, s in within.items() if s == style) / kids for (style, kids), n in inner.items())
        w = H.DECAY ** len(inner)
        return (1 - w) * own + w * (1 - lacks / m)

    df = spark.createDataFrame([(1, i, r[2]) for i, r in enumerate(rows)], "host long, page long, html string")
    got = {r.node: r.importance for r in style_tree(df).collect()}
    assert set(got) == set(values) and all(abs(got[n] - importance(n)) < 1e-9 for n in got)


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).columns == ["page_id", "url", "text", "n_removed"]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
