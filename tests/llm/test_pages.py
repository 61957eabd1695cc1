"""Pages: reading of odd HTML, importance against a plain model, extraction."""

from __future__ import annotations

import math
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessitura.llm import site_tree
from tessitura.llm.page_tree import Page, host_of

from .conftest import prose


def text_of(html, url=None):
    row = site_tree.tree_row(html, url)
    return site_tree.kept_text(*row[3:9], {}, site_tree.THRESHOLD)[0]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("   \n", ""), ("plain  text\n here", "plain text here"),
        ("<p>a &amp; b &#233;&nbsp;c &lt;i&gt; &unknown; &copy</p>", "a & b é c <i> &unknown; ©"),
        ("<p><b>one<br><p>two</b> more</p>three", "one\ntwo more\nthree"),
        ("<p>a<!-- <p>no --> b</p><!-- open", "a b"), ("a<script>if (a < b) '</p>'</script>b<style>p{}</style>c", "abc"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "a\nb\nc\nd\ne"), ("<table><tr><td>a<td>b<tr><th>c</table>", "a\nb\nc"),
        ("<div title='a > b' class=\"x\">in</div>", "in"), ("a < b and c<3 <", "a < b and c<3 <"), ("<p>in<em>line</em> <a href=x>link</a></p>", "inline link"),
        ("<head><title>T</title><meta x></head>body", "body"), ("<title>T<p>never closed", ""), ("</div></p>x</body></html>y", "x\ny"),
        ("<h1>a<h2>b</h2>c", "a\nb\nc"), ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"), ("<p>x</P><DIV>y</DIV>", "x\ny"), ("<pre>a\n  b</pre>", "a b"),
        ("<article><h1>t</h1><p>a</p><aside>n</aside><footer>f</footer></article><p>out</p>", "t\na"),
        ("<nav>n</nav><header>h</header><main><p>m</p></main><footer>f</footer>", "m"),
        ("<article><header><h1>t</h1></header><p>a</p></article>", "t\na"), ("<div class='cookie-notice'>c</div><p>a</p>", "a"), ("<div id=comments><p>c</p></div><p>a</p>", "a"),
        ("<div class='page has-sidebar'><div class='sidebarRight'>s</div><p>a</p></div>", "a"), ("<body class='nav'><p>a</p></body>", "a"),
        ("<form action=x><article><p>a</p><input value=v><button>b</button></article></form>", "a"), ("<form><label>Name</label><input></form><p>long enough text</p>", "long enough text"),
        ("<div class=comments><article class=x>c</article></div><article>a</article>", "a"), ("<div class='menu layout'><article>a</article></div>", "a"),
        ("<ul><li><a>one</a><li><a>two</a><li><a>three</a></ul><p>a <a>b</a></p>", "a b"), ("<article></article><p>x</p>", ""), ("<nav>only</nav>", ""),
        ("<div style='display:none'>x</div><div hidden>y</div><p>a</p>", "a"), ("<select><option>x</select><p>a", "a"), ("<svg><text>x</text></svg>a", "a"),
        ("<article><article class=reply>r</article><p>a</p></article>", "a"), ("a<iframe src=x></iframe>b", "ab"), ("İ<script>x</script>y", "İy"),
    ],
)
def test_text(html, text):
    assert text_of(html) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='a'>", "</div>", "<article>", "</article>", "<table><td>", "</table>", "<li>", "<b", "x", " y ", "&lt;", "<!--", "-->", "'", '"', ">", "<script>", "</script>", "<nav id=n>", "</nav>"]), max_size=30))
def test_any_tags(parts):
    html = "".join(parts)
    page = Page(html)
    assert all(up < k for k, up in enumerate(page.parent)) and all(o < len(page.parent) for _, o, _, _ in page.pieces)
    text = text_of(html, "http://h/")
    assert text == "\n".join(" ".join(line.split()) for line in text.split("\n") if line.strip())


def test_long_page():
    assert text_of("<div>" * 3_000 + "x" + "</div>" * 3_000) == "x"
    assert text_of("<article>" + "<p>word</p>" * 50_000) == "\n".join(["word"] * 50_000)
    assert len(text_of("<p " * 20_000 + ">x")) <= 20_000 * 3


@pytest.mark.parametrize(("url", "host"), [("http://A.b/c", "a.b"), ("https://u@h:8/x", "h"), ("//x/y", None), ("", None), (None, None), ("http:///x", None)])
def test_hosts(url, host):
    assert host_of(url) == host


def site(rng, host, n, copies=0):
    """Pages without telling names: a bar, an article of varying shape, a box of constant text."""
    bar, box = prose(rng, 6), prose(rng, 12)
    found = []
    for i in range(n):
        body = [prose(rng, rng.randrange(5, 30)) for _ in range(rng.randrange(1, 5))]
        found.append((f"http://{host}/{i}", f"<div>{bar}</div><div>{''.join(f'<p>{p}</p>' for p in body)}</div><div><p>{box}</p><p>{i} views</p></div>", "\n".join(body)))
    return found + found[:1] * copies


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, node string")


def model(rows, threshold=site_tree.THRESHOLD, least=site_tree.LEAST_PAGES):
    """The texts, from plain counts of pages."""
    trees = [site_tree.tree_row(h, u) for u, h in rows]
    held = defaultdict(set)
    for t in trees:
        for f, kind, value in zip(t[9], t[10], t[11]):
            held[t[2][f], kind, value].add(t[1])
    spread = defaultdict(lambda: ([], []))
    for (node, kind, _), found in held.items():
        spread[node][kind].append(len(found))
    known = {}
    for node, (texts, styles) in spread.items():
        m = sum(styles)
        if m >= least:
            entropy = -sum(c / m * math.log(c / m, m) for c in styles)
            spreads = [math.log(c, m) for c in texts for _ in range(c)]
            known[node] = (entropy, len(styles), 1 - sum(spreads) / len(spreads) if texts else 1.0)
    return [site_tree.kept_text(*t[3:9], {i: known[k] for i, k in enumerate(t[2]) if k in known}, threshold)[0] for t in trees]


@pytest.mark.parametrize("broadcast_bytes", [32_000_000, 0])
def test_extraction(spark, rng, broadcast_bytes):
    rows = site(rng, "a.example", 12, copies=30) + site(rng, "b.example", 8) + site(rng, "c.example", 1) + site(rng, "d.example", 2)
    given = [(u, h) for u, h, _ in rows] + [(None, "<p>x</p>"), ("http://a.example/n", None), ("http://a.example/e", ""), ("nohost", "<nav>n</nav><p>y</p>")]
    got = {r.page_id: r for r in site_tree.extraction_report(pages(spark, given), broadcast_bytes=broadcast_bytes).collect()}
    assert [got[i].text for i in range(len(given))] == model(given)
    assert all(r.n_chars == len(r.text) and r.url == given[i][0] for i, r in got.items())
    for i, (url, _, text) in enumerate(rows):
        if "/a." in url or "/b." in url:  # sites with enough pages: the bar and the box go, the article stays
            assert got[i].text == text
        else:
            assert text in got[i].text and len(got[i].text) > len(text)


def test_copies_keep_their_article(spark, rng):
    html = f"<article><p>{prose(rng, 20)}</p></article><div class=ad>%d</div>"
    given = [(f"http://a/{i}", html % i) for i in range(20)]
    assert {r.text for r in site_tree.extraction_report(pages(spark, given)).collect()} == {text_of(html % 1)} != {""}


def test_large_ids_beside_nulls(spark):
    frame = spark.createDataFrame([((1 << 60) + 1, "http://a/", "a"), (None, None, "b")], "page_id long, url string, html string").coalesce(1)
    assert {r.page_id for r in site_tree.extraction_report(frame).collect()} == {(1 << 60) + 1, None}


def test_columns_and_empty_table(spark):
    frame = pages(spark, [("http://h/", "<p>a</p>"), (None, None)]).withColumn("shape", F.lit(1)).withColumn("main", F.lit("old")).withColumn("tree", F.lit(2))
    got = {r.page_id: r for r in site_tree.main_text(frame).collect()}
    assert got[0].main.text == "a" and got[0].shape == 1 and got[0].tree == 2 and got[1].main.text == "" and set(got[0].asDict()) == set(frame.columns) - {"html"}
    assert site_tree.extraction_report(frame.limit(0)).count() == 0
