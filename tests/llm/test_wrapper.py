"""Main text extraction: the given pages by hand, tree matching by enumeration."""

import html
import itertools
import random
import re

from runfold.llm import wrapper
from tests.conftest import SF_SMALL


def article_by_hand(page):
    """The given pages have one article, closed or cut off, of headings and paragraphs."""
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)
    inner = re.sub(r"</?(?:p|h[1-6]|br|div|li|ul)\b[^>]*>", " ", re.sub(r"<!--.*?-->", "", m[1] if m else "", flags=re.S))
    inner = re.sub(r"<[^>]*>", "", inner)
    inner = re.sub(r"</?[a-zA-Z][^>]*\Z", "", inner)
    return " ".join(html.unescape(inner).split())


def test_query_by_hand(spark):
    import __spark_entry__ as e
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    out = e.queries()["op6_main_text"](spark, SF_SMALL).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r.text == article_by_hand(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def nested(rng, depth):
    s = wrapper.Shape(rng.choice("ab"))
    if depth:
        for _ in range(rng.randrange(4)):
            s.children.append(nested(rng, depth - 1))
    return s


def by_enumeration(a, b):
    if a.label != b.label:
        return 0
    best = 0
    for k in range(min(len(a.children), len(b.children)) + 1):
        for x in itertools.combinations(a.children, k):
            for y in itertools.combinations(b.children, k):
                best = max(best, sum(by_enumeration(p, q) for p, q in zip(x, y)))
    return best + 1


def test_tree_matching_by_enumeration():
    rng = random.Random(2)
    for _ in range(150):
        a, b = nested(rng, 2), nested(rng, 2)
        assert wrapper.matching(a, b)[0] == by_enumeration(a, b)


CHROME = """<header><h1>Site</h1></header><nav><a href="/x">One</a></nav><div class="cookie-notice">We use cookies</div>
<div id="sidebar">Side</div><div class="ad">Buy</div><form>Name <input></form>"""


def page(i, article=True):
    rng = random.Random(i)
    paras = [" ".join(rng.choice(["sun", "moon", "river", "hill", "tree", "a&amp;b"]) for _ in range(30)) for _ in range(4 + i % 3)]
    inner = f"<h2>Title {i}</h2>" + "".join(f"<p>{p}\n  <b>bo</b>ld" for p in paras)
    body = f"<article>{inner}</article>" if article else f'<div class="story">{inner}</div>'
    want = " ".join([f"Title {i}", *(html.unescape(p) + " bold" for p in paras)])
    return (f'<html><head><title>t</title><style>p{{}}</style></head><body>{CHROME}<div class="wrap"><div class="tag">Read more stories here</div>{body}</div>'
            f'<section id="comments"><article class="comment"><p>Nice!</p></article></section><footer>(c)</footer><script>if(a<b)"</p>"</script></body></html>'), want


def test_article_and_template(spark):
    for article in (True, False):
        made = [page(i, article) for i in range(10)]
        w = wrapper.induce([p for p, _ in made[:8]])
        for p, want in made:
            assert wrapper.main_text(p, w) == want
    assert "story" in w["content"][-1] and not any("Title" in t for t in w["template"])


def test_copies_of_an_article_stay():
    p, want = page(3)
    assert wrapper.main_text(p, wrapper.induce([p] * 8)) == want
    p, want = page(3, article=False)
    assert wrapper.main_text(p, wrapper.induce([p])).endswith(want)


def test_broken_pages():
    w = None
    assert wrapper.main_text("<article><p>one<p>two &am", w) == "one two &am"
    assert wrapper.main_text("<article><p>one<p>two</p><p cla", w) == "one two"
    assert wrapper.main_text("<article>a<!-- <p>no</p> -->b<br>c&nbsp;d &lt;e&#233;&quot</article>tail", w) == 'ab c d <eé"'
    assert wrapper.main_text("plain 1 < 2 text", w) == "plain 1 < 2 text"
    assert wrapper.main_text("<div><p>x</div><p>y<script>z", w) == "x y"
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert wrapper.main_text(f"<body>{deep}</body>", None) == "deep"
    assert wrapper.main_text(f"<body><article>{deep}<p>after</p></article>out</body>", wrapper.induce([deep] * 3)) == "deep after"


def test_edges(spark):
    schema = "page_id long, url string, html string, host string, text string"
    p, want = page(1)
    rows = [(1, None, p, "x", "y"), (2, "http://a.b/c", None, None, None), (3, "broken", "", None, None),
            (None, "http://a.b/c", p, None, None), (5, "http://a.b/c", p, None, None), (5, "http://a.b/c", p, None, None)]
    out = wrapper.extract(spark.createDataFrame(rows, schema), ["page_id", "text"]).collect()
    got = sorted((r.page_id or 0, r.main_text) for r in out)
    assert got == [(0, want), (1, want), (2, ""), (3, ""), (5, want), (5, want)]
    assert wrapper.extract(spark.createDataFrame([], schema), ["page_id"]).count() == 0
