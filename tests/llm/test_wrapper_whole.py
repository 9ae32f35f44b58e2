"""Main text: nothing of an article is lost, nothing beside it stays."""

import pytest

from runfold.llm import wrapper


def test_class_words_inside_an_article():
    inner = ('<h2 id="social-impact">Impact</h2><section id="related-work"><p>Work</p></section><div class="menu-of-the-day">Soup</div>'
             '<div class="related">More</div><div class="cookie-notice">Cookies</div><p class="notice">Note</p>')
    assert wrapper.main_text(f"<body><article>{inner}</article></body>", None) == "Impact Work Soup Note"
    assert wrapper.main_text('<body><main><p>Text</p><article class="comment">Nice!</article></main></body>', None) == "Text"


def test_deep_markup():
    deep = "<div>" * 300 + "<script>if (a < b) x()</script><nav>Menu</nav><section class='comments'>Nice!</section>text" + "</div>" * 300
    assert wrapper.main_text(f"<body><article>{deep}<p>after</p></article>out</body>", None) == "text after"
    assert wrapper.main_text(f"<body>{deep}<p>after</p></body>", wrapper.induce([deep] * 3)) == "text after"
    assert wrapper.main_text("<body><article>" + "<div>" * 300 + "text</article>out</body>", None) == "text"


def words(i, n=30):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_alignment_decides_in_articles():
    made = [f'<body><article><h2>News</h2><p>{words(i)}</p><div class="box"><p>Get our letter</p></div></article></body>' for i in range(4)]
    w = wrapper.induce(made)
    assert [wrapper.main_text(p, w) for p in made] == [f"News {words(i)}" for i in range(4)]
    assert wrapper.main_text(made[0], wrapper.induce([made[0]] * 4)) == f"News {words(0)} Get our letter"


def test_unmarked_copies_stay():
    story = f"<div class='top'>Top</div><div class='story'><h1>Title</h1><p>{words(1)}</p></div>"
    for n in (2, 8):
        made = [f"<body><div class='day'>{i}</div>{story}</body>" for i in range(n)]
        for p in (made, [made[0]] * n):
            assert wrapper.main_text(p[0], wrapper.induce(p)) == f"0 Top Title {words(1)}"
    assert wrapper.main_text("<body><p>One</p></body>", {"content": [], "template": ["/body/p\tOne"]}) == "One"


def test_all_slots_are_content():
    made = [f"<body><div class='first'><p>{words(i, 80)}</p></div><div class='second'><p>{words(-i, 20)}</p></div><b>Ad</b></body>" for i in range(1, 6)]
    w = wrapper.induce(made)
    assert wrapper.main_text(made[0], w).startswith(f"{words(1, 80)} {words(-1, 20)}")


def test_rare_layouts_have_a_template(spark):
    most = [f"<body><div class='a'><p>{words(i)}</p></div></body>" for i in range(300)]
    rare = [f"<body><div class='top'>Top</div><div class='b'><h1>T</h1><p>{words(-i)}</p></div></body>" for i in range(1, 4)]
    rows = [(i, f"http://h.x/{i}", p) for i, p in enumerate(most + rare)]
    out = wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), ["page_id"]).collect()
    got = {r.page_id: r.main_text for r in out}
    assert got == {i: words(i) if i < 300 else f"T {words(299 - i)}" for i in range(303)}


BODY = "The river runs past the hill. " * 8


@pytest.mark.parametrize("page, want", [
    (f'<body><div class="content-sidebar-wrap"><article><p>{BODY}</p></article></div></body>', BODY),
    (f'<body><div class="layout has-sidebar"><main><p>{BODY}</p></main><div class="sidebar">S</div></div></body>', BODY),
    (f'<body><div id="sidebar-wrap"><article>{BODY}</article></div></body>', BODY),
    ('<body><article class="news social-policy">Main</article><article class="teaser">T</article></body>', "Main T"),
    (f'<body><h2 id="social-impact">Impact</h2><section id="related-work">Work</section><p>{BODY}</p></body>', f"Impact Work {BODY}"),
    (f'<body><div class="site-footer">F</div><div class="sidebar-left">S</div><span class="cookie-notice">C</span><p>{BODY}</p></body>', BODY),
    (f'<body><div class="page-wrapper widget-area"><p>{BODY}</p></div><div class="main-navigation">N</div></body>', BODY),
    (f'<body><article>{BODY}</article><div class="comments"><article>first!</article></div></body>', BODY),
    (f'<body><article>{BODY}<article class="comment">first!</article></article></body>', BODY),
])
def test_classes_on_what_holds_the_text(page, want):
    assert wrapper.main_text(page, None) == " ".join(want.split())
