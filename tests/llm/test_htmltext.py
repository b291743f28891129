"""Main texts of the tables' pages and of hand-written ones."""

import html
import re

import numpy as np
import pytest

from tessera.llm import htmltext
from tessera.llm.queries import op3_html_text


def plain(page):
    """The tables' pages have one article of simple blocks: cut it out and split it."""
    body = re.search(r"<article>(.*?)</article>", page or "", re.S)
    if not body:
        return ""
    blocks = re.split(r"</?(?:p|h1)>", body[1].replace("<br>", " "))
    texts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in blocks]
    return "\n\n".join(t for t in texts if t)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_plain_extraction(spark, folder):
    got = {r.page_id: r for r in op3_html_text(spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == plain(p.html)
        assert got[p.page_id].n_chars == len(plain(p.html)) and got[p.page_id].url == p.url


@pytest.mark.parametrize("tag", ["div", "section", ""])
def test_pages_without_a_marked_article_give_the_same_texts(spark, tag):
    """Without the mark the content regions alone tell where the article is."""
    pages = [p.html for p in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if p.html]
    bare = [re.sub(r"<(/?)(?:article|main)[^>]*>", rf"<\1{tag}>" if tag else "", h) for h in pages]
    assert [htmltext.main_text(h) for h in bare] == [plain(h) for h in pages] and len(pages) > 200


LONG = "This sentence goes on for a while so that the line has a fair amount of text. "
PAGE = f"""<!doctype html><html><head><title>Site</title><script>var x = "<p>no</p>";</script></head><body>
<header><h1>Site name</h1><p>Welcome to the site, it is great.</p></header>
<nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav>
<div class="cookie-notice"><p>{LONG}We use cookies.</p></div>
<div id="content"><h2>Heading</h2><p>{LONG}<p>A &amp; B &lt;c&gt; &eacute;&#8212;d<br>next&nbsp;line</p>
<ul><li>one<li>two</ul><div class="ad-banner"><p>{LONG}Buy now!</p></div><p>Short.</p><form><p>Your name</p><input></form>
<blockquote>{LONG}</blockquote></div>
<aside><p>{LONG}Related.</p></aside><section id="comments"><div class="comment"><p>{LONG}I agree!</p></div></section>
<footer><p>{LONG}(c)</p></footer></body></html>"""


def test_article_without_furniture():
    one = LONG.strip()
    assert htmltext.main_text(PAGE).split("\n\n") == ["Heading", one, "A & B <c> é—d next line", "one", "two", "Short.", one]


def test_page_of_divs_without_marked_article():
    page = f"""<body><div class="header"><div class="logo">Site</div><p>{LONG}</p></div><div class="menu"><a href=1>A</a> <a href=2>B</a></div>
    <table><tr><td class="left sidebar"><p>{LONG}</p></td><td><h1>Title</h1><div class="header">Lead</div><p>{LONG}</p><p>Short.</p><p>{LONG}{LONG}</p></td></tr></table>
    <ol class="commentlist"><li><p>{LONG}</p></ol><div class="notice">{LONG}</div><div id="footer"><p>{LONG}</p></div></body>"""
    one = LONG.strip()
    assert htmltext.main_text(page).split("\n\n") == ["Title", one, "Short.", f"{one} {one}"]


def test_names_that_tell_of_other_elements_or_leave_nothing():
    assert htmltext.main_text(f"<div class='page has-sidebar no-ads'><p>{LONG}</p></div>") == LONG.strip()
    assert htmltext.main_text(f"<div id='login-page' class='search'><p>{LONG}</p><nav>x</nav></div>") == LONG.strip()


def test_headers_inside_an_article_stay():
    page = f"<header><h1>Site</h1></header><main><div class='header'><h1>Title</h1></div><p>{LONG}</p><div class='post-comments'><p>{LONG}</p></div></main>"
    assert htmltext.main_text(page).split("\n\n") == ["Title", LONG.strip()]


@pytest.mark.parametrize(
    "page,want",
    [
        ("<div id=content><div>{0}</div><div>{1}</div></div>", 2),
        ("<div id=content><div><p>{0}<p>{0}<p>{0}<p>{0}<p>{0}<p>{0}<p>{0}<p>{0}<p>{0}<p>{0}</div><div><p>{1}</div></div>", 11),
        ("<main><article><p>{0}<p>{0}</article><section><p>{1}</section></main>", 3),
        ("<body><article><p>{0}<p>{0}</article><article><p>{1}</article></body>", 3),
        ("<body><article><p>{0}<p>{0}</article><div><p>{1}</div></body>", 3),
    ],
)
def test_every_content_region_stays(page, want):
    one, other = LONG * 3, LONG.replace("sentence", "other") * 3
    got = htmltext.main_text(page.format(one, other)).split("\n\n")
    assert got[-1] == other.strip() and len(got) == want


@pytest.mark.parametrize("body", ["<pre>{0}</pre>", "<table><tr><td>{0}</table>", "<ul><li>{0}</ul>", "<blockquote>{0}</blockquote>"])
def test_one_long_block_does_not_hide_the_rest(body):
    page = "<nav><a href=1>Home</a></nav><div><h1>Title</h1>" + body.format(LONG * 20) + "<p>Short.</p></div>"
    assert htmltext.main_text(page).split("\n\n") == ["Title", (LONG * 20).strip(), "Short."]


@pytest.mark.parametrize("page,want", [(None, ""), ("", ""), ("   \n ", ""), ("just text", "just text"), ("<p>a<p>b", "a\n\nb"), ("<script>x()</script>", ""), ("<div><div><div>x", "x"), ("</p></div>x<b>y</b>", "xy"), ("<!-- c --><article>a <i>b</i>\n c</article>", "a b c")])
def test_small_pages(page, want):
    assert htmltext.main_text(page) == want


@pytest.mark.parametrize("tag", ["div", "span", "ul><li", "article", "b"])
def test_deep_pages_take_time_by_their_length(tag):
    import time

    began = time.process_time()
    page = "".join(f"<{tag}>{LONG if n % 20_000 == 0 else ''}" for n in range(100_000)) + "<p>end</li></p>" * 1000
    text = htmltext.main_text(page)
    assert text.count(LONG.strip()) == 5 and time.process_time() - began < 15


def test_smoothing_and_threshold():
    x = np.array([0.0, 0, 5, 5, 5, 0, 0])
    assert htmltext.smooth(np.ones(9)) == pytest.approx(np.ones(9))
    s = htmltext.smooth(x)
    assert s[3] == s.max() and s[0] < 1
    assert 0 < htmltext.threshold(x) < 5


def test_other_columns_nulls_and_long_pages(spark):
    big = "<article>" + "".join(f"<p>word{i} text</p>" for i in range(20_000)) + "</article>"
    df = spark.createDataFrame([(1, "u", None, "n"), (2, None, "", None), (3, "u", big, "n"), (3, "u", big, "n")], "page_id long, url string, html string, text string")
    rows = sorted(htmltext.extract(df).collect(), key=lambda r: r.page_id)
    assert [r.n_chars for r in rows[:2]] == [0, 0] and rows[2].text == rows[3].text and rows[2].text.count("\n\n") == 19_999
    assert htmltext.extract(df.limit(0)).count() == 0


def test_a_page_inside_one_form():
    inner = f"<div id='menu'><a href=1>A</a></div><div class='c'><h1>Title</h1><p>{LONG}<p>{LONG}<p>{LONG}</div><fieldset><p>Your mail</p></fieldset>"
    want = ["Title", *[LONG.strip()] * 3]
    for form in ("<form id='aspnetForm' action='/x'>", "<form>"):
        assert htmltext.main_text(f"<body>{form}{inner}</form></body>").split("\n\n") == want
    small = f"<body>{inner}<form><p>Write to us about anything you like at all.</p><p>Send</p></form></body>"
    assert htmltext.main_text(small).split("\n\n") == want


def test_classes_that_file_an_article_under_a_word():
    page = f"<body><div class='intro'><p>{LONG}</p></div><div class='post hentry tag-politics category-legal status-publish'><h1>Title</h1><p>{LONG}</p><p>{LONG}{LONG}</p></div><div class='tag-list'><p>{LONG}</p></div></body>"
    one = LONG.strip()
    assert htmltext.main_text(page).split("\n\n") == [one, "Title", one, f"{one} {one}"]


def test_wrappers_named_as_furniture_that_hold_the_page():
    page = f"<body><div class='intro'><p>Short intro.</p></div><div class='site-widget widget-post'><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div class='widget'><p>{LONG}</p></div></body>"
    one = LONG.strip()
    assert htmltext.main_text(page).split("\n\n")[-4:] == ["Title", one, one, one]
    comments = f"<body><article><h1>Title</h1><p>{LONG}</p></article><div class='comments'>" + f"<p>{LONG}</p>" * 9 + "</div></body>"
    assert htmltext.main_text(comments).split("\n\n") == ["Title", one]
    beside = f"<body><article><h1>Title</h1><p>{LONG}</p></article><div class='promo'>" + f"<p>{LONG}</p>" * 9 + "</div></body>"
    assert htmltext.main_text(beside).split("\n\n") == ["Title", one]


def test_paragraphs_of_an_article_with_telling_names():
    page = f"<article><h1>Title</h1><p class='legal'>The law says no.</p><p>{LONG}</p><p class='warning'>Mind the gap.</p><p class='ad'>Buy.</p><div class='warning'>Cookies.</div></article>"
    assert htmltext.main_text(page).split("\n\n") == ["Title", "The law says no.", LONG.strip(), "Mind the gap."]


def test_menus_and_copyright_without_names():
    links = "".join(f"<a href={n}>{w}</a> " for n, w in enumerate(("Home", "News", "Sport")))
    rows = "".join(f"<li><a href={n}>{w}</a>" for n, w in enumerate(("Home", "News", "Sport")))
    page = f"<body><div><div>{links}</div><ul>{rows}</ul><h1>Title</h1><p>{LONG}</p><p>See <a href=x>this</a> and <a href=y>that</a> too.</p><p><a href=z>Read the report</a></p><p>{LONG}</p><div>&copy; 2024 Example. All rights reserved.</div></div></body>"
    one = LONG.strip()
    assert htmltext.main_text(page).split("\n\n") == ["Title", one, "See this and that too.", "Read the report", one]


@pytest.mark.parametrize("broken", ["<a ", "<", "</a ", "<!--", "<!-- -- ", "<a href='", "<a href=\"x' ", "<div><p ", "<?x ", "<![x[ ", "&#", "<a b=<", "<script", "<!a "])
def test_broken_markup_takes_linear_time(broken):
    import time

    n = 300_000 // len(broken)
    began = time.time()
    for page in (broken * n, f"<p>{LONG}</p>" + broken * n, broken * n + f"><p>{LONG}</p>", f"<p>{LONG}</p>" + broken * n + "--><p>end</p>"):
        htmltext.main_text(page)
    assert time.time() - began < 30
