import html
import re
import time

import pytest

from gradeworks.llm import html_text

P = "A paragraph of prose that goes on for a while, with words and more words, about one thing or another. " * 3
TEXT = P.strip()


def article(page):
    """The blocks between the article tags, for pages whose article has only h1, p, b and br."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    blocks = (html.unescape(re.sub(r"<[^>]*>", " ", b)) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inner))
    return "\n".join(x for b in blocks if (x := " ".join(b.split())))


def test_pages_of_the_table(tables):
    pages = tables["pages"]
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == article(r["html"]) and got[r["page_id"]]["url"] == r["url"]


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain &amp; text &copy", "plain & text ©"), ("<body><article><p>cut of&", "cut of&"),
    ("<body><article><p>abc</p><p cla", "abc"), ("<p>a\n\t b <b>c</b>d<br>e</p>tail", "a b cd e\ntail"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<script>'<p>x</p>'</script><p>real<!-- <p>no</p> --></p><style>p{}</style>", "real"),
    (f"<body><div id=top><a href=x>Home</a> <a href=y>News</a></div><div class=wrap><div class=content><h1>T</h1><p>{P}<p>{P}</div>"
     f"<div class=sidebar><p>side</p></div></div><div class='comments'><p>{P}</p></div></body>", f"T\n{TEXT}\n{TEXT}"),
    (f"<header><h1>Site</h1></header><main><h1>T</h1><section><p>{P}<p>{P}</section><section><h2>S</h2><p>{P}</section></main>"
     "<footer>f</footer>", f"T\n{TEXT}\n{TEXT}\nS\n{TEXT}"),
    (f"<article><h1>T</h1><div><p>{P}<p>short.</div><form>x<input></form><div class='cookie-notice'>We use</div></article>"
     "<aside>more</aside>", f"T\n{TEXT}\nshort."),
    (f"<ul><li><a href=1>one</a><li><a href=2>two</a></ul><p>{P}", TEXT),
    (f"<div class='page with-sidebar no-comments'><p>{P}<p>{P}</div><div id=user-comments><p>{P}</div><div class='x ad-box'>buy</div>",
     f"{TEXT}\n{TEXT}"),
    ("<article><p>&lt;b&gt; &#233;&#x1F600;&nbsp;x</p><p hidden>no</p></article>", "<b> é😀 x"),
])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


LINKED = "".join(f"<li><a href=/{i}>Reference number {i} with its title</a>" for i in range(6))
REFERENCES = "\n".join(f"Reference number {i} with its title" for i in range(6))


@pytest.mark.parametrize(("page", "text"), [
    (f"<body><article><h1>T</h1><p>{P}<ul>{LINKED}</ul></article></body>", f"T\n{TEXT}\n{REFERENCES}"),
    (f"<body><div class='content sidebar-left'><p>{P}<p>{P}</div></body>", f"{TEXT}\n{TEXT}"),
    (f"<body><form action=x><input><div><p>{P}<p>{P}</div></form></body>", f"{TEXT}\n{TEXT}"),
    (f"<article><p>{P}<section id=responses><h2>Responses</h2><p>{P}</section></article>", f"{TEXT}\nResponses\n{TEXT}"),
    (f"<article><p>{P}<section id=social-history><h2>Social history</h2><p>{P}</section></article>", f"{TEXT}\nSocial history\n{TEXT}"),
    (f"<article><p>{P}<div class=related-work><p>{P}</div></article>", f"{TEXT}\n{TEXT}"),
    (f"<body><header><h1>Site</h1></header><article><header><h1>T</h1></header><p>{P}</article></body>", f"T\n{TEXT}"),
    (f"<body><div id=page class=widget><article><p>{P}</article><div id=comments>" + f"<article class=comment><p>{P}</article>" * 5 + "</div></div></body>", TEXT),
    (f"<body><div><p>{P}</div><section class=comments>" + f"<p>{P}" * 9 + "</section></body>", TEXT),
    (f"<article><p>{P}<div class=share-buttons><a href=1>A</a> <a href=2>B</a></div><aside>{P}</aside><footer>f</footer></article>", TEXT),
    (f"<body><div class=wrap><p>{P}<h2>Sources</h2><ul>{LINKED}</ul></div></body>", f"{TEXT}\nSources\n{REFERENCES}"),
    ("<body><div class=cookie-notice>all there is</div></body>", "all there is"),
])
def test_article_text_is_not_lost(page, text):
    assert html_text.main_text(page) == text


def test_deep_open_tags_take_linear_time():
    for make in (lambda n: "<b>" * n + "</x>" * n, lambda n: "<span>" * n + "<h1>x" * n, lambda n: "<b><div>" + "<i>" * n + "</b>" * n,
                 lambda n: "<ul>" + "<li><b>" * n, lambda n: "<table><tr>" + "<td><i>" * n, lambda n: "<p><i>" * n):
        started = time.process_time()
        html_text.main_text(make(8000))
        assert time.process_time() - started < 1.0


def test_awkward_pages_take_linear_time():
    for page in ("<div>" * 20000 + "x", "<p>a" * 20000, "<" * 50000, "<a b=\"" * 2000, "</p>" * 20000, "<a " * 20000, "<!--" * 20000):
        assert len(html_text.main_text(page)) <= len(page)


def test_rows_keep_their_ids(spark):
    rows = [(1, "u", "<p>a</p>", "t", 5, "k"), (1, "u", "<p>a</p>", "t", 5, "k"), (None, None, None, "t", 5, "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long, key string")
    got = sorted(map(str, html_text.extract(pages).collect()))
    assert len(got) == 3 and got[0] == got[1] == "Row(page_id=1, url='u', text='a', n_chars=1)"
    assert "Row(page_id=None, url=None, text='', n_chars=0)" in got
    assert html_text.extract(pages.limit(0)).collect() == []
