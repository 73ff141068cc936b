import html as H
import re

import pytest

from formledger.llm import html_text, queries

LONG = "This is the text of the article, and it is long enough to be taken as good by all of the rules that there are for it."


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        (f"<article><h1>Head</h1><p>{LONG}</p><p>Yes.</p></article><footer>&copy; x</footer>", f"Head\n\n{LONG}\n\nYes."),
        (f"<body><div class='menu'><a href=x>Home</a></div><div id=c><p>{LONG}</p><p>A&amp;B &lt; c</p></div><div class='comments'><p>{LONG}</p></div>", f"{LONG}\n\nA&B < c"),
        (f"<nav>{LONG}</nav><p>{LONG}<br>{LONG}</p><script>var a = '<p>';</script><style>p{{}}</style>", f"{LONG} {LONG}"),
        (f"<article><p>{LONG}</p><p>cut of", f"{LONG}\n\ncut of"),
        (f"<article><p>{LONG}</p><p class='x", LONG),
        (f"<main><p>xyzzy foo bar baz</p></main><aside>{LONG}</aside>", ""),
        (f"<article><p>qwe rty uio pas dfg hjk lzx cvb nmq wer tyu iop asd fgh jkl zxc vbn mqw ert</p></article><nav>a</nav>", "qwe rty uio pas dfg hjk lzx cvb nmq wer tyu iop asd fgh jkl zxc vbn mqw ert"),
        (f"<form>{LONG}</form><div class='cookie-notice'>{LONG}</div><div class='no-sidebar'><p>{LONG}</p></div>", LONG),
    ],
)
def test_pages(page, want):
    got = html_text.main_text(page)
    if page and page.startswith("<main>"):
        assert LONG not in got
    else:
        assert got == want


def test_long_link_lists_are_no_text():
    links = "".join(f"<li><a href=/{i}>the way to the other page of all</a></li>" for i in range(20))
    assert html_text.main_text(f"<div><ul>{links}</ul><p>{LONG}</p></div>") == LONG


def test_articles_of_the_tables(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in queries.op2_html(spark, small).collect():
        page = pages[r.page_id]
        body = page[page.index("<article>") + 9 :].split("</article>")[0]
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]*>?", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_clashing_columns_and_empty_table(spark):
    rows = spark.createDataFrame([(1, None, "mine"), (1, None, "mine")], "page_id long, html string, Text string")
    out = html_text.extract(rows)
    assert out.columns == ["page_id", "html", "Text", "_text"]
    assert [r["_text"] for r in out.collect()] == ["", ""]
    assert html_text.extract(rows.limit(0)).count() == 0


RUSSIAN = "Это длинный текст статьи на русском языке, который должен остаться целиком, потому что в нём нет ссылок и он длинный."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article class='post social-post'><p>{LONG}</p></article>", LONG),
        (f"<div class='search-results'><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n\n{LONG}"),
        (f"<div class='alert-level-story'><article><p>{LONG}</p></article></div>", LONG),
        (f"<article><p>{LONG}</p></article><div class='comments'><article class='comment'><p>{LONG} {LONG}</p></article></div>", LONG),
        (f"<body><nav><a href=x>Домой</a></nav><div><p>{RUSSIAN}</p><p>Да.</p></div><footer>{RUSSIAN}</footer>", f"{RUSSIAN}\n\nДа."),
        (f"<html><head><title>t</title><meta x><body><p>{LONG}</p>", LONG),
        (f"<label>Name<p>{LONG}</p>", LONG),
        (f"<button>Go<p>{LONG}</p><button>Stop</button><p>{LONG}</p>", f"{LONG}\n\n{LONG}"),
        (f"<iframe src=x><p>{LONG}</p>", LONG),
        (f"<noscript><p>{LONG}</p></noscript><p>{LONG}</p>", LONG),
        (f"<!-- <button> --><script>'<button>'</script><button>Go</button><p>{LONG}</p>", LONG),
        (f"<div class='cookie-notice'>{LONG}</div>", ""),
    ],
)
def test_pages_without_the_usual_marks(page, want):
    assert html_text.main_text(page) == want


def test_the_passes_decide_where_nothing_is_marked():
    """Without marks and articles the first pass calls lists of links bad, the second gives short blocks their neighbours' label."""
    links = "".join(f"<p><a href=/{i}>go to page {i}</a></p>" for i in range(8))
    page = f"<div>{links}<p>Top of it</p></div><div><h2>Short heading</h2><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div><div><p>Odd end</p>{links}</div>"
    parser = html_text._Blocks(page)
    parser.feed(page)
    parser.close()
    parser._end_block()
    assert not parser.marked and not parser.holds
    first = [html_text.first_label(r[0], r[1], 0.3) for r in parser.rows]
    final = html_text.labels(parser)
    assert first.count(html_text.BAD) == 16 and first.count(html_text.GOOD) == 2 and first.count(html_text.OPEN) == 4
    assert sum(a is html_text.OPEN and b == html_text.GOOD for a, b in zip(first, final)) == 2
    assert sum(a is html_text.OPEN and b == html_text.BAD for a, b in zip(first, final)) == 2
    assert html_text.main_text(page) == f"Short heading\n\n{LONG}\n\nYes.\n\n{LONG}"


def test_a_page_of_short_blocks():
    assert html_text.main_text("<html><body><h1>Note</h1><p>Closed today.</p></body></html>") == "Note\n\nClosed today."
    assert html_text.main_text("<body><nav><a href='x'>Home</a></nav></body>") == ""


def test_very_long_pages_take_time_by_their_length():
    import time

    for page in ("<button>" * 200_000, "<div>" * 20_000, "<p>" + LONG * 50_000, "<" * 200_000, f"<p>{LONG}" * 20_000, "<script>a()</script>" * 20_000 + "<script>" * 20_000, "<div class='sidebar'>text " * 20_000 + f"<p>{LONG}", "<div>text " * 20_000 + "</section>" * 20_000):
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 20
