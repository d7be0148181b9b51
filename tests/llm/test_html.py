"""Page texts against a plain reading of the given pages' article, and pages made by hand."""

import html as entities
import re
import time

import __spark_entry__ as entry
from isobar.llm import html

DATA = "/root/testdata/sf0.001"
LONG = "<p>The first paragraph has several words, and marks. It goes on for a while; then it ends.</p>"
SAID = "The first paragraph has several words, and marks. It goes on for a while; then it ends."


def plain(page):
    """The given pages' article without any ratio: tags that end a block become line ends."""
    inner = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", re.sub(r"(?s)<!--.*?-->|<script.*?</script>", "", page or ""), re.S)
    lines = re.split(r"</?(?:p|h1|br)>", inner[1] if inner else "")
    lines = [re.sub(r"[\s\u200b]+", " ", entities.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in lines]
    return "\n".join(x for x in lines if x)


def test_query_equals_plain_reading(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = entry.queries()["op6_html_text"](spark, DATA).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: plain(x) for k, x in pages.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_no_article_needed(spark):
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        page = r["html"] or ""
        for tag, attributes in (("div", ""), ("div", ' class="story"'), ("section", ""), ("main", "")):
            other = page.replace("<article>", f"<{tag}{attributes}>").replace("</article>", f"</{tag}>")
            assert html.main_text(other) == plain(page)


def test_headings_lists_and_quotes_follow_their_container():
    page = f"<body><div>Menu</div><div class=c><h1>Head</h1>{LONG}<ul><li>one</li><li>two</li></ul><blockquote>Q</blockquote><pre>x = 1</pre>{LONG}</div></body>"
    assert html.main_text(page) == f"Head\n{SAID}\none\ntwo\nQ\nx = 1\n{SAID}"
    assert html.main_text(f"<body><h1>Head</h1><div>{LONG}{LONG}</div><ul><li><a>x</a></li></ul></body>") == f"Head\n{SAID}\n{SAID}"


def test_names_count_as_whole():
    assert html.main_text("<div id='header-image'><p>In header.</p></div>") == "In header."
    page = (f"<article>{LONG}<div class='share-price'><p>Price fell.</p></div><section class='notice-period'><p>Three months.</p></section>"
            "<div class='comments'><p>Nice, thanks. Really good, I say.</p></div><div class='cookieBanner'>We use</div><ul><li><a>More</a></li></ul></article>")
    assert html.main_text(page) == f"{SAID}\nPrice fell.\nThree months."


def test_forms():
    assert html.main_text(f"<form><nav>n</nav><h1>T</h1>{LONG}<aside>s</aside></form>") == f"T\n{SAID}"
    assert html.main_text(f"<div>{LONG}<form><p>Your name, please.</p></form></div>") == SAID


def test_broken_and_long_pages():
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == html.main_text("<!-- x") == ""
    assert html.main_text("a <b c") == "a <b c"
    assert html.main_text("1 < 2 &amp; 3 > 2") == "1 < 2 & 3 > 2"
    assert html.main_text("<p>a<p>b</i></div>c") == "a\nb\nc"
    start = time.perf_counter()
    for part in ("<a ", "<b>", "<b><p>x", '<a x=">" ', '<a href="x', "<p></i>", "<div>x", "<!-- ", "x < y "):
        html.main_text(part * (400_000 // len(part)))
    assert time.perf_counter() - start < 30
