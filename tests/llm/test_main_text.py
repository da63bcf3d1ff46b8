import html
import re

from pyspark.sql import functions as F

from callgauge.llm.main_text import extracted, main_text

PROSE = "Some words that make up a paragraph of the article and go on for quite a while, so that it counts as text. "


def test_pages(spark, folder):
    """These pages name their article: all blocks in it, nothing else."""
    for (page,) in spark.read.parquet(f"{folder}/pages.parquet").select("html").collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", page, re.DOTALL)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert main_text(page) == "\n".join(b for b in blocks if b)


def test_page_that_names_no_article():
    page = f"""<html><head><title>T</title><script>if (a < b) x("<p>no</p>")</script></head><body>
    <div id="header"><a href="/">Home</a></div><ul class="menu"><li><a href="/a">A long link text</a></li></ul>
    <p><a href="/x">Just a link of some length, alone in its paragraph</a></p><ul><li><a>One</a></li><li><a>Two</a></li></ul>
    <div class="content"><h1>Headline</h1><p>By</p><p>{PROSE * 2}</p><p>Short.</p><p>{PROSE} caf&eacute; &amp;amp; <b>bo</b>ld<br>x</p></div>
    <div class="side-bar"><p>{PROSE * 3}</p></div><form><p>{PROSE}</p></form><p hidden>{PROSE}</p>
    <div id="comments"><p>{PROSE * 2}</p><div>{PROSE}</div></div><div class="cookie notice">{PROSE * 2}</div>
    <p><a href="/y">One more link at the end</a></p><footer><p>{PROSE}</p></footer></body></html>"""
    p = PROSE.strip()
    assert main_text(page) == f"Headline\nBy\n{p} {p}\nShort.\n{p} café &amp; bold x"


def test_article_with_own_header_and_comments():
    page = f"""<nav><p>{PROSE}</p><article><header><h1>Title</h1></header><p>One</p>
    <aside><p>{PROSE}</p></aside><p class="lead-in">Two <span class="ad">buy</span>three</p>
    <section class="comments"><article><p>{PROSE * 4}</p></article></section></article><p>{PROSE}</p>"""
    assert main_text(page) == "Title\nOne\nTwo three"


def test_largest_article_wins():
    page = f"<article><p>Teaser</p></article><article><p>{PROSE}</p><p>End</p></article><article><p>Teaser</p></article>"
    assert main_text(page) == f"{PROSE.strip()}\nEnd"


def test_article_in_several_elements():
    page = f"<article><h1>Part one</h1><p>{PROSE * 3}</p></article><p><a>More</a></p><article><p>{PROSE}</p></article>"
    assert main_text(page) == f"Part one\n{' '.join([PROSE.strip()] * 3)}\n{PROSE.strip()}"


def test_text_beside_teaser_cards():
    text = f"<div><h1>Headline</h1><p>{PROSE * 2}</p><p>Short.</p><p>{PROSE}</p></div>"
    cards = "".join(f'<article><a href="/{i}">A card with a long linked title of a page {i}</a><p>Teaser</p></article>' for i in range(4))
    p = PROSE.strip()
    for page in (text + cards, cards + text):
        assert main_text(page) == f"Headline\n{p} {p}\nShort.\n{p}"


def test_names_that_only_contain_a_noise_word():
    page = f"""<div class="page has-sidebar"><article><header class="entry-header header"><h1>Title</h1></header><p>{PROSE}</p>
    <p class="share-price">Price</p><div class="post-sidebar-left main-sidebar">{PROSE}</div></article></div>"""
    assert main_text(page) == f"Title\n{PROSE.strip()}\nPrice"


def test_parts_that_hold_the_text_stay():
    text = f"<h1>Title</h1><p>{PROSE}</p><p>End</p>"
    want = f"Title\n{PROSE.strip()}\nEnd"
    for page in (
        f'<div class="widget"><article>{text}</article></div>',
        f'<main><div class="widget"><article>{text}</article></div></main>',
        f'<div id="modal">{text}</div><div class="banner"><p>Buy this</p></div>',
        f'<form><div>{text}</div></form><div class="comments"><p>{PROSE}</p></div>',
    ):
        assert main_text(page) == want
    long = f'<article>{text}</article><div class="comments">{f"<p>{PROSE}</p>" * 9}</div>'
    assert main_text(long) == want


def test_stripped_parts_without_end_tag():
    p = PROSE.strip()
    assert main_text(f"<article><p class=notice>Old<p>{PROSE}</p><p>End</p></article>") == f"{p}\nEnd"
    assert main_text(f"<article><ul><li class=social>Like<li>One<li>Two</ul><p>{PROSE}</p></article>") == f"One\nTwo\n{p}"
    assert main_text(f"<table><tr><td class=ad>Buy<td>{PROSE}<tr class=menu><td>Home<tr><td>End</table>") == f"{p}\nEnd"
    assert main_text(f"<article><section><div class=ad>Buy</section><p>{PROSE}</p></article>") == p
    assert main_text(f"<article><p>{PROSE} <span class=ad>Buy</p><p>End</p></article>") == f"{p}\nEnd"


def test_stripping_in_linear_time():
    page = f"<div>{'<div class=ad><i>' * 100_000}{'</b></i></p>' * 100_000}</div><p>{PROSE}</p>"
    assert main_text(page) == PROSE.strip()


def test_odd_pages(spark):
    pages = [None, "", "<", "<p", "&", "<!-- open", "<script>open", f"<main>{PROSE}", "<div>" * 5000, "text <a href='" + "x" * 500, "a\x00b", "short text"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "page_id long, html string")
    got = {r.page_id: r.t for r in df.select("page_id", extracted(F.col("html")).alias("t")).collect()}
    assert got.pop(7) == PROSE.strip()
    assert {i: got.pop(i) for i in (2, 4, 9, 10, 11)} == {2: "<", 4: "&", 9: "text", 10: "a\x00b", 11: "short text"}
    assert set(got.values()) == {""} and len(got) == 6


def test_long_page_in_linear_time():
    page = f"<article>{f'<p>{PROSE}</p>' * 20_000}</article>"
    assert main_text(page).count("\n") == 19_999


def test_the_one_article_does_not_lose_to_text_beside_it():
    promo = "<div>" + "Buy our great product now, it is better than all of the others. " * 4 + "</div>"
    short = "<article><h1>Short</h1><p>Brief news item.</p></article>"
    assert main_text(short + promo) == main_text(promo + short) == "Short\nBrief news item."
    # an article without text names nothing
    assert main_text("<article><img src=x></article>" + promo).startswith("Buy our")
    # several short articles beside a long text are teasers
    teasers = "".join(f"<article><a href=x>More {i}</a></article>" for i in range(3))
    assert main_text(teasers + promo).startswith("Buy our")
