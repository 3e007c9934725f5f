"""The labelling of pages: against all labellings, and what the cut adds to the classifier."""

import itertools
import math
import re

import duckdb
import pytest

from stratalex.llm import html_extract as x

PAGES = duckdb.connect().sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
PROSE = "The harvest of the northern fields was counted again in spring, and the sum was larger than before."


def without_sections(html):
    """The page with plain divs for sections, and for every third paragraph."""
    seen = itertools.count(1)
    third = lambda m: f"<div>{m[1]}</div>" if next(seen) % 3 == 0 else m[0]
    html = re.sub(r"<p>((?:(?!<p>|</p>).)*)</p>", third, html.replace("<br><p>", "</p><p>"))
    return html.replace("<br><p>", "</p><p>"), re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", html).replace('<div class="ad">', "<div>")


def test_the_cut_decides_and_for_the_better(spark):
    model = x.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), "page_id", "html")
    flips = helped = alone = together = n = 0
    for (html,) in PAGES:
        marked, plain = without_sections(html)
        truth = [b.node.inside for b in x.blocks(marked)]
        _, cut, own = x.labelled(plain, model)
        assert len(cut) == len(truth)
        n += len(cut)
        alone += sum(a == t for a, t in zip(own, truth))
        together += sum(a == t for a, t in zip(cut, truth))
        flips += sum(a != b for a, b in zip(cut, own))
        helped += sum(a != b and a == t for a, b, t in zip(cut, own, truth))
    assert flips > 100 and helped > 0.95 * flips and together > 0.97 * n > alone, (n, flips, helped, alone, together)


def test_articles_come_out_whole():
    import html as h

    for (page,) in PAGES:
        inside = re.search("<article>(.*)</article>", page, re.S)[1].replace("<b>", "").replace("</b>", "")
        assert x.extract(page) == " ".join(h.unescape(re.sub("<(?:/?p|/?h1|br)>", " ", inside)).split())


@pytest.mark.parametrize("page", [
    f"<div><p>{PROSE}</p><p>Short</p><a href=x>Go</a><div>More of it</div><p>{PROSE}</p></div><footer>End of it</footer>",
    f"<nav><a>One</a> <a>Two</a></nav><div>Maybe text</div><main><h1>A title</h1><div>Five words are in here</div><p>{PROSE}</p><ul><li>Point</li><li>Other point</li></ul></main><div>Words, words.</div>",
    "<table><tr><td>a</td><td>b, c.</td></tr><tr><td><a>link</a></td><td>And more words than before in here.</td></tr></table><p>x</p>",
])
def test_labels_like_all_labellings(page):
    found, cut, _ = x.labelled(page)
    has = any(b.node.inside for b in found)
    odds = [x.content_odds(b, x.Shape(), has) for b in found]
    ties = x.ties_of(found)
    cost = lambda labels: sum(max(z, 0) * (not k) + max(-z, 0) * k for z, k in zip(odds, labels)) + sum(w for a, b, w in ties if labels[a] != labels[b])
    assert 4 <= len(found) <= 14
    assert math.isclose(cost(cut), min(map(cost, itertools.product([False, True], repeat=len(found)))), abs_tol=1e-9)


@pytest.mark.parametrize("page", ['<article class="post has-sidebar"><p>%s</p></article>', '<main class="content with-sidebar"><p>%s</p></main>', '<article id="legal-notice-2024"><p>%s</p></article>', '<div class="page no-menu"><article><p>%s</p></article></div>', '<div class="has-sidebar"><div class="entry-content"><p>%s</p></div></div>'])
def test_names_that_say_nothing_of_the_text(page):
    assert x.extract("<nav><a href=x>Home</a></nav>" + page % PROSE) == PROSE


def test_heading_with_a_name():
    assert x.extract(f'<article><h2 class="section-header">A head</h2><p>{PROSE}</p></article>') == f"A head {PROSE}"


def test_boilerplate_by_kind():
    rest = ['<div class="comments"><p>%s</p></div>', '<div id="cookie-notice">%s</div>', '<aside>%s</aside>', '<form><label>%s</label></form>', '<div class="ad-slot">%s</div>', '<div role="navigation">%s</div>', '<footer><p>%s</p></footer>', '<div hidden>%s</div>']
    for r in rest:
        assert x.extract(f"<header>Our site.</header><article><h1>Title</h1><p>{PROSE}</p></article>{r % 'I read this, and it was good.'}") == f"Title {PROSE}", r
        inside = x.extract(f"<article><h1>Title</h1><p>{PROSE}</p>{r % 'I read this, and it was good.'}<p>{PROSE}</p></article>")
        assert inside == f"Title {PROSE} {PROSE}", r


def test_training_learns_from_marked_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = x.train(pages, "page_id", "html")
    assert model == x.train(pages.repartition(7), "page_id", "html") != x.Shape()
    assert model.weights[1] < 0 < model.weights[0] and x.train(pages.limit(0), "page_id", "html") == x.Shape()


SAID = "We store a few small files on your device so that the site works as it should, and you may say no."
AROUND = [
    '<div class="menu"><a href=1>Home</a><a href=2>News and more</a></div>', '<ul id="nav-main"><li><a>Home</a></li><li><a>About us and others</a></li></ul>', f'<div class="sidebar"><h3>More</h3><p>{SAID}</p></div>', f'<div class="sidebar-content"><p>{SAID}</p></div>',
    f'<div class="cookie-consent"><p>{SAID}</p></div>', f'<div class="notice"><p>{SAID}</p></div>', f'<div class="ad"><p>{SAID}</p></div>', f'<div class="advert top"><span>{SAID}</span></div>', f"<form><p>{SAID}</p><input></form>", f'<div class="page-footer">{SAID}</div>',
    f'<section id="comments"><h2>3 comments</h2><div class="comment"><p>{SAID}</p></div><div class="comment"><p>It was a good read.</p></div></section>', f'<ol class="comment-list"><li><p>{SAID}</p></li></ol>', f"<footer><p>{SAID}</p></footer>", f"<aside><p>{SAID}</p></aside>",
    f'<div class="related"><h3>Read on</h3><a>{SAID}</a></div>', '<div class="entry-footer">Posted in <a>News</a> by Ann, on a day in May.</div>', f'<div role="dialog"><p>{SAID}</p></div>', f'<div class="newsletter-signup"><p>{SAID}</p></div>', '<ol class="breadcrumbs"><li><a>Home</a></li><li>Here we are</li></ol>', '<div class="share">Share this page with your friends.</div>',
]
#: As trained on the pages of sf0.01.
TRAINED = x.Shape((1.2112, -2.201, 0.1066, 3.7732, 2.3676, -0.9742), -1.4785)


@pytest.mark.parametrize("model", [x.Shape(), TRAINED], ids=["first", "trained"])
@pytest.mark.parametrize("wrapper", ["<article>%s</article>", "<main>%s</main>", '<div class="content">%s</div>', "<main><article>%s</article></main>", '<div id="main-content">%s</div>'])
def test_boilerplate_around_and_inside(wrapper, model):
    body = f"<h1>A title</h1><p>{PROSE}</p><p>Short one.</p><ul><li>Point one here.</li><li>Two</li></ul><blockquote>{PROSE}</blockquote><p>{PROSE}</p>"
    want = f"A title {PROSE} Short one. Point one here. Two {PROSE} {PROSE}"
    for other in [*AROUND, f"<header><p>{SAID}</p></header>"]:
        pages = [other + wrapper % body, wrapper % body + other] + ([wrapper % body.replace("<blockquote>", other + "<blockquote>")] if other in AROUND else [])
        assert all(x.extract(f"<html><body>{p}</body></html>", model) == want for p in pages), other
