"""Visible text of an article in formulas, drawings and aria-hidden elements, and wrappers with mixed class words."""

from stratalex.llm.html_extract import extract

PROSE = "The harvest of the northern fields was counted again in spring, and the sum was larger than before."


def test_formulas_and_labels():
    got = extract(f"<article><p>{PROSE} <math><mi>E</mi><mo>=</mo><mi>m</mi></math> and <span aria-hidden='true'>seen by all</span> stay.</p><p>{PROSE}</p><p>{PROSE} <svg><title>no</title><defs><text>no</text></defs><path d='M0'/><text>left</text><text>right</text></svg> follows.</p></article>")
    assert "E=m and seen by all stay." in got and "left right follows." in got and "no left" not in got


def test_wrapper_with_a_bad_word():
    body = f"<p>{PROSE}</p><p>{PROSE}</p>"
    assert PROSE in extract(f'<div class="content has-sidebar"><article>{body}</article></div>')
    assert extract(f'<div class="related sidebar"><div>{body}</div></div>') == ""


def test_odd_pages_take_linear_time():
    """What has no end is not sought again and again: four times the page takes nowhere near sixteen times the time."""
    import time

    from stratalex.llm.html_extract import blocks

    m = 8_000
    pages = ["<a ", '<a "', "<![CDATA[ >", '<a ">" ', "<div>", "<b> ", "<b><i>", "<!-- ", "</x", "<script", "<p>x<table>"]
    for make in [lambda k, x=x: x * k for x in pages] + [lambda k: "<div>" * k + "</x>" * k, lambda k: "<b><div>" + "<i>" * k + "</b>" * k + "<h1>" * k]:
        began = time.perf_counter()
        blocks(make(m))
        middle = time.perf_counter()
        blocks(make(4 * m))
        assert time.perf_counter() - middle < 9 * (middle - began) + 0.5, make(3)


def test_what_does_not_end():
    from stratalex.llm.html_extract import blocks

    said = lambda html: [b.text for b in blocks(html)]
    assert said("<p>one <b two") == ["one <b two"]
    assert said("<p>a < b</p><p class='x>two</p><p>three</p>") == ["a < b", "two", "three"]
    assert said("<p>one<!-- never") == ["one"] and said("<p>one<!doctype") == ["one"]
    assert said("<p>x<![CDATA[a<b]]></p><p>y<![CDATA[ z</p>") == ["xa<b", "y"]
    assert said("<p>one<script>var a = '<p>'</script>two") == ["one", "two"] and said("<p>one<script") == ["one<script"]
