"""Tags of foreign elements."""

import pytest

from tamarack.llm.html_tree import Page


@pytest.mark.parametrize("tag", ['<svg class="i"/>', "<svg/>", "<SVG\n viewBox='0 0 > 1' />", '<svg href="a/b"/>'])
def test_self_closed_elements_are_empty(tag):
    assert [t for _, t in Page(f"<p>one</p>{tag}<p>two</p><p>three</p>").texts] == ["one", "two", "three"]


@pytest.mark.parametrize("tag", ['<svg class="i"><path d="M0"/><text>no</text></svg>', '<svg data-x="/>"><text>no</text></svg>', '<script src="x"/>var no;</script>'])
def test_opened_elements_are_dropped(tag):
    assert [t for _, t in Page(f"<p>one</p>{tag}<p>two</p>").texts] == ["one", "two"]


@pytest.mark.parametrize("source", ["<a " * 400_000, "<a href='" * 100_000, '<a \"\'>' * 150_000, "<" * 1_000_000, "<!--" * 250_000, "<script>" * 125_000, "</" * 500_000, "<p " + "x=1 " * 250_000, "<a href=\"x>" * 90_000, "<svg " * 200_000, "<!" * 500_000, "<p>" * 100_000])
def test_long_bad_tags_take_linear_time(source):
    import time

    began = time.monotonic()
    Page(source)
    assert time.monotonic() - began < 4


def test_unclosed_quotes_end_at_the_next_bracket():
    assert [t for _, t in Page('<p>one</p><a href="x>two</a><p class=\'y\'>three</p>').texts] == ["one", "two", "three"]


def test_formulas_are_text():
    assert [t for _, t in Page("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>").texts] == ["so x=1 holds"]


def test_a_bare_bracket_is_text():
    assert [t for _, t in Page("<p>1 < 2 and 3 > 2</p>").texts] == ["1 < 2 and 3 > 2"]


PROBES = {
    "<html><body><h1>A title of it</h1><p>One sentence stands here.</p><p>Another one follows it.</p><p>The third ends the page.</p></body></html>": "A title of it\nOne sentence stands here.\nAnother one follows it.\nThe third ends the page.",
    "<html><body><div><div>Some text stands in plain nested boxes, as it often does.</div><div>And more of it in the next one.</div></div></body></html>": "Some text stands in plain nested boxes, as it often does.\nAnd more of it in the next one.",
    "<html><body>Text that stands directly in the body of the page.</body></html>": "Text that stands directly in the body of the page.",
    "Plain text that has no element at all, and ends.": "Plain text that has no element at all, and ends.",
    "<article><h1>Sources of the story</h1><p>The story was put together from these.</p><ul><li><a href='/1'>First long source of it</a></li><li><a href='/2'>Second long source of it</a></li></ul><p>That was all there is.</p></article>": "Sources of the story\nThe story was put together from these.\nFirst long source of it\nSecond long source of it\nThat was all there is.",
}


def test_pages_without_an_article(spark):
    from tamarack.llm import op01_html

    model = op01_html.train(spark)
    assert op01_html.main_texts(model, list(PROBES)) == list(PROBES.values())


def test_pages_of_another_make(spark):
    """A set made by hand in another manner than the training pages: other names, tables for layout, furniture without names."""
    import random

    from tamarack.llm import op01_html

    model, r, right, total = op01_html.train(spark), random.Random(3), 0, 0
    word = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(n))
    for k in range(60):
        paragraphs = [word(r.randint(12, 60)).capitalize() + "." for _ in range(r.randint(2, 8))]
        head = word(5).capitalize()
        body = f"<h2>{head}</h2>" + "".join(f"<p>{p}</p>" for p in paragraphs)
        main = [f"<div class='post-body'>{body}</div>", f"<main id='main'>{body}</main>", f"<td>{body}</td>", f"<section>{body}</section>"][k % 4]
        if k % 4 == 2:
            main = f"<table><tr>{main}</tr></table>"
        menu = "<ul>" + "".join(f"<li><a href='/{i}'>{word(1)}</a></li>" for i in range(6)) + "</ul>"
        page = f"<html><head><title>{head}</title></head><body><div class='top-nav'>{menu}</div>{main}<div class='comment-list'><p>{word(12)}.</p></div><footer><p>&copy; {word(3)}</p></footer></body></html>"
        (found,) = op01_html.main_texts(model, [page])
        wanted = [head, *paragraphs]
        got = found.split("\n") if found else []
        right += sum(len(x) for x in wanted if x in got) - sum(len(x) for x in got if x not in wanted)
        total += sum(map(len, wanted))
    assert right / total > 0.97
