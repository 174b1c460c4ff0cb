"""The page reader: intervals, implied ends, and pages of every bad shape."""

import random
import time

import pytest

from tamarack.operators.extract import dom
from tamarack.operators.extract import pages as P

N = 1_000_000
BAD = {
    "declarations": "<![foo[x]]>" * (N // 11), "scripts": "<script>" * (N // 8), "open tags": "<script " * (N // 8), "items": "<li>mot mot " * (N // 12), "nested items": "<ul><li>mot mot " * (N // 16), "boxes": "<div>" * (N // 5), "signs": "<" * N, "links": "<a href=x>mot " * (N // 14),
    "headings": "<h2>mot " * (N // 8), "quotes": '<a b="x>' * (N // 8), "ends": "<b>" * (N // 6) + "</i>" * (N // 8), "comments": "<!--" * (N // 4), "references": "&amp;" * (N // 5), "titles": "<title>" * (N // 7), "tables": "<table><tr><td>" * (N // 15), "attributes": "<a " + "x=1 " * (N // 4) + ">",
}


@pytest.mark.parametrize("shape", BAD)
def test_bad_pages_are_read_in_time(shape):
    began = time.process_time()
    dom.element_rows(1, "https://e/", BAD[shape], P._LISTED)
    assert time.process_time() - began < 6  # a second on an idle machine; quadratic reading would take minutes


def test_intervals_hold_what_parents_say():
    r = random.Random(3)
    pieces = ["<ul>", "</ul>", "<li>", "</li>", "<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<a href=x>", "</a>", "<br>", "mot ", "<h2>", "</h2>", "<table><tr><td>", "</table>", "<script>x<b></script>", "<!-- <li> -->", "</", "<3", "&lt;li&gt;"]
    for _ in range(400):
        page = dom.Page("".join(r.choice(pieces) for _ in range(r.randint(0, 60))))
        for k, up in enumerate(page.parent):
            assert up < k <= page.last[k] and (up < 0 or page.last[k] <= page.last[up])
            inside = [x for x in range(len(page.tag)) if k < x <= page.last[k]]
            assert all(_under(page, x, k) for x in inside) and sum(_under(page, x, k) for x in range(len(page.tag))) == len(inside)
        texts, own = page.texts(), page.own_texts()
        for k, tag in enumerate(page.tag):
            if page.last[k] == k:
                assert texts[k] == own[k]
            assert tag != "li" or up_tag(page, k) != "li" and up_tag(page, k) != "p"


def _under(page, x, k):
    while x >= 0 and x != k:
        x = page.parent[x]
        if x == k:
            return True
    return False


def up_tag(page, k):
    return page.tag[page.parent[k]] if page.parent[k] >= 0 else None


def test_implied_ends():
    page = dom.Page("<ul><li>Soudeur<li>Plombier de chantier</ul><p>Gras<b>suite</b><div>x</div>")
    assert list(zip(page.tag, page.texts(), strict=True)) == [("ul", "SoudeurPlombier de chantier"), ("li", "Soudeur"), ("li", "Plombier de chantier"), ("p", "Grassuite"), ("b", "suite"), ("div", "x")]
    nested = dom.Page("<ul><li>A<ul><li>B</ul>C<li>D</ul>")
    assert [(t, o) for t, o in zip(nested.texts(), nested.own_texts(), strict=True)][1:] == [("ABC", "AC"), ("B", ""), ("B", "B"), ("D", "D")]


def test_scripts_by_type():
    html = "<script type='application/ld+json'>{\"a\":\"<b>\"}</script><script>x</script><SCRIPT TYPE=\"Application/LD+JSON; charset=utf-8\">[1]</SCRIPT><script type='application/ld+json'>{"
    assert list(dom.scripts(html, "ld+json")) == ['{"a":"<b>"}', "[1]", "{"]


def test_pages_of_any_shape_give_rows(spark):
    made = spark.createDataFrame([(1, "https://e/", "<![foo[x]]><a href='http://[x'>A</a>"), (2, None, None), (3, None, "<a href=b>B</a>"), (3, None, "<a href=b>B</a>"), (None, "https://e/", "<h1>C")], "page_id long, url string, html string")
    assert sorted((str(r.page_id), r.tag, r.text, r.href) for r in P.page_elements(made).collect()) == [("1", "a", "A", None), ("3", "a", "B", "b"), ("3", "a", "B", "b"), ("None", "h1", "C", None)]
    assert P.page_elements(made.limit(0)).count() == 0
