"""References resolved as Columns, against the cases of RFC 3986 and the standard library."""

import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from tamarack.functions import urls as U

BASE = "http://a/b/c/d;p?q"
#: Section 5.4 of the RFC.
CASES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x",
    "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g",
    "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h",
    "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http://a/b/c/g", "mailto:x@y.z": "mailto:x@y.z",
}


def resolved(spark, pairs):
    rows = spark.createDataFrame([(k, b, h) for k, (b, h) in enumerate(pairs)], "k int, b string, h string")
    return [r.u for r in rows.orderBy("k").select(U.resolve_url(F.col("b"), F.col("h")).alias("u")).collect()]


def test_cases_of_the_standard(spark):
    assert dict(zip(CASES, resolved(spark, [(BASE, h) for h in CASES]), strict=True)) == CASES


def test_equals_the_library_on_random_references(spark):
    r = random.Random(4)
    parts = ["a", "b.c", "..", ".", "", "x%20y", "é"]
    pairs = []
    for _ in range(400):
        base = "https://h.x" + "".join("/" + r.choice(parts[:2]) for _ in range(r.randint(0, 3))) + r.choice(["", "/", "/i?q=1"])
        href = r.choice(["", "/", "../", "./"]) + "/".join(r.choice(parts) for _ in range(r.randint(1, 4))) + r.choice(["", "?a=b/../c", "#f"])
        if "//" not in href:
            pairs.append((base, href))
    assert resolved(spark, pairs) == [urljoin(b, h) for b, h in pairs]


def test_odd_addresses(spark):
    assert resolved(spark, [(None, "x"), (BASE, None), ("http://a", "g"), ("http://a?x#y", "#z"), ("http://a", "")]) == ["x", None, "http://a/g", "http://a?x#z", "http://a"]
    rows = spark.createDataFrame([("https://h/a/?q#f", "https://h/a"), ("https://h", "https://h//"), ("nothing", "")], "a string, b string")
    assert [tuple(x) for x in rows.select(U.same_url(F.col("a"), F.col("b")), U.url_path(F.col("a")), U.clean_url(F.col("a"))).collect()] == [(False, "/a/", "https://h/a/"), (True, "/", "https://h"), (False, "", "nothing")]
