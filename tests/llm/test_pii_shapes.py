"""Long texts of every shape, clashing columns, scripts, and full spaces of numbers."""

import re
import time

import pytest

from tamarack.llm import op07_pii as pii

from .test_operators import table

MB = 1 << 20
SHAPES = [
    "a@" + "b." * (MB // 2), "a@" * (MB // 2), "a@b-" * (MB // 4), "." * MB, "a." * (MB // 2), "key=" * (MB // 4), "key" * (MB // 3), "token=a=" * (MB // 8), "bearer " * (MB // 7), "-eyJ" * (MB // 4), "sk-" * (MB // 3),
    "1" * MB, "1." * (MB // 2), "+1" * (MB // 2), "+" + "12345678901234567890123456789012345 " * (MB // 37), "::" * (MB // 2), "a:" * (MB // 2), "abcdef" * (MB // 6), "0a" * (MB // 2), "DE12" + " ABCD" * (MB // 5), "Mr " * (MB // 3), "Mr " + "A" * MB,
    "Mr " + "Aa " * (MB // 3), "Mr " + "O'Aa-" * (MB // 5), "Dr J. " * (MB // 6), "\U0001d400a" * (MB // 5), "a@\U0001d400a." * (MB // 8), "ssn " * (MB // 4), "﷐" * (MB // 3), "x" * MB, " " * MB,
]


def test_long_texts_of_any_shape_end(spark):
    """In linear time, and without a recursion that grows with the text."""
    began = time.monotonic()
    docs = table(spark, [*enumerate(SHAPES), (100, "Call 555-123-4567.")]).repartition(8)
    out = {r.doc_id: r for r in pii.replace_pii(docs, "a key").collect()}
    assert len(out) == len(SHAPES) + 1 and time.monotonic() - began < 120
    for k, text in enumerate(SHAPES):
        assert out[k].n_entities or out[k].text == text, text[:20]


def test_many_entities_of_one_text(spark):
    words = ["".join(chr(97 + k // 26**d % 26) for d in range(3)) for k in range(8000)]
    text = " ".join([f"{w}@x.org" for w in words] + [f"Mr {w.capitalize()}b met {w.capitalize()}b." for w in words])
    (row,) = pii.replace_pii(table(spark, [(1, text)]), "a key").collect()
    mails = re.findall(r"\S+@\S+", row.text)
    assert row.n_entities == 24000 and len(set(mails)) == 8000 and not re.search(r"@x\.org", row.text)
    names = re.findall(r"Mr (\S+) met (\S+)\.", row.text)
    assert len(names) == 8000 and all(a == b for a, b in names) and len({a for a, _ in names}) == 8000


def test_clashing_columns_pass_through(spark):
    names = ["row", "first", "second", "has", "marked", "n", "parts", "c0", "c1", "kind", "n_entities", "dotted.name"]
    rows = [(1, "Call 555-123-4567.", *names), (2, "nothing", *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = pii.replace_pii(docs, "a key")
    assert set(out.columns) == set(docs.columns)
    for r in out.collect():
        assert [r[n] for n in names if n != "n_entities"] == [n for n in names if n != "n_entities"] and r.n_entities == (r.doc_id == 1)
    whole = pii.replace_pii(docs, "a key", count_column=None)
    assert whole.columns == docs.columns and {r.n_entities for r in whole.collect()} == {"n_entities"}


def test_scripts_of_names(spark):
    rows = [(1, "Mr Παπαδόπουλος came."), (2, "Господин Чехов приехал."), (3, "Mr Հովհաննես came."), (4, "Mr Smith came.")]
    out = {r.doc_id: r.text for r in pii.replace_pii(table(spark, rows), "a key").collect()}
    assert re.fullmatch(r"Mr [Ͱ-Ͽ-]+ came\.", out[1]) and out[1] != rows[0][1]
    assert re.fullmatch(r"Господин [Ѐ-ӿ-]+ приехал\.", out[2]) and out[2] != rows[1][1]
    assert out[3] == rows[2][1] and re.fullmatch(r"Mr [A-Z][a-z-]+ came\.", out[4])


def test_a_key_is_needed_and_matters(spark):
    docs = table(spark, [(1, "Call 555-123-4567.")])
    with pytest.raises(ValueError, match="key"):
        pii.replace_pii(docs, "")
    a, b, again = [pii.replace_pii(docs, k).first().text for k in ("one", "two", "one")]
    assert a == again != b
    assert pii.session_key(spark) == pii.session_key(spark) and len(pii.session_key(spark)) == 64


def test_a_full_space_keeps_numbers_apart(spark):
    rows = spark.createDataFrame([("ssn", f"{k:02d}") for k in range(100)] + [("email", "a@b.org")], "kind string, canon string")
    out = {(r.kind, r.canon): r.surrogate for r in pii.dictionary(rows, "a key", rounds=2).collect()}
    assert len(out) == 101 and len({v for (kind, _), v in out.items() if kind == "ssn"}) == 100


def test_numbers_in_context(spark):
    rows = [(1, "SSN: 123456789 given"), (2, "item 123456789 sold"), (3, "token=abcdefg1. Then"), (4, 'password = "a=b12345678"'), (5, "key=abc=def12345 x")]
    out = {r.doc_id: r.text for r in pii.replace_pii(table(spark, rows), "a key").collect()}
    assert re.fullmatch(r"SSN: \d{9} given", out[1]) and "123456789" not in out[1] and out[2] == rows[1][1]
    assert re.fullmatch(r"token=[a-z]{7}\d\. Then", out[3]) and "abcdefg1" not in out[3] and "b12345678" not in out[4] and "def12345" not in out[5]
