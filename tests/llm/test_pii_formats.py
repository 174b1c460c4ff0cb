"""Formats of names, addresses, numbers and secrets, and names that lose their title."""

import re

from tamarack.llm import op07_pii as pii

from .test_operators import table

GONE = {
    "Met Dr John Michael Smith today.": ["John", "Michael", "Smith"],
    "Met Mr Jean-Luc Picard today.": ["Jean", "Luc", "Picard"],
    "Met Mr O'Brien today.": ["Brien"],
    "Met Mrs McDonald today.": ["Donald"],
    "Met Herr Ludwig van Beethoven today.": ["Ludwig", "Beethoven"],
    "Met Dr J. R. Smith today.": ["Smith", "J."],
    "Host 2001:db8::1 is up.": ["2001:db8::1"],
    "Call 01 23 45 67 89 now.": ["23 45 67 89"],
    "Call 0171 1234567 now.": ["1234567"],
    "Call 5551234567 now.": ["1234567"],
    "Hash " + "0a1b" * 40 + " seen.": ["0a1b" * 8],
    "Paid by 3056 930902 5904 then.": ["930902"],
    "Mr John Smith came. Then John Smith's friend met Smith and John again.": ["John", "Smith"],
}
LEFT = ["std::vector<int> a::b at 12:30:45", "Released 2024-01-31 at 1706659200, version 2.0.1", "Smith and John without a title"]


def test_no_entity_stays_in_clear_text(spark):
    rows = [(k, t) for k, t in enumerate([*GONE, *LEFT])]
    out = {r.doc_id: r.text for r in pii.replace_pii(table(spark, rows), "a key").collect()}
    assert len(out) == len(rows)
    for k, (text, old) in enumerate(GONE.items()):
        assert not [x for x in old if x in out[k]], (text, out[k])
        assert out[k].split()[0] == text.split()[0] and out[k].split()[-1] == text.split()[-1]
    assert [out[len(GONE) + k] for k in range(len(LEFT))] == LEFT
    first, last, *rest = re.fullmatch(r"Mr ([\w-]+) ([\w-]+) came\. Then ([\w-]+) ([\w-]+)'s friend met ([\w-]+) and ([\w-]+) again\.", out[len(GONE) - 1]).groups()
    assert rest == [first, last, last, first]
