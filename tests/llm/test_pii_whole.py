"""Rows that hold the operator's own marks."""

import re

from tamarack.llm import op07_pii as pii

from .test_operators import table


def test_no_row_is_lost_beside_marks(spark):
    marks = [chr(c) for c in range(0xFDD0, 0xFDD8)]
    rows = [(k, f"{m}555-123-4567") for k, m in enumerate(marks)] + [(20, "".join(marks) * 2 + "0123 no entity"), (21, "".join(reversed(marks)) + "555-123-4567" + "".join(marks))]
    out = {r.doc_id: r.text for r in pii.replace_pii(table(spark, rows), "a key").collect()}
    assert len(out) == len(rows) and out[20] == rows[8][1]
    assert all(re.fullmatch(m + r"5\d\d-\d{3}-\d{4}", out[k]) and "123-4567" not in out[k] for k, m in enumerate(marks))
    assert re.fullmatch("".join(reversed(marks)) + r"5\d\d-\d{3}-\d{4}" + "".join(marks), out[21]) and "123-4567" not in out[21]
