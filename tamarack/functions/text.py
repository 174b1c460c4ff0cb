"""String functions as Columns: folding, slugs, names, formats."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ECMAScript counts as white space beyond Java's \s.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def _plain_letters() -> tuple[str, str]:
    """Lower-case letters that decompose into a base letter and marks, and their base letters."""
    found = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]) and chr(code).lower() == chr(code):
            found.append((chr(code), parts[0]))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


_ACCENTED, _PLAIN = _plain_letters()


def unaccent(s: Column) -> Column:
    """Lower-case text without its marks."""
    return F.regexp_replace(F.translate(s, _ACCENTED, _PLAIN), r"[\u0300-\u036f]", "")


def norm(s: Column) -> Column:
    """What searches compare: lower case, œ and æ spelled out, no marks. Plain ASCII has neither, and only changes its case."""
    low = F.lower(s)
    folded = unaccent(F.replace(F.replace(low, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae")))
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(folded)


def trim(s: Column) -> Column:
    return F.regexp_replace(s, rf"^{SPACE}+|{SPACE}+$", "")


def clean_text(s: Column) -> Column:
    """White space collapsed and trimmed; null becomes empty."""
    return trim(F.regexp_replace(F.coalesce(s, F.lit("")), f"{SPACE}+", " "))


def words(s: Column) -> Column:
    """The non-empty words of a search text, folded."""
    return F.filter(F.split(norm(s), f"{SPACE}+"), lambda w: w != "")


def slugify(s: Column, longest: int = 60) -> Column:
    dashed = F.regexp_replace(unaccent(F.lower(clean_text(s))), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, longest)


def deslugify(s: Column) -> Column:
    """Words of up to three letters in capitals, others capitalised."""
    parts = F.filter(F.split(s, "[-_]"), lambda w: w != "")
    return F.array_join(F.transform(parts, lambda w: F.when(F.length(w) <= 3, F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))), " ")


def initials(s: Column) -> Column:
    """Upper-case first letters of the first two words."""
    return F.array_join(F.transform(F.slice(F.split(s, f"{SPACE}+"), 1, 2), lambda w: F.upper(F.substring(w, 1, 1))), "")


def sentence_case(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.length(s))))


def escape_html(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def strip_tags(s: Column, longest: int = 600) -> Column:
    """Text of a fragment of markup, cut with an ellipsis; null if nothing is left."""
    plain = F.regexp_replace(s, "(?s)<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    plain = clean_text(plain)
    return F.when(plain == "", None).when(F.length(plain) > longest, F.concat(F.substring(plain, 1, longest - 1), F.lit("…"))).otherwise(plain)


def company_key(s: Column) -> Column:
    """A company's name without marks, brackets, places, legal forms and stop words."""
    word = lambda w: rf"(?<![A-Za-z0-9_])(?:{w})(?![A-Za-z0-9_])"
    x = unaccent(F.lower(F.coalesce(s, F.lit(""))))
    for pattern, instead in (
        (r"\([^)]*\)", " "),
        (rf"{SPACE}[-–]{SPACE}.*$", " "),
        (rf",?{SPACE}*usine(?![A-Za-z0-9_]).*$", " "),
        (r"""['’`.,;:!?"()/\\]""", " "),
        ("&", " et "),
        (word(rf"\d{{4}}-?\d{{4}}{SPACE}+quebec"), " "),
        (word(LEGAL_WORDS), " "),
        ("[^a-z0-9]+", " "),
    ):
        x = F.regexp_replace(x, pattern, instead)
    return F.trim(x)


# Legal forms and stop words that names are matched without.
LEGAL_WORDS = "inc|incorporee|ltee|ltd|limitee|enr|enregistree|senc|sencrl|sec|cie|compagnie|co|corp|corporation|2000|group|groupe|les|le|la|l|de|du|des|et|and|the"


def job_id(source: Column, url: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", source, url)), 1, 16)


def careers_key(url: Column) -> Column:
    """A careers page's address for comparison: trimmed, without trailing slashes, lower case."""
    return F.lower(F.regexp_replace(trim(url), "/+$", ""))


def parse_list(s: Column) -> Column:
    """A comma-separated parameter as an array of trimmed, non-empty items; null if none."""
    items = F.filter(F.transform(F.split(s, ","), trim), lambda x: x != "")
    return F.when(F.size(items) > 0, items)


def json_strings(s: Column) -> Column:
    """Stored JSON text as an array; anything unreadable is an empty array."""
    return F.coalesce(F.from_json(s, "array<string>"), F.array().cast("array<string>"))
