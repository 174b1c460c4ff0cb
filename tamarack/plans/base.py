"""Registration of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack import registry
from tamarack.sources.adapters import SQL_VIEWS

#: DuckDB macros used by several oracles, as text to paste in.
NOW = "TIMESTAMP '2001-08-02 00:00:00'"
ANNUAL = """(CASE "salaryPeriod" WHEN 'heure' THEN coalesce("salaryMax", "salaryMin") * 35 * 52 WHEN 'semaine' THEN coalesce("salaryMax", "salaryMin") * 52 WHEN 'mois' THEN coalesce("salaryMax", "salaryMin") * 12 ELSE coalesce("salaryMax", "salaryMin") END)"""
DAYS = f"""((epoch_us({NOW}) - epoch_us("postedAt")) / 86400000000.0)"""


def sql_norm(x: str) -> str:
    return f"strip_accents(replace(replace(lower({x}), 'œ', 'oe'), 'æ', 'ae'))"


def sql_first_match(text: str, rules: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    """A rule chain as CASE; RE2 has ECMAScript's word boundary, but needs the wider white space spelled out."""
    quote = lambda p: p.replace("'", "''")
    cases = " ".join(f"WHEN regexp_matches({text}, '(?i){quote(p)}') THEN '{v}'" for p, v in rules)
    return f"CASE {cases} ELSE {otherwise} END"


def query(name: str, sql: str | None = None, views: bool = True):
    """Register the decorated function (spark, sf_dir) → DataFrame, and its SQL over the views of adapters.SQL_VIEWS."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        registry.QUERIES[name] = f
        if sql is not None:
            registry.ORACLES[name] = (f"WITH {SQL_VIEWS.strip()},\nresult AS ({sql})\nSELECT * FROM result" if views else sql).strip()
        return f

    return add


def rounded(c: Column | str, digits: int) -> Column:
    """A double rounded as the SQL does: the product with the power of ten is rounded, half away from zero (round() itself rounds the shortest decimal form, so 143238.895 goes another way)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * F.lit(10.0**digits), 0) / F.lit(10.0**digits)


def stamp(c: Column | str) -> Column:
    """A time as text, the same in both engines."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def sql_stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"
