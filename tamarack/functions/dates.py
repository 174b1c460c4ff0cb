"""Dates: French texts, mixed epochs, relative times. Every function takes its own present."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack.functions.rules import ecma
from tamarack.functions.text import clean_text

# Month names and units of relative dates.
MONTHS = {"janvier": 1, "fevrier": 2, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "aout": 8, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12, "décembre": 12}
UNIT_SECONDS = {"minute": 60, "heure": 3600, "jour": 86400, "semaine": 604800, "mois": 2592000, "an": 31536000, "année": 31536000, "annee": 31536000}
FORMATS = ["yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd MMM yyyy HH:mm:ss Z", "MM/dd/yyyy", "MMMM d, yyyy", "MMM d, yyyy"]


def parse_date(text: Column) -> Column:
    """A date in one of the usual written forms, a weekday before it left out; else null."""
    text = F.regexp_replace(text, "^[A-Za-z]{3}, ", "")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in FORMATS])


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _shift(at: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(at) - seconds.cast("bigint") * 1_000_000)


def parse_french_date(text: Column, as_of: Column) -> Column:
    """« hier », « il y a 3 jours », « 20 août 2026 », else a usual form."""
    t = F.lower(clean_text(text))
    relative = r"il y a\s+(\d+)\s+(jour|semaine|mois|an|année|annee|heure|minute)"
    absolute = r"(\d{1,2})[\s-]+([a-zà-ÿ]+)\.?[\s-]+(\d{4})"
    number, unit = F.regexp_extract(t, relative, 1).try_cast("bigint"), F.regexp_extract(t, relative, 2)
    month = _map(MONTHS)[F.regexp_extract(t, absolute, 2)]
    first = F.make_timestamp(F.regexp_extract(t, absolute, 3).try_cast("int"), month, F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"), F.lit("UTC"))
    day = F.regexp_extract(t, absolute, 1).try_cast("int")
    return (
        F.when(t == "", None)
        .when(t.rlike("aujourd'?hui|à l'instant|maintenant"), as_of)
        .when(t.rlike(ecma(r"\bhier\b")), _shift(as_of, F.lit(86400)))
        .when(unit != "", _shift(as_of, number * _map(UNIT_SECONDS)[unit].cast("bigint")))
        .when(month.isNotNull(), _shift(first, (1 - day).cast("bigint") * 86400))
        .otherwise(parse_date(F.trim(text)))
    )


def epoch_ms(value: Column) -> Column:
    """Seconds, milliseconds or ISO text as epoch milliseconds."""
    text = F.trim(value.cast("string"))
    number = F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))
    return F.when(number > 1_000_000_000_000, number).when(number.isNotNull(), number * 1000).otherwise(F.unix_millis(parse_date(text)))


def days_since(at: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(at)) / F.lit(86_400_000_000)


def time_ago(at: Column, as_of: Column) -> Column:
    """« hier », « il y a 3 jours »: days, weeks and months."""
    seconds = (F.unix_micros(as_of) - F.unix_micros(at)) / F.lit(1_000_000)
    days, hours = F.floor(seconds / 86400), F.floor(seconds / 3600)
    ago = lambda n, unit: F.concat(F.lit("il y a "), n.cast("string"), F.lit(f" {unit}"))
    return (
        F.when(at.isNull(), None).when(hours <= 0, "à l'instant").when(days <= 0, ago(hours, "h")).when(days == 1, "hier").when(days < 7, ago(days, "jours"))
        .when(days < 30, ago(F.floor(days / 7), "sem.")).otherwise(ago(F.floor(days / 30), "mois"))
    )


def relative_time(at: Column, as_of: Column) -> Column:
    """The short form: minutes, hours, days, months; empty for null."""
    minutes = F.floor((F.unix_micros(as_of) - F.unix_micros(at)) / F.lit(60_000_000))
    ago = lambda n, unit: F.concat(F.lit("il y a "), n.cast("string"), F.lit(f" {unit}"))
    return (
        F.when(at.isNull(), "").when(minutes < 1, "à l'instant").when(minutes < 60, ago(minutes, "min")).when(minutes < 1440, ago(F.floor(minutes / 60), "h"))
        .when(minutes < 43200, ago(F.floor(minutes / 1440), "j")).otherwise(ago(F.floor(minutes / 43200), "mois"))
    )


def format_salary(low: Column, high: Column, period: Column) -> Column:
    """« 55 000 $ – 75 000 $ / an »; grouping by no-break blanks."""
    from tamarack.taxonomy import label

    money = lambda x: F.concat(F.replace(F.format_number(x, 0), F.lit(","), F.lit("\u00a0")), F.lit("\u00a0$"))
    amount = F.when(low.isNotNull() & high.isNotNull() & (low != high), F.concat(money(low), F.lit(" – "), money(high))).otherwise(money(F.coalesce(high, low)))
    return F.when(F.coalesce(low, high).isNotNull(), F.concat_ws(" ", amount, label("salary_period", period)))
