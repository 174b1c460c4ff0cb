"""Golden cases of the rule chains and text functions."""

import pytest
from pyspark.sql import functions as F

from tamarack.functions import dates, rules, text
from tamarack.operators import joins
from tamarack.operators.extract import pages


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("place", "region"),
    [("872, Archimède, Québec, Canada", "autre"), ("Lévis, Québec", "chaudiere-appalaches"), ("Granby", "monteregie"), ("Saint-Jérôme", None), ("Toronto, ON", "canada-autre"), ("", None), (None, None), ("Québec", "capitale-nationale"), ("Télétravail", "teletravail")],
)
def test_region(spark, place, region):
    assert value(spark, rules.detect_region(F.lit(place).cast("string"))) == region


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("55 000 $ à 75 000 $", (55000, 75000, "annee")), ("25,50 $ de l'heure", (25.5, 25.5, "heure")), ("25.50 $ / h", (2550, 2550, "heure")), ("60k $", (60000, 60000, "annee")), ("rien", None), (None, None), ("1,234,567 $", None)],
)
def test_salary(spark, given, wanted):
    found = value(spark, rules.parse_salary(F.lit(given).cast("string")))
    assert (tuple(found) if found else None) == wanted


def test_salary_reads_decimal_points_outside_compat(spark):
    assert value(spark, rules.parse_salary(F.lit("25.50 $ / h"), compat=False))[0] == 25.5


def test_small_functions(spark):
    assert value(spark, rules.map_employment_type(F.lit("Permanent, temps partiel"))) == "temps-partiel"
    assert value(spark, rules.detect_languages(F.lit("français et anglais"))) == ["bilingue", "en", "fr"]
    assert value(spark, rules.annual_salary(F.lit(None).cast("double"), F.lit(30.0), F.lit("heure"))) == 54600
    assert value(spark, pages.clean_board_title(F.lit("Carpenter Foreman Job Details | Aecon"))) == "Carpenter Foreman"
    assert value(spark, joins.region_id_from_name(F.lit("Saguenay--Lac-Saint-Jean"))) == "saguenay-lac-saint-jean"
    assert value(spark, text.deslugify(F.lit("exfo-inc"))) == "Exfo INC"
    assert value(spark, text.norm(F.lit("Cœur ÉTÉ ænima"))) == "coeur ete aenima"
    assert value(spark, text.clean_text(F.lit("  a   b\n"))) == "a b"
    assert value(spark, text.slugify(F.lit("Charpentier(ère) CCQ"))) == "charpentier-ere-ccq"
    assert value(spark, text.company_key(F.lit("9123-4567 Québec inc."))) == ""
    assert value(spark, text.company_key(F.lit("Béton Provincial - Laval"))) == "beton provincial"
    assert value(spark, rules.infer_category(F.lit("Manœuvre"), F.array(F.lit("")))) == "construction"
    assert value(spark, rules.infer_category(F.lit("Tutorial"), F.array(F.lit("")))) is None


def test_word_boundaries_are_ascii(spark):
    assert value(spark, F.lit("éan").rlike(rules.ecma(r"\ban\b"))) is True
    assert value(spark, F.lit("É").rlike(rules.ecma("é"))) is True


def test_relative_times(spark):
    now = F.lit("2024-03-01 12:00:00").cast("timestamp")
    ago = lambda s: value(spark, dates.time_ago(F.lit(s).cast("timestamp"), now))
    assert [ago(s) for s in ("2024-03-01 11:59:00", "2024-03-01 07:00:00", "2024-02-29 11:00:00", "2024-02-27 11:00:00", "2024-02-20 11:00:00", "2023-12-01 00:00:00")] == ["à l'instant", "il y a 5 h", "hier", "il y a 3 jours", "il y a 1 sem.", "il y a 3 mois"]
    assert value(spark, dates.format_salary(F.lit(55000.0), F.lit(75000.0), F.lit("annee"))) == "55 000 $ – 75 000 $ / an"


@pytest.mark.parametrize("text_", ["Désolé, aucun poste disponible en ce moment", "There are currently no openings", "Il n'y a aucune offre", "no current openings available"])
def test_no_openings(spark, text_):
    assert value(spark, pages.declares_no_openings(F.lit(f"<body><p>{text_}</p></body>")))
    assert not value(spark, pages.declares_no_openings(F.lit("<body><p>Postes disponibles</p></body>")))
