"""Lookup tables: regions, categories, employment types, work modes, languages, salary periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ids and labels that results must show.
REGIONS = {
    "bas-saint-laurent": "Bas-Saint-Laurent", "saguenay-lac-saint-jean": "Saguenay–Lac-Saint-Jean", "capitale-nationale": "Capitale-Nationale (Québec)", "mauricie": "Mauricie", "estrie": "Estrie",
    "montreal": "Montréal", "outaouais": "Outaouais", "abitibi-temiscamingue": "Abitibi-Témiscamingue", "cote-nord": "Côte-Nord", "nord-du-quebec": "Nord-du-Québec",
    "gaspesie-iles-de-la-madeleine": "Gaspésie–Îles-de-la-Madeleine", "chaudiere-appalaches": "Chaudière-Appalaches", "laval": "Laval", "lanaudiere": "Lanaudière", "laurentides": "Laurentides",
    "monteregie": "Montérégie", "centre-du-quebec": "Centre-du-Québec", "teletravail": "Télétravail (partout)", "canada-autre": "Canada (hors Québec)", "autre": "Autre / non précisé",
}
CATEGORIES = {
    "ti": "Informatique et TI", "genie": "Génie et ingénierie", "sante": "Santé et services sociaux", "construction": "Construction et métiers", "finance": "Finance, comptabilité et assurance",
    "admin": "Administration et bureautique", "vente": "Vente et service à la clientèle", "marketing": "Marketing et communications", "rh": "Ressources humaines", "education": "Éducation et formation",
    "juridique": "Juridique", "logistique": "Transport et logistique", "production": "Production et manufacture", "restauration": "Restauration, tourisme et hôtellerie", "arts": "Arts, design et culture",
    "science": "Sciences et recherche", "direction": "Direction et gestion", "autre": "Autre",
}
EMPLOYMENT_TYPES = {"temps-plein": "Temps plein", "temps-partiel": "Temps partiel", "contrat": "Contrat / temporaire", "stage": "Stage", "saisonnier": "Saisonnier", "occasionnel": "Occasionnel"}
WORK_MODES = {"presentiel": "Présentiel", "hybride": "Hybride", "teletravail": "Télétravail"}
LANGUAGES = {"fr": "Français", "en": "Anglais", "bilingue": "Bilingue (FR/EN)"}
SALARY_PERIODS = {"heure": "/ heure", "semaine": "/ semaine", "mois": "/ mois", "annee": "/ an"}

DIMENSIONS = {"region": REGIONS, "category": CATEGORIES, "employment": EMPLOYMENT_TYPES, "remote": WORK_MODES, "language": LANGUAGES, "salary_period": SALARY_PERIODS}


def label(dimension: str, id_: Column) -> Column:
    """The label of an id; the id itself where the table has none; null stays null."""
    pairs = [x for k, v in DIMENSIONS[dimension].items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[id_], id_)


def label_table(spark: SparkSession) -> DataFrame:
    """(dimension, id, label, ord): about sixty rows."""
    rows = [(d, i, text, k) for d, items in DIMENSIONS.items() for k, (i, text) in enumerate(items.items())]
    return spark.createDataFrame(rows, "dimension string, id string, label string, ord int")
