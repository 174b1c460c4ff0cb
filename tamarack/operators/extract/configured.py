"""Sources that differ from others by their settings alone: a table, and the parser that each row names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Id, company, method, and the address or the platform's name; of generic pages also the pattern of their links, of lists how many postings count.
CONFIGURED = [
    ("atwill-morin", "Atwill-Morin", "bamboohr", "atwillmorin", None, None),
    ("beluga", "Béluga Construction", "zoho", "https://constructionbeluga.zohorecruit.ca/jobs/Careers", None, None),
    ("cote-et-fils", "Construction Côté et fils", "jobillico", "https://www.jobillico.com/voir-entreprise/construction-cote-fils.tZkiVw", None, None),
    ("ebc", "EBC", "wp-feed", "https://ebcinc.com/fr/job/feed/", None, None),
    ("hamel-construction", "Hamel Construction", "generic", "https://www.hamelconstruction.com/carrieres", None, None),
    ("jcdrolet", "JC Drolet", "generic", "https://jcdrolet.com/carrieres/", None, None),
    ("jmdemers", "JM Demers Excavation", "generic", "https://www.jmdemers.com/carriere", None, None),
    ("lafontaine", "Lafontaine", "zoho", "https://lafontaineinc.zohorecruit.com/jobs/Careers", None, None),
    ("lefrancois", "Lefrançois", "generic", "https://www.lefrancoisinc.ca/carri%C3%A8res", None, None),
    ("leqel", "LEQEL", "generic", "https://www.leqel.ca/carriere/", "/emploi-", None),
    ("pomerleau", "Pomerleau", "avature", "https://jobs.pomerleau.ca/fr_CA/Jobs/SearchJobs", None, 60),
    ("portneuf", "Construction & Pavage Portneuf", "jobillico", "https://www.jobillico.com/fr/employeurs/construction-pavage-portneuf-inc-eBlqIn/voir-liste-emplois", None, None),
    ("refrabec", "Refrabec", "generic", "https://refrabec.qc.ca/carrieres/", None, None),
]


def configured_sources(spark: SparkSession) -> DataFrame:
    """id, company, method, address, pattern, most."""
    return spark.createDataFrame(CONFIGURED, "id string, company string, method string, address string, pattern string, most int")


def generic_postings(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(page_id, source_id, company, strategy, url, title) of pages (page_id, source_id, url, html) of sources (as `configured_sources`) with generic pages: `pages.career_postings`, with a source's own pattern of links where it has one."""
    from tamarack.operators.extract.pages import career_postings

    generic = sources.where("method = 'generic'")
    patterns = [r["pattern"] for r in generic.select("pattern").distinct().collect()]  # few: they are written by hand
    out = None
    for pattern in patterns:
        own = generic.where(F.col("pattern").eqNullSafe(F.lit(pattern))).select(F.col("id").alias("source_id"), "company")
        found = career_postings(pages.join(own.select("source_id"), "source_id", "left_semi"), pattern).join(pages.select("page_id", "source_id"), "page_id").join(own, "source_id")
        part = found.select("page_id", "source_id", "company", "strategy", "url", "title")
        out = part if out is None else out.unionByName(part)
    return out
