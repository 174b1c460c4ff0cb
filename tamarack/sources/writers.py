"""Sinks: exports, codecs, sitemap and structured data of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Schema.org names of employment types and salary units.
SCHEMA_EMPLOYMENT = {"temps-plein": "FULL_TIME", "temps-partiel": "PART_TIME", "contrat": "CONTRACTOR", "stage": "INTERN", "saisonnier": "TEMPORARY", "occasionnel": "PER_DIEM"}
SCHEMA_UNIT = {"heure": "HOUR", "semaine": "WEEK", "mois": "MONTH", "annee": "YEAR"}


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def sitemap(spark: SparkSession, pages: list[str], jobs: DataFrame, employers: DataFrame) -> DataFrame:
    """path of fixed pages, postings and employers."""
    fixed = spark.createDataFrame([(p,) for p in pages], "path string")
    return fixed.unionAll(jobs.select(F.concat(F.lit("/emplois/"), "id").alias("path"))).unionAll(employers.select(F.concat(F.lit("/entreprises/"), "id").alias("path")))


def job_posting(days_valid: int = 60) -> Column:
    """A posting as schema.org JSON; what is null is left out."""
    salary = F.when(
        F.coalesce("salaryMin", "salaryMax").isNotNull(),
        F.struct(F.lit("CAD").alias("currency"), F.struct(F.col("salaryMin").alias("minValue"), F.col("salaryMax").alias("maxValue"), _lookup(SCHEMA_UNIT, F.col("salaryPeriod")).alias("unitText")).alias("value")),
    )
    posted = F.coalesce("postedAt", "scrapedAt")
    return F.to_json(F.struct(
        F.lit("JobPosting").alias("@type"), F.col("title"), F.struct(F.col("company").alias("name")).alias("hiringOrganization"), F.date_format(posted, "yyyy-MM-dd").alias("datePosted"),
        F.date_format(posted + F.expr(f"INTERVAL {days_valid} DAYS"), "yyyy-MM-dd").alias("validThrough"), _lookup(SCHEMA_EMPLOYMENT, F.col("employmentType")).alias("employmentType"),
        F.when(F.col("remote") == "teletravail", "TELECOMMUTE").alias("jobLocationType"), salary.alias("baseSalary"),
    ))


def to_stored(jobs: DataFrame) -> DataFrame:
    """Arrays as JSON text, for stores without arrays."""
    return jobs.withColumns({c: F.to_json(F.coalesce(c, F.array().cast("array<string>"))) for c in ("tags", "languages")})


def from_stored(rows: DataFrame) -> DataFrame:
    from tamarack.functions.text import json_strings

    return rows.withColumns({c: json_strings(F.col(c)) for c in ("tags", "languages")})


def employer_json() -> Column:
    """An employer as JSON; empty texts, false and null are left out, but enabled stays where it is false."""
    text = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    return F.to_json(F.struct("id", "name", text("homepage"), text("careersUrl"), text("method"), text("region"), F.when(F.col("verified"), True).alias("verified"), F.when(~F.col("enabled"), False).alias("enabled")))


def export_employers(employers: DataFrame, path: str) -> None:
    """One JSON line for each employer, in order of id."""
    employers.select("id", employer_json().alias("value")).orderBy("id").select("value").write.mode("overwrite").text(path)


def export_snapshot(jobs: DataFrame, path: str) -> None:
    jobs.write.mode("overwrite").json(path)


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON snapshot; what cannot be read becomes null rows, which are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The licence registry's CSV by position: quoted commas, doubled quotes, line breaks inside quotes.

    Line breaks inside quotes keep a file from being split: a file is read by one task, so a registry of more than some gigabytes should come in several files. ord follows the lines of a file, and the files in the order of their reading."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    at = {0: "licence", 1: "status", 14: "name", 16: "municipality", 19: "region", 23: "other_name"}
    return raw.select(*[F.col(f"`{raw.columns[k]}`").alias(v) for k, v in at.items()], F.monotonically_increasing_id().alias("ord"))


def export_csv(rows: DataFrame, path: str) -> None:
    """All values quoted, quotes doubled, a header, UTF-8 with its mark in the first column's name."""
    first, *rest = rows.columns
    rows.select(F.col(first).alias("﻿" + first), *rest).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def admin_csv_rows(facts: DataFrame) -> DataFrame:
    yes = lambda c: F.when(c, "oui").otherwise("non")
    return facts.select("id", F.col("name").alias("nom"), F.col("method").alias("methode"), F.coalesce("region", F.lit("")).alias("region"), F.col("job_count").alias("offres"), yes(F.col("verified")).alias("verifie"), yes(F.col("enabled")).alias("actif"), F.col("careersUrl").alias("url"))
