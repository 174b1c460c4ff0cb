"""Joins of postings, employers, sources and favourites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.text import slugify
from tamarack.operators.rollups import counts_by_source
from tamarack.taxonomy import REGIONS


def region_id_from_name(name):
    """The id of a region written out; null for unknown names."""
    slug = slugify(name, 200)
    return F.when(slug.isin(*REGIONS), slug)


def effective_region(jobs: DataFrame, employers: DataFrame, fold=None) -> DataFrame:
    """jobs with effective_region: their own, else that of their employer (fold maps the employer's region to an id)."""
    known = employers.select(F.col("id").alias("sourceId"), (fold(F.col("region")) if fold else F.col("region")).alias("employer_region"))
    # postings without a source have nothing to be joined with, and would all meet in one partition
    joined = jobs.where("sourceId is not null").join(known, "sourceId", "left").withColumn("effective_region", F.coalesce("regionId", "employer_region")).drop("employer_region")
    return joined.unionByName(jobs.where("sourceId is null").withColumn("effective_region", F.col("regionId")))


def without_disabled(jobs: DataFrame, employers: DataFrame) -> DataFrame:
    """Postings whose source is not switched off; postings without a source stay."""
    off = employers.where("enabled = false").select(F.col("id").alias("sourceId"))
    return jobs.where("sourceId is not null").join(off, "sourceId", "left_anti").unionByName(jobs.where("sourceId is null"))


def sources_with_counts(employers: DataFrame, jobs: DataFrame) -> DataFrame:
    """Enabled sources with their number of postings; counts are made before the join."""
    counts = counts_by_source(jobs).withColumnRenamed("sourceId", "id")
    return employers.where("enabled").join(counts, "id", "left").select("id", "name", "method", F.coalesce("n", F.lit(0)).alias("job_count"))


def employer_profile(jobs: DataFrame, employers: DataFrame) -> DataFrame:
    """Sources with or without an employer row: name, number of postings and newest date."""
    own = jobs.where("sourceId is not null").groupBy("sourceId").agg(F.count("*").alias("n"), F.min_by("company", F.struct((-F.unix_micros(F.coalesce("postedAt", "scrapedAt"))).alias("a"), F.col("id"))).alias("company"), F.max("postedAt").alias("newest"))
    joined = employers.select("id", "name").join(own, F.col("id") == F.col("sourceId"), "full")
    return joined.select(F.coalesce("id", "sourceId").alias("id"), F.coalesce("name", "company", "sourceId").alias("name"), F.coalesce("n", F.lit(0)).alias("n"), "newest")


def similar_jobs(wanted: DataFrame, jobs: DataFrame, k: int = 6) -> DataFrame:
    """The k most similar postings of each wanted one: 2 for the region, 2 for the category, 1 for the source; ties by id.

    Postings of one (region, category, source) cell have the same best ones but for themselves, so the best k + 1 are found once for each cell that is wanted. A posting that is
    among them agrees with the cell in some of the three, and is among the k + 1 least ids of all that agree in these: any lesser id there scores as high or higher.
    So each combination of the three gives k + 1 ids a group, found from the k + 1 least ids of each cell; no posting meets all others, and no cell all cells."""
    cell = ["regionId", "categoryId", "sourceId"]
    points = dict(zip(cell, (2, 2, 1), strict=True))

    def least(rows: DataFrame, by: list[str]) -> DataFrame:
        ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("id")))
        return ranked.where(F.col("place") <= k + 1).drop("place")

    heads = least(jobs.select("id", *cell), cell)
    cells = wanted.select(*[F.col(c).alias(f"w_{c}") for c in cell]).distinct()
    hits = None
    for n in range(1, 8):
        by = [c for i, c in enumerate(cell) if n >> i & 1]
        known = heads.where(" and ".join(f"{c} is not null" for c in by))
        found = cells.join(least(known, by) if len(by) < 3 else known, [F.col(f"w_{c}") == F.col(c) for c in by])
        hits = found if hits is None else hits.unionByName(found)
    score = sum(F.when(F.col(f"w_{c}") == F.col(c), F.lit(p)).otherwise(F.lit(0)) for c, p in points.items())
    w = [f"w_{c}" for c in cell]
    every = hits.select(*w, score.alias("score"), "id").distinct()
    rank = F.row_number().over(Window.partitionBy(*w).orderBy(F.col("score").desc(), "id"))
    best = every.withColumn("place", rank).where(F.col("place") <= k + 1).groupBy(*w).agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("best"))  # k + 1 at most
    joined = wanted.select(F.col("id").alias("of"), *cell).join(best, [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in cell])
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("of")), 1, k)
    return joined.select("of", F.posexplode(others).alias("pos", "x")).select("of", "x.id", "x.score", (F.col("pos") + 1).alias("rank"))


def favorites_found(jobs: DataFrame, favorites: DataFrame) -> DataFrame:
    return jobs.join(favorites.select(F.col("job_id").alias("id")), "id", "left_semi")


def favorites_missing(jobs: DataFrame, favorites: DataFrame) -> DataFrame:
    return favorites.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_anti")


def merge_favorites(remote: DataFrame, local: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all favourites, those to insert): the union, and the local ones that are not remote."""
    return remote.union(local).distinct(), local.distinct().join(remote, ["user_id", "job_id"], "left_anti")


def toggle_favorite(favorites: DataFrame, toggled: DataFrame) -> DataFrame:
    """Each toggled pair is removed where it is, and added where it is not."""
    keys = ["user_id", "job_id"]
    return favorites.join(toggled, keys, "left_anti").unionByName(toggled.distinct().join(favorites, keys, "left_anti"))


def merge_for_publish(base: DataFrame, mine: DataFrame) -> DataFrame:
    """Committed employers with the edits of one editor: five fields are theirs, the rest the base's; their new rows are added."""
    edited = ["name", "careersUrl", "method", "verified", "enabled"]
    kept = [c for c in base.columns if c != "id" and c not in edited]
    m = mine.select("id", *[F.col(c).alias(f"m_{c}") for c in mine.columns if c != "id"], F.lit(True).alias("is_mine"))
    b = base.withColumn("is_base", F.lit(True))
    pick = [F.when(F.col("is_mine"), F.col(f"m_{c}")).otherwise(F.col(c)).alias(c) for c in edited]
    rest = [F.when(F.col("is_base"), F.col(c)).otherwise(F.col(f"m_{c}")).alias(c) for c in kept]
    return b.join(m, "id", "full").select("id", *pick, *rest)


def overlay(base: DataFrame, edits: DataFrame, verified_ids: DataFrame) -> DataFrame:
    """base with the non-null fields of edits over it, and verified set for the given ids."""
    e = edits.select("id", *[F.col(c).alias(f"e_{c}") for c in edits.columns if c != "id"])
    joined = base.join(e, "id", "left").join(verified_ids.select("id").distinct().withColumn("is_verified", F.lit(True)), "id", "left")
    out = [F.coalesce(f"e_{c}", c).alias(c) if f"e_{c}" in e.columns else F.col(c) for c in base.columns if c not in ("id", "verified")]
    return joined.select("id", *out, F.coalesce("is_verified", "verified").alias("verified"))


def catalog_union(curated: DataFrame, discovered: DataFrame) -> DataFrame:
    """Both catalogues; a discovered id overrides a curated one."""
    return discovered.unionByName(curated.join(discovered.select("id"), "id", "left_anti"))
