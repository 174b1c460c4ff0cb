"""Roll-ups: who is hiring, statistics, counts of sources, duplicates, latest runs, key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.text import careers_key, norm, trim


def hiring_companies(jobs: DataFrame) -> DataFrame:
    """Postings by folded company name. "First" is the newest posting; distinct sets are in order of their first posting."""
    recency = F.struct((-F.unix_micros(F.coalesce("postedAt", "scrapedAt"))).alias("age"), F.col("id"))
    rows = jobs.withColumn("company", trim(F.col("company"))).where("company <> ''").withColumn("key", norm(F.col("company"))).withColumn("ord", recency)

    def seen(column: str) -> Column:
        return F.min_by(column, F.when(F.col(column).isNotNull() & (F.col(column) != ""), F.col("ord")))

    def distinct(column: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(column)), ",")

    return rows.groupBy("key").agg(
        F.min_by("company", "ord").alias("company"), seen("companyLogoUrl").alias("logo"), F.count("*").alias("openings"), distinct("categoryId").alias("categories"), distinct("regionId").alias("regions"),
        distinct("sourceId").alias("sources"), F.max(F.coalesce("postedAt", "scrapedAt")).alias("latest"),
    )


def statistics(jobs: DataFrame) -> DataFrame:
    """(dimension, id, n): totals and counts by source, region and category in one pass; null counts as autre."""
    ids = {"source": F.col("sourceId"), "region": F.coalesce("regionId", F.lit("autre")), "category": F.coalesce("categoryId", F.lit("autre")), "total": F.lit("all")}
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), c.alias("id")) for d, c in ids.items()])
    return jobs.select(F.explode(pairs).alias("x")).groupBy("x.dimension", "x.id").agg(F.count("*").alias("n"))


def distinct_companies(jobs: DataFrame, approximate: bool = False) -> DataFrame:
    """Raw spellings and folded names."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return jobs.agg(count("company").alias("raw"), count(norm(trim(F.col("company")))).alias("folded"))


def counts_by_source(jobs: DataFrame) -> DataFrame:
    return jobs.where("sourceId is not null").groupBy("sourceId").agg(F.count("*").alias("n"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The run of the largest id of each source."""
    return runs.groupBy("sourceId").agg(F.max_by(F.struct("id", "status", "found", "startedAt"), "id").alias("r")).select("sourceId", "r.*")


def recent_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.col("startedAt").desc(), F.col("id").desc()).limit(n)


def high_water_mark(runs: DataFrame) -> DataFrame:
    return runs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("since"))


def duplicate_careers(employers: DataFrame) -> DataFrame:
    """Employers whose careers page, compared without case and trailing slashes, is another's too."""
    keyed = employers.withColumn("careers_key", careers_key(F.col("careersUrl")))
    return keyed.withColumn("copies", F.count("*").over(Window.partitionBy("careers_key"))).where("copies > 1")


def with_admin_facts(employers: DataFrame, jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """employers with job_count, is_duplicate and the last run."""
    key = careers_key(F.col("careersUrl"))
    flagged = employers.withColumn("is_duplicate", F.count("*").over(Window.partitionBy(key)) > 1)
    counted = flagged.join(counts_by_source(jobs).withColumnRenamed("sourceId", "id"), "id", "left").withColumn("job_count", F.coalesce("n", F.lit(0))).drop("n")
    last = latest_runs(runs).select(F.col("sourceId").alias("id"), F.col("status").alias("last_status"), F.col("startedAt").alias("last_run_at"))
    return counted.join(last, "id", "left")


ADMIN_FILTERS = {
    "all": lambda: F.lit(True), "verified": lambda: F.col("verified"), "unverified": lambda: ~F.coalesce("verified", F.lit(False)), "nojobs": lambda: F.col("job_count") == 0,
    "disabled": lambda: F.col("enabled") == F.lit(False), "duplicates": lambda: F.col("is_duplicate"), "errors": lambda: F.col("last_status") == "error", "neverrun": lambda: F.col("last_status").isNull(),
}


def admin_filter(facts: DataFrame, mode: str = "all", method: str = "all", region: str = "all", text: str = "") -> DataFrame:
    keep = ADMIN_FILTERS[mode]()
    if method != "all":
        keep &= F.col("method") == method
    if region != "all":
        keep &= F.coalesce("region", F.lit("")) == region
    if text.strip():
        hay = F.lower(F.concat_ws(" ", "name", "careersUrl", "homepage", "method", F.coalesce("region", F.lit(""))))
        keep &= F.contains(hay, F.lit(text.strip().lower()))
    return facts.where(keep)


def admin_order(sort: str = "name") -> list[Column]:
    name = F.collate(F.col("name"), "fr")
    first = {"jobsDesc": [F.col("job_count").desc()], "jobsAsc": [F.col("job_count").asc()], "method": [F.col("method").asc()], "region": [F.coalesce("region", F.lit("")).asc()], "lastRun": [F.col("last_run_at").desc_nulls_last()]}
    return [*first.get(sort, []), name.asc(), F.col("id").asc()]


def key_figures(facts: DataFrame) -> DataFrame:
    """Seven conditional counts and a sum in one pass."""
    return facts.agg(
        F.count("*").alias("total"), F.count_if("verified").alias("verified"), F.count_if(F.col("job_count") == 0).alias("no_jobs"), F.count_if(F.col("enabled") == F.lit(False)).alias("disabled"),
        F.count_if("is_duplicate").alias("duplicates"), F.count_if(F.col("last_status") == "error").alias("errors"), F.count_if(F.col("last_status").isNull()).alias("never_run"), F.sum("job_count").alias("offers"),
    )


def top(rows: DataFrame, column: str, n: int = 8, drop: tuple[str, ...] = ()) -> DataFrame:
    """The n most frequent values, catch-all ids left out; ties by value."""
    kept = rows.where(F.col(column).isNotNull() & ~F.col(column).isin(*drop)) if drop else rows.where(F.col(column).isNotNull())
    return kept.groupBy(F.col(column).alias("id")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("id")).limit(n)


def facet_cut(facet_rows: DataFrame, n: int = 6) -> DataFrame:
    """The first n of each dimension. Facets are as many as the ids of the taxonomies and sources."""
    return facet_rows.withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy(F.col("count").desc(), "id"))).where(F.col("rank") <= n)


def signature(rows: DataFrame, *columns: str) -> DataFrame:
    """A fingerprint of a table's contents, whatever its order."""
    return rows.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*columns)).alias("hash"))
