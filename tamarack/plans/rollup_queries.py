"""Roll-up, statistics, join and administration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.operators import joins as J
from tamarack.operators import rollups as R
from tamarack.plans.base import query, sql_norm, sql_stamp, stamp
from tamarack.sources.adapters import employer, events_now, job, read, scrape_run

RECENT = 'coalesce("postedAt", "scrapedAt")'
_COMPANY = "CASE WHEN id::BIGINT % 9 = 0 THEN ' ' || upper(company) || ' ' WHEN id::BIGINT % 9 = 1 THEN '' ELSE company END"


def _varied(spark, sf_dir):
    """Postings whose company is written in several ways, and sometimes not at all."""
    n = F.col("id").cast("bigint") % 9
    return job(spark, sf_dir).withColumn("company", F.when(n == 0, F.concat(F.lit(" "), F.upper("company"), F.lit(" "))).when(n == 1, "").otherwise(F.col("company")))


@query(
    "hiring_companies",
    f"""SELECT key, arg_min(company, ord) AS company, arg_min("companyLogoUrl", ord) FILTER ("companyLogoUrl" IS NOT NULL) AS logo, count(*) AS openings, array_to_string(list_sort(list(DISTINCT "categoryId")), ',') AS categories,
    coalesce(array_to_string(list_sort(list(DISTINCT "regionId") FILTER ("regionId" IS NOT NULL)), ','), '') AS regions, coalesce(array_to_string(list_sort(list(DISTINCT "sourceId") FILTER ("sourceId" IS NOT NULL)), ','), '') AS sources, {sql_stamp(f"max({RECENT})")} AS latest
    FROM (SELECT *, {sql_norm("company")} AS key, row_number() OVER (ORDER BY {RECENT} DESC, id) AS ord FROM (SELECT * REPLACE (trim({_COMPANY}) AS company) FROM job) WHERE company <> '') GROUP BY key""",
)
def hiring_companies(spark, sf_dir):
    return R.hiring_companies(_varied(spark, sf_dir)).withColumn("latest", stamp("latest"))


@query("stats_totals", f"SELECT count(*) AS total, count(DISTINCT company) AS raw, count(DISTINCT {sql_norm('trim(company)')}) AS folded FROM (SELECT * REPLACE ({_COMPANY} AS company) FROM job)")
def stats_totals(spark, sf_dir):
    rows = _varied(spark, sf_dir)
    return R.distinct_companies(rows).crossJoin(rows.agg(F.count("*").alias("total"))).select("total", "raw", "folded")  # one row by one row


for _d, _c in (("source", "sourceId"), ("region", "regionId"), ("category", "categoryId")):

    @query(f"stats_by_{_d}", f"""SELECT {f'coalesce("{_c}", {chr(39)}autre{chr(39)})' if _d != "source" else f'"{_c}"'} AS id, count(*) AS n FROM job GROUP BY 1""")
    def _stats(spark, sf_dir, d=_d):
        return R.statistics(job(spark, sf_dir)).where(F.col("dimension") == d).select("id", "n")


@query("sources_with_counts", 'SELECT e.id, e.name, e.method, coalesce(n, 0) AS job_count FROM employer e LEFT JOIN (SELECT "sourceId", count(*) AS n FROM job GROUP BY 1) c ON e.id = c."sourceId" WHERE e.enabled')
def sources_with_counts(spark, sf_dir):
    return J.sources_with_counts(employer(spark, sf_dir), job(spark, sf_dir))


@query("effective_region", 'SELECT j.id, coalesce(j."regionId", e.region) AS effective_region FROM job j LEFT JOIN employer e ON j."sourceId" = e.id')
def effective_region(spark, sf_dir):
    return J.effective_region(job(spark, sf_dir), employer(spark, sf_dir)).select("id", "effective_region")


@query("region_coverage", 'SELECT count(*) AS total, count_if("regionId" IS NULL AND r IS NOT NULL)::BIGINT AS filled, count(r) AS with_region FROM (SELECT j."regionId", coalesce(j."regionId", e.region) AS r FROM job j LEFT JOIN employer e ON j."sourceId" = e.id)')
def region_coverage(spark, sf_dir):
    rows = J.effective_region(job(spark, sf_dir), employer(spark, sf_dir))
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("regionId").isNull() & F.col("effective_region").isNotNull()).alias("filled"), F.count("effective_region").alias("with_region"))


@query(
    "employer_profile",
    f"""SELECT coalesce(e.id, j."sourceId") AS id, coalesce(e.name, j.company, j."sourceId") AS name, coalesce(j.n, 0) AS n, {sql_stamp("j.newest")} AS newest FROM (SELECT * FROM employer WHERE id::BIGINT % 5 <> 0) e FULL JOIN
    (SELECT "sourceId", count(*) AS n, arg_min(company, ord) AS company, max("postedAt") AS newest FROM (SELECT *, row_number() OVER (ORDER BY {RECENT} DESC, id) AS ord FROM job WHERE "sourceId" IS NOT NULL) GROUP BY 1) j ON e.id = j."sourceId" """,
)
def employer_profile(spark, sf_dir):
    known = employer(spark, sf_dir).where(F.col("id").cast("bigint") % 5 != 0)
    return J.employer_profile(job(spark, sf_dir), known).withColumn("newest", stamp("newest"))


@query(
    "similar_topk",
    """SELECT of, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY of ORDER BY score DESC, id)::INT AS rank FROM (SELECT w.id AS of, j.id, CASE WHEN w."regionId" = j."regionId" THEN 2 ELSE 0 END
    + CASE WHEN w."categoryId" = j."categoryId" THEN 2 ELSE 0 END + CASE WHEN w."sourceId" = j."sourceId" THEN 1 ELSE 0 END AS score FROM (SELECT * FROM job WHERE id::BIGINT % 20 = 0) w JOIN job j ON w.id <> j.id) WHERE score > 0) WHERE rank <= 6""",
)
def similar_topk(spark, sf_dir):
    rows = job(spark, sf_dir)
    return J.similar_jobs(rows.where(F.col("id").cast("bigint") % 20 == 0), rows).select("of", "id", "score", "rank")


_FAVORITES = "(SELECT 'u' || (c_custkey % 7) AS user_id, (c_custkey * 37)::VARCHAR AS job_id FROM customer)"


def _favorites(spark, sf_dir):
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(F.concat(F.lit("u"), (key % 7).cast("string")).alias("user_id"), (key * 37).cast("string").alias("job_id"))


@query("favorites_semi", f"SELECT id, title FROM job WHERE id IN (SELECT job_id FROM {_FAVORITES})")
def favorites_semi(spark, sf_dir):
    return J.favorites_found(job(spark, sf_dir), _favorites(spark, sf_dir)).select("id", "title")


@query("favorites_missing_anti", f"SELECT user_id, job_id FROM {_FAVORITES} WHERE job_id NOT IN (SELECT id FROM job)")
def favorites_missing_anti(spark, sf_dir):
    return J.favorites_missing(job(spark, sf_dir), _favorites(spark, sf_dir)).select("user_id", "job_id")


@query("favorites_merge", f"SELECT user_id, job_id, 'all' AS part FROM (SELECT * FROM {_FAVORITES} UNION SELECT 'u1', job_id FROM {_FAVORITES} WHERE job_id LIKE '%7') UNION ALL SELECT user_id, job_id, 'insert' FROM (SELECT 'u1' AS user_id, job_id FROM {_FAVORITES} WHERE job_id LIKE '%7' EXCEPT SELECT * FROM {_FAVORITES})")
def favorites_merge(spark, sf_dir):
    remote = _favorites(spark, sf_dir)
    local = remote.where("job_id like '%7'").withColumn("user_id", F.lit("u1"))
    every, new = J.merge_favorites(remote, local)
    return every.withColumn("part", F.lit("all")).union(new.withColumn("part", F.lit("insert")))


@query("disabled_anti", 'SELECT id, "sourceId" FROM job WHERE "sourceId" IS NULL OR "sourceId" NOT IN (SELECT id FROM employer WHERE NOT enabled)')
def disabled_anti(spark, sf_dir):
    return J.without_disabled(job(spark, sf_dir), employer(spark, sf_dir)).select("id", "sourceId")


@query("active_sources", "SELECT id FROM employer WHERE method <> 'lever' AND enabled")
def active_sources(spark, sf_dir):
    return employer(spark, sf_dir).where("method <> 'lever' and enabled").select("id")


@query("catalog_union", "SELECT id, name FROM employer UNION ALL SELECT id, name FROM (VALUES ('1', 'curated'), ('curated-1', 'Curated')) t(id, name) WHERE id NOT IN (SELECT id FROM employer)")
def catalog_union(spark, sf_dir):
    curated = spark.createDataFrame([("1", "curated"), ("curated-1", "Curated")], "id string, name string")
    return J.catalog_union(curated, employer(spark, sf_dir).select("id", "name"))


@query("sitemap_union", """SELECT '/' AS path UNION ALL SELECT '/emplois' UNION ALL SELECT '/emplois/' || id FROM job UNION ALL SELECT '/entreprises/' || id FROM employer WHERE enabled""")
def sitemap_union(spark, sf_dir):
    from tamarack.sources.writers import sitemap

    return sitemap(spark, ["/", "/emplois"], job(spark, sf_dir), employer(spark, sf_dir).where("enabled"))


@query("last_run_per_source", f'SELECT "sourceId", id, status, found, {sql_stamp(chr(34) + "startedAt" + chr(34))} AS started FROM run QUALIFY row_number() OVER (PARTITION BY "sourceId" ORDER BY id DESC) = 1')
def last_run_per_source(spark, sf_dir):
    return R.latest_runs(scrape_run(spark, sf_dir)).select("sourceId", "id", "status", "found", stamp("startedAt").alias("started"))


@query("recent_runs", 'SELECT id, "sourceId", status FROM run ORDER BY "startedAt" DESC, id DESC LIMIT 10')
def recent_runs(spark, sf_dir):
    return R.recent_runs(scrape_run(spark, sf_dir)).select("id", "sourceId", "status")


@query("high_water_mark", "SELECT coalesce(max(id), 0) AS since FROM run")
def high_water_mark(spark, sf_dir):
    return R.high_water_mark(scrape_run(spark, sf_dir))


@query("activity_topn", 'SELECT r.id, r.status, coalesce(e.name, r."sourceId") AS name FROM (SELECT * FROM run ORDER BY id DESC LIMIT 30) r LEFT JOIN employer e ON r."sourceId" = e.id')
def activity_topn(spark, sf_dir):
    last = scrape_run(spark, sf_dir).orderBy(F.col("id").desc()).limit(30)
    return last.join(employer(spark, sf_dir).select(F.col("id").alias("sourceId"), "name"), "sourceId", "left").select("id", "status", F.coalesce("name", "sourceId").alias("name"))


@query("duplicate_keys", """SELECT id, lower(rtrim(trim("careersUrl"), '/')) AS careers_key, count(*) OVER (PARTITION BY lower(rtrim(trim("careersUrl"), '/'))) AS copies FROM employer QUALIFY copies > 1""")
def duplicate_keys(spark, sf_dir):
    return R.duplicate_careers(employer(spark, sf_dir)).select("id", "careers_key", "copies")


_FACTS = """(SELECT e.*, count(*) OVER (PARTITION BY lower(rtrim(trim("careersUrl"), '/'))) > 1 AS is_duplicate, coalesce(n, 0) AS job_count, last_status, last_run_at FROM employer e LEFT JOIN (SELECT "sourceId", count(*) AS n FROM job GROUP BY 1) c ON e.id = c."sourceId"
LEFT JOIN (SELECT "sourceId", status AS last_status, "startedAt" AS last_run_at FROM run QUALIFY row_number() OVER (PARTITION BY "sourceId" ORDER BY id DESC) = 1) l ON e.id = l."sourceId")"""


def _facts(spark, sf_dir):
    return R.with_admin_facts(employer(spark, sf_dir), job(spark, sf_dir), scrape_run(spark, sf_dir))


@query("kpi_strip", f"SELECT count(*) AS total, count_if(verified)::BIGINT AS verified, count_if(job_count = 0)::BIGINT AS no_jobs, count_if(NOT enabled)::BIGINT AS disabled, count_if(is_duplicate)::BIGINT AS duplicates, count_if(last_status = 'error')::BIGINT AS errors, count_if(last_status IS NULL)::BIGINT AS never_run, sum(job_count)::BIGINT AS offers FROM {_FACTS}")
def kpi_strip(spark, sf_dir):
    return R.key_figures(_facts(spark, sf_dir))


@query("admin_filter_sort", f"SELECT id, name, job_count FROM {_FACTS} WHERE last_status = 'error' AND method = 'jsonld' AND contains(lower(concat_ws(' ', name, \"careersUrl\", homepage, method, coalesce(region, ''))), 'supplier') ORDER BY job_count DESC, name, id LIMIT 40")
def admin_filter_sort(spark, sf_dir):
    return R.admin_filter(_facts(spark, sf_dir), "errors", method="jsonld", text=" Supplier").orderBy(*R.admin_order("jobsDesc")).limit(40).select("id", "name", "job_count")


@query("admin_modes", f"""SELECT mode, count(*) AS n FROM (SELECT unnest(list_filter(['all', CASE WHEN verified THEN 'verified' ELSE 'unverified' END, CASE WHEN job_count = 0 THEN 'nojobs' END, CASE WHEN NOT enabled THEN 'disabled' END, CASE WHEN is_duplicate THEN 'duplicates' END,
CASE WHEN last_status = 'error' THEN 'errors' END, CASE WHEN last_status IS NULL THEN 'neverrun' END], lambda x: x IS NOT NULL)) AS mode FROM {_FACTS}) GROUP BY 1""")
def admin_modes(spark, sf_dir):
    modes = F.filter(F.array(*[F.when(test(), name) for name, test in R.ADMIN_FILTERS.items()]), lambda x: x.isNotNull())
    return _facts(spark, sf_dir).select(F.explode(modes).alias("mode")).groupBy("mode").agg(F.count("*").alias("n"))


@query("distinct_regions", "SELECT DISTINCT region FROM employer WHERE region IS NOT NULL")
def distinct_regions(spark, sf_dir):
    return employer(spark, sf_dir).where("region is not null").select("region").distinct().orderBy(F.collate(F.col("region"), "fr")).select("region")


@query("distinct_tags", "SELECT DISTINCT tag FROM (SELECT unnest(tags) AS tag FROM job) WHERE tag <> ''")
def distinct_tags(spark, sf_dir):
    return job(spark, sf_dir).select(F.explode("tags").alias("tag")).where("tag <> ''").distinct()


@query(
    "merge_precedence",
    """SELECT coalesce(b.id, m.id) AS id, CASE WHEN m.id IS NOT NULL THEN m.name ELSE b.name END AS name, CASE WHEN m.id IS NOT NULL THEN m.verified ELSE b.verified END AS verified, CASE WHEN b.id IS NOT NULL THEN b.region ELSE m.region END AS region
    FROM (SELECT * FROM employer WHERE id::BIGINT % 4 <> 0) b FULL JOIN (SELECT * REPLACE (upper(name) AS name, NOT verified AS verified, 'MINE' AS region) FROM employer WHERE id::BIGINT % 3 <> 0) m ON b.id = m.id""",
)
def merge_precedence(spark, sf_dir):
    rows = employer(spark, sf_dir)
    number = F.col("id").cast("bigint")
    mine = rows.where(number % 3 != 0).withColumns({"name": F.upper("name"), "verified": ~F.col("verified"), "region": F.lit("MINE")})
    return J.merge_for_publish(rows.where(number % 4 != 0), mine).select("id", "name", "verified", "region")


@query("overlay_edits", """SELECT b.id, coalesce(e.name, b.name) AS name, coalesce(v.v, b.verified) AS verified FROM employer b LEFT JOIN (SELECT id, 'Edited ' || name AS name FROM employer WHERE id::BIGINT % 10 = 0) e ON b.id = e.id LEFT JOIN (SELECT id, true AS v FROM employer WHERE id::BIGINT % 8 = 0) v ON b.id = v.id""")
def overlay_edits(spark, sf_dir):
    rows = employer(spark, sf_dir)
    number = F.col("id").cast("bigint")
    edits = rows.where(number % 10 == 0).select("id", F.concat(F.lit("Edited "), "name").alias("name"))
    return J.overlay(rows, edits, rows.where(number % 8 == 0)).select("id", "name", "verified")


@query("employer_offers_topn", f'SELECT id, title, city FROM job WHERE "sourceId" = \'3\' ORDER BY {RECENT} DESC, id LIMIT 60')
def employer_offers_topn(spark, sf_dir):
    from tamarack.operators.search import order

    return job(spark, sf_dir).where("sourceId = '3'").orderBy(*order()).limit(60).select("id", "title", "city")


@query("run_poll", f"SELECT id, \"sourceId\", status, {sql_stamp(chr(34) + 'startedAt' + chr(34))} AS started FROM run WHERE id > 9000 AND status <> 'running'")
def run_poll(spark, sf_dir):
    return scrape_run(spark, sf_dir).where("id > 9000 and status <> 'running'").select("id", "sourceId", "status", stamp("startedAt").alias("started"))


@query("relative_time", """SELECT id, CASE WHEN m < 1 THEN 'à l''instant' WHEN m < 60 THEN 'il y a ' || m || ' min' WHEN m < 1440 THEN 'il y a ' || (m // 60) || ' h' WHEN m < 43200 THEN 'il y a ' || (m // 1440) || ' j' ELSE 'il y a ' || (m // 43200) || ' mois' END AS ago
FROM (SELECT id, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us("startedAt")) // 60000000 AS m FROM run)""")
def relative_time(spark, sf_dir):
    from tamarack.functions.dates import relative_time as ago

    return scrape_run(spark, sf_dir).select("id", ago(F.col("startedAt"), events_now()).alias("ago"))
