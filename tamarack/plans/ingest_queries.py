"""Ingestion queries: upsert, guarded sync, change sets, registry resolution, alerts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tamarack.operators import alerts as A
from tamarack.operators import ingest as I
from tamarack.operators import resolve as R
from tamarack.plans.base import ANNUAL, NOW, query, sql_norm, sql_stamp, stamp
from tamarack.sources.adapters import employer, job, orders_now, read, scrape_run


def _target(spark, sf_dir):
    """Stored postings: order lines by (supplier, part), the url naming both."""
    line = read(spark, sf_dir, "lineitem").where("l_orderkey % 3 <> 0").groupBy("l_suppkey", "l_partkey").agg(F.max("l_orderkey").alias("o"))
    return line.select(F.concat_ws("-", "l_suppkey", "l_partkey").alias("url"), F.concat_ws("|", "l_suppkey", "l_partkey").alias("id"), F.col("l_suppkey").cast("string").alias("sourceId"), F.concat(F.lit("old "), F.col("o").cast("string")).alias("title"))


def _batch(spark, sf_dir):
    """Incoming postings with repeated urls; of five sources two send all, two little and one nothing."""
    line = read(spark, sf_dir, "lineitem").where("l_orderkey % 3 = 0 and (l_suppkey % 5 < 2 or (l_suppkey % 5 < 4 and l_partkey % 5 = 0))")
    return line.select(
        F.concat_ws("-", "l_suppkey", "l_partkey").alias("url"), F.concat_ws("|", "l_suppkey", "l_partkey").alias("id"), F.col("l_suppkey").cast("string").alias("sourceId"), F.concat(F.lit("new "), F.col("l_orderkey").cast("string")).alias("title"),
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("ord"),
    )


def _signals(spark, sf_dir):
    key = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(key.cast("string").alias("sourceId"), (key % 2 == 0).alias("reachable_empty"), (key % 7 == 0).alias("explicit_empty"), (key % 5 == 0).alias("force"))


_TARGET = "target AS (SELECT l_suppkey || '-' || l_partkey AS url, l_suppkey || '|' || l_partkey AS id, l_suppkey::VARCHAR AS \"sourceId\", 'old ' || max(l_orderkey) AS title FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY l_suppkey, l_partkey)"
_BATCH = """batch AS (SELECT l_suppkey || '-' || l_partkey AS url, l_suppkey || '|' || l_partkey AS id, l_suppkey::VARCHAR AS "sourceId", 'new ' || l_orderkey AS title, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE l_orderkey % 3 = 0 AND (l_suppkey % 5 < 2 OR (l_suppkey % 5 < 4 AND l_partkey % 5 = 0)))"""
_LAST = "last_batch AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY url ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) = 1)"
_SIGNALS = 'signals AS (SELECT s_suppkey::VARCHAR AS "sourceId", s_suppkey % 2 = 0 AS reachable_empty, s_suppkey % 7 = 0 AS explicit_empty, s_suppkey % 5 = 0 AS force FROM supplier)'
_POLICY = """policy AS (SELECT s."sourceId", coalesce(n, 0) AS n, coalesce(e, 0) AS e, CASE WHEN coalesce(n, 0) = 0 THEN CASE WHEN explicit_empty OR (reachable_empty AND coalesce(e, 0) <= 10) THEN 'purge' ELSE 'keep' END
WHEN NOT force AND coalesce(e, 0) >= 10 AND coalesce(n, 0) < 0.4 * coalesce(e, 0) THEN 'keep' ELSE 'replace' END AS action FROM signals s LEFT JOIN (SELECT "sourceId", count(*) AS n FROM batch GROUP BY 1) b USING ("sourceId") LEFT JOIN (SELECT "sourceId", count(*) AS e FROM target GROUP BY 1) t USING ("sourceId"))"""
_DELETES = """deletes AS (SELECT t."sourceId", t.id FROM target t JOIN policy p USING ("sourceId") WHERE p.action = 'purge' OR (p.action = 'replace' AND t.id NOT IN (SELECT id FROM batch b WHERE b."sourceId" = t."sourceId")))"""
_UPSERT = "upserted AS (SELECT coalesce(t.url, b.url) AS url, coalesce(t.id, b.id) AS id, coalesce(t.\"sourceId\", b.\"sourceId\") AS \"sourceId\", coalesce(b.title, t.title) AS title FROM target t FULL JOIN last_batch b ON t.url = b.url)"


@query("upsert_last_wins", f"WITH {_TARGET}, {_BATCH}, {_LAST}, {_UPSERT} SELECT * FROM upserted", views=False)
def upsert_last_wins(spark, sf_dir):
    return I.upsert_jobs(_target(spark, sf_dir), _batch(spark, sf_dir), "ord")


@query("upsert_counts", f"WITH {_TARGET}, {_BATCH}, {_LAST} SELECT count_if(t.url IS NULL)::BIGINT AS inserted, count_if(t.url IS NOT NULL)::BIGINT AS updated FROM last_batch b LEFT JOIN target t ON t.url = b.url", views=False)
def upsert_counts(spark, sf_dir):
    return I.upsert_counts(_target(spark, sf_dir), _batch(spark, sf_dir))


@query("sync_policy_decision", f'WITH {_TARGET}, {_BATCH}, {_SIGNALS}, {_POLICY} SELECT "sourceId", n, e, action FROM policy', views=False)
def sync_policy_decision(spark, sf_dir):
    return I.sync_policy(_target(spark, sf_dir), _batch(spark, sf_dir), _signals(spark, sf_dir)).select("sourceId", "n", "e", "action")


@query("sync_deletes_anti", f"WITH {_TARGET}, {_BATCH}, {_SIGNALS}, {_POLICY}, {_DELETES} SELECT * FROM deletes", views=False)
def sync_deletes_anti(spark, sf_dir):
    target, batch = _target(spark, sf_dir), _batch(spark, sf_dir)
    return I.sync_deletes(target, batch, I.sync_policy(target, batch, _signals(spark, sf_dir)))


@query("sync_result", f'WITH {_TARGET}, {_BATCH}, {_LAST}, {_SIGNALS}, {_POLICY}, {_DELETES}, {_UPSERT} SELECT u.* FROM upserted u WHERE u.id NOT IN (SELECT id FROM deletes)', views=False)
def sync_result(spark, sf_dir):
    return I.sync_jobs(_target(spark, sf_dir), _batch(spark, sf_dir), _signals(spark, sf_dir), "ord")


@query("validate_raw", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'url' WHEN o_orderkey % 10 = 1 THEN 'title' WHEN o_orderkey % 15 = 2 THEN 'company' WHEN o_orderkey % 7 = 3 THEN 'remote' END AS reason FROM orders WHERE o_orderkey % 6 = 0 OR o_orderkey % 10 = 1 OR o_orderkey % 15 = 2 OR o_orderkey % 7 = 3", views=False)
def validate_raw(spark, sf_dir):
    key = F.col("o_orderkey")
    raw = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit("s").alias("sourceId"), F.when(key % 6 == 0, "not a url").otherwise("https://x.example/").alias("url"), F.when(key % 10 == 1, "").otherwise("t").alias("title"), F.when(key % 15 != 2, "c").alias("company"),
        F.when(key % 7 == 3, "lunaire").when(key % 7 == 4, "hybride").alias("remote"), F.lit("stage").alias("employmentType"), F.lit(None).cast("string").alias("salaryPeriod"),
    )
    return I.validate_raw(raw)[1].select("o_orderkey", "reason")


@query(
    "employer_change_set",
    """SELECT coalesce(e.id, u.id) AS id, CASE WHEN u.id IS NOT NULL THEN u.name ELSE e.name END AS name, coalesce(f.url, u.url, e."careersUrl") AS "careersUrl", CASE WHEN coalesce(e.id, u.id) IN (SELECT id FROM employer WHERE id::BIGINT % 9 = 0) THEN false ELSE coalesce(u.enabled, e.enabled) END AS enabled
    FROM employer e FULL JOIN (SELECT (id::BIGINT + 50)::VARCHAR AS id, 'U' || name AS name, 'https://u.example/' AS url, enabled FROM employer) u ON e.id = u.id LEFT JOIN (SELECT id, 'https://fixed.example/' || id AS url FROM employer WHERE id::BIGINT % 4 = 0) f ON coalesce(e.id, u.id) = f.id""",
)
def employer_change_set(spark, sf_dir):
    rows = employer(spark, sf_dir).select("id", "name", "careersUrl", "enabled")
    number = F.col("id").cast("bigint")
    upsert = rows.select((number + 50).cast("string").alias("id"), F.concat(F.lit("U"), "name").alias("name"), F.lit("https://u.example/").alias("careersUrl"), "enabled")
    fixed = rows.where(number % 4 == 0).select("id", F.concat(F.lit("https://fixed.example/"), "id").alias("careersUrl"))
    return I.apply_changes(rows, upsert, fixed, rows.limit(0), rows.where(number % 9 == 0).select("id"))


@query(
    "change_counts",
    """SELECT action, count(*) AS n FROM (SELECT CASE WHEN e.id IS NULL THEN 'created' ELSE 'updated' END AS action FROM (SELECT (id::BIGINT + 50)::VARCHAR AS id FROM employer) u LEFT JOIN employer e USING (id)
    UNION ALL SELECT CASE WHEN e.id IS NULL THEN 'skipped' ELSE 'fixed' END FROM (SELECT (id::BIGINT * 2)::VARCHAR AS id FROM employer) f LEFT JOIN employer e USING (id) UNION ALL SELECT CASE WHEN enabled THEN 'disabled' ELSE 'unchanged' END FROM employer) GROUP BY 1""",
)
def change_counts(spark, sf_dir):
    rows = employer(spark, sf_dir)
    number = F.col("id").cast("bigint")
    return I.change_counts(rows, rows.select((number + 50).cast("string").alias("id")), rows.select((number * 2).cast("string").alias("id"), F.lit("https://fixed.example/").alias("careersUrl")), rows.select("id"))


@query("employer_delete_cascade", 'SELECT id, "sourceId" FROM job WHERE "sourceId" IS NULL OR "sourceId"::BIGINT % 3 <> 0')
def employer_delete_cascade(spark, sf_dir):
    rows = employer(spark, sf_dir)
    return I.delete_employers(rows, job(spark, sf_dir), rows.where(F.col("id").cast("bigint") % 3 == 0))[1].select("id", "sourceId")


@query("bulk_update", "SELECT id, CASE WHEN id::BIGINT % 2 = 0 THEN false ELSE enabled END AS enabled, CASE WHEN id::BIGINT % 2 = 0 THEN 'generic' ELSE method END AS method FROM employer")
def bulk_update(spark, sf_dir):
    rows = employer(spark, sf_dir).select("id", "enabled", "method")
    return I.bulk_update(rows, rows.where(F.col("id").cast("bigint") % 2 == 0), enabled=False, method="generic")


@query("run_states", f'SELECT "sourceId" AS id, status, {sql_stamp(chr(34) + "startedAt" + chr(34))} AS moment FROM run QUALIFY row_number() OVER (PARTITION BY "sourceId" ORDER BY "startedAt" DESC) = 1')
def run_states(spark, sf_dir):
    events = scrape_run(spark, sf_dir).select(F.col("sourceId").alias("id"), "status", F.col("startedAt").alias("at"))
    return I.run_states(events).select("id", "status", stamp("at").alias("moment"))


@query("numbered_slugs", "SELECT p_partkey, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS slug FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS s, row_number() OVER (PARTITION BY replace(p_name, ' ', '-') ORDER BY p_partkey) AS n FROM part)", views=False)
def numbered_slugs(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug"))
    return I.numbered_slugs(rows, "slug", "p_partkey")


def _registry(spark, sf_dir):
    """Customers as a licence registry: names of suppliers in other spellings, some twice, some inactive or malformed."""
    key = F.col("c_custkey")
    licence = F.concat_ws("-", F.lpad((key % 10000).cast("string"), 4, "0"), F.lpad((key * 7 % 10000).cast("string"), 4, "0"), F.lpad((key % 100).cast("string"), 2, "0"))
    name = F.concat(F.lit("SUPPLIER#"), F.lpad((key % 120).cast("string"), 9, "0"), F.when(key % 2 == 0, " Inc.").otherwise(" ltée - Laval"))
    from tamarack.sources.adapters import places

    return read(spark, sf_dir, "customer").join(F.broadcast(places(spark, sf_dir)), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.when(key % 13 == 0, "bad").otherwise(licence).alias("licence"), F.when(key % 11 == 0, "Inactive").otherwise("Active").alias("status"), name.alias("name"), F.when(key % 3 == 0, F.concat(F.lit("Other "), key.cast("string"))).alias("other_name"),
        F.col("n_name").alias("municipality"), F.col("r_name").alias("region"), key.alias("ord"),
    )


_KEYED = "trim(regexp_replace(regexp_replace(regexp_replace(lower(%s), '\\s[-–]\\s.*$', ' '), '\\b(inc|ltee|ltée)\\b', ' ', 'g'), '[^a-z0-9é]+', ' ', 'g'))"
_RESOLVED = f"""
registry AS (SELECT CASE WHEN c_custkey % 13 = 0 THEN 'bad' ELSE lpad((c_custkey % 10000)::VARCHAR, 4, '0') || '-' || lpad((c_custkey * 7 % 10000)::VARCHAR, 4, '0') || '-' || lpad((c_custkey % 100)::VARCHAR, 2, '0') END AS licence,
  CASE WHEN c_custkey % 11 = 0 THEN 'Inactive' ELSE 'Active' END AS status, 'SUPPLIER#' || lpad((c_custkey % 120)::VARCHAR, 9, '0') || CASE WHEN c_custkey % 2 = 0 THEN ' Inc.' ELSE ' ltee - Laval' END AS name,
  CASE WHEN c_custkey % 3 = 0 THEN 'Other ' || c_custkey END AS other_name, lower(r_name) AS region, c_custkey FROM customer JOIN place ON c_nationkey = n_nationkey),
idx AS (SELECT name_key, licence, arg_min(region, c_custkey) AS region FROM (SELECT {_KEYED % "unnest([name, other_name])"} AS name_key, licence, region, c_custkey FROM registry WHERE status = 'Active' AND licence <> 'bad') WHERE length(name_key) >= 3 GROUP BY 1, 2),
hits AS (SELECT e.id, count(i.licence) AS hits, max(i.licence) AS only_one, count_if(e.region IS NOT NULL AND (contains(i.region, lower(e.region)) OR contains(lower(e.region), i.region))) AS near,
  max(CASE WHEN contains(i.region, lower(e.region)) OR contains(lower(e.region), i.region) THEN i.licence END) AS near_one FROM employer e LEFT JOIN idx i ON {_KEYED % "e.name"} = i.name_key GROUP BY e.id)"""
_OUTCOME = "SELECT id, CASE WHEN hits = 1 THEN only_one WHEN hits > 1 AND near = 1 THEN near_one END AS licence, CASE WHEN hits = 0 THEN 'no match' WHEN hits = 1 THEN 'assigned' WHEN near = 1 THEN 'disambiguated' ELSE 'ambiguous' END AS outcome FROM hits"


def _resolved(spark, sf_dir):
    return R.resolve_licences(employer(spark, sf_dir).withColumn("rbq", F.lit(None).cast("string")), R.registry_index(_registry(spark, sf_dir)))


@query("resolve_unique_match", f"WITH {_RESOLVED.strip()} {_OUTCOME}")
def resolve_unique_match(spark, sf_dir):
    return _resolved(spark, sf_dir)


@query("resolve_outcomes", f"WITH {_RESOLVED.strip()} SELECT outcome, count(*) AS n FROM ({_OUTCOME}) GROUP BY 1")
def resolve_outcomes(spark, sf_dir):
    return R.outcome_counts(_resolved(spark, sf_dir))


#: Saved searches: id, q, regions, categories, languages, salaryMin, postedWithinDays, cities, last_notified_at.
ALERTS = [
    ("a1", None, ["EUROPE"], None, None, None, None, None, "2001-01-01"), ("a2", "red widget", None, None, None, None, None, None, "2000-06-01"), ("a3", None, None, ["BUILDING", "MACHINERY"], ["bilingue"], None, None, None, "2001-05-01"),
    ("a4", None, None, None, None, 400000.0, 60, None, "2001-06-15"), ("a5", "économy", [], None, ["fr", "en"], 100000.0, 400, ["tion_1"], "2000-12-31"), ("a6", "no such words", None, None, None, None, None, None, "1999-01-01"), ("a7", None, ["ASIA", "AFRICA"], None, None, None, 10, None, "2001-07-20"),
]
_ALERT_KIND = "id string, user_id string, label string, query struct<q: string, company: string, regions: array<string>, cities: array<string>, categories: array<string>, employmentTypes: array<string>, remote: array<string>, sources: array<string>, languages: array<string>, salaryMin: double, postedWithinDays: int>, created_at timestamp, last_notified_at timestamp"


def alert_table(spark):
    from datetime import datetime

    day = lambda s: datetime.strptime(s, "%Y-%m-%d")
    rows = [(i, "u", i, (q, None, regions, cities, categories, None, None, None, languages, salary, days), day("1998-01-01"), day(at)) for i, q, regions, categories, languages, salary, days, cities, at in ALERTS]
    return spark.createDataFrame(rows, _ALERT_KIND)


def _stored(spark, sf_dir):
    return job(spark, sf_dir).withColumn("createdAt", F.col("scrapedAt"))


_HAY = sql_norm("concat_ws(' ', title, company, description, array_to_string(tags, ' '))")
_AGE = "(epoch_us(TIMESTAMP '2001-08-02') - epoch_us(\"postedAt\")) / 86400000000.0"
_ALERT_SQL = {
    "a1": "\"regionId\" = 'EUROPE'", "a2": f"contains({_HAY}, 'red') AND contains({_HAY}, 'widget')", "a3": "\"categoryId\" IN ('BUILDING', 'MACHINERY') AND list_has_any(languages, ['bilingue'])", "a4": f"{ANNUAL} >= 400000 AND {_AGE} <= 60",
    "a5": f"contains({_HAY}, 'economy') AND list_has_any(languages, ['fr', 'en']) AND {ANNUAL} >= 100000 AND {_AGE} <= 400 AND contains(lower(city), 'tion_1')", "a6": "false", "a7": f"\"regionId\" IN ('ASIA', 'AFRICA') AND {_AGE} <= 10",
}
_MATCHES = " UNION ALL ".join(f"SELECT '{i}' AS alert_id, * FROM job WHERE \"scrapedAt\" > TIMESTAMP '{next(a[-1] for a in ALERTS if a[0] == i)}' AND {p}" for i, p in _ALERT_SQL.items())


@query("alert_matches", f"SELECT alert_id, id FROM ({_MATCHES})")
def alert_matches(spark, sf_dir):
    return A.match_alerts(_stored(spark, sf_dir), alert_table(spark), orders_now()).select("alert_id", "id")


@query("alert_digest_rows", f"SELECT alert_id, id, total, rank FROM (SELECT alert_id, id, count(*) OVER (PARTITION BY alert_id) AS total, row_number() OVER (PARTITION BY alert_id ORDER BY coalesce(\"postedAt\", \"scrapedAt\") DESC, id)::INT AS rank FROM ({_MATCHES})) WHERE rank <= 30")
def alert_digest_rows(spark, sf_dir):
    return A.newest_of_each(A.match_alerts(_stored(spark, sf_dir), alert_table(spark), orders_now())).select("alert_id", "id", "total", "rank")


@query("alert_cutoffs", f"SELECT a.id, {sql_stamp('coalesce(m.reached, a.cut)')} AS last_notified_at FROM (VALUES {', '.join(f'({chr(39)}{a[0]}{chr(39)}, TIMESTAMP {chr(39)}{a[-1]}{chr(39)})' for a in ALERTS)}) a(id, cut) LEFT JOIN (SELECT alert_id, max(\"scrapedAt\") AS reached FROM ({_MATCHES}) WHERE alert_id <> 'a1' GROUP BY 1) m ON a.id = m.alert_id")
def alert_cutoffs(spark, sf_dir):
    alerts = alert_table(spark)
    matches = A.match_alerts(_stored(spark, sf_dir), alerts, orders_now())
    return A.advance(alerts, matches, alerts.where("id <> 'a1'")).select("id", stamp("last_notified_at").alias("last_notified_at"))


def customer_alerts(spark, sf_dir):
    """An alert of each customer: some look for a name among all words, some for a company; some also name regions, a category, languages or pay. Each was last notified on the day of the customer's first order."""
    key = F.col("c_custkey")
    some = lambda n, value: F.when(key % n == 0, value)
    languages = some(4, F.array(F.lit("fr"), F.lit("en")))
    fields = {
        "q": F.when(key % 2 == 1, F.col("c_name")), "company": F.when(key % 2 == 0, F.upper("c_name")), "regions": some(3, F.array("c_mktsegment")), "cities": None, "categories": some(5, F.array(F.lit("x"), F.col("c_mktsegment"))), "employmentTypes": None, "remote": None, "sources": None,
        "languages": languages, "salaryMin": some(7, F.floor("c_acctbal").cast("double")), "postedWithinDays": None,
    }
    kinds = dict(re.findall(r"(\w+): (string|array<string>|double|int)", _ALERT_KIND.partition("struct<")[2]))
    query_of = F.struct(*[(F.lit(None) if v is None else v).cast(kinds[n]).alias(n) for n, v in fields.items()])
    first = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("timestamp").alias("last_notified_at"))
    rows = read(spark, sf_dir, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select(key.cast("string").alias("id"), F.lit("u").alias("user_id"), F.col("c_name").alias("label"), query_of.alias("query"), F.lit("2001-01-01").cast("timestamp").alias("created_at"), "last_notified_at")


@query("alert_oldest_cutoff", f"SELECT {sql_stamp('least(min(o_orderdate), {})'.format(NOW))} AS oldest FROM orders", views=False)
def alert_oldest_cutoff(spark, sf_dir):
    return A.oldest_cutoff(customer_alerts(spark, sf_dir), orders_now()).select(stamp("oldest").alias("oldest"))


@query(
    "alert_word_index",
    """SELECT c_custkey::VARCHAR AS alert_id, id FROM customer JOIN (SELECT o_custkey, min(o_orderdate) AS first FROM orders GROUP BY 1) ON c_custkey = o_custkey
    JOIN job ON contains(lower(job.company), lower(c_name)) AND "scrapedAt" > first WHERE (c_custkey % 4 <> 0 OR list_has_any(languages, ['fr', 'en']))""",
)
def alert_word_index(spark, sf_dir):
    """Alerts of words and companies alone, as many as customers: found among the postings' words, without a nested loop."""
    alerts = customer_alerts(spark, sf_dir)
    words = alerts.withColumn("query", F.col("query").dropFields("regions", "categories", "salaryMin"))
    for name, kind in (("regions", "array<string>"), ("categories", "array<string>"), ("salaryMin", "double")):
        words = words.withColumn("query", F.col("query").withField(name, F.lit(None).cast(kind)))
    return A.match_alerts(_stored(spark, sf_dir), words, orders_now(), ["id"])


@query(
    "merge_result_pages",
    """WITH hit AS (SELECT l_suppkey::VARCHAR AS source_id, l_linenumber AS page, l_orderkey AS pos, 'https://r/' || l_partkey AS url FROM lineitem), ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id, url ORDER BY page, pos) AS n FROM hit),
    stops AS (SELECT source_id, min(page) AS stop FROM (SELECT source_id, page, count_if(n = 1) AS new FROM ranked GROUP BY 1, 2) WHERE new = 0 GROUP BY 1)
    SELECT r.source_id, r.page::BIGINT AS page, r.url FROM ranked r LEFT JOIN stops s USING (source_id) WHERE n = 1 AND (stop IS NULL OR r.page < stop)""",
    views=False,
)
def merge_result_pages(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("source_id"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("pos"), F.concat(F.lit("https://r/"), F.col("l_partkey").cast("string")).alias("url"))
    return I.merge_result_pages(rows).select("source_id", F.col("page").cast("bigint").alias("page"), "url")


@query(
    "run_reports",
    f"""WITH {_TARGET}, {_BATCH}, wanted AS (SELECT s_suppkey::VARCHAR AS "sourceId" FROM supplier UNION SELECT 'x' || s_suppkey FROM supplier WHERE s_suppkey % 10 = 0), f AS (SELECT b."sourceId", count(DISTINCT b.url) AS found, count(DISTINCT CASE WHEN t.url IS NULL THEN b.url END) AS inserted FROM batch b LEFT JOIN target t ON t.url = b.url GROUP BY 1)
    SELECT w."sourceId", CASE WHEN w."sourceId" LIKE 'x%' THEN 'unknown' WHEN TRY_CAST(w."sourceId" AS BIGINT) % 8 = 3 THEN 'error' ELSE 'success' END AS status, CASE WHEN w."sourceId" LIKE 'x%' OR TRY_CAST(w."sourceId" AS BIGINT) % 8 = 3 THEN 0 ELSE coalesce(found, 0) END AS found,
    CASE WHEN w."sourceId" LIKE 'x%' OR TRY_CAST(w."sourceId" AS BIGINT) % 8 = 3 THEN 0 ELSE coalesce(inserted, 0) END AS inserted, CASE WHEN w."sourceId" LIKE 'x%' OR TRY_CAST(w."sourceId" AS BIGINT) % 8 = 3 THEN 0 ELSE coalesce(found - inserted, 0) END AS updated,
    CASE WHEN w."sourceId" LIKE 'x%' THEN 'unknown source: ' || w."sourceId" WHEN TRY_CAST(w."sourceId" AS BIGINT) % 8 = 3 THEN 'timeout' END AS error FROM wanted w LEFT JOIN f USING ("sourceId")""",
    views=False,
)
def run_reports(spark, sf_dir):
    key = F.col("s_suppkey")
    known = read(spark, sf_dir, "supplier").select(key.cast("string").alias("sourceId"), key)
    requested = known.select("sourceId").union(known.where(key % 10 == 0).select(F.concat(F.lit("x"), "sourceId")))
    return I.run_reports(requested, known, _batch(spark, sf_dir), _target(spark, sf_dir), known.where(key % 8 == 3).select("sourceId", F.lit("timeout").alias("error")))


@query(
    "alert_changes",
    """SELECT id, user_id, cut FROM (SELECT c_custkey::VARCHAR AS id, 'u' || (c_custkey % 9) AS user_id, 'old' AS cut FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey::VARCHAR, 'u' || (c_custkey % 9), 'none' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 1)
    WHERE NOT (id::BIGINT % 5 = 0 AND user_id = 'u4')""",
    views=False,
)
def alert_changes(spark, sf_dir):
    key = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(key, key.cast("string").alias("id"), F.concat(F.lit("u"), (key % 9).cast("string")).alias("user_id"), F.lit("l").alias("label"), F.lit("2001-01-01").cast("timestamp").alias("created_at"), F.lit("2001-02-01").cast("timestamp").alias("last_notified_at"))
    made = A.create_alerts(rows.where(key % 2 == 0).drop("c_custkey"), rows.where(key % 3 == 0).drop("c_custkey"))
    left = A.delete_alerts(made, rows.where(key % 5 == 0).select("id", F.lit("u4").alias("user_id")))
    return left.select("id", "user_id", F.when(F.col("last_notified_at").isNull(), "none").otherwise("old").alias("cut"))


@query("source_methods", "SELECT id, CASE method WHEN 'jsonld' THEN 'html' ELSE 'api' END AS source_method FROM employer")
def source_methods(spark, sf_dir):
    from tamarack.functions.rules import source_method

    return employer(spark, sf_dir).select("id", source_method(F.col("method")).alias("source_method"))


@query(
    "alert_labels",
    """SELECT id, CASE WHEN part = '' THEN 'Toutes les nouvelles offres' ELSE part END AS label FROM (SELECT c_custkey::VARCHAR AS id, array_to_string(list_filter([CASE WHEN c_custkey % 2 = 1 THEN '« ' || c_name || ' »' END, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 5 = 0 THEN 'x' END, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END,
      CASE WHEN c_custkey % 4 = 0 THEN 'FR' END, CASE WHEN c_custkey % 4 = 0 THEN 'EN' END, CASE WHEN c_custkey % 7 = 0 THEN '≥ ' || floor(c_acctbal)::BIGINT || ' $/an' END], lambda x: x IS NOT NULL), ' · ') AS part FROM customer)""",
    views=False,
)
def alert_labels(spark, sf_dir):
    return customer_alerts(spark, sf_dir).select("id", A.describe().alias("label"))


@query(
    "seed_jobs",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'laval' ELSE 'montreal' END AS region, CASE WHEN o_orderkey % 3 = 0 THEN 'ti' ELSE 'construction' END AS category, CASE WHEN o_orderkey % 5 = 0 THEN 'hybride' END AS remote, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(TIMESTAMP '2001-08-02' - INTERVAL 1 DAY * (o_orderkey % 7), '%Y-%m-%d') END AS posted FROM orders""",
    views=False,
)
def seed_jobs(spark, sf_dir):
    key, none = F.col("o_orderkey"), F.lit(None).cast("string")
    seeds = read(spark, sf_dir, "orders").select(
        F.lit("s1").alias("sourceId"), F.concat(F.lit("https://x.example/"), key.cast("string")).alias("url"), F.lit("Soudeur").alias("title"), F.lit("Acme").alias("company"), none.alias("companyLogoUrl"), F.lit("Montréal, Québec").alias("location"), F.when(key % 5 == 0, "hybride").alias("remote"),
        none.alias("employmentType"), F.lit(None).cast("double").alias("salaryMin"), F.lit(None).cast("double").alias("salaryMax"), none.alias("salaryPeriod"), F.lit("Un poste").alias("description"), F.array().cast("array<string>").alias("tags"), F.when(key % 2 == 0, "laval").alias("regionId"), none.alias("city"),
        F.when(key % 3 == 0, "ti").alias("categoryId"), F.lit(None).cast("array<string>").alias("languages"), F.when(key % 7 != 0, key % 7).alias("postedDaysAgo"),
    )
    return I.seed_jobs(seeds, orders_now()).select(F.substring_index("url", "/", -1).cast("bigint").alias("o_orderkey"), F.col("regionId").alias("region"), F.col("categoryId").alias("category"), "remote", F.date_format("postedAt", "yyyy-MM-dd").alias("posted"))
