"""The driver's tables in the engine's shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The present of the order tables and of the event table.
ORDERS_NOW, EVENTS_NOW = "2001-08-02 00:00:00", "2024-01-31 00:00:00"

#: A task takes about so many rows where each is dear.
ROWS_A_TASK = 20_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """rows dealt to as many tasks as they need, before work that is dear for each row: a narrow table has few row groups, and so few tasks, however many rows it has."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // rows_a_task))
    return rows.repartition(tasks)


def orders_now():
    return F.lit(ORDERS_NOW).cast("timestamp")


def events_now():
    return F.lit(EVENTS_NOW).cast("timestamp")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_nationkey, n_name, r_name: as many rows as nations."""
    return read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


def job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as postings. The first line of an order names its source and title; orders without lines have neither."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    first = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(line).alias("line")).select("l_orderkey", F.col("line.l_suppkey").alias("l_suppkey"), F.col("line.l_partkey").alias("l_partkey"))
    customer = read(spark, sf_dir, "customer").join(F.broadcast(places(spark, sf_dir)), F.col("c_nationkey") == F.col("n_nationkey"))  # nations and regions are fixed dimensions
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    rows = read(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    return rows.select(
        key.cast("string").alias("id"), F.col("l_suppkey").cast("string").alias("sourceId"), F.concat(F.lit("https://jobs.example.com/"), key.cast("string")).alias("url"), F.col("p_name").alias("title"), F.col("c_name").alias("company"),
        F.when(key % 5 == 0, F.concat(F.lit("https://cdn.example.com/"), F.col("o_custkey").cast("string"))).alias("companyLogoUrl"), F.concat_ws(", ", "n_name", "r_name").alias("location"),
        F.when(key % 11 != 0, F.col("r_name")).alias("regionId"), F.col("n_name").alias("city"), F.when(key % 3 == 0, "hybride").when(key % 3 == 1, "presentiel").alias("remote"), F.col("c_mktsegment").alias("categoryId"),
        F.col("o_orderpriority").alias("employmentType"), F.when(key % 5 != 0, F.col("o_totalprice") / 2).alias("salaryMin"), F.when(key % 7 != 0, F.col("o_totalprice")).alias("salaryMax"),
        F.when(F.col("o_orderstatus") == "F", "annee").when(F.col("o_orderstatus") == "O", "mois").when(F.col("o_orderstatus") == "P", "heure").alias("salaryPeriod"), F.concat_ws(" ", "p_brand", "p_type").alias("description"),
        F.split(F.coalesce("p_type", F.lit("")), " ").alias("tags"), F.when(key % 4 == 0, F.array(F.lit("fr"), F.lit("en"))).when(key % 4 == 1, F.array(F.lit("fr"))).when(key % 4 == 2, F.array(F.lit("bilingue"))).otherwise(F.array().cast("array<string>")).alias("languages"),
        F.when(key % 13 != 0, day).alias("postedAt"), F.timestamp_micros(F.unix_micros(day) + 86_400_000_000).alias("scrapedAt"),
    )


def employer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as employers."""
    key = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").join(F.broadcast(places(spark, sf_dir)), F.col("s_nationkey") == F.col("n_nationkey")).select(
        key.cast("string").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("https://www.example.com/"), (key % 40).cast("string")).alias("homepage"),
        F.concat(F.lit("https://Careers.example.com/"), (key % 40).cast("string"), F.when(key % 2 == 0, "/").otherwise("")).alias("careersUrl"),
        F.when(key % 4 == 0, "generic").when(key % 4 == 1, "jsonld").when(key % 4 == 2, "lever").otherwise("greenhouse").alias("method"), F.when(key % 6 != 0, F.col("r_name")).alias("region"), F.col("n_name").alias("city"),
        (key % 3 == 0).alias("verified"), (key % 17 != 0).alias("enabled"), F.col("s_acctbal").alias("balance"),
    )


def scrape_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs of sources."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("sourceId"), F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "running").otherwise("success").alias("status"),
        F.floor("value").cast("int").alias("found"), F.col("ts").cast("timestamp").alias("startedAt"), F.col("props"), F.col("event_type"),
    )


#: The same views for DuckDB.
SQL_VIEWS = """
place AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
first_line AS (SELECT l_orderkey, l_suppkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS k FROM lineitem) WHERE k = 1),
job AS (
  SELECT o_orderkey::VARCHAR AS id, l_suppkey::VARCHAR AS "sourceId", 'https://jobs.example.com/' || o_orderkey AS url, p_name AS title, c_name AS company,
    CASE WHEN o_orderkey % 5 = 0 THEN 'https://cdn.example.com/' || o_custkey END AS "companyLogoUrl", n_name || ', ' || r_name AS location, CASE WHEN o_orderkey % 11 <> 0 THEN r_name END AS "regionId", n_name AS city,
    CASE o_orderkey % 3 WHEN 0 THEN 'hybride' WHEN 1 THEN 'presentiel' END AS remote, c_mktsegment AS "categoryId", o_orderpriority AS "employmentType",
    CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 2 END AS "salaryMin", CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS "salaryMax",
    CASE o_orderstatus WHEN 'F' THEN 'annee' WHEN 'O' THEN 'mois' WHEN 'P' THEN 'heure' END AS "salaryPeriod", concat_ws(' ', p_brand, p_type) AS description, string_split(coalesce(p_type, ''), ' ') AS tags,
    CASE o_orderkey % 4 WHEN 0 THEN ['fr', 'en'] WHEN 1 THEN ['fr'] WHEN 2 THEN ['bilingue'] ELSE []::VARCHAR[] END AS languages, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS "postedAt", o_orderdate + INTERVAL 1 DAY AS "scrapedAt"
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN place ON c_nationkey = n_nationkey LEFT JOIN first_line ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey),
employer AS (
  SELECT s_suppkey::VARCHAR AS id, s_name AS name, 'https://www.example.com/' || (s_suppkey % 40) AS homepage, 'https://Careers.example.com/' || (s_suppkey % 40) || CASE WHEN s_suppkey % 2 = 0 THEN '/' ELSE '' END AS "careersUrl",
    CASE s_suppkey % 4 WHEN 0 THEN 'generic' WHEN 1 THEN 'jsonld' WHEN 2 THEN 'lever' ELSE 'greenhouse' END AS method, CASE WHEN s_suppkey % 6 <> 0 THEN r_name END AS region, n_name AS city,
    s_suppkey % 3 = 0 AS verified, s_suppkey % 17 <> 0 AS enabled, s_acctbal AS balance
  FROM supplier JOIN place ON s_nationkey = n_nationkey),
run AS (
  SELECT event_id AS id, user_id::VARCHAR AS "sourceId", CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'running' ELSE 'success' END AS status, floor(value)::INT AS found, ts AS "startedAt", props, event_type FROM events)
"""
