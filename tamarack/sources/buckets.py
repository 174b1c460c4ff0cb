"""Stored postings in folders by the hash of their key, so that a batch rewrites only the folders it touches; and result pages in folders by range of their sort key, so that a deep page reads only its own.

Counts come from the pass that writes (observed metrics), not from a second scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tamarack.operators.ingest import KEPT_ON_UPDATE, upsert_jobs
from tamarack.operators.search import paging

BUCKET, RANGE = "bucket", "range"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_buckets(rows: DataFrame, path: str, key: str = "url", buckets: int = 256) -> int:
    """Write rows (one for each key) to `buckets` folders; the number of rows written. A folder is written by one task: choose their number so that a folder is a few hundred megabytes."""
    seen = Observation()
    rows.withColumn(BUCKET, _bucket(key, buckets)).repartition(buckets, BUCKET).observe(seen, F.count("*").alias("rows")).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
    return int(seen.get["rows"] or 0)


def read_buckets(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def upsert_buckets(path: str, batch: DataFrame, order: str, columns: list[str], key: str = "url", buckets: int = 256, kept: tuple[str, ...] = KEPT_ON_UPDATE) -> dict[str, int]:
    """Upsert a batch into the folders that its keys fall in (`ingest.upsert_jobs` on those alone); the others keep their files. Returns how many rows were inserted and updated, counted as they were written.

    A folder is replaced when the job commits; a job that fails before leaves all as it was. One writer at a time. A batch with rows of which none is written raises."""
    spark = batch.sparkSession
    touched = [r[BUCKET] for r in batch.select(_bucket(key, buckets).alias(BUCKET)).distinct().collect()]  # `buckets` numbers at most
    if not touched:
        return {"inserted": 0, "updated": 0}
    stored = spark.read.parquet(path).where(F.col(BUCKET).isin(touched)).select(*columns, F.lit(True).alias("__known"), F.lit(None).cast("boolean").alias("__new"))
    merged = upsert_jobs(stored, batch.withColumn("__new", F.lit(True)), order, (*kept, "__known"))
    seen, new = Observation(), F.coalesce(F.col("__new"), F.lit(False))
    counted = merged.observe(seen, F.count_if(new & F.col("__known").isNull()).alias("inserted"), F.count_if(new & F.col("__known").isNotNull()).alias("updated"))
    out = counted.select(*columns, _bucket(key, buckets).alias(BUCKET)).repartition(min(len(touched), buckets), BUCKET)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    counts = {k: int(v or 0) for k, v in seen.get.items()}
    if not counts["inserted"] + counts["updated"]:
        raise ValueError(f"a batch for {len(touched)} folders of {path} changed no rows")
    return counts


@dataclass(frozen=True)
class RangedPages:
    """Rows in folders by range of a total order, with the number of rows before each range."""

    path: str
    columns: list[str]
    schema: StructType
    sort: list[Column]
    before: list[int]  # by range, and the total

    def page(self, spark: SparkSession, page: int, page_size: int) -> DataFrame:
        """One page, clamped: only the ranges that it lies in are read and sorted."""
        _, _, offset = paging(self.before[-1], page, page_size)
        inside = [k for k in range(len(self.before) - 1) if self.before[k] < offset + page_size and self.before[k + 1] > offset]
        rows = spark.read.schema(self.schema).parquet(self.path).where(F.col(RANGE).isin(inside)).select(*self.columns)
        return rows.orderBy(*self.sort).offset(offset - (self.before[inside[0]] if inside else 0)).limit(page_size)


def ranged_pages(rows: DataFrame, sort: list[Column], path: str, ranges: int = 64) -> RangedPages:
    """Deal rows to ranges of the order `sort` (which ends in a unique key) once; any page, however deep, is then read from one or two of them."""
    spark, columns = rows.sparkSession, rows.columns
    rows.repartitionByRange(ranges, *sort).withColumn(RANGE, F.spark_partition_id()).write.mode("overwrite").partitionBy(RANGE).parquet(path)
    schema = StructType([*rows.schema.fields, StructField(RANGE, IntegerType())])
    counts = {r[RANGE]: r["count"] for r in spark.read.schema(schema).parquet(path).groupBy(RANGE).count().collect()}  # `ranges` rows at most, from the files' footers
    before = [0]
    for k in range(ranges):
        before.append(before[-1] + counts.get(k, 0))
    return RangedPages(path, columns, schema, sort, before)

