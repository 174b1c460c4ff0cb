"""Incremental writes as set operations: upsert, guarded sync, change sets, run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.rules import normalize_raw_job

#: Fixed by the policy: an unconfirmed empty read clears at most so many rows; a read is suspicious below this share of at least so many.
SMALL_SOURCE, SUSPICIOUS_FROM, SUSPICIOUS_SHARE = 10, 10, 0.4
#: Columns that an update leaves as they are.
KEPT_ON_UPDATE = ("id", "sourceId", "currency", "scrapedAt", "createdAt")


def last_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key: the last in order."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def upsert_jobs(target: DataFrame, batch: DataFrame, order: str, kept: tuple[str, ...] = KEPT_ON_UPDATE) -> DataFrame:
    """target after the batch: by url, the last of the batch wins; rows that exist keep the columns in `kept`. One shuffle on url."""
    new = last_by(batch, "url", order).drop(order)
    names = [c for c in target.columns if c != "url"]
    b = new.select("url", *[(F.col(c) if c in new.columns else F.lit(None)).alias(f"b_{c}") for c in names], F.lit(True).alias("in_batch"))
    t = target.withColumn("in_target", F.lit(True))
    pick = [F.when(F.col("in_batch").isNull() | (F.col("in_target") & F.lit(c in kept)), F.col(c)).otherwise(F.col(f"b_{c}")).alias(c) for c in names]
    return t.join(b, "url", "full").select("url", *pick)


def upsert_counts(target: DataFrame, batch: DataFrame) -> DataFrame:
    """How many urls of the batch are new and how many are updates."""
    marked = batch.select("url").distinct().join(target.select("url", F.lit(True).alias("known")), "url", "left")
    return marked.agg(F.count_if(F.col("known").isNull()).alias("inserted"), F.count_if("known").alias("updated"))


def sync_policy(existing: DataFrame, batch: DataFrame, signals: DataFrame) -> DataFrame:
    """One row for each source read: n incoming rows (before deduplication), e existing rows, and action: purge, keep or replace.

    A source with nothing read is purged if its page says so, or if it was reachable and has few rows; a read that is far smaller than
    what is stored only adds. signals has a row for each source read (model.BATCH_SIGNALS)."""
    counts = batch.groupBy("sourceId").agg(F.count("*").alias("n"))
    stored = existing.groupBy("sourceId").agg(F.count("*").alias("e"))
    both = signals.join(counts, "sourceId", "left").join(stored, "sourceId", "left").fillna(0, ["n", "e"])
    empty = F.when(F.col("explicit_empty") | (F.col("reachable_empty") & (F.col("e") <= SMALL_SOURCE)), "purge").otherwise("keep")
    suspicious = ~F.col("force") & (F.col("e") >= SUSPICIOUS_FROM) & (F.col("n") < F.col("e") * SUSPICIOUS_SHARE)
    return both.withColumn("action", F.when(F.col("n") == 0, empty).when(suspicious, "keep").otherwise("replace"))


def sync_deletes(existing: DataFrame, batch: DataFrame, policy: DataFrame) -> DataFrame:
    """(sourceId, id) of the rows that the policy removes."""
    acting = policy.where("action in ('purge', 'replace')").select("sourceId", "action")
    candidates = existing.select("sourceId", "id").join(acting, "sourceId")
    read = batch.select("sourceId", "id", F.lit("replace").alias("action")).distinct()
    return candidates.join(read, ["sourceId", "id", "action"], "left_anti").select("sourceId", "id")


def sync_jobs(target: DataFrame, batch: DataFrame, signals: DataFrame, order: str) -> DataFrame:
    """target after a guarded replacement of the sources in signals. Counts are taken before the upsert."""
    removed = sync_deletes(target, batch, sync_policy(target, batch, signals))
    return upsert_jobs(target, batch, order).join(removed, ["sourceId", "id"], "left_anti").select(*target.columns)


def validate_raw(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with reason)."""
    enums = {"remote": ("presentiel", "hybride", "teletravail"), "employmentType": ("temps-plein", "temps-partiel", "contrat", "stage", "saisonnier", "occasionnel"), "salaryPeriod": ("heure", "semaine", "mois", "annee")}
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = F.when(missing("sourceId"), "sourceId").when(missing("url") | F.try_parse_url("url", F.lit("PROTOCOL")).isNull(), "url").when(missing("title"), "title").when(missing("company"), "company")
    for column, allowed in enums.items():
        reason = reason.when(F.col(column).isNotNull() & ~F.col(column).isin(*allowed), column)
    marked = raw.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def apply_changes(employers: DataFrame, upsert: DataFrame, fix_url: DataFrame, reactivate: DataFrame, disable: DataFrame) -> DataFrame:
    """Employers after a change set: upserts, then addresses, then reactivations, and last what is switched off. Of several rows of one id a reactivation counts before an upsert, then the least as JSON text; of several addresses the least."""
    columns = employers.columns
    put = upsert.unionByName(reactivate.withColumns({"enabled": F.lit(True), "again": F.lit(True)}), allowMissingColumns=True).withColumn("is_put", F.lit(True))
    every = F.struct(*[c for c in put.columns if c != "id"])
    first = F.struct((~F.coalesce("again", F.lit(False))).alias("a"), F.to_json(every).alias("b"))
    u = put.groupBy("id").agg(F.min_by(every, first).alias("r")).select("id", "r.*").select("id", *[(F.col(c) if c in put.columns else F.lit(None)).alias(f"u_{c}") for c in columns if c != "id"], "is_put")
    merged = employers.join(u, "id", "full").select("id", *[F.coalesce(f"u_{c}", c).alias(c) for c in columns if c != "id"])
    fixed = merged.join(fix_url.groupBy("id").agg(F.min("careersUrl").alias("f_url")), "id", "left").withColumn("careersUrl", F.coalesce("f_url", "careersUrl")).drop("f_url")
    off = disable.select("id").distinct().withColumn("is_off", F.lit(True))
    return fixed.join(off, "id", "left").withColumn("enabled", F.when(F.col("is_off"), F.lit(False)).otherwise(F.col("enabled"))).select(*columns)


def change_counts(employers: DataFrame, upsert: DataFrame, fix_url: DataFrame, disable: DataFrame) -> DataFrame:
    """(action, n): created, updated, fixed, disabled, skipped."""
    ids = employers.select("id", F.lit(True).alias("known"), "careersUrl", "enabled")
    a = upsert.select("id").distinct().join(ids, "id", "left").select(F.when(F.col("known"), "updated").otherwise("created").alias("action"))
    b = fix_url.select("id", F.col("careersUrl").alias("url")).join(ids, "id", "left").select(F.when(F.col("known").isNull(), "skipped").when(F.col("url") == F.col("careersUrl"), "unchanged").otherwise("fixed").alias("action"))
    c = disable.select("id").distinct().join(ids, "id", "left").select(F.when(F.col("known").isNull(), "skipped").when(F.col("enabled"), "disabled").otherwise("unchanged").alias("action"))
    return a.union(b).union(c).groupBy("action").agg(F.count("*").alias("n"))


def delete_employers(employers: DataFrame, jobs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(employers, jobs) without the given ids and their postings."""
    ids = gone.select("id").distinct()
    return employers.join(ids, "id", "left_anti"), jobs.join(ids.withColumnRenamed("id", "sourceId"), "sourceId", "left_anti")


def bulk_update(employers: DataFrame, selected: DataFrame, **values) -> DataFrame:
    """The given columns set for the selected ids, all at once."""
    marked = employers.join(selected.select("id").distinct().withColumn("is_selected", F.lit(True)), "id", "left")
    return marked.select(*[F.when(F.col("is_selected"), F.lit(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in employers.columns])


def run_states(events: DataFrame) -> DataFrame:
    """The last event of each run (columns id and at, and others)."""
    return last_by(events, "id", "at")


def numbered_slugs(rows: DataFrame, slug: str, order: str) -> DataFrame:
    """rows whose repeated slugs get -2, -3, … in order."""
    n = F.row_number().over(Window.partitionBy(slug).orderBy(order))
    return rows.withColumn("n", n).withColumn(slug, F.when(F.col("n") == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), F.col("n").cast("string")))).drop("n")


def seed_jobs(seeds: DataFrame, as_of: Column) -> DataFrame:
    """Sample postings as normalised ones: what a seed states (regionId, city, categoryId, remote, languages) stands, the rest is read from its texts; postedDaysAgo counts from as_of."""
    posted = F.date_format(F.timestamp_micros(F.unix_micros(as_of) - F.col("postedDaysAgo").cast("long") * 86_400_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    base = normalize_raw_job(seeds.withColumn("postedAt", posted), as_of)
    stated = ["regionId", "city", "categoryId", "remote", "languages"]
    own = seeds.select("sourceId", "url", *[F.col(c).alias(f"own_{c}") for c in stated])
    joined = base.join(own, ["sourceId", "url"])
    return joined.withColumns({c: F.coalesce(f"own_{c}", c) for c in stated}).select(*base.columns)


def merge_result_pages(rows: DataFrame) -> DataFrame:
    """Result pages (source_id, page, pos, url, ...) as reading them one by one would give: a page without a new address ends its source; the first place of an address counts."""
    first = rows.groupBy("source_id", "url").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("source_id", "url")]), F.struct("page", "pos")).alias("r")).select("source_id", "url", "r.*")
    pages = rows.select("source_id", "page").distinct().join(first.groupBy("source_id", "page").agg(F.count("*").alias("new")), ["source_id", "page"], "left")
    last = pages.groupBy("source_id").agg(F.min(F.when(F.col("new").isNull(), F.col("page"))).alias("stop"))
    return first.join(last, "source_id").where("stop is null or page < stop").select(*rows.columns)


def run_reports(requested: DataFrame, sources: DataFrame, batch: DataFrame, target: DataFrame, failures: DataFrame) -> DataFrame:
    """One row for each requested source id: status (success, error, unknown), rows found, inserted and updated, and the error.

    requested: sourceId; sources: sourceId of those that have a reader; batch and target: sourceId, url; failures: sourceId, error. A source that failed inserts nothing; an id without a reader is reported, not dropped."""
    valid = batch.select("sourceId", "url").distinct().join(target.select("url", F.lit(True).alias("known")).distinct(), "url", "left")
    found = valid.groupBy("sourceId").agg(F.count("*").alias("found"), F.count_if(F.col("known").isNull()).alias("inserted"), F.count_if("known").alias("updated"))
    known = sources.select("sourceId", F.lit(True).alias("has_reader")).distinct()
    failed = failures.groupBy("sourceId").agg(F.min("error").alias("error"))
    joined = requested.select("sourceId").distinct().join(known, "sourceId", "left").join(failed, "sourceId", "left").join(found, "sourceId", "left")
    ok = F.col("has_reader") & F.col("error").isNull()
    n = lambda c: F.when(ok, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).alias(c)
    status = F.when(F.col("has_reader").isNull(), "unknown").when(F.col("error").isNotNull(), "error").otherwise("success")
    return joined.select("sourceId", status.alias("status"), n("found"), n("inserted"), n("updated"), F.when(F.col("has_reader").isNull(), F.concat(F.lit("unknown source: "), "sourceId")).otherwise(F.col("error")).alias("error"))
