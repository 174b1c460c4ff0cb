"""JSON payloads of recruiting platforms, as from_json and explode. What cannot be read gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.rules import map_employment_type
from tamarack.functions.text import clean_text, job_id, slugify, strip_tags

_SPONTANEOUS = "(?iu)candidature spontan|spontaneous application|application spontan"

# Where each platform keeps its postings and their fields.
ATS_SCHEMAS = {
    "greenhouse": "struct<jobs: array<struct<title: string, absolute_url: string, location: struct<name: string>>>>",
    "lever": "array<struct<text: string, hostedUrl: string, categories: struct<location: string, commitment: string>>>",
    "recruitee": "struct<offers: array<struct<title: string, careers_url: string, location: string, city: string, employment_type_code: string>>>",
    "smartrecruiters": "struct<content: array<struct<name: string, id: string, location: struct<city: string, region: string>, typeOfEmployment: struct<label: string>>>>",
}
ATS_FIELDS = {"greenhouse": ("jobs", "title", "absolute_url"), "lever": (None, "text", "hostedUrl"), "recruitee": ("offers", "title", "careers_url"), "smartrecruiters": ("content", "name", None)}
BAMBOO = "struct<result: array<struct<id: string, jobOpeningName: string, departmentLabel: string, employmentStatusLabel: string, location: struct<city: string, state: string>, isRemote: boolean>>>"
ULTIPRO_ITEM = "struct<Id: string, Title: string, FullTime: boolean, JobCategoryName: string, PostedDate: string, Locations: array<struct<City: string, State: struct<Code: string>, Address: struct<City: string, State: struct<Code: string>>>>>"
ZOHO = "array<struct<id: string, Posting_Title: string, City: string, State: string, Industry: string, Date_Opened: string, Remote_Job: boolean, Job_Type: string, Job_Description: string>>"
SITE_API = "array<struct<published: boolean, name: string, title: string, slug: string, description: string>>"


def _joined(*parts: Column) -> Column:
    """Non-empty parts with commas; null if none."""
    text = F.array_join(F.filter(F.array(*[clean_text(p) for p in parts]), lambda x: x != ""), ", ")
    return F.when(text != "", text)


def _given(c: Column) -> Column:
    return F.when(c != "", c)


def _tags(c: Column) -> Column:
    return F.when(clean_text(c) != "", F.array(clean_text(c))).otherwise(F.array().cast("array<string>"))


def _finish(rows: DataFrame, **columns: Column) -> DataFrame:
    out = rows.select("source_id", "company", *[c.alias(n) for n, c in columns.items()])
    return out.where("coalesce(title, '') <> '' and coalesce(url, '') <> ''")


def parse_ats(rows: DataFrame, platform: str) -> DataFrame:
    """rows: source_id, company, handle, payload."""
    root, title, url = ATS_FIELDS[platform]
    read = F.from_json("payload", ATS_SCHEMAS[platform])
    e = rows.select("source_id", "company", "handle", F.explode(read[root] if root else read).alias("e"))
    place = {
        "greenhouse": lambda: _joined(F.col("e.location.name")), "lever": lambda: _joined(F.col("e.categories.location")), "recruitee": lambda: _joined(F.coalesce(_given(F.col("e.location")), F.col("e.city"))),
        "smartrecruiters": lambda: _joined(F.col("e.location.city"), F.col("e.location.region")),
    }[platform]()
    kind = {"lever": "e.categories.commitment", "recruitee": "e.employment_type_code", "smartrecruiters": "e.typeOfEmployment.label"}.get(platform)
    address = F.col(f"e.{url}") if url else F.when(F.coalesce("e.id", F.lit("")) != "", F.concat(F.lit("https://jobs.smartrecruiters.com/"), "handle", F.lit("/"), "e.id"))
    return _finish(e, url=address, title=clean_text(F.col(f"e.{title}")), location=place, employmentType=map_employment_type(F.col(kind)) if kind else F.lit(None).cast("string"))


def parse_bamboo(rows: DataFrame) -> DataFrame:
    """rows: source_id, company, base, payload."""
    e = rows.select("source_id", "company", "base", F.explode(F.from_json("payload", BAMBOO)["result"]).alias("e"))
    url = F.when(F.coalesce("e.id", F.lit("")) != "", F.concat("base", F.lit("/careers/"), "e.id"))
    return _finish(e, url=url, title=clean_text(F.col("e.jobOpeningName")), location=_joined(F.col("e.location.city"), F.col("e.location.state")), remote=F.when(F.col("e.isRemote"), "teletravail"), employmentType=map_employment_type(F.col("e.employmentStatusLabel")), tags=_tags(F.col("e.departmentLabel")))


def parse_ultipro(rows: DataFrame) -> DataFrame:
    """rows: source_id, company, tenant, board, payload."""
    from tamarack.functions.dates import parse_date

    read = F.from_json("payload", f"struct<opportunities: array<{ULTIPRO_ITEM}>, Opportunities2: array<{ULTIPRO_ITEM}>>")
    renamed = rows.withColumn("payload", F.regexp_replace("payload", '"Opportunities"\\s*:', '"Opportunities2":'))  # two names that differ by case only
    e = renamed.select("source_id", "company", "tenant", "board", F.explode(F.coalesce(read["opportunities"], read["Opportunities2"])).alias("e"))
    board = F.concat(F.lit("https://recruiting.ultipro.ca/"), "tenant", F.lit("/JobBoard/"), "board")
    at = F.get("e.Locations", F.lit(0))
    return _finish(
        e, url=F.when(F.coalesce("e.Id", F.lit("")) != "", F.concat(board, F.lit("/OpportunityDetail?opportunityId="), "e.Id")).otherwise(board), title=clean_text(F.col("e.Title")),
        location=_joined(F.coalesce(at["City"], at["Address"]["City"]), F.coalesce(at["State"]["Code"], at["Address"]["State"]["Code"])), employmentType=F.when(F.col("e.FullTime"), "temps-plein").when(~F.col("e.FullTime"), "temps-partiel"),
        postedAt=parse_date(F.col("e.PostedDate")), tags=_tags(F.col("e.JobCategoryName")),
    )


def parse_zoho_json(rows: DataFrame) -> DataFrame:
    """rows: source_id, company, careers_url, payload: a page that holds the postings as JSON in an input's value."""
    inputs = F.regexp_extract_all("payload", F.lit(r"(?is)<input\b[^>]*\bvalue\s*=\s*(?:\"(\s*\[[^\"]*)\"|'(\s*\[[^']*)')[^>]*>"), 0)
    value = F.regexp_extract(F.element_at(F.filter(inputs, lambda x: F.contains(x, F.lit("Posting_Title"))), 1), r"(?is)\bvalue\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", 0)
    inner = F.regexp_replace(value, r"(?is)^value\s*=\s*[\"']|[\"']$", "")
    for a, b in (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        inner = F.replace(inner, F.lit(a), F.lit(b))
    e = rows.select("source_id", "company", F.regexp_replace("careers_url", "/+$", "").alias("base"), F.explode(F.from_json(F.trim(inner), ZOHO)).alias("e"))
    title, key = clean_text(F.col("e.Posting_Title")), clean_text(F.col("e.id"))
    out = _finish(
        e, url=F.when(key != "", F.concat_ws("/", "base", key, slugify(title))), title=title, location=_joined(F.col("e.City"), F.col("e.State")), remote=F.when(F.col("e.Remote_Job"), "teletravail"), employmentType=map_employment_type(F.col("e.Job_Type")),
        description=strip_tags(F.col("e.Job_Description")), postedAt=_given(clean_text(F.col("e.Date_Opened"))), tags=_tags(F.col("e.Industry")),
    )
    return out.where(~F.col("title").rlike(_SPONTANEOUS))


def first_source_with_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of `first`, and those of `second` for sources that `first` has none of."""
    return first.unionByName(second.join(first.select("source_id").distinct(), "source_id", "left_anti"), allowMissingColumns=True)


def parse_site_api(rows: DataFrame) -> DataFrame:
    """rows: source_id, company, homepage, payload: a list of postings, whose description may be JSON in text."""
    e = rows.select("source_id", "company", "homepage", F.explode(F.from_json("payload", SITE_API)).alias("e")).where(F.coalesce("e.published", F.lit(True)))
    text = F.trim(F.get_json_object("e.description", "$.text"))
    slug = F.trim("e.slug")
    out = _finish(e, url=F.when(slug != "", F.concat("homepage", F.lit("/carriere/"), slug)), title=clean_text(F.coalesce("e.name", "e.title")), description=F.when(text != "", F.substring(text, 1, 600)))
    return out.dropDuplicates(["url"])


def with_ids(raw: DataFrame) -> DataFrame:
    return raw.withColumn("id", job_id(F.col("source_id"), F.col("url")))
