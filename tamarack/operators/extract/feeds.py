"""RSS feeds and free-text lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.dates import parse_french_date
from tamarack.functions.rules import map_employment_type
from tamarack.functions.text import clean_text, sentence_case, slugify, strip_tags
from tamarack.operators.extract.payloads import _SPONTANEOUS, _tags

# Feed categories that name a kind of contract or a place.
TYPE_TERM = r"permanent|temporaire|contractuel|contrat|stage|temps\s*plein|temps\s*partiel|saisonnier|[ée]tudiant|occasionnel|pige"
PLACE_TERM = (
    "montr[ée]al|qu[ée]bec|brossard|laval|longueuil|gatineau|sherbrooke|trois-rivi[èe]res|saguenay|chicoutimi|jonqui[èe]re|l[ée]vis|sept-[îi]les|baie-comeau|fermont|malartic|rouyn|noranda|val-d'?or|amos|granby|drummondville|victoriaville|rimouski"
    "|matane|joliette|terrebonne|repentigny|saint-j[ée]r[ôo]me|mirabel|ottawa|toronto|vancouver|calgary|edmonton|winnipeg|mississauga|hamilton|halifax|moncton|r[ée]gion"
)
TYPE_HEADING = r"^(permanent|temporaire|contractuel|contrat|stage|saisonnier|occasionnel|temps\s+(?:plein|partiel))(?![A-Za-z0-9_])"


def _items(rows: DataFrame) -> DataFrame:
    """One row for each <item> of payload, with its position."""
    return rows.select("source_id", "company", F.posexplode(F.regexp_extract_all("payload", F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), 1)).alias("pos", "item"))


def _element(name: str) -> Column:
    raw = F.regexp_extract("item", rf"(?is)<{name}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1)
    return _decoded(raw)


def _decoded(text: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def parse_zoho_rss(rows: DataFrame, keep: str | None = None) -> DataFrame:
    """rows: source_id, company, payload. keep: a pattern that titles must have."""
    d = _element("description")
    title, url = clean_text(_element("title")), clean_text(_element("link"))
    place = clean_text(F.regexp_replace(F.regexp_extract(d, r"(?is)Lieu\s*:\s*(.*?)\s*<br", 1), "<[^>]+>", ""))
    out = _items(rows).select("source_id", "company", url.alias("url"), title.alias("title"), F.when(place != "", place).alias("location"), strip_tags(d).alias("description"), _tags(F.regexp_extract(d, r"(?isu)Cat[ée]gorie\s*:\s*(.*?)\s*<br", 1)).alias("tags"))
    out = out.where((F.col("title") != "") & (F.col("url") != "") & ~F.col("title").rlike(_SPONTANEOUS))
    return out if keep is None else out.where(F.col("title").rlike(keep))


def parse_job_feed(rows: DataFrame, as_of: Column) -> DataFrame:
    """Categories are places, a kind of contract (the first that names one), and all of them tags."""
    found = F.filter(F.transform(F.regexp_extract_all("item", F.lit(r"(?is)<category\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</category>"), 1), lambda c: clean_text(_decoded(c))), lambda c: c != "")
    rows = _items(rows).withColumn("tags", found)
    places = F.array_join(F.filter("tags", lambda c: c.rlike(f"(?iu){PLACE_TERM}")), ", ")
    kind = F.element_at(F.filter("tags", lambda c: c.rlike(f"(?iu){TYPE_TERM}")), 1)
    title, url = clean_text(_element("title")), F.substring_index(clean_text(_element("link")), "?", 1)
    date = clean_text(_element("pubDate"))
    out = rows.select("source_id", "company", url.alias("url"), title.alias("title"), F.when(places != "", places).alias("location"), map_employment_type(F.when(F.size(F.filter("tags", lambda c: c.rlike(f"(?iu){TYPE_TERM}"))) > 0, kind)).alias("employmentType"), parse_french_date(date, as_of).alias("postedAt"), "tags")
    return out.where("title <> '' and url <> ''")


def parse_category_list(rows: DataFrame) -> DataFrame:
    """Free text in which `** CATEGORY **` lines own the `-- job` lines after them; a category alone is a posting. rows: source_id, company, base, text."""
    lines = rows.select("source_id", "company", "base", F.posexplode(F.split("text", r"\n+")).alias("pos", "line")).withColumn("line", clean_text(F.col("line"))).where("line <> ''")
    page = Window.partitionBy("source_id").orderBy("pos")
    opened = F.max(F.col("line").rlike(r"(?iu)emplois?\s+disponibles").cast("int")).over(Window.partitionBy("source_id"))
    started = F.coalesce(F.max(F.col("line").rlike(r"(?iu)emplois?\s+disponibles").cast("int")).over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    body = lines.withColumn("opened", opened).withColumn("started", started).where("opened = 0 or started = 1")
    head = F.regexp_extract("line", r"^\*{2,}\s*(.+?)\s*\*{2,}$", 1)
    label = sentence_case(clean_text(F.regexp_replace(F.regexp_replace(F.regexp_replace(head, r"\s*:\s*$", ""), r"^\d+\s*", ""), r"(?iu)^postes?\s+de\s+", "")))
    owned = body.withColumn("head", F.when(head != "", label)).withColumn("category", F.last("head", ignorenulls=True).over(page)).withColumn("group", F.count("head").over(page)).where("category is not null")
    job = F.regexp_extract("line", r"^-{2,}\s*(.+)$", 1)
    named = owned.withColumn("job", F.when(F.col("head").isNull() & (job != ""), sentence_case(clean_text(job))))
    named = named.withColumn("jobs", F.count("job").over(Window.partitionBy("source_id", "group")))
    leaf = named.where("job is not null or (head is not null and jobs = 0)").withColumn("title", F.when(F.col("job").isNotNull(), F.concat_ws(" — ", "category", "job")).otherwise(F.col("category")))
    slug = slugify(F.col("title"))
    n = F.row_number().over(Window.partitionBy("source_id", slug).orderBy("pos"))
    url = F.concat("base", F.lit("#"), slug, F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(""))
    return leaf.select("source_id", "company", url.alias("url"), "title", F.when(F.col("category").rlike("(?iu)d[ée]neigement"), "saisonnier").alias("employmentType"), F.when(F.col("job").isNotNull(), F.array("category")).otherwise(F.array().cast("array<string>")).alias("tags"))


def parse_heading_pairs(headings: DataFrame) -> DataFrame:
    """A heading whose next heading names a kind of contract is a posting. headings: source_id, company, base, pos, text."""
    page = Window.partitionBy("source_id").orderBy("pos")
    kind = lambda c: c.rlike(f"(?iu){TYPE_HEADING}")
    pairs = headings.withColumn("next", F.lead("text").over(page)).where(kind(F.col("next")) & ~kind(F.col("text")) & ~F.col("text").rlike(r"(?iu)candidature\s+spontan") & F.length("text").between(3, 120))
    slugged = pairs.withColumn("slug", slugify(F.col("text"))).withColumn("n", F.row_number().over(Window.partitionBy("source_id", "slug").orderBy("pos"))).where("n = 1")
    base = F.regexp_replace(F.regexp_replace("base", "#.*$", ""), "/+$", "")
    return slugged.select("source_id", "company", F.concat(base, F.lit("/#"), "slug").alias("url"), F.col("text").alias("title"), map_employment_type(F.col("next")).alias("employmentType"))
