"""Search, sort, page and facet queries."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from tamarack.operators import search as S
from tamarack.operators.rollups import facet_cut, top
from tamarack.plans.base import ANNUAL, DAYS, NOW, query, rounded, sql_norm, sql_stamp, stamp
from tamarack.sources.adapters import job, orders_now

RECENT = 'coalesce("postedAt", "scrapedAt") DESC NULLS LAST, id'


def _show(df):
    return df.select("id", "title", "company", "regionId", rounded(S.annual(), 2).alias("annual"), stamp("postedAt").alias("posted"))


SHOW = f'id, title, company, "regionId", round({ANNUAL}, 2) AS annual, {sql_stamp(chr(34) + "postedAt" + chr(34))} AS posted'


def _page(spark, sf_dir, q: S.JobQuery):
    now = orders_now()
    found = job(spark, sf_dir).where(S.matches(q, now))
    return _show(S.page_of(found, S.order(q.sort, q.q, now), q.page, q.page_size))


@query("search_recent_page", f"""SELECT {SHOW} FROM job WHERE "regionId" = 'EUROPE' AND {ANNUAL} >= 100000 ORDER BY {RECENT} LIMIT 20""")
def search_recent_page(spark, sf_dir):
    return _page(spark, sf_dir, S.JobQuery(regions=["EUROPE"], salary_min=100000))


@query("search_page_3", f"""SELECT {SHOW} FROM job WHERE "categoryId" IN ('BUILDING', 'MACHINERY') ORDER BY {RECENT} LIMIT 50 OFFSET 100""")
def search_page_3(spark, sf_dir):
    return _page(spark, sf_dir, S.JobQuery(categories=["BUILDING", "MACHINERY"], page=3, page_size=50))


@query("search_page_clamped", f"""SELECT {SHOW} FROM (SELECT *, row_number() OVER (ORDER BY {RECENT}) AS k, count(*) OVER () AS n FROM job WHERE city = 'NATION_3') WHERE k > (ceil(n / 100.0) - 1) * 100""")
def search_page_clamped(spark, sf_dir):
    """The last page, as in its SQL: the page asked for lies beyond any number of postings."""
    found = job(spark, sf_dir).where("city = 'NATION_3'")
    return _show(S.page_of(found, S.order(), sys.maxsize, 100, S.order(backwards=True)))


@query("search_all_filters", f"""SELECT id, "sourceId" FROM job WHERE list_has_any(languages, ['fr']) AND remote IN ('hybride', 'presentiel') AND "employmentType" IN ('1-URGENT', '2-HIGH') AND {DAYS} <= 1500 AND {ANNUAL} >= 50000""")
def search_all_filters(spark, sf_dir):
    q = S.JobQuery.parse({"languages": "fr", "remote": "hybride, presentiel", "employment_types": ["1-URGENT", "2-HIGH"], "posted_within_days": "1500", "salary_min": "50000"})
    return job(spark, sf_dir).where(S.matches(q, orders_now())).select("id", "sourceId")


@query("sort_salary_desc", f"SELECT {SHOW} FROM job ORDER BY {ANNUAL} DESC NULLS LAST, id LIMIT 100")
def sort_salary_desc(spark, sf_dir):
    return _page(spark, sf_dir, S.JobQuery(sort="salary_desc", page_size=100))


@query("sort_salary_asc", f"SELECT {SHOW} FROM job ORDER BY {ANNUAL} ASC NULLS LAST, id LIMIT 100")
def sort_salary_asc(spark, sf_dir):
    return _page(spark, sf_dir, S.JobQuery(sort="salary_asc", page_size=100))


@query("sort_company", f"SELECT {SHOW} FROM job ORDER BY company, id LIMIT 100")
def sort_company(spark, sf_dir):
    return _page(spark, sf_dir, S.JobQuery(sort="company", page_size=100))


_TITLE = sql_norm("coalesce(title, '')")


@query(
    "relevance_topk",
    f"""SELECT id, title, round(score, 6) AS score FROM (SELECT id, title, CASE WHEN {_TITLE} = 'red widget' THEN 100 ELSE 0 END + CASE WHEN contains({_TITLE}, 'red widget') THEN 40 ELSE 0 END
    + CASE WHEN contains({sql_norm("company")}, 'red widget') THEN 15 ELSE 0 END + CASE WHEN contains({_TITLE}, 'red') THEN 8 ELSE 0 END + CASE WHEN contains({_TITLE}, 'widget') THEN 8 ELSE 0 END
    + CASE WHEN len(list_filter(tags, lambda t: contains(lower(t), 'red'))) > 0 THEN 4 ELSE 0 END + CASE WHEN len(list_filter(tags, lambda t: contains(lower(t), 'widget'))) > 0 THEN 4 ELSE 0 END
    + coalesce(greatest(0.0, 10 - {DAYS} / 3), 0.0) AS score FROM job WHERE contains({_TITLE}, 'red') AND contains({_TITLE}, 'widget')) ORDER BY score DESC, id LIMIT 50""",
)
def relevance_topk(spark, sf_dir):
    now = orders_now()
    q = S.JobQuery(q="Réd  Widget", sort="relevance", page_size=50)
    rows = job(spark, sf_dir).where(S.matches(S.JobQuery(q=q.q), now)).withColumn("score", S.relevance("Réd Widget", now))
    return rows.orderBy(F.col("score").desc(), "id").limit(q.page_size).select("id", "title", rounded("score", 6).alias("score"))


_HAY = sql_norm("concat_ws(' ', title, company, description, array_to_string(tags, ' '))")


@query("text_search_all_words", f"SELECT id, title, company FROM job WHERE contains({_HAY}, 'small') AND contains({_HAY}, 'economy')")
def text_search_all_words(spark, sf_dir):
    return job(spark, sf_dir).where(S.matches(S.JobQuery(q="  SMALL économy "), orders_now())).select("id", "title", "company")


@query("text_search_documents", f"""SELECT doc_id FROM documents WHERE contains({sql_norm("coalesce(text, '')")}, 'menteie') AND contains({sql_norm("coalesce(text, '')")}, 'ciono')""", views=False)
def text_search_documents(spark, sf_dir):
    from tamarack.functions.text import norm
    from tamarack.sources.adapters import read

    folded = norm(F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "documents").where(F.contains(folded, F.lit("menteie")) & F.contains(folded, F.lit("ciono"))).select("doc_id")


@query("company_contains", f"SELECT id, company FROM job WHERE contains({sql_norm('company')}, '#00000012')")
def company_contains(spark, sf_dir):
    return job(spark, sf_dir).where(S.matches(S.JobQuery(company="#00000012"), orders_now())).select("id", "company")


@query("city_any", """SELECT id, city FROM job WHERE contains(lower(city), 'tion_1') OR contains(lower(city), 'nation_24')""")
def city_any(spark, sf_dir):
    return job(spark, sf_dir).where(S.matches(S.JobQuery(cities=["tion_1", "NATION_24"]), orders_now())).select("id", "city")


@query("salary_min", f"""SELECT id, round({ANNUAL}, 2) AS annual FROM job WHERE {ANNUAL} >= 300000""")
def salary_min(spark, sf_dir):
    return job(spark, sf_dir).where(S.matches(S.JobQuery(salary_min=300000), orders_now())).select("id", rounded(S.annual(), 2).alias("annual"))


@query("posted_within", f"""SELECT days, count(*) AS n FROM job, (VALUES (1), (7), (14), (30), (365)) t(days) WHERE {DAYS} <= days GROUP BY days""")
def posted_within(spark, sf_dir):
    from tamarack.functions.dates import days_since

    windows = F.explode(F.filter(F.array(*[F.lit(d) for d in (1, 7, 14, 30, 365)]), lambda d: days_since(F.col("postedAt"), orders_now()) <= d))
    return job(spark, sf_dir).select(windows.alias("days")).groupBy("days").agg(F.count("*").alias("n"))


@query("job_by_id", f"SELECT {SHOW} FROM job WHERE id = '42'")
def job_by_id(spark, sf_dir):
    return _show(job(spark, sf_dir).where("id = '42'"))


for _name, _column, _dimension in (("facet_regions", "regionId", "region"), ("facet_categories", "categoryId", "category"), ("facet_employment", "employmentType", "employment")):

    @query(_name, f'SELECT "{_column}" AS id, "{_column}" AS label, count(*) AS count FROM job WHERE "{_column}" IS NOT NULL AND {ANNUAL} >= 100000 GROUP BY 1')
    def _facet(spark, sf_dir, column=_column, dimension=_dimension):
        return S.one_facet(job(spark, sf_dir).where(S.matches(S.JobQuery(salary_min=100000), orders_now())), column, dimension)


@query("facet_remote", """SELECT remote AS id, CASE remote WHEN 'hybride' THEN 'Hybride' WHEN 'presentiel' THEN 'Présentiel' END AS label, count(*) AS count FROM job WHERE remote IS NOT NULL GROUP BY 1""")
def facet_remote(spark, sf_dir):
    return S.one_facet(job(spark, sf_dir), "remote", "remote")


@query("facet_languages_explode", """SELECT id, CASE id WHEN 'fr' THEN 'Français' WHEN 'en' THEN 'Anglais' ELSE 'Bilingue (FR/EN)' END AS label, count(*) AS count FROM (SELECT unnest(languages) AS id FROM job) GROUP BY 1""")
def facet_languages_explode(spark, sf_dir):
    return S.facets(job(spark, sf_dir)).where("dimension = 'language'").select("id", "label", "count")


_FACETS = """SELECT dimension, id, count(*) AS count FROM (SELECT 'region' AS dimension, "regionId" AS id FROM job UNION ALL SELECT 'category', "categoryId" FROM job UNION ALL SELECT 'employment', "employmentType" FROM job
UNION ALL SELECT 'remote', remote FROM job UNION ALL SELECT 'source', "sourceId" FROM job UNION ALL SELECT 'language', unnest(languages) FROM job) WHERE id IS NOT NULL GROUP BY 1, 2"""


@query("facets_all", _FACETS)
def facets_all(spark, sf_dir):
    return S.facets(job(spark, sf_dir)).select("dimension", "id", "count")


@query("facet_display_cut", f"SELECT dimension, id, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY count DESC, id)::INT AS rank FROM ({_FACETS})) WHERE rank <= 6")
def facet_display_cut(spark, sf_dir):
    return facet_cut(S.facets(job(spark, sf_dir))).select("dimension", "id", "count", "rank")


@query("search_paging", """SELECT count(*) AS total, least(999, greatest(1, ceil(count(*) / 20.0)))::INT AS page, 20 AS page_size, greatest(1, ceil(count(*) / 20.0))::INT AS total_pages FROM job WHERE "regionId" = 'ASIA'""")
def search_paging(spark, sf_dir):
    return S.search(job(spark, sf_dir), S.JobQuery(regions=["ASIA"], page=999), orders_now())[2]


@query("sponsored_first", f"""SELECT id, "sourceId", row_number() OVER (ORDER BY coalesce("sourceId" IN ('7', '9'), false) DESC, {RECENT})::INT AS place FROM (SELECT * FROM job WHERE "sourceId" IN ('7', '8', '9') ORDER BY {RECENT} LIMIT 40)""")
def sponsored_first(spark, sf_dir):
    from pyspark.sql import Window

    now = orders_now()
    page = job(spark, sf_dir).where("sourceId in ('7', '8', '9')").orderBy(*S.order()).limit(40)
    place = F.row_number().over(Window.orderBy(F.coalesce(F.col("sourceId").isin("7", "9"), F.lit(False)).desc(), *S.order("recent", None, now)))  # one page
    return S.sponsored_first(page, ["7", "9"], S.order()).select("id", "sourceId", place.alias("place"))


@query("home_top_categories", """SELECT "categoryId" AS id, count(*) AS n FROM job WHERE "categoryId" <> 'AUTOMOBILE' GROUP BY 1 ORDER BY n DESC, id LIMIT 8""")
def home_top_categories(spark, sf_dir):
    return top(job(spark, sf_dir), "categoryId", 8, ("AUTOMOBILE",))


@query("home_latest", f"SELECT id, title FROM job ORDER BY {RECENT} LIMIT 6")
def home_latest(spark, sf_dir):
    return job(spark, sf_dir).orderBy(*S.order()).limit(6).select("id", "title")


@query("collection_filter", f"SELECT {NOW} > max(\"postedAt\") AS all_past, count(*) AS n, count_if({DAYS} < 0)::BIGINT AS future FROM job")
def collection_filter(spark, sf_dir):
    from tamarack.functions.dates import days_since

    return job(spark, sf_dir).agg((orders_now() > F.max("postedAt")).alias("all_past"), F.count("*").alias("n"), F.count_if(days_since(F.col("postedAt"), orders_now()) < 0).alias("future"))
