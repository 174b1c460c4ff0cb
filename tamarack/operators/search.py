"""Faceted search: predicates, sorts, relevance, pages and facets over postings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, fields
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.dates import days_since
from tamarack.functions.rules import annual_salary
from tamarack.functions.text import norm, trim, words
from tamarack.taxonomy import label

SORTS = ("recent", "salary_desc", "salary_asc", "company", "relevance")
MAX_PAGE_SIZE = 100


@dataclass(frozen=True)
class JobQuery:
    """A validated search. Absent or empty parameters filter nothing."""

    q: str | None = None
    company: str | None = None
    regions: Sequence[str] = ()
    cities: Sequence[str] = ()
    categories: Sequence[str] = ()
    employment_types: Sequence[str] = ()
    remote: Sequence[str] = ()
    sources: Sequence[str] = ()
    languages: Sequence[str] = ()
    salary_min: float | None = None
    posted_within_days: int | None = None
    sort: str = "recent"
    page: int = 1
    page_size: int = 20
    max_page_size: int = field(default=MAX_PAGE_SIZE, repr=False)

    def __post_init__(self):
        if self.sort not in SORTS:
            raise ValueError(f"sort is one of {', '.join(SORTS)}")
        if self.page < 1 or not 1 <= self.page_size <= self.max_page_size:
            raise ValueError(f"page starts at 1; page_size lies between 1 and {self.max_page_size}")

    @classmethod
    def parse(cls, given: dict[str, object]) -> JobQuery:
        """From request parameters: comma lists or repeated values become trimmed, non-empty items; numbers are read from text."""
        kinds = {"salary_min": float, "posted_within_days": int, "page": int, "page_size": int}
        lists = {"regions", "cities", "categories", "employment_types", "remote", "sources", "languages"}
        out: dict[str, object] = {}
        for name, value in given.items():
            if value is None or value == "":
                continue
            if name in lists:
                items = value if isinstance(value, (list, tuple)) else str(value).split(",")
                out[name] = tuple(x.strip() for x in items if str(x).strip())
            elif name in kinds:
                out[name] = kinds[name](value)
            else:
                out[name] = str(value)
        return cls(**out)

    def params(self) -> dict[str, str]:
        """The inverse of parse: parameters that differ from the defaults, as text."""
        out = {}
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name != "max_page_size" and value != f.default and value not in ((), None):
                out[f.name] = ",".join(value) if isinstance(value, (list, tuple)) else str(value)
        return out

    def filters_only(self) -> dict[str, str]:
        """What a saved search keeps: filters, without company, sort and paging."""
        return {k: v for k, v in self.params().items() if k not in ("company", "sort", "page", "page_size")}


def haystack() -> Column:
    """The folded text that q is looked up in."""
    return norm(F.concat_ws(" ", "title", "company", "description", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")))


def _folded(text: str) -> Column:
    return norm(F.lit(text))


def matches(query: JobQuery, as_of: Column) -> Column:
    """The conjunction of the query's filters as one predicate."""
    found: list[Column] = []
    if query.q and query.q.strip():
        # one contains() for each word; the words are literals, so nothing is interpreted row by row
        found += [F.contains(haystack(), _folded(w)) for w in query.q.split()]
    if query.company:
        found.append(F.contains(norm(F.col("company")), _folded(query.company)))
    for column, wanted in (("regionId", query.regions), ("categoryId", query.categories), ("employmentType", query.employment_types), ("remote", query.remote), ("sourceId", query.sources)):
        if wanted:
            found.append(F.col(column).isin(*wanted))
    if query.cities:
        found.append(reduce(lambda a, b: a | b, [F.contains(F.coalesce(norm(F.col("city")), F.lit("")), _folded(c)) for c in query.cities]))
    if query.languages:
        found.append(F.arrays_overlap("languages", F.array(*[F.lit(x) for x in query.languages])))
    if query.salary_min is not None:
        found.append(annual() >= query.salary_min)
    if query.posted_within_days is not None:
        found.append(days_since(F.col("postedAt"), as_of) <= query.posted_within_days)
    return reduce(lambda a, b: a & b, found, F.lit(True))


def annual() -> Column:
    return annual_salary(F.col("salaryMin"), F.col("salaryMax"), F.col("salaryPeriod"))


def _contains(word: Column, tag: Column) -> Column:
    return F.contains(tag, word)


def relevance(q: str, as_of: Column) -> Column:
    """100 for an equal title, 40 and 15 for the whole text in title and company, 8 and 4 for each word in title and tags, up to 10 for freshness."""
    needle, title = _folded(q.strip()), norm(F.col("title"))
    score = F.when(title == needle, 100).otherwise(0) + F.when(F.contains(title, needle), 40).otherwise(0) + F.when(F.contains(norm(F.col("company")), needle), 15).otherwise(0)
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), norm)
    for word in map(_folded, q.split()):
        score += F.when(F.contains(title, word), 8).otherwise(0) + F.when(F.exists(tags, partial(_contains, word)), 4).otherwise(0)
    return score + F.coalesce(F.greatest(F.lit(0.0), 10 - days_since(F.col("postedAt"), as_of) / 3), F.lit(0.0))


def order(sort: str = "recent", q: str | None = None, as_of: Column | None = None, backwards: bool = False) -> list[Column]:
    """Sort columns; every order ends in the id, so pages are stable. Backwards, the same order from its end."""
    up = lambda c: c.desc_nulls_first() if backwards else c.asc_nulls_last()
    down = lambda c: c.asc_nulls_first() if backwards else c.desc_nulls_last()
    if sort == "relevance" and q:
        return [down(relevance(q, as_of)), up(F.col("id"))]
    first = {"salary_desc": down(annual()), "salary_asc": up(annual()), "company": up(F.collate(F.col("company"), "fr"))}
    return [first.get(sort, down(F.coalesce("postedAt", "scrapedAt"))), up(F.col("id"))]


def paging(total: int, page: int, page_size: int) -> tuple[int, int, int]:
    """(page, total pages, offset): a page beyond the last is the last."""
    pages = max(1, -(-total // page_size))
    page = min(page, pages)
    return page, pages, (page - 1) * page_size


def page_of(rows: DataFrame, sort: list[Column], page: int, page_size: int, backwards: list[Column] | None = None) -> DataFrame:
    """One page, clamped. The total comes first; then only the rows up to the page's end are sorted (TakeOrdered). Where `backwards` is given, the same order from its end, a page of the second half is taken from there: the last one needs a page's rows, not all."""
    total = rows.count()
    _, _, offset = paging(total, page, page_size)
    after = max(0, total - offset - page_size)
    if backwards is None or offset <= after:
        return rows.orderBy(*sort).offset(offset).limit(page_size)
    return rows.orderBy(*backwards).offset(after).limit(total - offset - after).orderBy(*sort)


def facets(rows: DataFrame) -> DataFrame:
    """(dimension, id, label, count) of six dimensions, from one pass and one shuffle of partial counts."""
    single = {"region": "regionId", "category": "categoryId", "employment": "employmentType", "remote": "remote", "source": "sourceId"}
    pairs = F.array_append(
        F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("id")) for d, c in single.items()]), F.struct(F.lit("").alias("dimension"), F.lit(None).cast("string").alias("id"))
    )
    every = F.concat(pairs, F.transform(F.coalesce("languages", F.array().cast("array<string>")), lambda x: F.struct(F.lit("language").alias("dimension"), x.alias("id"))))
    counted = rows.select(F.explode(every).alias("x")).where("x.id is not null").groupBy("x.dimension", "x.id").agg(F.count("*").alias("count"))
    return counted.select("dimension", "id", with_label(F.col("dimension"), F.col("id")).alias("label"), "count")


def with_label(dimension: Column, id_: Column) -> Column:
    from tamarack.taxonomy import DIMENSIONS

    return F.coalesce(*[F.when(dimension == d, label(d, id_)) for d in DIMENSIONS], id_)


def one_facet(rows: DataFrame, column: str, dimension: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("id")).agg(F.count("*").alias("count")).select("id", label(dimension, F.col("id")).alias("label"), "count")


def search(rows: DataFrame, query: JobQuery, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, facets, paging) of a query: facets count all that is filtered, a dimension's own filter included.

    The total is counted at once, items and facets when they are read, each by a pass that reads the columns it needs. Nothing is cached here: give rows persisted, and release them, where they are dear to make."""
    found = rows.where(matches(query, as_of))
    total = found.count()
    page, pages, offset = paging(total, query.page, query.page_size)
    items = found.orderBy(*order(query.sort, query.q, as_of)).offset(offset).limit(query.page_size)
    return items, facets(found), rows.sparkSession.createDataFrame([(total, page, query.page_size, pages)], "total long, page int, page_size int, total_pages int")


def sponsored_first(page: DataFrame, sponsors: Sequence[str], sort: list[Column]) -> DataFrame:
    """A page with the postings of sponsors first; both parts keep their order."""
    return page.orderBy(F.coalesce(F.col("sourceId").isin(*sponsors), F.lit(False)).desc(), *sort)


__all__ = ["JobQuery", "annual", "facets", "haystack", "matches", "one_facet", "order", "page_of", "paging", "relevance", "search", "sponsored_first", "trim", "words"]
