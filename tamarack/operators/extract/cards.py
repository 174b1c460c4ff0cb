"""Lists of postings as cards: one reader, one set of DataFrame rules, and a table of settings for the sites.

The reader lists the elements of a page that a site's settings name, each with the card it stands in; a card's title, address, place and kind are then the first of its elements that fit."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.dates import parse_french_date
from tamarack.functions.rules import has, map_employment_type
from tamarack.functions.text import clean_text, deslugify, slugify
from tamarack.operators.extract import dom
from tamarack.operators.extract.pages import MARKETING_PREFIX, NAV_LABELS, clean_board_title

HEADING = r"^h[1-6] "


@dataclass(frozen=True)
class Site:
    """Settings of one site. Patterns of elements are matched against `tag #id .class1 .class2 ` (with a blank after each part); those of addresses against the href."""

    card: str  # the card's element; cards within cards are their own
    title: str = HEADING
    link: str | None = None  # the link's address; None: the address is the page's with the title's slug
    link_element: str = "^a "
    place: str | None = None
    kind: str | None = None
    posted: str | None = None
    needs: str | None = None  # what the whole card's text must have
    not_title: str | None = None
    not_link: str | None = None
    slug_title: str | None = None  # a pattern of the address whose group is the title, before ("first") or after ("last") the elements
    slug_first: bool = False
    drop_title: str | None = None  # what is cut from a title
    longest: int = 120
    join_slash: bool = False  # "/#" instead of "#" before a title's slug
    keep_query: bool = False
    absolute: bool = False  # only addresses that were absolute
    joined_places: bool = False
    link_optional: bool = False  # without a link the address is the page's with the title's slug


#: What the sites' pages look like.
SITES = {
    "avature": Site(card=r"^article .*\.article--result ", title=r"^a .*\.link |^a .*in~article__header__text__title ", link=r".", link_element=r"^a .*\.link |^a .*in~article__header__text__title ", place=r"\.list-item-location ", posted=r"\.list-item-posted "),
    "canam": Site(card=r"^a .*\.c-card-job ", title=r"\.c-card-job__title ", link=r"/emploi/", link_element=r"^a .*\.c-card-job ", place=r"\.c-btn--tag ", joined_places=True),
    "guay": Site(card=r"\.card-position ", title=r"^h3 ", link=r".", place=r"^p .*in~content ", kind=r"^p .*in~content ", absolute=True),
    "charpentistes": Site(card=r"^a .*in~sqs-html-content ", title=r"^a ", link=r"^(?!mailto:|tel:|#)", not_link=r"/(commercial|residentiel|r[ée]sidentiel|sur-mesure|carrieres|carri[èe]res|contact|a-propos|about|services?)/?$", drop_title=r"\s+recherch[ée]e?s?\s*$", keep_query=True),
    "drolet": Site(card=r"\.w-dyn-item |rolelistitem ", title=HEADING, link=r"/postes-disponible/", slug_title=r"([^/]+)/*$"),
    "revenco": Site(card=r"^\S+ .*\.row .*\.emploi |^\S+ .*\.emploi .*\.row ", title=r"^h3 ", link=r"/emplois/", kind=r"^p ", absolute=True),
    "electricitemc2": Site(card=r"\.elementor-image-box-title ", title=r"\.elementor-image-box-title ", not_title=r"candidature\s+spontan", join_slash=True),
    "excavationsrsr": Site(card=r"\.e-n-accordion-item-title-text |\.e-n-accordion-item-title |\.elementor-accordion-title |\.elementor-tab-title ", title=".", not_title=r"^(faq|questions?|nos\s+valeurs|avantages?|pourquoi|à\s+propos|contact|candidature\s+spontan)", longest=90, join_slash=True),
    "galilee": Site(card=r"^h3 ", title=r"^h3 ", not_title=r"^(emplois?\s+disponibles?|carri[èe]res?|nos\s+valeurs|flexibilit|environnement|apprentissage|avantages?|navigation|nous\s+joindre)", longest=90),
    "stefetmax": Site(card=r"^h3 ", title=r"^h3 ", not_title=r"postes?\s+suivants?|recherche de candidatur|candidature spontan|expansion|nous joindre|vos designers|heures d['’]ouverture|que ce soit|foire aux questions|^faq$|^.{71,}", drop_title=r"[.\s]+$", longest=70),
    "jackstaff": Site(card=r"^a ", title=r"^a ", link=r"(?i)/opportunite-d-emploi/[^/]+/[^/]+/\d+", slug_title=r"(?i)/opportunite-d-emploi/[^/]+/([^/]+)/\d+", slug_first=True, keep_query=True),
    "jobillico": Site(card=r"\.card__content |^li |\.card ", title=r"^a ", link=r"/offre-d-emploi/.*/\d{4,}(?:\?|$)", place=r"^p (?!.*\.mb0 )(?!.*\.date )"),
    "jobs-listing": Site(card=r"^li .*in~jobs-listing ", title=r"^a ", link=r"^(?!#)", not_title=NAV_LABELS + "|" + MARKETING_PREFIX, place=r"^span (?!.*ina )", keep_query=True),
    "wix": Site(card=r"\.wixui-repeater__item ", title=HEADING, link=r"^https?://(?!.*(?:facebook|instagram|linkedin\.com|youtube))", needs=r"temps\s*plein|temps\s*partiel|permanent|contractuel|contrat|saisonnier|temporaire|\d+\s*h\b|\d+\s*heures|\bstage\b|\bccq\b", place=HEADING, kind=HEADING, longest=140, keep_query=True, link_optional=True),
}
#: Fixed value: what tells a kind of contract from a place among a card's headings.
JOB_TYPE = SITES["wix"].needs


#: Texts of more characters are not listed: a card holds less.
LONGEST_CARD = 5_000


class Reader:
    """A site's settings, ready to be held against elements."""

    def __init__(self, site: Site):
        find = lambda pattern, flags=0: re.compile(pattern, flags).search if pattern else lambda x: None
        self.card, self.title, self.link_element, self.place, self.kind, self.posted = map(find, (site.card, site.title, site.link_element if site.link else None, site.place, site.kind, site.posted))
        self.link, self.not_link, self.not_title, self.needs = find(site.link), find(site.not_link, re.I), find(site.not_title, re.I), find(site.needs, re.I)
        self.absolute, self.all_have = site.absolute, site.needs is None
        self.around = frozenset(re.findall(r"in~([\w-]+)", " ".join(x for x in (site.card, site.title, site.link_element, site.place, site.kind, site.posted) if x)))

    def rows(self, html: str, url: str | None) -> list[tuple]:
        """(card, pos, href, text, is_title, is_link, is_place, is_kind, is_posted, has_needed) of the elements inside cards that the settings name, in page order; card: the number of the innermost card."""
        page = dom.Page(html)
        texts = page.texts(LONGEST_CARD)
        inside: list[frozenset] = []
        number, cards, found = [], 0, []
        linked: list[bool] = []
        for k, (tag, a, up) in enumerate(zip(page.tag, page.attributes, page.parent, strict=True)):
            above, in_link = (inside[up], linked[up]) if up >= 0 else (frozenset(), False)
            classes = a.get("class", "").split()
            own = self.around.intersection(classes)
            inside.append(above | own if own - above else above)
            linked.append(in_link or tag == "a")
            number.append(number[up] if up >= 0 else 0)
            if page.hidden[k] or tag in dom.HIDDEN:
                continue
            parts = [tag, *([f"#{a['id']}"] if a.get("id") else []), *(f".{c}" for c in classes), *(["rolelistitem"] if a.get("role") == "listitem" else []), *sorted(f"in~{c}" for c in above), *(["ina"] if in_link else [])]
            signature = " ".join(parts) + " "
            if is_card := self.card(signature):
                cards += 1
                number[k] = cards
            if not number[k]:
                continue
            flags = [bool(f(signature)) for f in (self.title, self.link_element, self.place, self.kind, self.posted)]
            if is_card or any(flags):
                text, raw = texts[k] or a.get("title", "").strip(), a.get("href")
                href = dom.absolute(url, raw)
                flags = [f and text != "" for f in flags]
                title = flags[0] and not self.not_title(text)
                link = bool(self.link_element(signature)) and raw is not None and bool(self.link(raw)) and (not self.absolute or raw.lower().startswith(("http://", "https://"))) and not self.not_link(href or "")
                found.append((number[k], len(found), href, text, title, link, *flags[2:], self.all_have or bool(self.needs(text))))
        return found


_ROW = "site string, page_id long, base string, card long, pos long, href string, text string, is_title boolean, is_link boolean, is_place boolean, is_kind boolean, is_posted boolean, has_needed boolean"
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.bool_()] * 6]


def card_elements(pages: DataFrame, sites: dict[str, Site]) -> DataFrame:
    """Rows of _ROW of pages (page_id, site, url, html), each read by its site's settings; pages of other sites give none."""

    def kernel(batches):
        readers = {name: Reader(site) for name, site in sites.items()}
        for batch in dom.slices(batches):
            rows = []
            for site, page, url, source in zip(*(batch[c].to_pylist() for c in ("site", "page_id", "url", "html")), strict=True):
                rows += [(site, page, url, *row) for row in (readers[site].rows(source, url) if site in readers and source else ())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=[c.split()[0] for c in _ROW.split(", ")])

    return pages.select("site", "page_id", "url", "html").mapInArrow(kernel, _ROW)


def parse_sites(pages: DataFrame, sites: dict[str, Site], as_of=None) -> DataFrame:
    """(site, page_id, url, title, location, employmentType, postedAt) of pages (page_id, site, url, html) of any of `sites`: one reading and one grouping for all. The first card of an address counts. Relative dates count from `as_of` (a column or
    a text of a time); without it they are null."""
    rows = card_elements(pages, sites)
    of = lambda test: F.col("site").isin([n for n, s in sites.items() if test(s)]) if any(map(test, sites.values())) else F.lit(False)
    keys = ["site", "page_id", "base", "card"]
    first = lambda value, where: F.min_by(F.when(where, value), F.when(where, F.col("pos")))
    kind_of, same = has(F.col("text"), JOB_TYPE), of(lambda s: s.place is not None and s.place == s.kind)  # told apart by their words
    titled = rows.withColumn("title_pos", F.min(F.when(F.col("is_title"), F.col("pos"))).over(Window.partitionBy(*keys)))
    every = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_place") & of(lambda s: s.joined_places), F.struct("pos", "text")))), lambda x: x["text"]), ", ")  # the elements of one card
    place = F.col("is_place") & (F.col("pos") > F.col("title_pos")) & ~(same & kind_of)
    cards = titled.groupBy(*keys).agg(
        first(F.col("text"), F.col("pos") == F.col("title_pos")).alias("title"), first(F.col("href"), F.col("is_link")).alias("href"), first(F.col("text"), place).alias("place"), every.alias("places"),
        first(F.col("text"), F.col("is_kind") & (~same | kind_of)).alias("kind"), first(F.col("text"), F.col("is_posted")).alias("posted"), F.max("has_needed").alias("has_needed"),
    )
    title = clean_text("title")
    for name, s in sites.items():
        own = F.col("site") == name
        if s.slug_title:
            slug = deslugify(F.try_url_decode(F.regexp_extract(F.regexp_replace("href", "[?#].*$", ""), s.slug_title, 1)))
            good = F.length(slug) >= 4
            title = F.when(own, F.when(good, slug).otherwise(title) if s.slug_first else F.coalesce(F.nullif(title, F.lit("")), F.when(good, slug))).otherwise(title)
        if s.drop_title:
            title = F.when(own, F.trim(F.regexp_replace(title, f"(?iu){s.drop_title}", ""))).otherwise(title)
    cards = cards.where("has_needed").withColumn("title", clean_board_title(title))
    base = F.regexp_replace(F.regexp_replace("base", "#.*$", ""), "/+$", "")
    fragment = F.concat(base, F.when(of(lambda s: s.join_slash), "/#").otherwise("#"), slugify(F.col("title")))
    address = F.when(of(lambda s: s.keep_query), F.regexp_replace("href", "#.*$", "")).otherwise(F.regexp_replace("href", "[?#].*$", ""))
    url = F.when(of(lambda s: s.link is None), fragment).when(of(lambda s: s.link_optional), F.coalesce(address, fragment)).otherwise(address)
    longest = F.lit(120)
    for length in {s.longest for s in sites.values()}:
        longest = F.when(of(lambda s, n=length: s.longest == n), length).otherwise(longest)
    out = cards.withColumn("url", url).where(F.col("url").isNotNull() & (F.length("title") >= 3) & (F.length("title") <= longest))
    out = out.withColumn("n", F.row_number().over(Window.partitionBy("site", "page_id", "url").orderBy("card"))).where("n = 1")
    posted = parse_french_date(F.regexp_replace("posted", r"(?iu)^publi[ée]\s*", ""), F.lit(as_of).cast("timestamp"))
    location = F.nullif(F.when(of(lambda s: s.joined_places), F.col("places")).otherwise(F.col("place")), F.lit(""))
    return out.select("site", "page_id", "url", "title", location.alias("location"), map_employment_type(F.col("kind")).alias("employmentType"), posted.alias("postedAt"))


def parse_cards(pages: DataFrame, site: Site | str, as_of=None) -> DataFrame:
    """parse_sites of pages (page_id, url, html) of one site, by its name or settings."""
    name = site if isinstance(site, str) else "own"
    return parse_sites(pages.select("page_id", F.lit(name).alias("site"), "url", "html"), {name: SITES[site] if isinstance(site, str) else site}, as_of).drop("site")


def parse_all(pages: DataFrame, as_of=None) -> DataFrame:
    """parse_sites of pages (page_id, site, url, html) of all known sites."""
    return parse_sites(pages, SITES, as_of)


def item_list(pages: DataFrame) -> DataFrame:
    """(page_id, url, name) of the postings in a board page's ItemList; of an address that repeats the last name counts."""

    def kernel(batches):
        for batch in dom.slices(batches):
            ids, places, urls, names = [], [], [], []
            for page, source in zip(batch["page_id"].to_pylist(), batch["html"].to_pylist(), strict=True):
                for block in dom.scripts(source, "application/ld+json") if source and "ItemList" in source else ():
                    try:
                        data = json.loads(block) if "ItemList" in block else []
                    except (ValueError, RecursionError):
                        continue
                    for node in data if isinstance(data, list) else [data]:
                        for item in (node.get("itemListElement") if isinstance(node, dict) else None) or []:
                            if isinstance(item, dict) and isinstance(item.get("url"), str):
                                ids.append(page), places.append(len(places)), urls.append(item["url"]), names.append(item["name"] if isinstance(item.get("name"), str) else "")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(urls, pa.string()), pa.array(names, pa.string())], names=["page_id", "pos", "url", "name"])

    rows = pages.select("page_id", "html").mapInArrow(kernel, "page_id long, pos long, url string, name string").where(F.col("url").rlike("(?i)offre-d?-?emploi"))
    return rows.groupBy("page_id", F.regexp_replace("url", r"\?.*$", "").alias("url")).agg(clean_text(F.max_by("name", "pos")).alias("name"))
