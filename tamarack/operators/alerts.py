"""Saved searches against new postings: data-driven predicates, cut-offs for each alert, digests."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.dates import days_since
from tamarack.functions.text import SPACE, escape_html, norm, words
from tamarack.operators.extract.pages import written_once
from tamarack.operators.search import annual, haystack
from tamarack.taxonomy import label

DIGEST = 30
#: Up to so many alerts of any kind meet the postings in one pass.
FEW = 256
#: Alerts of one kind are broadcast up to so many; beyond, those without a list to be joined by meet the postings in slices of this size.
SLICE = 20_000
#: Numbers to which words are hashed.
BUCKETS = 1 << 20
#: Lengths of the stretches by which words are found in longer ones.
STRETCHES = (3, 6, 12, 24)
#: Parts that an alert's matches are dealt to before its newest ones meet.
PARTS = 256
#: Lists of an alert by which it can be joined, the most selective first, and the postings' columns.
INDEXED = {"sources": "sourceId", "categories": "categoryId", "regions": "regionId", "employmentTypes": "employmentType", "remote": "remote"}

#: What alerts of text alone may ask for, and the postings' columns, beside their texts, that this is tested on.
TESTS = {"salaryMin": ["salaryMin", "salaryMax", "salaryPeriod"], "postedWithinDays": ["postedAt"], "languages": ["languages"], "q": [], "company": [], "cities": []}


def _any(column: str, wanted: Column) -> Column:
    return wanted.isNull() | (F.size(wanted) == 0) | F.coalesce(F.array_contains(wanted, F.col(column)), F.lit(False))


def _folded(alerts: DataFrame) -> DataFrame:
    """alerts with the texts of column `query` folded, once for each alert: q_words, q_company, q_cities."""
    return alerts.withColumns({"q_words": words("query.q"), "q_company": norm(F.col("query.company")), "q_cities": F.transform("query.cities", norm)})


def alert_predicate(as_of: Column, tests: Collection[str] | None = None) -> Column:
    """Whether a posting fits the alert in column `query`, whose texts `_folded` has prepared; absent parameters fit all. Of the parameters only `tests` are looked at, where they are given: those that any alert has."""
    q = lambda name: F.col(f"query.{name}")
    every = {name: _any(column, q(name)) for name, column in INDEXED.items()} | {
        "salaryMin": q("salaryMin").isNull() | F.coalesce(F.col("annual") >= q("salaryMin"), F.lit(False)),
        "postedWithinDays": q("postedWithinDays").isNull() | F.coalesce(days_since(F.col("postedAt"), as_of) <= q("postedWithinDays"), F.lit(False)),
        "languages": q("languages").isNull() | (F.size(q("languages")) == 0) | F.coalesce(F.arrays_overlap("languages", q("languages")), F.lit(False)),
        "q": q("q").isNull() | F.forall("q_words", lambda w: F.contains(F.col("hay"), w)),
        "company": q("company").isNull() | F.contains(F.col("company_folded"), F.col("q_company")),
        "cities": q("cities").isNull() | (F.size(q("cities")) == 0) | F.exists("q_cities", lambda c: F.contains(F.col("city_folded"), c)),
    }
    return reduce(lambda x, y: x & y, [c for name, c in every.items() if tests is None or name in tests], F.lit(True))


def _prepared(jobs: DataFrame, paid: bool = True) -> DataFrame:
    """jobs with what alerts look at, made once for each posting; without `paid` no alert asks for pay."""
    made = {"hay": haystack(), "company_folded": norm(F.col("company")), "city_folded": F.coalesce(norm(F.col("city")), F.lit(""))}
    return jobs.withColumns(made | {"annual": annual()} if paid else made)


def oldest_cutoff(alerts: DataFrame, as_of: Column) -> DataFrame:
    return alerts.agg(F.least(F.coalesce(F.min("last_notified_at"), as_of), as_of).alias("oldest"))


def _grams(text: Column, size: int | Column) -> Column:
    """The distinct stretches of a text of so many characters; none of a shorter one."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def _long_words(text: Column) -> Column:
    return F.filter(F.coalesce(words(text), F.array().cast("array<string>")), lambda w: F.length(w) >= STRETCHES[0])


def _bits(token: Column) -> tuple[Column, Column]:
    """The number that a word is hashed to, and its two of that number's 64 bits."""
    h = F.xxhash64(token)
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, k), F.lit(64)).cast("int"))
    return F.pmod(h, F.lit(BUCKETS)), bit(32).bitwiseOR(bit(40))


def _inside(needles: DataFrame, known: DataFrame) -> DataFrame:
    """word, token, n of the words of needles (word, letters) and the tokens of known (token, letters, n) that they lie in.

    Equal ones are joined. Longer tokens are found by a word's rarest stretch of 3, 6, 12 or 24 characters (the longest that it has): only tokens longer than the shortest word with stretches of a length are cut into these, and only words shorter than the longest token."""
    equal = needles.join(known, needles["word"] == known["token"]).select("word", "token", "n")
    longest = known.agg(F.max("letters").alias("n")).head()["n"] or 0
    size = F.element_at(F.filter(F.array(*map(F.lit, STRETCHES)), lambda x: x <= F.length("word")), -1)
    short = needles.where(F.col("letters") < longest).withColumn("size", size)
    least = {r["size"]: r["n"] for r in short.groupBy("size").agg(F.min("letters").alias("n")).collect()}  # one row for each of STRETCHES at most
    if not least:
        return equal
    none = F.array().cast("array<string>")
    cut = F.concat(*[F.when(F.col("letters") > n, _grams(F.col("token"), size)).otherwise(none) for size, n in sorted(least.items())])
    wanted = short.select("word", "letters", F.explode(_grams(F.col("word"), F.col("size"))).alias("gram"))
    held = written_once(known.where(F.col("letters") > min(least.values())).select("token", "n", F.col("letters").alias("of_token"), F.explode(cut).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi"))
    counts = held.groupBy("gram").agg(F.count("*").alias("tokens"))
    rare = wanted.join(counts, "gram", "left").groupBy("word").agg(F.min(F.struct(F.coalesce("tokens", F.lit(0)).alias("tokens"), "gram"))["gram"].alias("gram"), F.min("letters").alias("letters"))
    return equal.unionByName(rare.join(held, "gram").where((F.col("of_token") > F.col("letters")) & F.contains("token", F.col("word"))).select("word", "token", "n"))


def _by_words(prepared: DataFrame, alerts: DataFrame, fits: Column, towns: bool = True) -> DataFrame:
    """Alerts that must find a word of three letters or more in a posting: each stands under the one of its words (of its texts and company, or of each of its cities, any of which may be found) that the fewest postings have, and meets these alone.

    A word lies within one of the words of a posting, so it is looked up among the distinct words of all postings, not in every posting (`_inside`). So work grows with the postings' words and with the matches of the rarest words, not with alerts times postings.
    Postings are shuffled once, to the alerts of their words, and only under words that an alert needs: a broadcast set of 64 bits for each of at most BUCKETS numbers holds back the others. Without `towns` no alert names cities, and their words are left alone."""
    q = lambda name: F.col(f"query.{name}")
    must = F.concat(_long_words(q("q")), _long_words(q("company")))
    needles = F.when(F.size(must) > 0, F.array(must)).otherwise(F.transform(q("cities"), _long_words))
    listed = alerts.select("alert_id", F.posexplode(needles).alias("needle", "words")).select("alert_id", "needle", F.explode(F.array_distinct("words")).alias("word"))
    # made anew from the texts where it is needed, which is cheaper than to shuffle it
    has = F.array_distinct(F.filter(F.split(F.concat_ws(" ", "hay", "city_folded") if towns else F.col("hay"), f"{SPACE}+"), lambda w: F.length(w) >= STRETCHES[0]))

    known = written_once(prepared.select(F.explode(has).alias("token")).groupBy("token").agg(F.count("*").alias("n")).withColumn("letters", F.length("token")))
    words_ = listed.select("word").distinct().withColumn("letters", F.length("word"))
    pairs = written_once(_inside(words_, known))

    frequency = pairs.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("tokens"))
    chosen = listed.join(frequency, "word", "left").groupBy("alert_id", "needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))["word"].alias("word"))
    keys = chosen.groupBy("alert_id").agg(F.sort_array(F.collect_set("word")).alias("keys"))  # as many as an alert has cities
    under = pairs.select("word", "token").join(frequency.select("word", (F.col("tokens") == 1).alias("single")), "word")
    own = written_once(alerts.join(keys, "alert_id").select("*", F.explode("keys").alias("word")).join(under, "word"))
    number, bits = _bits(F.col("token"))
    used = F.broadcast(own.select("token").distinct().select(number.alias("number"), bits.alias("bits")).groupBy("number").agg(F.bit_or("bits").alias("all_bits")))  # BUCKETS rows at most
    sent = prepared.select("*", F.explode(has).alias("token")).withColumns({"number": number, "bits": bits}).join(used, "number").where(F.col("all_bits").bitwiseAND(F.col("bits")) == F.col("bits")).drop("number", "bits", "all_bits")
    # a posting that has a word in several of its own, or several of an alert's cities, counts once
    first = F.when(F.col("single"), F.lit(True)).otherwise(F.col("token") == F.element_at(F.filter(has, lambda t: F.contains(t, F.col("word"))), 1))
    once = F.when(F.size("keys") == 1, F.lit(True)).otherwise(F.col("word") == F.element_at(F.filter("keys", lambda w: F.exists(has, lambda t: F.contains(t, w))), 1))
    return sent.join(own, "token").where(fits & first & once).drop("token", "word", "keys", "single")


def match_alerts(jobs: DataFrame, alerts: DataFrame, as_of: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """(alert_id, job columns) of postings created after an alert's cut-off that fit it; of the job's columns those named, or all.

    The oldest cut-off of all alerts is a literal that prunes the scan of postings; the folded texts of a posting are computed once, not for each alert. Up to FEW alerts of any kinds are sent to the postings' tasks, which pass over the postings once.

    Of more, an alert that names sources, categories, regions, contracts or modes of work stands under each value of the first of these lists, and meets only postings of that value, by an equi-join; the rest of its predicate is tested there.
    Alerts of words, companies or places alone are found by words (`_by_words`), among postings that are made and written once, with the columns that these alerts and the result need. What is left, alerts of languages, pay, age or of shorter words alone, fits a large part of the postings: these alerts are sent to the postings' tasks, in slices
    whose size is bounded."""
    columns = list(jobs.columns if columns is None else columns)
    has = lambda n: F.coalesce(F.size(f"query.{n}"), F.lit(0)) > 0
    needle = (F.size(_long_words(F.col("query.q"))) > 0) | (F.size(_long_words(F.col("query.company"))) > 0)
    towns = has("cities") & F.forall("query.cities", lambda c: F.size(_long_words(c)) > 0)
    index = F.coalesce(*[F.when(has(n), F.lit(n)) for n in INDEXED], F.when(needle | towns, F.lit("text")))
    a = _folded(alerts.select(F.col("id").alias("alert_id"), "query", F.coalesce("last_notified_at", "created_at").alias("cutoff"), index.alias("by")))
    given = [F.count(F.when(has(n), 1) if n in ("languages", "cities") else f"query.{n}").alias(n) for n in TESTS]
    kinds = {r["by"]: r for r in a.groupBy("by").agg(F.count("*").alias("n"), F.min("cutoff").alias("oldest"), *given).collect()}  # one row for each list, and one without
    oldest = min((r["oldest"] for r in kinds.values() if r["oldest"] is not None), default=None)
    fresh = jobs.where(F.col("createdAt") > F.lit(oldest)) if oldest is not None else jobs.limit(0)
    prepared = _prepared(fresh)
    fits = (F.col("createdAt") > F.col("cutoff")) & alert_predicate(as_of)
    parts = []
    if 0 < sum(r["n"] for r in kinds.values()) <= FEW:
        parts, kinds = [prepared.join(F.broadcast(a), fits)], {}
    for name in (n for n in INDEXED if n in kinds):
        own = a.where(F.col("by") == name).select("*", F.explode(F.array_distinct(f"query.{name}")).alias("value"))
        own = F.broadcast(own) if kinds[name]["n"] <= SLICE else own
        parts.append(prepared.join(own, (F.col(INDEXED[name]) == F.col("value")) & fits).drop("value"))
    if "text" in kinds:
        tests = [n for n in TESTS if kinds["text"][n]]  # an alert of text alone has no lists
        read = {"createdAt", "title", "company", "description", "tags", "city"}.union(*[TESTS[n] for n in tests])
        narrow = _prepared(written_once(fresh.select(*[c for c in fresh.columns if c in columns or c in read])), "salaryMin" in tests)
        parts.append(_by_words(narrow, a.where(F.col("by") == "text"), (F.col("createdAt") > F.col("cutoff")) & alert_predicate(as_of, tests), "cities" in tests))
    pieces = -(-kinds[None]["n"] // SLICE) if None in kinds else 0
    for k in range(pieces):
        own = a.where(F.col("by").isNull() & (F.pmod(F.xxhash64("alert_id"), F.lit(pieces)) == k))
        parts.append(prepared.join(F.broadcast(own), fits))  # SLICE alerts or few more
    parts = parts or [prepared.join(a, F.lit(False))]
    return reduce(DataFrame.unionByName, [p.select("alert_id", *columns) for p in parts])


def describe(source_name: Callable[[Column], Column] | None = None) -> Column:
    """The criteria of the alert in column `query` in words; source_name maps an id to a name (default: the id)."""
    q = lambda name: F.col(f"query.{name}")
    each = lambda name, text: F.coalesce(F.transform(q(name), text), F.array().cast("array<string>"))
    one = lambda value, text: F.when(value.isNotNull(), F.array(text)).otherwise(F.array().cast("array<string>"))
    cities = F.nullif(F.array_join(q("cities"), ", "), F.lit(""))
    parts = F.concat(
        one(F.nullif(q("q"), F.lit("")), F.concat(F.lit("« "), q("q"), F.lit(" »"))), one(cities, cities), each("regions", lambda x: label("region", x)), each("categories", lambda x: label("category", x)), each("employmentTypes", lambda x: label("employment", x)), each("remote", lambda x: label("remote", x)),
        each("languages", F.upper), each("sources", source_name or (lambda x: x)), one(q("salaryMin"), F.concat(F.lit("≥ "), F.format_string("%.0f", "query.salaryMin"), F.lit(" $/an"))),
    )
    return F.coalesce(F.nullif(F.array_join(parts, " · "), F.lit("")), F.lit("Toutes les nouvelles offres"))


def create_alerts(alerts: DataFrame, new: DataFrame) -> DataFrame:
    """alerts with those of new whose id isn't there; a new alert has nothing notified yet, so its cut-off is its creation. A repeated new id counts once, by its latest creation, then its label."""
    columns = [c for c in alerts.columns if c != "id"]
    once = new.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("created_at", "label")).alias("r")).select("id", "r.*")
    added = once.join(alerts.select("id"), "id", "left_anti").withColumn("last_notified_at", F.lit(None).cast(alerts.schema["last_notified_at"].dataType))
    return alerts.unionByName(added.select(*alerts.columns))


def delete_alerts(alerts: DataFrame, gone: DataFrame) -> DataFrame:
    """alerts without those of gone (id, user_id): only their owner removes them."""
    return alerts.join(gone.select("id", "user_id").distinct(), ["id", "user_id"], "left_anti")


def newest_of_each(matches: DataFrame, k: int = DIGEST) -> DataFrame:
    """The k newest matches of each alert, with the true total, from one reading of the matches. They are counted and cut in PARTS parts of an alert; only the k newest of each part meet."""
    newest = [F.coalesce("postedAt", "scrapedAt").desc_nulls_last(), F.col("id").asc()]
    part = Window.partitionBy("alert_id", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    some = matches.withColumns({"part_rank": F.row_number().over(part.orderBy(*newest)), "part_total": F.count("*").over(part)}).where(F.col("part_rank") <= k)
    alert = Window.partitionBy("alert_id")
    ranked = some.withColumns({"rank": F.row_number().over(alert.orderBy(*newest)), "total": F.sum(F.when(F.col("part_rank") == 1, F.col("part_total"))).over(alert)}).where(F.col("rank") <= k)
    return ranked.select("alert_id", *[c for c in matches.columns if c != "alert_id"], "rank", "total")


def advance(alerts: DataFrame, matches: DataFrame, sent: DataFrame) -> DataFrame:
    """Alerts whose digest was sent move their cut-off to the newest posting evaluated; others keep theirs."""
    reached = matches.groupBy(F.col("alert_id").alias("id")).agg(F.max("createdAt").alias("reached")).join(sent.select("id").distinct(), "id", "left_semi")
    return alerts.join(reached, "id", "left").withColumn("last_notified_at", F.coalesce("reached", "last_notified_at")).select(*alerts.columns)


def digest(newest: DataFrame) -> DataFrame:
    """alert_id, subject and body (HTML) of each alert's mail."""
    line = F.concat(F.lit('<li><a href="'), escape_html(F.col("url")), F.lit('">'), escape_html(F.col("title")), F.lit("</a> — "), escape_html(F.col("company")), F.lit("</li>"))
    items = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))  # DIGEST lines at most
    grouped = newest.groupBy("alert_id").agg(items.alias("items"), F.max("total").alias("total"))
    plural = F.when(F.col("total") > 1, "s").otherwise("")
    subject = F.concat(F.col("total").cast("string"), F.lit(" nouvelle"), plural, F.lit(" offre"), plural)
    return grouped.select("alert_id", subject.alias("subject"), F.concat(F.lit("<ul>"), F.array_join(F.transform("items", lambda x: x["line"]), ""), F.lit("</ul>")).alias("body"))
