"""Properties of search, roll-ups, ingestion, registry and exports."""

import os
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tamarack.operators import alerts, ingest, joins, resolve, rollups, search
from tamarack.operators.extract import feeds, pages
from tamarack.sources import adapters, writers

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def test_query_parsing_round_trip():
    q = search.JobQuery.parse({"regions": " a, ,b ", "salary_min": "10", "page": "2", "q": "", "company": "x", "sort": "salary_desc"})
    assert q.regions == ("a", "b") and q.q is None and q.page == 2
    assert search.JobQuery.parse(q.params()) == q
    assert q.filters_only() == {"regions": "a,b", "salary_min": "10.0"}
    for bad in ({"sort": "x"}, {"page_size": "101"}, {"page": "0"}):
        with pytest.raises(ValueError, match="sort|page"):
            search.JobQuery.parse(bad)


def test_pages_cover_the_sort(spark):
    rows = adapters.job(spark, DATA).where("regionId = 'ASIA'").cache()
    whole = [r.id for r in rows.orderBy(*search.order()).collect()]
    n = -(-len(whole) // 100)
    assert sum(([r.id for r in search.page_of(rows, search.order(), k, 100).collect()] for k in range(1, n + 1)), []) == whole


def test_facets_sum_to_known_values_and_ignore_partitioning(spark):
    rows = adapters.job(spark, DATA).cache()
    sums = {r.dimension: r.n for r in search.facets(rows).groupBy("dimension").agg(F.sum("count").alias("n")).collect()}
    for dimension, column in (("region", "regionId"), ("category", "categoryId"), ("source", "sourceId")):
        assert sums[dimension] == rows.where(F.col(column).isNotNull()).count()
    assert sorted(map(tuple, search.facets(rows).collect())) == sorted(map(tuple, search.facets(rows.repartition(7, "title")).collect()))


def test_roll_up_counts_every_posting(spark):
    rows = adapters.job(spark, DATA)
    assert rollups.hiring_companies(rows).agg(F.sum("openings")).first()[0] == rows.count()
    assert sorted(map(tuple, rollups.hiring_companies(rows).collect())) == sorted(map(tuple, rollups.hiring_companies(rows.repartition(5)).collect()))


KIND = "id string, sourceId string, url string, title string"


def jobs(spark, rows):
    return spark.createDataFrame(rows, KIND)


def batch(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], KIND + ", ord int")


def signal(spark, source, reachable=False, explicit=False, force=False):
    return spark.createDataFrame([(source, reachable, explicit, force)], "sourceId string, reachable_empty boolean, explicit_empty boolean, force boolean")


@pytest.mark.parametrize(
    ("stored", "read", "flags", "action"),
    [(5, 0, {"explicit": True}, "purge"), (50, 0, {"explicit": True}, "purge"), (10, 0, {"reachable": True}, "purge"), (11, 0, {"reachable": True}, "keep"), (5, 0, {"force": True}, "keep"), (10, 3, {}, "keep"), (10, 4, {}, "replace"), (10, 3, {"force": True}, "replace"), (9, 1, {}, "replace"), (0, 1, {}, "replace")],
)
def test_sync_policy(spark, stored, read, flags, action):
    target = jobs(spark, [(f"s{k}", "s", f"u{k}", "old") for k in range(stored)])
    incoming = batch(spark, [(f"s{k}", "s", f"u{k}", "new") for k in range(read)])
    assert ingest.sync_policy(target, incoming, signal(spark, "s", **flags)).first()["action"] == action
    left = ingest.sync_jobs(target, incoming, signal(spark, "s", **flags), "ord").collect()
    assert len(left) == {"purge": 0, "keep": max(stored, read), "replace": read}[action]


def test_upsert_is_idempotent_and_keeps_identity(spark):
    target = jobs(spark, [("a", "s1", "u1", "old"), ("b", "s1", "u2", "old")])
    incoming = batch(spark, [("x", "s2", "u1", "new"), ("c", "s2", "u3", "first"), ("c", "s2", "u3", "last")])
    once = ingest.upsert_jobs(target, incoming, "ord")
    assert sorted(map(tuple, once.select("url", "id", "sourceId", "title").collect())) == [("u1", "a", "s1", "new"), ("u2", "b", "s1", "old"), ("u3", "c", "s2", "last")]
    assert sorted(map(tuple, ingest.upsert_jobs(once, incoming, "ord").collect())) == sorted(map(tuple, once.collect()))
    assert tuple(ingest.upsert_counts(target, incoming).first()) == (1, 1)


def test_favorites(spark):
    kind = "user_id string, job_id string"
    remote, local = spark.createDataFrame([("u", "1"), ("u", "2")], kind), spark.createDataFrame([("u", "2"), ("u", "3")], kind)
    every, new = joins.merge_favorites(remote, local)
    assert every.count() == 3 and [r.job_id for r in new.collect()] == ["3"]
    assert sorted(r.job_id for r in joins.toggle_favorite(remote, local).collect()) == ["1", "3"]


def test_similar_jobs_match_brute_force(spark):
    rows = adapters.job(spark, DATA)
    every = rows.select("id", "regionId", "categoryId", "sourceId").collect()
    found = {}
    for r in joins.similar_jobs(rows.where("id in ('1', '11', '30')"), rows).orderBy("of", "rank").collect():
        found.setdefault(r["of"], []).append((r.score, r.id))
    for w in (e for e in every if e.id in ("1", "11", "30")):
        scored = [(2 * (w.regionId is not None and w.regionId == e.regionId) + 2 * (w.categoryId is not None and w.categoryId == e.categoryId) + (w.sourceId is not None and w.sourceId == e.sourceId), e.id) for e in every if e.id != w.id]
        assert found[w.id] == sorted((s for s in scored if s[0]), key=lambda s: (-s[0], s[1]))[:6]


def test_registry_csv_and_resolution(spark, tmp_path):
    head = ",".join(f"c{k}" for k in range(24))
    line = lambda lic, status, name, reg, other="": ",".join([lic, status, *[""] * 12, name, "", "Ville", "", "", reg, "", "", "", other])
    path = tmp_path / "registry.csv"
    path.write_text("\n".join([head, line("1111-1111-11", "Active", '"Béton, ""Fort"" inc."', "Laval"), line("2222-2222-22", "Active", '"Pont\nNeuf ltée"', "Montérégie"), line("3333-3333-33", "Active", "Pont Neuf", "Estrie"), line("bad", "Active", "Mur", "Laval"), line("4444-4444-44", "Annulée", "Mur", "Laval"), line("5555-5555-55", "active", "Toit", "Laval", "Autre Nom")]), encoding="utf-8")
    index = resolve.registry_index(writers.read_registry(spark, str(path)))
    employers = spark.createDataFrame([("1", "beton fort", None, None), ("2", "Pont Neuf", "monteregie", None), ("3", "PONT NEUF", None, None), ("4", "Mur", None, None), ("5", "Autre nom inc", None, None), ("6", "Toit", None, "has one")], "id string, name string, region string, rbq string")
    found = {r.id: (r.licence, r.outcome) for r in resolve.resolve_licences(employers, index).collect()}
    assert found == {"1": ("1111-1111-11", "assigned"), "2": ("2222-2222-22", "disambiguated"), "3": (None, "ambiguous"), "4": (None, "no match"), "5": ("5555-5555-55", "assigned")}


def test_exports_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'a "quoted", name', ["x", "y"], ["fr"]), ("2", None, None, None)], "id string, name string, tags array<string>, languages array<string>")
    stored = writers.to_stored(rows)
    assert [r.tags for r in writers.from_stored(stored).orderBy("id").collect()] == [["x", "y"], []]
    assert writers.from_stored(stored.withColumn("tags", F.lit("not json"))).first()["tags"] == []
    writers.export_csv(rows.select("id", "name"), str(tmp_path / "csv"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "csv").glob("part-*"))
    assert '"1","a ""quoted"", name"' in text
    employers = adapters.employer(spark, DATA)
    writers.export_employers(employers, str(tmp_path / "json"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "json").glob("part-*"))).splitlines()
    assert len(lines) == employers.count() and not any('"verified":false' in x or '"enabled":true' in x for x in lines)
    posting = adapters.job(spark, DATA).select(writers.job_posting().alias("j")).first()["j"]
    assert '"@type":"JobPosting"' in posting


def test_digest_and_cutoffs(spark):
    kind = "alert_id string, id string, url string, title string, company string, postedAt timestamp, scrapedAt timestamp, createdAt timestamp"
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", str(k), "u", "<t>", "c", start + timedelta(hours=k), start, start + timedelta(hours=k)) for k in range(40)], kind)
    newest = alerts.newest_of_each(rows)
    assert newest.count() == 30 and {r.total for r in newest.collect()} == {40}
    mail = alerts.digest(newest).first()
    assert mail.subject == "40 nouvelles offres" and mail.body.count("<li>") == 30 and "&lt;t&gt;" in mail.body


def test_heading_pairs_and_lists(spark):
    heads = spark.createDataFrame([("s", "c", "https://g/x#y", k, t) for k, t in enumerate(["Nos postes", "Soudeur", "Permanent | Laval", "Grutier", "Temps plein", "Temps plein", "Candidature spontanée", "Stage"])], "source_id string, company string, base string, pos int, text string")
    assert [(r.title, r.url, r.employmentType) for r in feeds.parse_heading_pairs(heads).orderBy("url").collect()] == [("Grutier", "https://g/x/#grutier", "temps-plein"), ("Soudeur", "https://g/x/#soudeur", "temps-plein")]
    text = "Intro\nEMPLOIS DISPONIBLES:\n** 3 POSTES DE CHAUFFEUR : **\n-- classe 1\n-- Classe 1\n** DÉNEIGEMENT **\n"
    rows = spark.createDataFrame([("s", "c", "b", text)], "source_id string, company string, base string, text string")
    assert sorted((r.title, r.url, r.employmentType) for r in feeds.parse_category_list(rows).collect()) == [("Chauffeur — Classe 1", "b#chauffeur-classe-1", None), ("Chauffeur — Classe 1", "b#chauffeur-classe-1-2", None), ("Déneigement", "b#deneigement", "saisonnier")]


def test_details_and_entities(spark):
    listed = spark.createDataFrame([("s", k, f"u{k}", None if k == 0 else f"t{k}", "Toronto, ON" if k == 1 else None) for k in range(4)], "source_id string, pos int, url string, title string, location string")
    details = spark.createDataFrame([("u0", "detail", "Laval", "d"), ("u2", "detail", "Calgary, AB", "d"), ("u3", "detail", "Laval", "d")], "url string, title string, location string, description string")
    found = {r.url: (r.title, r.location, r.description) for r in pages.with_details(listed, details, cap=2).collect()}
    assert found == {"u0": ("detail", "Laval", "d"), "u3": ("t3", None, None)}
    assert pages.decode_entities(spark.createDataFrame([("l&#x27;&eacute;t&eacute;",), (None,)], "t string"), "t").collect()[0].t == "l'été"


def test_word_alerts_have_no_nested_loop(spark):
    from datetime import datetime

    from tamarack.operators import alerts as A
    from tamarack.plans.ingest_queries import _ALERT_KIND

    day = datetime(2020, 1, 1)
    kinds = "id string, title string, company string, description string, tags array<string>, city string, regionId string, categoryId string, employmentType string, remote string, sourceId string, languages array<string>, salaryMin double, salaryMax double, salaryPeriod string, postedAt timestamp, createdAt timestamp"
    titles = ["Soudeur à Québec", "Électricien", "ab", "", None, "Peintre peintre", "Soudeuse industrielle", "x" * 5000 + " grutier"]
    jobs = spark.createDataFrame([(str(k), t, "Acme Béton" if k % 2 else "Zut", None, ["jour"], ["Saint-Jérôme", "Laval", None][k % 3], None, None, None, None, None, ["fr"], None, None, None, None, datetime(2020, 2, 1)) for k, t in enumerate(titles)], kinds)

    def alert(k, q=None, company=None, cities=None, languages=None):
        return (f"a{k}", "u", "", (q, company, None, cities, None, None, None, None, languages, None, None), day, day)

    cases = [alert(0, "soud"), alert(1, "QUEBEC sou"), alert(2, None, "béton"), alert(3, None, None, ["laval", "jérôme", "saint"]), alert(4, "ab"), alert(5, "de", None, ["laval"]), alert(6, "grutier xxx"), alert(7, "", "", []), alert(8, "zzz"), alert(9, "peintre", "acme", ["val"]), alert(10, None, None, ["la"]), alert(11, None, None, None, ["fr"]), alert(12, "acme jour")]
    names = re.findall(r"(\w+): ", _ALERT_KIND.partition("struct<")[2])
    order = {"q": 0, "company": 1, "cities": 3, "languages": 8}
    alerts = spark.createDataFrame([(*c[:3], {n: (c[3][order[n]] if n in order else None) for n in names}, c[4], c[5]) for c in cases], _ALERT_KIND)
    fold = lambda x: "".join(ch for ch in unicodedata.normalize("NFD", (x or "").lower()) if not unicodedata.combining(ch))
    want = set()
    for k, (_, _, _, (q, company, _, cities, *_rest), _, _) in enumerate(cases):
        for job in jobs.collect():
            hay = fold(" ".join(x for x in (job.title, job.company, job.description, *job.tags) if x))
            if all(w in hay for w in fold(q).split()) and fold(company) in fold(job.company) and (not cities or any(fold(c) in fold(job.city) for c in cities)):
                want.add((f"a{k}", job.id))
    got = A.match_alerts(jobs, alerts, F.lit(datetime(2020, 3, 1))).select("alert_id", "id")
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    many = spark.range(100_000).select("id", F.lit("u").alias("user_id"), F.lit("").alias("label"), F.lit(day).alias("created_at"), F.lit(day).alias("last_notified_at"))
    many = many.withColumn("query", F.struct(*[(F.concat(F.lit("mot"), "id") if n == "q" else F.lit(None).cast(alerts.schema["query"].dataType[n].dataType)).alias(n) for n in names]))
    plan = A.match_alerts(jobs, many, F.lit(datetime(2020, 3, 1)))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_only_touched_folders_are_rewritten(spark, tmp_path):
    from tamarack.sources import buckets as B

    rows = spark.createDataFrame([(f"u{k}", str(k), "s", f"old {k}") for k in range(200)], "url string, id string, sourceId string, title string")
    path = str(tmp_path / "stored")
    assert B.write_buckets(rows, path, buckets=16) == 200
    files = lambda: {f.relative_to(path).as_posix(): f.stat().st_mtime_ns for f in (tmp_path / "stored").rglob("*.parquet")}
    before = files()
    batch = spark.createDataFrame([("u3", "x", "t", "new 3", 1), ("u3", "y", "t", "newer 3", 2), ("fresh", "z", "t", "new", 1)], "url string, id string, sourceId string, title string, ord int")
    assert B.upsert_buckets(path, batch, "ord", rows.columns, buckets=16) == {"inserted": 1, "updated": 1}
    after = files()
    gone = {f.split("/")[0] for f in before.keys() - after.keys()}
    assert 1 <= len(gone) <= 2 and {f.split("/")[0] for f in after.keys() - before.keys()} >= gone and all(after[f] == before[f] for f in before if f.split("/")[0] not in gone)
    wanted = {tuple(r) for r in ingest.upsert_jobs(rows, batch, "ord").select(*rows.columns).collect()}
    assert {tuple(r) for r in B.read_buckets(spark, path, rows.columns).collect()} == wanted and len(wanted) == 201
    assert B.upsert_buckets(path, batch.limit(0), "ord", rows.columns, buckets=16) == {"inserted": 0, "updated": 0}


def test_deep_pages_read_their_range_alone(spark, tmp_path):
    from tamarack.sources import buckets as B

    rows = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 7 != 0, (F.col("id") * 37 % 100).cast("int")).alias("v"))
    sort = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    pages = B.ranged_pages(rows, sort, str(tmp_path / "pages"), 8)
    wanted = [tuple(r) for r in rows.orderBy(*sort).collect()]
    for page in (1, 2, 17, 50, 51, 999):
        k = min(page, 50)
        assert [tuple(r) for r in pages.page(spark, page, 20).collect()] == wanted[(k - 1) * 20 : k * 20]
    plan = pages.page(spark, 25, 20)._jdf.queryExecution().executedPlan().toString()
    assert len([b for b in range(8) if pages.before[b] < 500 and pages.before[b + 1] > 480]) <= 2 and "PartitionFilters: [" in plan and "range" in plan.split("PartitionFilters: [")[1][:80]
    assert B.ranged_pages(rows.limit(0), sort, str(tmp_path / "none"), 4).page(spark, 3, 20).count() == 0
