"""Shapes that only larger tables have."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tamarack import registry
from tamarack.plans.base import rounded

registry.load()
SMALL = "/root/testdata/sf0.001"


def same_as_sql(spark, folder, name, tables):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found, wanted = registry.QUERIES[name](spark, str(folder)).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns) and len(wanted)
    rows = lambda f: sorted(map(str, f[sorted(f.columns)].astype(object).itertuples(index=False, name=None)))
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("heading", ["a &amp; b&amp", "x &lt;y&gt; &quot;z&quot; &am", "&amp;lt; &ampx;"])
def test_headings_with_cut_references(spark, tmp_path, heading):
    spark.createDataFrame([(1, "http://a/b", f"<html><body><h1>{heading}</h1><p>t</p></body></html>")], "page_id long, url string, html string").toPandas().to_parquet(tmp_path / "pages.parquet")
    same_as_sql(spark, tmp_path, "extract_headings", ["pages"])


def test_amounts_are_rounded_as_in_sql(spark):
    values = [143238.895, 139573.395, 142076.955, 2387.615, 9903.005, 1.005, -2.675, 0.125, 100.0, 12345678.115]
    wanted = [duckdb.execute(f"SELECT round({v!r}::DOUBLE, 2)").fetchall()[0][0] for v in values]
    got = [r.v for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(rounded("v", 2).alias("v")).collect()]
    assert got == wanted
    assert [r.v for r in spark.createDataFrame([(None,)], "v double").select(rounded("v", 2).alias("v")).collect()] == [None]


def test_run_counts_by_whole_seconds(spark, tmp_path):
    moments = ["2024-01-09 11:59:59.4", "2024-01-09 11:59:59.500001", "2024-01-09 11:59:59.7", "2024-01-09 12:00:00", "2024-01-09 17:59:59.5", "2024-01-09 17:59:58.5", "2024-01-09 18:00:00.2"]
    values = ", ".join(f"({k}, TIMESTAMP '{m}', {k}, 'view', {k}.5, '{{}}')" for k, m in enumerate(moments))
    duckdb.execute(f"COPY (SELECT * FROM (VALUES {values}) v(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet'")
    duckdb.execute(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value::DOUBLE AS value, props FROM '{tmp_path}/events.parquet') TO '{tmp_path}/e.parquet'")
    (tmp_path / "e.parquet").rename(tmp_path / "events.parquet")
    tables = "region nation customer supplier part orders lineitem".split()
    for t in tables:
        (tmp_path / f"{t}.parquet").symlink_to(f"{SMALL}/{t}.parquet")
    same_as_sql(spark, tmp_path, "stream_run_counts", ["events", *tables])


_JOB = "id string, title string, company string, description string, tags array<string>, city string, regionId string, categoryId string, employmentType string, remote string, sourceId string, languages array<string>, salaryMin double, salaryMax double, salaryPeriod string, postedAt timestamp, createdAt timestamp, scrapedAt timestamp"


def _alerts(spark, given):
    from datetime import datetime

    from tamarack.plans.ingest_queries import _ALERT_KIND

    names = ["q", "company", "regions", "cities", "categories", "employmentTypes", "remote", "sources", "languages", "salaryMin", "postedWithinDays"]
    return spark.createDataFrame([(k, "u", "", tuple(q.get(n) for n in names), datetime(2020, 1, 1), None) for k, q in given.items()], _ALERT_KIND)


def _jobs(spark, rows):
    from datetime import datetime

    day = datetime(2020, 2, 1)
    return spark.createDataFrame([(str(k), title, company, None, ["jour"], city, region, None, None, None, "s1" if k % 2 else None, ["fr"], None, None, None, day, day, day) for k, (title, company, city, region) in enumerate(rows)], _JOB)


def test_names_alike_meet_only_their_own_postings(spark):
    """The fault was one key for all names with a common three-letter stretch: candidates grew with alerts times postings."""
    from pyspark.sql import functions as F

    from tamarack.functions.text import norm
    from tamarack.operators import alerts as A

    names = [f"Customer#{k:09d}" for k in range(0, 60_000, 100)]
    jobs = _jobs(spark, [("Soudeur", n, "Laval", None) for n in names])
    prepared = jobs.withColumns({"hay": A.haystack(), "company_folded": norm(F.col("company")), "city_folded": norm(F.col("city"))})
    alerts = A._folded(_alerts(spark, {n: {"q" if k % 2 else "company": n} for k, n in enumerate(names)}).select(F.col("id").alias("alert_id"), "query"))
    met = A._by_words(prepared, alerts, F.lit(True)).select("alert_id", "company").collect()
    assert len(met) == len(names) and all(r.alert_id == r.company for r in met)


@pytest.mark.parametrize("few", [0, 1000])
def test_alerts_match_by_index_as_in_one_pass(spark, monkeypatch, few):
    import unicodedata

    from pyspark.sql import functions as F

    from tamarack.operators import alerts as A

    fold = lambda x: "".join(c for c in unicodedata.normalize("NFD", (x or "").lower()) if not unicodedata.combining(c))
    monkeypatch.setattr(A, "FEW", few), monkeypatch.setattr(A, "SLICE", 2), monkeypatch.setattr(A, "BUCKETS", 8)
    posted = [("Soudeur à Québec", "Acme Béton", "Laval", "r1"), ("Peintre peintre peintres", "Béton Acme inc", "Saint-Jérôme", "r2"), (None, None, None, None), ("x" * 40, "A B C", "Laval", "r1"), ("contremaîtresse-soudeuse", "Zut", "Val David", "r3"), ("ab", "zz", "Saint-Laval", "r2")]
    given = {"a": {"q": "soud"}, "b": {"company": "acme béton"}, "c": {"company": "a b c"}, "d": {"q": "peintre"}, "e": {"cities": ["laval", "saint", "val"]}, "f": {"cities": ["la"]}, "g": {"q": "x" * 30}, "h": {"q": "x" * 41}, "i": {"q": ""}, "j": {}, "k": {"regions": ["r1", "r1", "r2"]}, "l": {"regions": ["r3"], "q": "soudeuse"}, "m": {"q": "contremaitresse sou"}, "n": {"cities": ["saint-l", "erome"], "q": "a"}, "o": {"company": "ton ac"}, "p": {"sources": ["s1"], "company": "béton"}}
    want = set()
    for k, q in given.items():
        for i, (title, company, city, region) in enumerate(posted):
            hay = " ".join(fold(x) for x in (title, company, "jour") if x is not None)
            fits = all(w in hay for w in fold(q.get("q")).split()) and (q.get("company") is None or company is not None and fold(q["company"]) in fold(company)) and (not q.get("cities") or any(fold(c) in fold(city) for c in q["cities"]))
            if fits and (not q.get("regions") or region in q["regions"]) and (not q.get("sources") or i % 2):
                want.add((k, str(i)))
    from datetime import datetime

    rows = [tuple(r) for r in A.match_alerts(_jobs(spark, posted), _alerts(spark, given), F.lit(datetime(2020, 3, 1))).select("alert_id", "id").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_postings_are_made_once_for_alerts_of_text(spark):
    """The fault was postings made once for their words and again to be matched, shuffled twice then, and under words that no alert needs."""
    from datetime import datetime

    from tamarack.operators import alerts as A

    names = [f"Customer#{k:09d}" for k in range(600)]
    jobs, seen = _jobs(spark, [("Soudeur", n, "Laval", None) for n in names]), spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    alerts = _alerts(spark, {n: {"q" if k % 2 else "company": n} for k, n in enumerate(names)})
    found = A.match_alerts(jobs.mapInArrow(count, jobs.schema), alerts, F.lit(datetime(2020, 3, 1)), ["company", "id"])
    rows = found.collect()
    assert found.columns == ["alert_id", "company", "id"] and len(rows) == 600 and all(r.alert_id == r.company for r in rows) and seen.value == 600


def test_words_are_cut_only_for_longer_tokens(spark, monkeypatch):
    from tamarack.operators import alerts as A

    def inside(words, tokens):
        cut = []
        monkeypatch.setattr(A, "written_once", lambda rows: cut.append(rows) or rows)
        table = lambda given, name: spark.createDataFrame([(w, 2) for w in given], f"{name} string, n long").withColumn("letters", F.length(name))
        found = sorted((r.word, r.token) for r in A._inside(table(words, "word").drop("n"), table(tokens, "token")).collect())
        assert found == sorted((w, t) for w in words for t in tokens if w in t)
        return [rows.count() for rows in cut]

    same = [f"customer#{k:09d}" for k in range(50)]
    assert inside(same, same[:30] + ["ring", "x" * 18]) == []
    assert inside(["ring", "abc", "spring", "customer#00000001", "x" * 30], [*same, "ring", "springs", "stringent", "zabcabc", "x" * 29, "y" + "x" * 31])[0] > 0


def test_newest_matches_are_read_once(spark):
    from datetime import datetime, timedelta

    from tamarack.operators import alerts as A

    day = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(a, f"{a}{k}", day + timedelta(hours=k * 7 % 500) if k % 9 else None, day + timedelta(hours=k)) for a, n in (("a", 700), ("b", 3), ("c", 30)) for k in range(n)], "alert_id string, id string, postedAt timestamp, scrapedAt timestamp")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = A.newest_of_each(rows.mapInArrow(count, rows.schema)).collect()
    want = set()
    for a in "abc":
        own = sorted((r for r in rows.collect() if r.alert_id == a), key=lambda r: (-(r.postedAt or r.scrapedAt).timestamp(), r.id))
        want |= {(a, r.id, k + 1, len(own)) for k, r in enumerate(own[:30])}
    assert {(r.alert_id, r.id, r["rank"], r.total) for r in got} == want and len(got) == len(want) and seen.value == 733


@pytest.mark.parametrize("name", ["no_openings", "career_cascade"])
def test_pages_of_one_row_group_are_read_by_many_tasks(spark, tmp_path, name):
    duckdb.execute(f"COPY (SELECT i AS c_custkey, 'c' AS c_name, 1 AS c_nationkey, 1.0 AS c_acctbal, 'm' AS c_mktsegment FROM range(60000) r(i)) TO '{tmp_path}/customer.parquet' (FORMAT parquet, ROW_GROUP_SIZE 100000)")
    from tamarack.plans import extract_queries
    from tamarack.sources import adapters

    assert adapters.spread(spark.read.parquet(f"{tmp_path}/customer.parquet"), 5_000).rdd.getNumPartitions() == 12
    if name == "no_openings":
        found = extract_queries.no_openings(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() >= 3 and found.where("declared").count() == 12_000
    else:
        small = tmp_path / "small"
        small.mkdir()
        duckdb.execute(f"COPY (SELECT * FROM '{tmp_path}/customer.parquet' LIMIT 500) TO '{small}/customer.parquet'")
        same_as_sql(spark, small, name, ["customer"])


def test_last_page_of_more_than_999(spark, tmp_path):
    """The fault was page 999, which is the last one only of fewer than 99,901 postings."""
    made = {
        "orders": "SELECT i::BIGINT AS o_orderkey, 1::BIGINT AS o_custkey, 'F' AS o_orderstatus, i + 0.25::DOUBLE AS o_totalprice, TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * (i % 900)::INT AS o_orderdate, '5-LOW' AS o_orderpriority FROM range(100130) r(i)",
        "customer": "SELECT 1::BIGINT AS c_custkey, 'c' AS c_name, n_nationkey AS c_nationkey, 1.0::DOUBLE AS c_acctbal, 'm' AS c_mktsegment FROM nation WHERE n_name = 'NATION_3'",
    }
    con = duckdb.connect()
    for t in ("region", "nation", "lineitem", "part"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{SMALL}/{t}.parquet")
    con.execute(f"CREATE VIEW nation AS SELECT * FROM '{SMALL}/nation.parquet'")
    for t, sql in made.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet'")
    same_as_sql(spark, tmp_path, "search_page_clamped", ["region", "nation", "customer", "orders", "lineitem", "part"])


@pytest.mark.parametrize(("sort", "total"), [("recent", 23), ("salary_desc", 23), ("salary_asc", 23), ("company", 23), ("relevance", 23), ("recent", 0)])
def test_pages_from_the_end_equal_those_from_the_start(spark, sort, total):
    from datetime import datetime, timedelta

    from tamarack.operators import search as S

    now = datetime(2024, 1, 31)
    kind = "id string, title string, company string, tags array<string>, salaryMin double, salaryMax double, salaryPeriod string, postedAt timestamp, scrapedAt timestamp"
    given = [(str(k), ["soudeur", "un soudeur", None][k % 3], ["Zut", "Éric", None, "Eric"][k % 4], [], k % 4 * 1.0 if k % 3 else None, None, "annee", now - timedelta(days=k % 5) if k % 4 else None, now if k % 8 else None) for k in range(total)]
    rows = spark.createDataFrame(given, kind)
    forth, back = (S.order(sort, "soudeur", F.lit(now), b) for b in (False, True))
    for page in (4, 999):
        got, want = S.page_of(rows, forth, page, 4, back).collect(), S.page_of(rows, forth, page, 4).collect()
        assert got == want and len(want) == (0 if not total else 4 if page == 4 else 3)
