"""Text-rule queries. Free texts are dealt to the rows of a table by key, so that every rule is met many times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack.functions import dates as D
from tamarack.functions import rules as R
from tamarack.functions import text as T
from tamarack.plans.base import query, sql_first_match, sql_stamp, stamp
from tamarack.sources.adapters import orders_now, read

LOCATIONS = [
    "Montréal, QC", "872, Archimède, Québec, Canada", "Lévis, Québec", "Granby", "Saint-Jérôme", "Toronto, ON", "Québec (Québec)", "Télétravail", "Remote, Canada", "Gatineau", "SAGUENAY (QC)", "Val-d'Or", "Îles-de-la-Madeleine",
    "Halifax", "Canada", "Paris, France", "", "Laval, Québec", "Ville inconnue, Qc", "sainte-foy, quebec", "Trois-Rivières", "Regina, SK", "Canadarm", "Terrebonne; Mascouche", "Rivière-du-Loup", "(Ottawa)",
]
TITLES = [
    "Développeur full stack", "Ingénieur civil", "Infirmière clinicienne", "Préposé aux bénéficiaires", "Manœuvre spécialisé", "Électricien de chantier", "Comptable senior", "Adjointe administrative", "Caissier", "Sales associate", "Directrice marketing",
    "Recruteur TI", "HR generalist", "Enseignante au primaire", "Tutor", "Tutorial writer", "Avocat", "Legal counsel", "Chauffeur classe 1", "Truck driver", "Opérateur de machine", "Boulanger", "Cook", "Graphiste", "Chimiste R&D", "Chargé de projet",
    "Manager", "Menagerie", "Concierge", "Chief of staff", "QA lead", "Squash coach", "Couvreur", "Arpenteur", "Team Lead", "Agent",
]
SALARIES = [
    "55 000 $ à 75 000 $", "25,50 $ de l'heure", "25.50 $ / h", "Entre 20 $ - 32 $ horaire", "60k $ par an", "45k à 60k $", "1 200 $ par semaine", "4 000 $ / mois", "Salaire à discuter", "", "90 000$ annuel", "18$/heure", "22 $ to 28 $", "100 $",
    "1,234,567 $", "55,000 $", "de 30 à 40 heures, 21 $ de l'heure",
]
MODES = ["Poste hybride", "100% remote", "full remote", "Télétravail possible", "Travail à distance", "Présentiel", "Sur place", "Remote friendly", "En personne", "hybrid schedule", "Entièrement à distance", "bureau"]
TONGUES = ["français et anglais", "Bilingual", "English required", "Anglais un atout", "French only", "aucune exigence", "FRANÇAIS", "bilingue, english, french"]
TYPES = ["Permanent, temps partiel", "Temps plein", "Stage d'été", "Contrat de 6 mois", "Saisonnier", "Sur appel", "Full-time", "part time", "Contract", "Freelance", "autre", "", "Occasionnel / per diem", "TEMPORAIRE"]
UNITS = ["HOUR", "par heure", "Week", "hebdomadaire", "MONTH", "mensuel", "YEAR", "annuel", "par an", "ansible", "jour"]
DATES = ["Publié aujourd'hui", "Hier", "il y a 3 jours", "il y a 2 semaines", "Il y a 1 mois", "il y a 5 heures", "il y a 10 minutes", "il y a 2 ans", "20 août 2026", "1 février 2024", "3-mars-2023", "31 décembre 1999", "2020-05-06", "n'importe quoi", "", "12 foobar 2020"]
COMPANIES = [
    "Construction Tremblay Inc.", "CONSTRUCTION TREMBLAY LTÉE", "Les Entreprises Côté & Fils enr.", "Béton Provincial - Laval", "9123-4567 Québec inc.", "Groupe ABC (Déneigement NC)", "Ciment McInnis, Usine McInnis", "L'Équipe d'Or", "The Co", "Société des Ponts et Chaussées", "ÉLECTRICITÉ 2000",
]
SLUGS = ["exfo-inc", "groupe_ebc", "a-b--c", "canam", "les-toits-abc-ltee"]


def dealt(values: list[str], key: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def sql_dealt(values: list[str], key: str) -> str:
    items = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{items}])[({key} % {len(values)} + 1)::INT]"


def _orders(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey")


def _sql(values: list[str], out: str) -> str:
    return f"SELECT o_orderkey, t AS text, {out} FROM (SELECT o_orderkey, {sql_dealt(values, 'o_orderkey')} AS t FROM orders)"


def _run(spark, sf_dir, values: list[str], name: str, rule):
    return _orders(spark, sf_dir).select("o_orderkey", dealt(values, "o_orderkey").alias("text")).withColumn(name, rule(F.col("text")))


_CITY = "coalesce(nullif(trim(regexp_extract(t, '^([^,(]*)', 1)), ''), t)"
_REST = sql_first_match("t", [(R.REMOTE_PLACE, "teletravail"), (R.OTHER_PROVINCE, "canada-autre"), (R.QUEBEC_HINT, "autre"), (R.CANADA, "canada-autre")])


@query("detect_region", _sql(LOCATIONS, f"CASE WHEN t <> '' THEN {sql_first_match(_CITY, R.CITY_REGIONS, _REST)} END AS region"), views=False)
def detect_region(spark, sf_dir):
    return _run(spark, sf_dir, LOCATIONS, "region", R.detect_region)


@query("detect_remote", _sql(MODES, f"CASE WHEN regexp_matches(t, '(?i){R.REMOTE_HINT}') THEN {sql_first_match('t', R.WORK_MODE_RULES)} END AS mode"), views=False)
def detect_remote(spark, sf_dir):
    return _run(spark, sf_dir, MODES, "mode", lambda t: R.remote_of(F.lit(None).cast("string"), t))


@query("infer_category", _sql(TITLES, f"{sql_first_match(r'replace(replace(t, chr(339), chr(111) || chr(101)), chr(338), chr(79) || chr(69))', R.CATEGORY_RULES)} AS category"), views=False)
def infer_category(spark, sf_dir):
    return _run(spark, sf_dir, TITLES, "category", lambda t: R.infer_category(t, F.array(F.lit(""))))


@query("detect_language", _sql(TONGUES, "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(t, '(?i){p}') THEN '{v}' END" for p, v in R.LANGUAGE_RULES) + ") AS languages"), views=False)
def detect_language(spark, sf_dir):
    return _run(spark, sf_dir, TONGUES, "languages", lambda t: F.array_join(R.detect_languages(t), ","))


_N = r"(\d[\d\s.,]*)"
_RANGE, _SINGLE = rf"(?i){_N}\s*(?:k)?\s*\$?\s*(?:à|a|-|–|to)\s*{_N}\s*(?:k)?\s*\$", rf"(?i){_N}\s*(?:k)?\s*\$"


def _sql_number(x: str) -> str:
    return rf"try_cast(regexp_replace(replace(regexp_replace({x}, '\s', '', 'g'), '.', ''), '^([^,]*),', '\1.') AS DOUBLE)"


def _sql_thousands(x: str) -> str:
    return rf"CASE WHEN regexp_matches(t, '(?i)k\s*\$') AND {x} > 0 AND {x} < 1000 THEN {x} * 1000 ELSE {x} END"


@query(
    "parse_salary",
    f"""SELECT o_orderkey, t AS text, low, high, CASE WHEN coalesce(high, low) IS NOT NULL THEN {sql_first_match("t", R.PERIOD_RULES, "CASE WHEN coalesce(high, low) > 1000 THEN 'annee' WHEN coalesce(high, low) IS NOT NULL THEN 'heure' END")} END AS period
    FROM (SELECT o_orderkey, t, {_sql_thousands("a")} AS low, {_sql_thousands("b")} AS high FROM (SELECT o_orderkey, t, CASE WHEN regexp_matches(t, '{_RANGE}') THEN {_sql_number(f"regexp_extract(t, '{_RANGE}', 1)")} ELSE {_sql_number(f"regexp_extract(t, '{_SINGLE}', 1)")} END AS a,
    CASE WHEN regexp_matches(t, '{_RANGE}') THEN {_sql_number(f"regexp_extract(t, '{_RANGE}', 2)")} ELSE {_sql_number(f"regexp_extract(t, '{_SINGLE}', 1)")} END AS b FROM (SELECT o_orderkey, {sql_dealt(SALARIES, "o_orderkey")} AS t FROM orders)))""",
    views=False,
)
def parse_salary(spark, sf_dir):
    rows = _run(spark, sf_dir, SALARIES, "s", R.parse_salary)
    return rows.select("o_orderkey", "text", F.col("s.salaryMin").alias("low"), F.col("s.salaryMax").alias("high"), F.col("s.salaryPeriod").alias("period"))


@query("map_employment_type", _sql(TYPES, f"{sql_first_match('lower(t)', R.EMPLOYMENT_RULES)} AS kind"), views=False)
def map_employment_type(spark, sf_dir):
    return _run(spark, sf_dir, TYPES, "kind", R.map_employment_type)


@query("card_employment_type", _sql(TYPES, f"{sql_first_match('lower(t)', R.CARD_EMPLOYMENT_RULES)} AS kind"), views=False)
def card_employment_type(spark, sf_dir):
    return _run(spark, sf_dir, TYPES, "kind", R.card_employment_type)


@query("map_salary_unit", _sql(UNITS, f"{sql_first_match('lower(t)', R.SALARY_UNIT_RULES)} AS unit"), views=False)
def map_salary_unit(spark, sf_dir):
    return _run(spark, sf_dir, UNITS, "unit", R.map_salary_unit)


_MONTH_SQL = "CASE mo " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in D.MONTHS.items()) + " END"
_UNIT_SQL = "CASE u " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in D.UNIT_SECONDS.items()) + " END"


@query(
    "parse_french_date",
    f"""SELECT o_orderkey, text, {sql_stamp("d")} AS at FROM (SELECT o_orderkey, text, CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, 'aujourd''?hui') THEN now_ WHEN regexp_matches(t, '\\bhier\\b') THEN now_ - INTERVAL 1 DAY
    WHEN u <> '' THEN now_ - to_seconds(n::BIGINT * {_UNIT_SQL}) WHEN {_MONTH_SQL} IS NOT NULL THEN make_date(y::INT, {_MONTH_SQL}, 1)::TIMESTAMP + to_days(dd::INT - 1) ELSE try_strptime(t, '%Y-%m-%d') END AS d
    FROM (SELECT o_orderkey, t AS text, lower(t) AS t, TIMESTAMP '2001-08-02' AS now_, regexp_extract(lower(t), 'il y a\\s+(\\d+)\\s+(jour|semaine|mois|an|année|annee|heure|minute)', 1) AS n, regexp_extract(lower(t), 'il y a\\s+(\\d+)\\s+(jour|semaine|mois|an|année|annee|heure|minute)', 2) AS u,
    regexp_extract(lower(t), '(\\d{{1,2}})[\\s-]+([a-zà-ÿ]+)\\.?[\\s-]+(\\d{{4}})', 1) AS dd, regexp_extract(lower(t), '(\\d{{1,2}})[\\s-]+([a-zà-ÿ]+)\\.?[\\s-]+(\\d{{4}})', 2) AS mo, regexp_extract(lower(t), '(\\d{{1,2}})[\\s-]+([a-zà-ÿ]+)\\.?[\\s-]+(\\d{{4}})', 3) AS y
    FROM (SELECT o_orderkey, {sql_dealt(DATES, "o_orderkey")} AS t FROM orders)))""",
    views=False,
)
def parse_french_date(spark, sf_dir):
    return _run(spark, sf_dir, DATES, "d", lambda t: D.parse_french_date(t, orders_now())).select("o_orderkey", "text", stamp("d").alias("at"))


_WORDS = T.LEGAL_WORDS
_KEY_SQL = "strip_accents(lower(t))"
for _p, _i in ((r"\([^)]*\)", " "), (r"\s[-–]\s.*$", " "), (r",?\s*usine\b.*$", " "), (r"""[''’`.,;:!?"()/\\]""", " "), ("&", " et "), (r"\b\d{4}-?\d{4}\s+quebec\b", " "), (rf"\b({_WORDS})\b", " "), ("[^a-z0-9]+", " ")):
    _KEY_SQL = f"regexp_replace({_KEY_SQL}, '{_p}', '{_i}', 'g')"


@query("company_key", _sql(COMPANIES, f"trim({_KEY_SQL}) AS key"), views=False)
def company_key(spark, sf_dir):
    return _run(spark, sf_dir, COMPANIES, "key", T.company_key)


@query("job_id_sha1", "SELECT id, substr(sha1(coalesce(\"sourceId\", '') || '|' || url), 1, 16) AS job_id FROM job WHERE \"sourceId\" IS NOT NULL")
def job_id_sha1(spark, sf_dir):
    from tamarack.sources.adapters import job

    return job(spark, sf_dir).where("sourceId is not null").select("id", T.job_id(F.col("sourceId"), F.col("url")).alias("job_id"))


@query("slugify", "SELECT doc_id, substr(regexp_replace(regexp_replace(strip_accents(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM documents", views=False)
def slugify(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query("norm_documents", "SELECT doc_id, md5(strip_accents(replace(replace(lower(text), 'œ', 'oe'), 'æ', 'ae'))) AS folded FROM documents", views=False)
def norm_documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.norm(F.col("text"))).alias("folded"))


@query("clean_text", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS cleaned FROM documents", views=False)
def clean_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("cleaned"))


@query("deslugify", f"SELECT o_orderkey, t AS text, array_to_string(list_transform(list_filter(regexp_split_to_array(t, '[-_]'), lambda w: w <> ''), lambda w: CASE WHEN length(w) <= 3 THEN upper(w) ELSE upper(w[1]) || w[2:] END), ' ') AS title FROM (SELECT o_orderkey, {sql_dealt(SLUGS, 'o_orderkey')} AS t FROM orders)", views=False)
def deslugify(spark, sf_dir):
    return _run(spark, sf_dir, SLUGS, "title", T.deslugify)


@query("initials", f"SELECT o_orderkey, t AS text, array_to_string(list_transform(regexp_split_to_array(t, '\\s+')[1:2], lambda w: upper(w[1])), '') AS initials FROM (SELECT o_orderkey, {sql_dealt(COMPANIES, 'o_orderkey')} AS t FROM orders)", views=False)
def initials(spark, sf_dir):
    return _run(spark, sf_dir, COMPANIES, "initials", T.initials)


@query("region_from_name", "SELECT o_orderkey, t AS text, CASE WHEN s IN ('monteregie', 'saguenay-lac-saint-jean', 'nord-du-quebec', 'laval') THEN s END AS region FROM (SELECT *, regexp_replace(regexp_replace(strip_accents(lower(t)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM (SELECT o_orderkey, " + sql_dealt(["Montérégie", "Saguenay--Lac-Saint-Jean", "Nord-du-Québec", " LAVAL ", "Ailleurs"], "o_orderkey") + " AS t FROM orders))", views=False)
def region_from_name(spark, sf_dir):
    from tamarack.operators.joins import region_id_from_name

    return _run(spark, sf_dir, ["Montérégie", "Saguenay--Lac-Saint-Jean", "Nord-du-Québec", " LAVAL ", "Ailleurs"], "region", region_id_from_name)


_MONEY = "replace(format('{:,}', round_even(%s, 0)::BIGINT), ',', chr(160)) || chr(160) || '$'"


@query(
    "format_salary",
    f"""SELECT id, CASE WHEN coalesce("salaryMin", "salaryMax") IS NOT NULL THEN concat_ws(' ', CASE WHEN "salaryMin" IS NOT NULL AND "salaryMax" IS NOT NULL AND "salaryMin" <> "salaryMax" THEN {_MONEY % '"salaryMin"'} || ' – ' || {_MONEY % '"salaryMax"'} ELSE {_MONEY % 'coalesce("salaryMax", "salaryMin")'} END,
    CASE "salaryPeriod" WHEN 'heure' THEN '/ heure' WHEN 'mois' THEN '/ mois' WHEN 'annee' THEN '/ an' END) END AS salary FROM job""",
)
def format_salary(spark, sf_dir):
    from tamarack.sources.adapters import job

    return job(spark, sf_dir).select("id", D.format_salary(F.col("salaryMin"), F.col("salaryMax"), F.col("salaryPeriod")).alias("salary"))


@query("time_ago", """SELECT id, CASE WHEN s < 3600 THEN 'à l''instant' WHEN s < 86400 THEN 'il y a ' || (s // 3600) || ' h' WHEN s < 172800 THEN 'hier' WHEN s < 604800 THEN 'il y a ' || (s // 86400) || ' jours' WHEN s < 2592000 THEN 'il y a ' || (s // 604800) || ' sem.' ELSE 'il y a ' || (s // 2592000) || ' mois' END AS ago
FROM (SELECT id, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us("startedAt")) // 1000000 AS s FROM run)""")
def time_ago(spark, sf_dir):
    from tamarack.sources.adapters import events_now, scrape_run

    return scrape_run(spark, sf_dir).select("id", D.time_ago(F.col("startedAt"), events_now()).alias("ago"))


@query("epoch_ms", "SELECT id, CASE id % 3 WHEN 0 THEN epoch_ms(date_trunc('second', \"startedAt\")) WHEN 1 THEN epoch_us(\"startedAt\") // 1000 ELSE epoch_ms(date_trunc('second', \"startedAt\")) END AS ms FROM run")
def epoch_ms(spark, sf_dir):
    from tamarack.sources.adapters import scrape_run

    at, n = F.col("startedAt"), F.col("id") % 3
    written = F.when(n == 0, F.unix_seconds(at).cast("string")).when(n == 1, F.unix_millis(at).cast("string")).otherwise(stamp(at))
    return scrape_run(spark, sf_dir).select("id", D.epoch_ms(written).alias("ms"))


@query("escape_html", "SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped FROM pages", views=False)
def escape_html(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(T.escape_html(F.col("html"))).alias("escaped"))


@query("html_to_text", """SELECT page_id, CASE WHEN length(t) > 600 THEN substr(t, 1, 599) || '…' ELSE nullif(t, '') END AS text FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '(?s)<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS t FROM pages)""", views=False)
def html_to_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query(
    "normalize_raw",
    f"""SELECT o_orderkey, CASE WHEN loc <> '' THEN {sql_first_match("coalesce(nullif(trim(regexp_extract(loc, '^([^,(]*)', 1)), ''), loc)", R.CITY_REGIONS, _REST.replace("(t,", "(loc,"))} END AS region,
    {sql_first_match(r"replace(title, chr(339), 'oe')", R.CATEGORY_RULES)} AS category, CASE WHEN regexp_matches(body, '(?i){R.REMOTE_HINT}') THEN {sql_first_match("body", R.WORK_MODE_RULES)} END AS remote, 'CAD' AS currency
    FROM (SELECT *, title || ' ' || description || ' ' || loc AS body FROM (SELECT o_orderkey, {sql_dealt(TITLES, "o_orderkey")} AS title, {sql_dealt(LOCATIONS, "o_orderkey")} AS loc, {sql_dealt(MODES, "o_orderkey")} AS description FROM orders))""",
    views=False,
)
def normalize_raw(spark, sf_dir):
    raw = _orders(spark, sf_dir).select(
        "o_orderkey", F.lit("s1").alias("sourceId"), F.concat(F.lit("https://x.example/"), F.col("o_orderkey").cast("string")).alias("url"), dealt(TITLES, "o_orderkey").alias("title"), F.lit(" Acme ").alias("company"), F.lit(None).cast("string").alias("companyLogoUrl"),
        dealt(LOCATIONS, "o_orderkey").alias("location"), F.lit(None).cast("string").alias("remote"), F.lit(None).cast("string").alias("employmentType"), F.lit(None).cast("double").alias("salaryMin"), F.lit(None).cast("double").alias("salaryMax"),
        F.lit(None).cast("string").alias("salaryPeriod"), dealt(MODES, "o_orderkey").alias("description"), F.array().cast("array<string>").alias("tags"), F.lit("2001-07-01").alias("postedAt"),
    )
    done = R.normalize_raw_job(raw, orders_now())
    keyed = done.select(F.substring_index("url", "/", -1).cast("bigint").alias("o_orderkey"), F.col("regionId").alias("region"), F.col("categoryId").alias("category"), "remote", "currency")
    return keyed
