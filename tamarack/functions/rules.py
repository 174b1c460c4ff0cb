"""Rule chains that read free text: region, work mode, category, languages, salary, employment type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack.functions.text import SPACE, clean_text

# Ordered patterns, the first that is found decides.
CITY_REGIONS = [
    ("montreal|montréal|ville-marie|verdun|lachine|anjou|outremont", "montreal"),
    ("laval", "laval"),
    ("longueuil|brossard|saint-hubert|st-hubert|boucherville|saint-jean-sur-richelieu|granby|sorel|chambly|varennes", "monteregie"),
    ("levis|lévis|thetford|sainte-marie|montmagny", "chaudiere-appalaches"),
    ("gatineau|hull|aylmer|outaouais", "outaouais"),
    ("sherbrooke|magog|granby|estrie", "estrie"),
    ("trois-rivieres|trois-rivières|shawinigan|mauricie", "mauricie"),
    ("drummondville|victoriaville|centre-du-quebec", "centre-du-quebec"),
    ("saguenay|chicoutimi|jonquiere|jonquière|alma|lac-saint-jean", "saguenay-lac-saint-jean"),
    ("rimouski|riviere-du-loup|rivière-du-loup|bas-saint-laurent|matane", "bas-saint-laurent"),
    ("rouyn|noranda|val-d'or|abitibi|amos", "abitibi-temiscamingue"),
    ("sept-iles|sept-îles|baie-comeau|cote-nord|côte-nord", "cote-nord"),
    ("gaspe|gaspé|iles-de-la-madeleine|îles-de-la-madeleine|gaspesie|gaspésie", "gaspesie-iles-de-la-madeleine"),
    ("repentigny|terrebonne|mascouche|joliette|lanaudiere|lanaudière", "lanaudiere"),
    ("saint-jerome|st-jerome|blainville|mirabel|sainte-therese|laurentides|mont-tremblant", "laurentides"),
    ("chibougamau|nord-du-quebec|nunavik|baie-james", "nord-du-quebec"),
    ("quebec|québec|sainte-foy|ste-foy|charlesbourg|beauport|l'ancienne-lorette", "capitale-nationale"),
]
REMOTE_PLACE = "télétravail|teletravail|à distance|a distance|remote"
REMOTE_HINT = REMOTE_PLACE + "|hybride"
OTHER_PROVINCE = (
    r"[,(]\s*(?:ab|bc|on|mb|sk|ns|nb|nl|pe|pei|nt|yt|nu)\b|\b(?:ontario|alberta|manitoba|saskatchewan|british columbia|colombie-britannique|nova scotia|nouvelle-[ée]cosse|new brunswick|nouveau-brunswick"
    r"|newfoundland|terre-neuve|prince edward|[îi]le-du-prince|northwest territories|yukon|nunavut|toronto|ottawa|vancouver|calgary|edmonton|winnipeg|halifax|regina|saskatoon|mississauga|hamilton|london|windsor|kitchener)\b"
)
QUEBEC_HINT = r"[,(]\s*qc\b|qu[ée]bec"
CANADA = r"\bcanada\b"
WORK_MODE_RULES = [
    ("hybride|hybrid", "hybride"),
    (r"télétravail|teletravail|à distance|a distance|100%\s*remote|full remote|entièrement à distance", "teletravail"),
    ("présentiel|presentiel|sur place|en personne", "presentiel"),
]
CATEGORY_RULES = [
    (r"developpeu|développeu|programmeu|logiciel|software|devops|data|donnees|données|analyste (?:d'affaires|programmeur)|architecte (?:logiciel|ti)|infonuagique|cloud|cybersecurit|réseau|reseau|informatique|full ?stack|front[- ]?end|back[- ]?end|\bqa\b|scrum|\bux\b|ui designer|intelligence artificielle|machine learning|developer|programmer|information technology|web develop|network|system administrator|sysadmin", "ti"),
    (r"ingenieu|ingénieu|genie|génie|mecanique|mécanique|électrique|electrique|civil|structure|aérospat|aerospat|automatisation|engineer|mechanical|aerospace", "genie"),
    (r"infirmi|pr[ée]pos[ée]+\s+(?:aux?\s+)?b[ée]n[ée]fic|beneficiaire|bénéficiaire|medecin|médecin|pharmac|dentaire|physio|ergotherapeu|ergothérapeu|inhalotherapeu|psycholog|travailleu(?:r|se) social|soins|clinique|hospitali|nurse|health care|healthcare|medical|caregiver|orderly|personal support worker", "sante"),
    (r"electricien|électricien|plombier|charpentier|menuisier|macon|maçon|grutier|chantier|construction|manoeuvre|cimentier|signaleur|poseur de tuyau|soudeur|couvreu|ferblantier|arpenteu|estimateu|monteur de lign|monteuse de lign|monteur de structure|monteur-assembleur|homme de cour|electrician|plumber|carpenter|welder|roofer|labourer|lineman|heavy equipment", "construction"),
    (r"comptab|financ|fiscal|controleu|contrôleu|analyste financier|actuaire|assurance|banque|credit|crédit|paie|verificateu|vérificateu|tresorerie|trésorerie|account(?:ant|ing)|financial|bookkeep|payroll|auditor|banking|investment|comptes? payable|accounts payable", "finance"),
    (r"adjoint|secretai|secrétai|réceptionn|receptionn|commis|soutien administratif|bureautique|coordonnateu(?:r|rice) administra|administrative|administratif|receptionist|clerk|office assistant|data entry|secretary", "admin"),
    (r"vente|vendeu|conseiller (?:en vente|aux ventes)|representant|représentant|caissier|service (?:à la clientele|a la clientele|client)|commercial(?:e)?\b|\bsales\b|cashier|retail|customer service|account executive", "vente"),
    (r"marketing|communication|redacteu|rédacteu|contenu|médias sociaux|medias sociaux|publicit|relations publiques|growth|seo|social media|copywriter|content (?:writer|creator)", "marketing"),
    (r"ressources humaines|recruteu|recrutement|recruitment|talent|conseiller rh|paie et avantages|dotation|human resources|recruiter|\bhr\b", "rh"),
    (r"enseignant|professeu|educateu|éducateu|formateu|pedagog|pédagog|scolaire|garderie|cpe|orthopedagog|teacher|professor|educator|instructor|\btutor\b|early childhood", "education"),
    (r"avocat|juriste|notaire|parajuriste|juridique|technicien juridique|lawyer|paralegal|\blegal\b|attorney|notary", "juridique"),
    (r"logistique|entrepot|entrepôt|cariste|chauffeu|camionneu|livreu|approvisionn|chaine (?:d'approvisionnement|logistique)|magasinier|repartiteu|répartiteu|transport|\bdriver\b|warehouse|truck|delivery|logistics|forklift|dispatcher|courier", "logistique"),
    (r"operateu|opérateu|production|assembleu|manutention|usine|manufactur|journalier|controle qualite|contrôle qualité|machiniste|operator|assembler|mechanic|mécanicien|millwright|maintenance|boucher|bouchère|butcher", "production"),
    (r"cuisinier|chef|serveu|barista|plongeu|restauration|hotel|hôtel|tourism|préposé (?:à l'accueil)|aide-cuisinier|gerant de restaurant|\bcook\b|server|waiter|waitress|dishwasher|hospitality|restaurant|food service|kitchen|boulanger|boulangère|p[âa]tissier|p[âa]tissière|baker|pastry", "restauration"),
    (r"designer|graphiste|artiste|photograph|videast|vidéast|monteur vid|monteuse vid|montage vid|createu|créateu|illustrateu|musique|scenograph|graphic|artist|videographer|illustrator", "arts"),
    (r"chercheu|scientifique|laboratoire|biolog|chimist|technicien de laboratoire|recherche et developpement|r&d|microbiolog|research(?:er)?|scientist|laboratory|chemist|lab technician", "science"),
    (r"directeu|directrice|vice-president|vice-président|chef de (?:service|departement|département)|gestionnaire|president|président|pdg|dg\b|chef d'equipe|chef d'équipe|\bmanager\b|\bdirector\b|supervisor|management trainee|team lead|\bchief\b|head of|executive|charg\S* de projet|chef de projet|gestion de projet", "direction"),
]
LANGUAGE_RULES = [("bilingue|bilingual|français et anglais|francais et anglais", "bilingue"), ("anglais|english", "en"), ("français|francais|french", "fr")]
PERIOD_RULES = [
    (r"de l'heure|/\s*h(?:eure)?\b|horaire|par heure", "heure"),
    (r"par (?:an|année|annee)|/\s*an(?:née|nee)?\b|annuel", "annee"),
    (r"par mois|/\s*mois|mensuel", "mois"),
    (r"par semaine|/\s*semaine|hebdomadaire", "semaine"),
]
EMPLOYMENT_RULES = [
    ("stage|stagiaire|internship", "stage"),
    ("saisonnier|seasonal", "saisonnier"),
    ("occasionnel|sur appel|per diem", "occasionnel"),
    ("temps partiel|part[- ]?time", "temps-partiel"),
    ("contrat|contractuel|temporaire|pige|freelance|contract", "contrat"),
    ("temps plein|permanent|full[- ]?time", "temps-plein"),
]
CARD_EMPLOYMENT_RULES = [("partiel|part", "temps-partiel"), ("plein|full|permanent", "temps-plein"), ("saison", "saisonnier"), ("stage", "stage"), ("contrat|temporaire", "contrat")]
SALARY_UNIT_RULES = [("hour|heure|horaire", "heure"), ("week|semaine|hebdo", "semaine"), ("month|mois|mensuel", "mois"), (r"year|annu|annee|année|an\b", "annee")]
SCHEMA_EMPLOYMENT = {"FULL_TIME": "temps-plein", "PART_TIME": "temps-partiel", "CONTRACTOR": "contrat", "TEMPORARY": "contrat", "INTERN": "stage", "SEASONAL": "saisonnier", "PER_DIEM": "occasionnel"}
SCHEMA_SALARY_UNIT = {"HOUR": "heure", "WEEK": "semaine", "MONTH": "mois", "YEAR": "annee"}

_BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ecma(pattern: str) -> str:
    """A case-insensitive pattern with ECMAScript's word boundary and white space, for Java."""
    return "(?iu)" + pattern.replace(r"\b", _BOUNDARY).replace(r"\s", SPACE)


def has(text: Column, pattern: str) -> Column:
    return text.rlike(ecma(pattern))


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """The value of the first rule whose pattern is found."""
    out = None
    for pattern, value in rules:
        out = F.when(has(text, pattern), value) if out is None else out.when(has(text, pattern), value)
    return out if otherwise is None else out.otherwise(otherwise)


def detect_region(location: Column) -> Column:
    """The city stands before the first comma or bracket; then come telework, other provinces, Québec, Canada."""
    city = F.trim(F.regexp_extract(location, "^([^,(]*)", 1))
    city = F.when(city == "", location).otherwise(city)
    rest = F.when(has(location, REMOTE_PLACE), "teletravail").when(has(location, OTHER_PROVINCE), "canada-autre").when(has(location, QUEBEC_HINT), "autre").when(has(location, CANADA), "canada-autre")
    return F.when(F.coalesce(location, F.lit("")) != "", first_match(city, CITY_REGIONS, rest))


def detect_remote(text: Column) -> Column:
    return first_match(text, WORK_MODE_RULES)


def remote_of(given: Column, text: Column) -> Column:
    """The given mode, else what the text says if it hints at any."""
    return F.coalesce(given, F.when(has(text, REMOTE_HINT), detect_remote(text)))


def infer_category(title: Column, tags: Column | None = None) -> Column:
    hay = title if tags is None else F.concat_ws(" ", title, F.array_join(tags, " "))
    for a, b in (("œ", "oe"), ("Œ", "oe"), ("æ", "ae"), ("Æ", "ae")):
        hay = F.replace(hay, F.lit(a), F.lit(b))
    return first_match(hay, CATEGORY_RULES)


def detect_languages(text: Column) -> Column:
    return F.filter(F.array(*[F.when(has(text, p), v) for p, v in LANGUAGE_RULES]), lambda x: x.isNotNull())


def map_employment_type(text: Column) -> Column:
    return first_match(F.lower(clean_text(text)), EMPLOYMENT_RULES)


def card_employment_type(text: Column) -> Column:
    return first_match(F.lower(clean_text(text)), CARD_EMPLOYMENT_RULES)


def map_salary_unit(text: Column) -> Column:
    return first_match(F.lower(clean_text(text)), SALARY_UNIT_RULES)


_NUMBER = rf"(\d[\d{SPACE[1:-1]}.,]*)"


def to_number(text: Column, compat: bool = True) -> Column:
    """A written amount. compat reads every dot as a thousands mark; otherwise a dot before two last digits is a decimal point."""
    plain = F.regexp_replace(text, SPACE, "")
    plain = F.regexp_replace(plain, r"\.", "") if compat else F.regexp_replace(F.regexp_replace(plain, r"\.(\d{2})$", ",$1"), r"\.", "")
    return F.regexp_replace(plain, "^([^,]*),", "$1.").try_cast("double")


def parse_salary(text: Column, compat: bool = True) -> Column:
    """struct(salaryMin, salaryMax, salaryPeriod), null where the text has no amount."""
    t = F.replace(text, F.lit("\u00a0"), F.lit(" "))
    range_ = rf"(?iu){_NUMBER}{SPACE}*(?:k)?{SPACE}*\$?{SPACE}*(?:à|a|-|–|to){SPACE}*{_NUMBER}{SPACE}*(?:k)?{SPACE}*\$"
    single = rf"(?iu){_NUMBER}{SPACE}*(?:k)?{SPACE}*\$"
    is_range = t.rlike(range_)
    low = F.when(is_range, to_number(F.regexp_extract(t, range_, 1), compat)).otherwise(to_number(F.regexp_extract(t, single, 1), compat))
    high = F.when(is_range, to_number(F.regexp_extract(t, range_, 2), compat)).otherwise(low)
    thousands = lambda x: F.when(has(t, r"k\s*\$") & (x > 0) & (x < 1000), x * 1000).otherwise(x)
    low, high = thousands(low), thousands(high)
    guess = F.coalesce(high, low)
    period = first_match(t, PERIOD_RULES, F.when(guess > 1000, "annee").when(guess.isNotNull(), "heure"))
    return F.when(guess.isNotNull(), F.struct(low.alias("salaryMin"), high.alias("salaryMax"), period.alias("salaryPeriod")))


def annual_salary(low: Column, high: Column, period: Column) -> Column:
    """The upper bound (else the lower) for a year of 52 weeks of 35 hours."""
    base = F.coalesce(high, low)
    return F.when(period == "heure", base * 35 * 52).when(period == "semaine", base * 52).when(period == "mois", base * 12).otherwise(base)


def normalize_raw_job(raw, as_of):
    """Raw postings as normalised ones: identity, trimmed texts, and what the rules read from them. raw has the columns of model.RAW_JOB."""
    from tamarack.functions.dates import parse_date
    from tamarack.functions.text import job_id, trim

    text = F.concat_ws(" ", F.col("title"), F.coalesce("description", F.lit("")), F.coalesce("location", F.lit("")))
    salary = F.when(F.col("salaryMin").isNull() & F.col("salaryMax").isNull(), parse_salary(F.col("description")))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return raw.withColumn("__salary", salary).select(
        job_id(F.col("sourceId"), F.col("url")).alias("id"), "sourceId", "url", trim(F.col("title")).alias("title"), trim(F.col("company")).alias("company"), "companyLogoUrl", trim(F.col("location")).alias("location"),
        detect_region(F.col("location")).alias("regionId"), F.lit(None).cast("string").alias("city"), remote_of(F.col("remote"), text).alias("remote"), infer_category(F.col("title"), tags).alias("categoryId"), "employmentType",
        F.coalesce("salaryMin", F.col("__salary.salaryMin")).alias("salaryMin"), F.coalesce("salaryMax", F.col("__salary.salaryMax")).alias("salaryMax"), F.coalesce("salaryPeriod", F.col("__salary.salaryPeriod")).alias("salaryPeriod"),
        F.lit("CAD").alias("currency"), trim(F.col("description")).alias("description"), tags.alias("tags"), detect_languages(text).alias("languages"), parse_date(F.col("postedAt")).alias("postedAt"), as_of.alias("scrapedAt"),
    )


def source_method(method: Column) -> Column:
    """How a catalogue names an employer's way of publishing: pages are html, feeds rss, all else an api."""
    return F.when(method.isin("html", "jsonld", "jobillico"), "html").when(method == "zoho", "rss").when(method.isNotNull(), "api")
