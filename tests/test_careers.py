"""Career pages: labels, slogans and services one by one, links with their headings."""

import pytest
from pyspark.sql import functions as F

from tamarack.functions.rules import has
from tamarack.operators.extract import pages as P

LABELS = (
    "carrières|carrieres|carrière|postuler|postuler maintenant|postuler ici|postulez ici|postulez|postulez maintenant|postule|je postule|description|description du poste|description de poste|description de l'emploi|en savoir plus|en savoir +|voir|voir l'offre|voir l'emploi|voir ce poste|voir le poste"
    "|voir les postes|voir les postes disponibles|voir tous les postes|voir toutes les offres|voir toutes les offres disponibles|voir les offres|voir les offres d'emploi|voir les détails|voir les détails du poste|voir plus|voir tout|voir détail|détails|détails du poste|plus de détails|consulter|lire|lire la suite"
    "|lire plus|accueil|contact|nous joindre|nous rejoindre|contactez-nous|rejoignez-nous|joindre l'équipe|emplois|emploi|poste|postes|english|anglais|français|home|apply|apply now|view|view job|view details|read more|learn more|more|à propos|a propos|services|blogue|soumission|équipe|equipe|réalisations"
    "|realisations|site|plan du site|travaux|projets|candidature spontanée|jobillico|indeed|linkedin|workday|glassdoor|neuvoo|monster|talentup|retour|retour à la liste|retour aux offres|« précédent|suivant »|postes disponibles|poste à combler|postes actuellement ouverts|postes en recrutement continu|recrutement continu"
    "|postes à pourvoir|partager|partage|partagez|share|équipements|produits|nos produits|emplois temps plein|emploi étudiant|emplois télétravail|guide carrière|eoe|eeo|faq|eng"
).split("|")
SLOGANS = ["Nous recherchons un opérateur", "Un emploi de plombier à échelle humaine", "Pourquoi nous rejoindre", "Deviens soudeur", "Votre avenir", "Apply for welder", "Zone de soudeur", "Pour nous contacter", "Tu aimes la mécanique", "Je veux travailler", "Candidature spontanée soudeur", "Voir tous nos monteurs"]
SERVICES = ["Déneigement", "Charpente", "Maintenance industrielle", "Aménagement paysager", "Entretien d'espaces verts", "Construction résidentielle", "Déneigement de voies publiques", "Réparation et modifications", "Débosselage de véhicules", "Forage du sol", "Remorquage pour tous"]
TITLES = ["Opérateur de déneigement", "Soudeur", "Manœuvre en excavation", "Contremaître", "Foreuse", "Technicien en maintenance industrielle"]


def flags(spark, texts, column):
    return [r.x for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(column.alias("x")).collect()]


def test_each_label_slogan_and_service(spark):
    t = F.col("t")
    assert [x for x, y in zip(LABELS, flags(spark, LABELS, has(t, P.NAV_LABELS)), strict=True) if not y] == []
    assert [x for x, y in zip(SLOGANS, flags(spark, SLOGANS, has(t, P.MARKETING_PREFIX)), strict=True) if not y] == []
    assert [x for x, y in zip(SERVICES, flags(spark, SERVICES, has(t, P.SERVICE_ONLY) | has(t, P.SERVICE_LED)), strict=True) if not y] == []
    assert all(flags(spark, TITLES, P.is_job_title(t))) and not any(flags(spark, LABELS + SLOGANS + SERVICES, P.is_job_title(t)))


CASES = [
    ("<a href='/emplois/operateur-de-pelle-mecanique'>En savoir plus</a><h3>Opérateur de pelle mécanique</h3>", [("https://e/emplois/operateur-de-pelle-mecanique", "Opérateur de pelle mécanique")]),  # the heading of the slug
    ("<a href='/emplois/chef-de-chantier'>nous rejoindre</a>", [("https://e/emplois/chef-de-chantier", "Chef de Chantier")]),
    ("<a href='/emplois/x-1'>Nous recherchons un opérateur</a>", []),
    ("<a href='/nos-offres'>Soudeur haute pression</a><a href='/blogue/soudeur'>Soudeur</a>", [("https://e/nos-offres", "Soudeur haute pression")]),
    ("<a href='/offre/a/'>Monteur Voir le poste</a><a href='/offre/a'>Monteur</a>", [("https://e/offre/a/", "Monteur")]),
    ("<a href='mailto:emploi@x.ca'>Soudeur</a><a href='/candidature-spontanee-emploi'>Soudeur</a><a href='/carrieres/'>Soudeur</a>", []),
    ("<a href='/emplois/b?poste=Ferblantier#contact'>Postuler</a>", [("https://e/emplois/b?poste=Ferblantier", "Ferblantier")]),
    ("<a href='/emplois/comptes'>Commis aux comptes recevablesSherbrooke, Qc</a>", [("https://e/emplois/comptes", "Commis aux comptes recevables")]),
    ("<a href='/emplois/d'>Déneigement de voies</a><a href='/emplois/e'>Soudeur (poste comblé)</a><a href='/emplois/f'>Envie de bouger ?</a>", []),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_job_links(spark, k):
    made = spark.createDataFrame([(k, "https://e/carrieres", CASES[k][0])], "page_id long, url string, html string")
    out = P.job_links(P.page_elements(made)).orderBy("pos").collect()
    assert [(r.url, r.title) for r in out] == CASES[k][1]


def test_postings_at_any_depth(spark):
    node = '{"@type":"JobPosting","title":"T","hiringOrganization":{"name":"C"}}'
    for _ in range(40):
        node = f'{{"@graph":[{node}]}}'
    made = spark.createDataFrame([(1, "https://e/", f"<script type='application/ld+json'>{node}</script><script type='application/ld+json'>{'[' * 200000}</script>")], "page_id long, url string, html string")
    assert [(r.title, r.company) for r in P.parse_json_ld(made).collect()] == [("T", "C")]


CARD_CASES = [
    ("<div class=c><h3>Grutier d'expérience</h3><p>Laval</p><a href='/emplois/x-1'>Voir le poste</a></div><h2>Autre</h2>", "Grutier d'expérience"),  # the card's heading, not the page's
    ("<section><h2>Nos postes</h2><div><div><h4>Paveur</h4></div><div><a href='https://ats.x/offre/77'>Jobillico</a></div></div></section>", "Paveur"),  # the nearest ancestor that has one
    ("<div><h3>Soudeur</h3><h3>Monteur d'acier</h3><a href='https://ats.x/offre/77'>Postuler</a></div>", "Monteur d'acier"),  # the last of it
    ("<h3>Soudeur</h3><a href='https://ats.x/offre/77'>Postuler</a>", None),  # no card
    ("<div><h3>Soudeur</h3>" + "<div>" * 6 + "<a href='https://ats.x/offre/77'>Postuler</a></div>", None),  # too far up
    ("<div><h3>Commis</h3><a href='/offre/77'>" + "Commis de chantier à temps plein, poste permanent de jour, du lundi au vendredi, " * 1 + "horaire flexible et avantages</a></div>", "Commis"),  # over 90 characters
    ("<a href='/carrieres/offre-9' title='Briqueteur-maçon'></a>", "Briqueteur-maçon"),
    ("<div><a href='https://www.jobillico.com/fr/offre-d-emploi/acme/chef-equipe/9'>https://www.jobillico.com/fr/offre-d-emploi/acme/chef-equipe/9</a></div>", "Chef Equipe"),
    ("<ul><li><a href='/emplois/foreur-1'>Foreur<li><a href='/emplois/paveur-2'>Paveur</ul>", "Foreur"),  # unclosed links and items
]


@pytest.mark.parametrize("k", range(len(CARD_CASES)))
def test_nearest_heading(spark, k):
    made = spark.createDataFrame([(k, "https://e/carrieres", CARD_CASES[k][0])], "page_id long, url string, html string")
    out = P.job_links(P.page_elements(made)).orderBy("pos").collect()
    assert (out[0].title if out else None) == CARD_CASES[k][1]


REFUSED = [
    "Soudeur contact@acme.ca", "Marie-Claude Dubé | Estimatrice, technicienne", "Métier : Cuisiniste", "Horaire : Opérateur de jour", "Opérateur CMMB_AS", "Installer et superviser les monteurs", "Opérateur afin de livrer", "Soudeurs recherchés", "Soudeur (poste comblé) poste comblé",
    "Le soudeur travaille bien.", "Soudeur ?", "Soudeurs Tremblay inc.", "Un soudeur motivé de nuit dans notre équipe du nord lointain", "Nous recherchons un soudeur", "Actualiser les postes de soudeur", "Nos emplois de soudeur", "Déneigement", "Exigences et avantages",
]
ACCEPTED = ["Opérateur (H/F) (institutionnel et commercial, de jour ou de soir, à Laval)", "Frigoriste - Compagnon ou apprenti - Rive-Sud de Montréal", "Soudeur.", "Dessinateur en Conception 3D et Mise en Plan", "Chauffeur classe 1"]


def test_each_rule_of_a_title(spark):
    t = F.col("t")
    assert [x for x, y in zip(REFUSED, flags(spark, REFUSED, P.is_job_title(t)), strict=True) if y] == []
    assert [x for x, y in zip(ACCEPTED, flags(spark, ACCEPTED, P.is_job_title(t)), strict=True) if not y] == []


HEADING_CASES = [
    ("<h2>Contremaître - Charpentier - Manœuvre</h2>", ["Contremaître", "Charpentier", "Manœuvre"]),
    ("<h2>Frigoriste - Compagnon - Rive-Sud</h2>", ["Frigoriste - Compagnon - Rive-Sud"]),
    ("<ul><li>Soudeur<li>Plombier de chantier</ul><p>Bienvenue", ["Soudeur", "Plombier de chantier"]),
    ("<ul><li>Mécanicien de machinerie : <ul><li>Effectuer les réparations</li></ul></li><li><ul><li>Grutier</li></ul></li></ul>", ["Mécanicien de machinerie", "Grutier"]),
    ("<ul><li>Opérateur 3 ans</li><li>Opérateur type 2</li><li>Soudeur with ticket</li><li>Chauffeur, permis classe 1</li><li>Opérateur de pelle mécanique sur chenilles hydrauliques</li></ul>", ["Opérateur type 2"]),
    ("<div><h3>Avantages</h3><div><ul><li>Contremaîtres accessibles</li></ul></div></div><div><strong>Postes</strong><ul><li>Soudeur</li></ul></div>", ["Soudeur"]),
    ("<p><b>Exigences</b></p><div><b>Tâches</b><ul><li>Opérateur adjoint</li></ul></div>", []),
    ("<div class='x elementor-tab-title'>Paveur</div><div class='elementor-tab-titles'>Mineur</div>", ["Paveur"]),
    ("<nav><a href='#'>Soudeur</a></nav><a href='#a'>Grutier</a><a>Mineur</a><a href='/docs/fiche.PDF'>Peintre</a><a href='#'><p>Vitrier</p></a><a href='/page'>Monteur</a>", ["Grutier", "Mineur", "Peintre"]),
    ("<strong>— Soudeur •</strong><b>Offre d'emploi : Grutier Postuler</b><h6>Mineur</h6>", ["Soudeur", "Grutier"]),
]


@pytest.mark.parametrize("k", range(len(HEADING_CASES)))
def test_heading_jobs(spark, k):
    made = spark.createDataFrame([(k, "https://e/carrieres/#x", HEADING_CASES[k][0])], "page_id long, url string, html string")
    out = {r.title: r.url for r in P.heading_jobs(P.page_elements(made)).collect()}
    assert sorted(out) == sorted(HEADING_CASES[k][1])
    assert out.get("Peintre", "https://e/docs/fiche.PDF") == "https://e/docs/fiche.PDF" and out.get("Grutier", "https://e/carrieres#grutier") == "https://e/carrieres#grutier"


def test_wix_and_lists_come_before_a_single_offer(spark):
    single = "<h1>Soudeur</h1><p>Responsabilités</p><p>Exigences</p>"
    wix = "<div class='wixui-repeater__item'><h3>Grutier</h3><h4>Temps plein</h4><a href='https://x/1'>Voir</a></div>"
    listing = "<ul class='jobs-listing'><li><a href='/acme/12?l=fr'>Peintre industriel</a> <span>Laval</span></li></ul>"
    made = spark.createDataFrame([(1, "https://e/c", single), (2, "https://e/c", single + wix), (3, "https://e/c", single + listing)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.strategy, r.title) for r in P.career_postings(made).collect()) == [(1, "single", "Soudeur"), (2, "wix", "Grutier"), (3, "listing", "Peintre industriel")]


def test_a_repeated_page_gives_its_postings_once_each(spark):
    page = (1, "https://e/", '<script type="application/ld+json">{"@type":"JobPosting","title":"T","hiringOrganization":{"name":"C"}}</script>')
    made = spark.createDataFrame([page, page, page], "page_id long, url string, html string")
    assert P.parse_json_ld(made).count() == 3


def test_configured_sources(spark):
    from tamarack.operators.extract import configured as C

    sources = C.configured_sources(spark)
    assert sources.count() == 13 and sources.select("id").distinct().count() == 13
    by_route = sources.where("address like 'http%'").where(P.route(F.col("address"), F.col("method")) != F.when(F.col("method") == "avature", "generic").otherwise(F.col("method")))
    assert by_route.count() == 0
    own = "<a href='/emploi-soudeur'>Soudeur</a><a href='/emploi-x'>Postuler</a><a href='/offre/grutier-2'>Grutier</a>"
    made = spark.createDataFrame([(1, "leqel", "https://www.leqel.ca/carriere/", own), (2, "refrabec", "https://refrabec.qc.ca/carrieres/", own), (3, "ebc", "https://ebcinc.com/", own)], "page_id long, source_id string, url string, html string")
    found = sorted((r.source_id, r.strategy, r.title) for r in C.generic_postings(made, sources).collect())
    assert [f for f in found if f[2] != "X"] == [("leqel", "pattern", "Soudeur"), ("refrabec", "links", "Grutier"), ("refrabec", "links", "Soudeur")]


def test_stefetmax(spark):
    from tamarack.operators.extract import cards

    html = "<h3>Soudeur monteur.</h3><h3>Les postes suivants</h3><h3>FAQ</h3><h3>" + "Opérateur " * 8 + "</h3><h3>Soudeur monteur</h3><h2>Grutier</h2>"
    made = spark.createDataFrame([(1, "https://stefetmax.com/carrieres#x", html)], "page_id long, url string, html string")
    assert [(r.url, r.title) for r in cards.parse_cards(made, "stefetmax").collect()] == [("https://stefetmax.com/carrieres#soudeur-monteur", "Soudeur monteur")]
