import json

import pytest
from pyspark.sql import functions as F

from trendspark.operators import claims, resolve, scoring

CAND = "topic string, rank int, title string, qid string, bytes bigint"


def winner(spark, topic, *cands):
    got = [resolve.pick_winner(spark.createDataFrame([(topic, k, *c) for k, c in enumerate(order)], CAND)).collect() for order in (cands, cands[::-1])]
    return got[0][0]["qid"] if got[0] else None, got[1][0]["qid"] if got[1] else None


def test_winner_does_not_depend_on_order(spark):
    assert winner(spark, "Mercury", ("Freddie Mercury", "Q15869", 99_999), ("Mercury (planet)", "Q308", 50_000), ("Mercury (element)", "Q925", 40_000)) == ("Q308", "Q308")
    assert winner(spark, "python", ("Python (missile)", "Q15728", 5_000), ("Python (programming language)", "Q28865", 50_000)) == ("Q28865", "Q28865")
    assert winner(spark, "x", ("X (a)", "Q10", 5), ("X (b)", "Q9", 5)) == ("Q9", "Q9")
    assert winner(spark, "gold", ("Gold rush", None, 5)) == (None, None)
    assert winner(spark, "gold", ("Gold rush", "Q1", 5), ("Gold mine", "Q2", 9))[0] == "Q1"


def test_senses(spark):
    titles = [("Java", k, t) for k, t in enumerate(["Java (programming language)", "Java", "Java (disambiguation)", "JAVA (programming language)", "Java Sea", "Java (island)"])]
    got = resolve.competing_senses(spark.createDataFrame([("Java", "Java (island)")], "topic string, winner string"), spark.createDataFrame(titles, "topic string, ord int, title string"))
    assert [r["title"] for r in got.collect()] == ["Java (programming language)"]


def test_rivals(spark):
    links = [("t", "A", "Q2", 9_000, False, False), ("t", "B", "Q3", 30_000, False, False), ("t", "C", "Q1", 90_000, False, False), ("t", "D", "Q4", 90_000, True, False), ("t", "E", "Q5", 90_000, False, True), ("t", "F", None, 90_000, False, False)]
    got = resolve.rival_articles(spark.createDataFrame(links, "topic string, title string, qid string, bytes bigint, missing boolean, is_disambig boolean"), spark.createDataFrame([("t", "Q1", 100_000)], "topic string, qid string, bytes bigint"))
    assert [r["title"] for r in got.collect()] == ["B"]


@pytest.mark.parametrize(
    ("query", "via", "title", "senses", "confidence"),
    [("gold", "exact-title", "Gold", [], "high"), ("java", "exact-title", "Java", ["Java (x)"], "medium"), ("gold mining", "search", "Gold mining", [], "medium"), ("gold mining", "search", "Gold", [], "medium"),
     ("silver coin minting", "search", "Silver", [], "low"), ("gold", "search", "Copper", [], "low"), ("how has gold mining changed lately", "search", "Gold mining", [], "low"), ("the", "search", "Gold", [], "low")],
)
def test_confidence(spark, query, via, title, senses, confidence):
    df = spark.createDataFrame([(query, via, title, None, senses)], "query string, via string, title string, label string, senses array<string>")
    assert resolve.match_confidence(df).collect()[0]["confidence"] == confidence


def test_routes(spark):
    topics = spark.createDataFrame([("gold",), ("ag",), ("label",), ("java",), ("nothing",)], "topic string")
    pages = spark.createDataFrame([("Gold", False, 9, "Q1", False), ("Silver", False, 8, "Q2", False), ("Java", False, 7, "Q3", True), ("Java (island)", False, 6, "Q4", False)], "title string, missing boolean, bytes bigint, qid string, is_disambig boolean")
    search = spark.createDataFrame([("ag", 1, "Silver"), ("gold", 1, "Silver"), ("java", 1, "Java (island)")], "topic string, rank int, title string")
    items = spark.createDataFrame([("Label", "Q9")], "label string, qid string")
    got = {r["topic"]: (r["via"], r["qid"]) for r in resolve.find_entities(topics, pages, search, items).collect()}
    assert got == {"gold": ("exact-title", "Q1"), "ag": ("search", "Q2"), "label": ("entity-search", "Q9"), "java": ("search", "Q4"), "nothing": (None, None)}


def test_every_title_a_reply_was_asked_for(spark, tmp_path):
    from trendspark.plans.reference import redirect_chain

    page = lambda title, **k: {"pageid": 1, "ns": 0, "title": title, **k}
    ids = lambda q: {"pageprops": {"wikibase_item": q}}
    bodies = [
        {"pages": [page("Gold", **ids("Q1"))], "normalized": [{"from": "gold", "to": "Aurum"}], "redirects": [{"from": "Aurum", "to": "Gold"}]},
        {"pages": [page("Silver", **ids("Q2")), page("Tin", **ids("Q3")), {"ns": 0, "title": "None", "missing": True}], "redirects": [{"from": "Argentum", "to": "Silver"}]},
        {"pages": [page("Lead", **ids("Q4"))]},
        {"pages": [page("Zinc", **ids("Q5"))], "normalized": [{"from": "zinc", "to": "Zinc"}]},
    ]
    rows = [(i, json.dumps({"batchcomplete": True, "query": q})) for i, q in enumerate(bodies)]
    spark.createDataFrame(rows, "response_id bigint, body string").write.parquet(str(tmp_path / "api_responses.parquet"))
    got = {(r["title"], r["canonical"], r["redirected_from"], r["missing"], r["qid"]) for r in redirect_chain(spark, str(tmp_path)).collect()}
    assert got == {
        ("gold", "Gold", "Aurum", False, "Q1"), ("Argentum", "Silver", "Argentum", False, "Q2"), ("Tin", "Tin", None, False, "Q3"), ("None", "None", None, True, None),
        ("Lead", "Lead", None, False, "Q4"), ("zinc", "Zinc", None, False, "Q5"),
    }


def test_every_edition_once(spark):
    asked = spark.createDataFrame([("t", "Q1", x) for x in ("en", "de", "fr", "es", "pl", "it")], "topic string, qid string, lang string")
    links = spark.createDataFrame([("Q1", "en", "A"), ("Q1", "de", "B"), ("Q1", "fr", "C")], "qid string, lang string, title string")
    ll = spark.createDataFrame([("t", "es", "D#part"), ("t", "pl", "E")], "topic string, lang string, title string")
    pairs, pages = "lang string, from_title string, to_title string", "lang string, title string, missing boolean, bytes bigint, qid string, is_disambig boolean"
    checked = resolve.follow_titles(
        links.select("lang", "title"), spark.createDataFrame([("en", "A", "AA")], pairs), spark.createDataFrame([("de", "B", "BB")], pairs),
        spark.createDataFrame([("en", "AA", False, 5, "Q1", False), ("de", "BB", False, 6, "Q7", False), ("fr", "C", True, None, None, False)], pages),
    )
    got = {r["lang"]: r["status"] for r in resolve.resolve_editions(asked, links, ll, checked).collect()}
    assert got == {"en": "ok", "de": "folded_into_broader_article", "fr": "title_gone", "es": "section_only", "pl": "not_linked_in_wikidata", "it": "no_article"}
    assert {r["lang"]: r["status"] for r in resolve.resolve_editions(asked, links, ll, checked, allow_fold=True).collect()}["de"] == "measures_broader_topic"


ROWS = "run_id string, lang string, title string, confidence string, raw_yoy double, normalized_yoy double, figures array<double>, numbers array<double>"


def issues(spark, text):
    results = spark.createDataFrame(
        [("r", "uk", "Добування", "high", -30.2, 23.7, [1200.0, 837.0, -30.2, 23.7], [1200.0, 837.0, -30.2, 23.7, 48.0]), ("r", "tr", "Altın", "low", 92.4, 40.3, [500.0, 962.0, 92.4, 40.3], [500.0, 962.0, 92.4, 40.3])], ROWS
    )
    runs = spark.createDataFrame([("r", "gold", "Gold", [731.0])], "run_id string, topic string, label string, shared array<double>")
    drafts = spark.createDataFrame([(1, "r", text)], "draft_id int, run_id string, text string")
    return sorted((r["id"], r["figure"]) for r in claims.check_claims(drafts, runs, results).collect())


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Ukrainian views fell 30.2% while the share rose.", []), ("Interest is at 62.5 now.", [("untraceable_figure", "62.5")]), ("In Ukrainian, interest grew 30.2%.", [("direction_conflict", "30.2")]),
        ("In Ukrainian, views fell 23.7%.", [("direction_conflict", "23.7")]), ("In Ukrainian, views did not fall 23.7%.", []), ("Turkish views rose 92.4%.", [("low_confidence_quoted", "92.4")]),
        ("Turkish views rose 92.4%, but confidence is low.", []), ("Ukrainian shows 962 views.", [("misattributed_figure", "962")]), ("Ukrainian and Turkish differ: 962 and 837.", []), ("In 2024, 12 months, 7% decline.", []),
        ("About 1,210 Ukrainian views.", []), (None, []), ("", []),
    ],
)
def test_claims(spark, text, found):
    assert issues(spark, text) == found


def test_scores(spark):
    t = spark.createDataFrame([("a", "s", ['wt views "gold" --langs en'], "Grew 5 of 48.1", "48.1", None), ("b", "s", ["wt views 'how is gold doing these days'"], "bad 99.5", "1", ""), ("c", "s", None, None, None, None)], "transcript_id string, scenario string, commands array<string>, answer string, tool_output string, reference string")
    s = spark.createDataFrame([("s", ["views"], ["(?i)GREW"], ["bad"])], "scenario string, must_call array<string>, must_mention array<string>, must_not_mention array<string>")
    got = {r["transcript_id"]: r for r in scoring.score(t, s).collect()}
    assert got["a"]["pass"] and not got["b"]["pass"] and not got["c"]["ran_a_command"]
    assert [got["b"][c] for c in scoring.CHECKS] == [True, True, False, False, False, False]


def test_topics_to_articles_the_whole_way(spark):
    """Every route and every status, with senses, other candidates, warnings and targets."""
    pages = spark.createDataFrame(
        [("Mercury", False, 900, "Q1", False), ("Mercury (disambiguation)", False, 10, "Q2", True), ("Mercury (element)", False, 800, "Q3", False), ("Mercury (band)", False, 20, "Q4", False), ("Gold mining", False, 500, "Q5", False), ("Gold", False, 900, "Q6", False), ("Tin Inc.", False, 5, "Q7", False), ("Gone", True, None, None, False)],
        "title string, missing boolean, bytes int, qid string, is_disambig boolean",
    )
    returned = spark.createDataFrame([("mercury", 1, "Mercury"), ("mercury", 2, "Mercury (disambiguation)"), ("tin", 1, "Tin Inc.")], "topic string, rank int, title string")
    search = spark.createDataFrame([("mining of gold", k, t) for k, t in ((1, "Gold mining"), (2, "Gold"), (3, "Gone"), (11, "Mercury"))], "topic string, rank int, title string")
    items = spark.createDataFrame([("Silver rush", "Q9"), ("Silver Rush", "Q8"), ("mercury", "Q1")], "label string, qid string")
    links = pages.withColumn("topic", F.lit("mercury"))
    site = spark.createDataFrame([("Q1", x, t) for x, t in (("en", "Mercury"), ("de", "Merkur"), ("fr", "Mercure"), ("es", "Mercurio"), ("pl", "Merkury"))], "qid string, lang string, title string")
    other = spark.createDataFrame([("mercury", "it", "Pianeti#Mercurio"), ("mercury", "pt", "Mercúrio")], "topic string, lang string, title string")
    checked = spark.createDataFrame(
        [("de", "Merkur", "Merkur", None, True, None, None, False), ("fr", "Mercure", "Planètes", "Mercure", False, 9, "Q77", False), ("es", "Mercurio", "Mercurio", None, False, 9, "Q1", True), ("pl", "Merkury", "Merkury (planeta)", "Merkury", False, 9, "Q1", False)],
        "lang string, title string, canonical string, redirected_from string, missing boolean, bytes int, qid string, is_disambig boolean",
    )
    topics = spark.createDataFrame([("mercury",), ("mining of gold",), ("silver rush",), ("tin",), ("nothing",)], "topic string")
    wiki = resolve.Wiki(pages, returned, search, items, links, site, other, checked)
    langs = ["en", "de", "fr", "es", "pl", "it", "pt", "ru"]
    entities, editions = resolve.resolve_topics(topics, langs, wiki)
    e = {r["topic"]: r for r in entities.collect()}
    assert {t: (r["via"], r["qid"]) for t, r in e.items()} == {"mercury": ("exact-title", "Q1"), "mining of gold": ("search", "Q5"), "silver rush": ("entity-search", "Q8"), "tin": ("exact-title", "Q7"), "nothing": (None, None)}
    assert e["mercury"]["senses"] == ["Mercury (element)"] and e["mercury"]["confidence"] == "medium" and e["mercury"]["label"] == "mercury"
    assert e["mining of gold"]["others"] == ["Gold"] and e["silver rush"]["others"] == ["Silver rush"] and e["nothing"]["confidence"] == "low"
    got = {r["lang"]: (r["status"], r["title"], r["warning"], r["target"], r["redirected_from"]) for r in editions.where("topic = 'mercury'").collect()}
    assert got == {
        "en": ("ok", "Mercury", None, None, None), "de": ("title_gone", "Merkur", None, None, None), "fr": ("folded_into_broader_article", "Planètes", None, "Planètes", "Mercure"),
        "es": ("disambiguation_page", "Mercurio", "disambiguation_page", None, None), "pl": ("ok", "Merkury (planeta)", None, None, "Merkury"), "it": ("section_only", None, None, "Pianeti#Mercurio", None),
        "pt": ("not_linked_in_wikidata", None, None, "Mercúrio", None), "ru": ("no_article", None, None, None, None),
    }
    _, editions = resolve.resolve_topics(topics, ["fr", "de"], wiki, allow_fold=True)
    assert {r["lang"]: r["status"] for r in editions.where("qid = 'Q1'").collect()} == {"fr": "measures_broader_topic", "de": "title_gone"}
    _, editions = resolve.resolve_topics(topics, ["fr", "de"], wiki, verify=False)
    assert {r["lang"]: r["status"] for r in editions.where("qid = 'Q1'").collect()} == {"fr": "ok", "de": "ok"}
