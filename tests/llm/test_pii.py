import copy
import time

import numpy as np
import pytest

from trendspark.llm import pii
from trendspark.llm.pii import EMAIL, KINDS, entities, fit, infer, mask_personal, mentions, personal_items, train

GIVEN = ["Clive", "Hester", "Jürgen", "Harbor", "Noémie", "Lucía"]
FAMILIES = ["Dunskmere", "Kelmstow", "Bexlcombe", "Tansfield", "Stolzerfeldt", "Roquetière", "Thackelbury"]


def texts():
    out = []
    for i in range(300):
        g, f = GIVEN[i % 6], FAMILIES[i % 7] + "abcdefghij"[i % 10]
        out += [
            f"Chart by {g} {f}. Totals for April were read early and may still grow.", f"The median of Harbor ceramics is {i} views. Please add the Dutch edition.",
            f"Call me on +44 20 7946 0{100 + i} before the run.", f"My SSN is 9{10 + i % 80}-{10 + i % 89}-{1000 + i}. Ticket 4471-08-{1000 + i} asks for the chart.", f"{f}, {g}\n{10 + i} Millrace Road\n{g.lower()}@post.example.com",
        ]
    return out


@pytest.fixture(scope="module")
def model():
    return train(texts(), GIVEN)


def got(text, model):
    return {(KINDS[k], text[a:b]) for a, b, k in entities(text, model)}


@pytest.mark.parametrize("address", ["a.b+c@post.example.com", "a.b (at) post (dot) example (dot) com", "a_b [at] post.example.com", "ab AT post DOT example DOT com", "ab＠post.example.org", "ab @ post.example.org", "AB@POST.EXAMPLE"])
def test_email(model, address):
    assert got(f"Write to {address}, please.", model) == {("email", address)}


def test_no_email(model):
    assert not got("@trenddesk please check views@daily and look at 5 pages", model)


@pytest.mark.parametrize("number", ["+44 20 7946 0232", "+1-713-555-0189", "(415) 555-0196", "206.555.0180", "01.99.00.15.43", "+33 (0)1-99-00-90-86", "030/23125552", "(+48) 992.097.249", "00493023125358", "07700 900 564", "997-664-650", "1 (617) 555 0187"])
def test_phone(model, number):
    assert got(f"Call me on {number} before the run.", model) == {("phone", number)}


@pytest.mark.parametrize(("label", "number"), [("SSN", "915-06-1169"), ("NI number", "QQ 47 48 60 B"), ("passport", "XK 4385832"), ("PESEL", "46134973460"), ("DNI", "07780356-Z"), ("NIE", "X-0880504-N"), ("Steuer-ID", "03 165 460 959"), ("NIR", "9 37 92 00 049 026 23"), ("licence", "Z674-6636-7477"), ("Personalausweis", "L2K07G247")])
def test_idnum(model, label, number):
    assert got(f"My {label} is {number}.", model) == {("idnum", number)}


def test_other_numbers_are_none(model):
    for t in ("Ticket 4471-08-1039 asks for it.", "See 192.0.2.17 in the server log.", "ISBN 978-0-00-465104-6 is cited.", "Revision 1391852510 shortened it.", "Build 2022.05.26.10 fixed it.", "entry 27552604 records a move", "r_20250521T0518_4db8f0"):
        assert not got(t, model), t


@pytest.mark.parametrize("street", ["137 Cinderpath St", "179A Upper Tamber Way", "208 West Bellweather Avenue", "17a upper fernhollow close", "5 bis avenue de la Tuilerie", "79, place du Vieux-Lavoir", "Calle de los Olmos, 219", "C/ del Molino Viejo, 37", "Torfstichgasse 175c", "Alte-Ziegeleistraße 115–117", "ul. Jałowcowa 138/44", "An der Schleusenallee 94"])
def test_address(model, street):
    assert got(f"Meet at\n{street}\nat nine.", model) == {("address", street)}


def test_no_address(model):
    for t in ("Meet at the usual place, 14 Northern editions to go.", "La mediana es de 104 visitas al día.", "most of them about places. Search lists 37 pages"):
        assert not got(t, model), t


@pytest.mark.parametrize("name", ["Clive Dunskmere", "Dunskmere, Clive", "Clive-Noémie Tansfield", "HESTER KELMSTOW", "hester kelmstow", "H. Kelmstow", "Hester B. Kelmstow", "Jürgen Stolzerfeldt-Bexlcombe", "Lucía de la Roquetière"])
def test_name(model, name):
    assert got(f"Chart by {name}.", model) == {("name", name)}


def test_no_name(model):
    for t in ("Clive asked again.", "The curve of Harbor ceramics is flat.", "Totals for April may grow.", "clive.dunskmere@post.example.com"):
        assert not {x for x in got(t, model) if x[0] == "name"}, t


def test_titles_and_possessives_stay(model):
    assert got("I copied Clive Dunskmere's numbers. Herr Jürgen Stolzerfeldt agrees.", model) == {("name", "Clive Dunskmere"), ("name", "Jürgen Stolzerfeldt")}


def test_repeated_mentions_agree(model):
    t = "Chart by Clive Quorndale.\nSelma Quorndale\nselma.quorndale@post.example.com"
    assert ("name", "Selma Quorndale") in got(t, model)


def without(model, **parts):
    """The model with some parts put back to the prior, or taken out."""
    out = copy.deepcopy(model)
    for name, value in parts.items():
        setattr(out, name, value)
    return out


NO_LINKS = {k: [0.0, 0.0] for k in pii.LINKS}
PRIOR_WEIGHTS = {k: dict(w) for k, w in pii.PRIOR.items()}


def test_links_decide(model):
    """Names without a listed given name, that only another mention tells of: the same family name, the same with another
    ending, an address spelled from the name."""
    bare = without(model, links=NO_LINKS)
    for text, name in (
        ("Chart by Clive Quorndale.\n\nLater Selma Quorndale wrote again.", "Selma Quorndale"),
        ("Chart by Clive Quorndalesk.\n\nWe asked Selma Quorndaleski again.", "Selma Quorndaleski"),
        ("We asked Selma Quorndale again.\n\nselma.quorndale@post.example.com", "Selma Quorndale"),
    ):
        assert ("name", name) in got(text, model) and ("name", name) not in got(text, bare), text


def number(i, k, sep):
    d = f"{(712345678 + 7919013 * i + 104729 * k) % 900000000 + 100000000}"
    return sep.join((d[:3], d[3:6], d[6:]))


def cued(n=60):
    """Numbers that are phone numbers before "nach Feierabend" and tickets before "im Archiv", a cue telling which; and "Rufzeichen"
    before numbers that a cue tells of elsewhere in the text."""
    out = []
    for i in range(n):
        out += [f"Please call {number(i, 1, '-')} nach Feierabend.\nPlease phone {number(i, 1, '.')} nach Feierabend.", f"See ticket {number(i, 2, '-')} im Archiv."]
        out += [f"Please phone {number(i, 3, '-')} first.\nRufzeichen {number(i, 3, '')} wurde notiert."]
    return out


def test_fitted_weights_decide():
    """A form that says little: the words behind it, seen with other forms, tell what it is."""
    m = train([*texts(), *cued()], GIVEN)
    t = "The number 981234567 nach Feierabend."
    assert got(t, m) == {("phone", "981234567")} and not got(t, without(m, weights=PRIOR_WEIGHTS))
    t = "The number 981-234-567 im Archiv."
    assert not got(t, m) and got(t, without(m, weights=PRIOR_WEIGHTS)) == {("phone", "981-234-567")}


def test_labels_travel_over_links_into_the_weights():
    """No cue stands on the line of a number behind "Rufzeichen"; the linked number tells what it is, and the word is learned."""
    t = "Rufzeichen 981234567 wurde notiert."
    m = train([*texts(), *cued()], GIVEN)
    assert got(t, m) == {("phone", "981234567")} and not got(t, without(m, weights=PRIOR_WEIGHTS))
    apart = [x for t in cued() for x in t.split("\n")]
    assert not got(t, train([*texts(), *apart], GIVEN))


def test_links_are_fitted_with_the_weights():
    """Where linked mentions agree their potential grows, where they do not it falls."""
    agree = train([*texts(), *[f"Please call {number(i, 1, '-')}.\nPlease phone {number(i, 1, '.')}." for i in range(80)]], GIVEN)
    differ = train([*texts(), *[f"Please call {number(i, 1, '-')}.\nSee ticket {number(i, 1, '.')}." for i in range(80)]], GIVEN)
    assert differ.links["same"][0] < pii.LINKS["same"][0] < agree.links["same"][0]


def test_messages_pass_until_they_are_still(model):
    """A chain of names, each linked to the next, with one clear case at its end: it takes as many rounds as links."""
    chain = "abcdefghi"
    ms = mentions("\n\n".join([*(f"Selma {a}orst-{b}orst" for a, b in zip(chain.upper(), chain[1:].upper())), "Chart by Clive Iorst."]), model)
    far, _ = pii.beliefs(ms, model)
    near, _ = pii.beliefs(ms, model, rounds=2)
    assert len(ms) >= 9 and np.abs(far - near).max() > 0.01
    again, _ = pii.beliefs(ms, model, rounds=1000)
    assert np.abs(far - again).max() < 0.05


def test_time_grows_with_the_mentions(model):
    """Ten times the mentions: not much more than ten times the work."""
    one = "".join(f"{g} {f}{i}a, {g.lower()}.{f.lower()}{i}@post.example.com, +44 20 7946 0{100 + i}\n" for i in range(60) for g, f in [("Hester", "Kelmstow"), ("Selma", "Bexlcombe")])
    took = []
    for text in (one, one * 10):
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            entities(text, model)
            best = min(best, time.perf_counter() - began)
        took.append(best)
    assert took[1] < 16 * took[0], took


def test_sample_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in enumerate(texts())], DOCS)
    names = spark.createDataFrame([(g,) for g in GIVEN], "given_name string")
    one, many = (fit(docs.repartition(n), names, sample=400) for n in (1, 13))
    assert one.weights == many.weights and one.links == many.links and one.common == many.common


def test_links_are_linear_and_exclude_overlaps(model):
    ms = mentions("Clive Dunskmere " * 400, model)
    assert len(pii._links(ms)) < 12 * len(ms)
    spans = sorted(x[:2] for x in entities("Clive Dunskmere " * 400, model))
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert infer([], model) == []


DOCS = "doc_id bigint, text string, kind string, start int"


def test_operator(spark):
    rows = [(i, t, "k", 0) for i, t in enumerate(texts())] + [(10_001, None, "k", 0), (10_002, "", "k", 0), (10_003, "Chart by Clive Dunskmere, 137 Millrace Road.", "k", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    names = spark.createDataFrame([(g, None) for g in [*GIVEN, None, ""]], "given_name string, lang string")
    items = {(r["kind"], r["item"]) for r in personal_items(docs, names).where("doc_id = 10003").collect()}
    assert items == {("name", "clivedunskmere"), ("address", "137millraceroad")}
    masked = {r["doc_id"]: r["text"] for r in mask_personal(docs, fit(docs, names)).where("doc_id > 10000").collect()}
    assert masked == {10_001: None, 10_002: "", 10_003: "Chart by [NAME], [ADDRESS]."}
    assert personal_items(docs.limit(0), names).count() == 0
    assert {r["restored"] for r in pii.restored(docs, fit(docs, names)).collect()} == {True}


def test_copies_and_frequent_names_are_no_common_words(spark):
    often = [f"Note {i}: chart {i * 7} by Selma Vanterholm." if i % 2 else f"Hester Vanterholm read page {i}." for i in range(120)]
    rows = [(i, t, "k", 0) for i, t in enumerate([*texts(), *["Figures of Clive Orlensgard, as agreed."] * 400, *often])]
    docs = spark.createDataFrame([*rows, (10_001, "Chart by Clive Orlensgard.", "k", 0), (10_002, "Chart by Hester Vanterholm.", "k", 0)], DOCS)
    names = spark.createDataFrame([(g,) for g in GIVEN], "given_name string")
    model = fit(docs, names)
    assert not {"orlensgard", "vanterholm"} & model.common and {"chart", "median"} <= model.common
    items = {(r["doc_id"], r["item"]) for r in personal_items(docs, names).where("doc_id > 10000 and kind = 'name'").collect()}
    assert items == {(10_001, "cliveorlensgard"), (10_002, "hestervanterholm")}


def test_all_texts_count_beside_the_sample(spark):
    """Words, places, lead-ins and given names that stand in texts too long for the sample only."""
    fill = " ".join(f"The median of page {i} is flat." for i in range(800))
    long = [f"{fill} The page {i} was vetted by Selma {FAMILIES[i % 7]}a. A quiet brookwort was asked {i} times. Demandé de voir." for i in range(12)]
    assert min(map(len, long)) > pii.SAMPLE_CHARS
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in enumerate([*texts(), *long])], DOCS)
    names = spark.createDataFrame([(g,) for g in GIVEN], "given_name string")
    model = fit(docs, names, sample=700)
    assert "selma" in model.given and "brookwort" in model.common and ("demandé", "de") in model.leadins
    alone = train(texts(), GIVEN)
    assert "selma" not in alone.given and "brookwort" not in alone.common


def test_counts_of_the_operator_equal_those_in_memory(spark):
    ts = [*dict.fromkeys(texts()), "Geprüft von Kelmstow, Hester", "The museum of Tamtara is old."]
    whole = sum((pii.tally(t) for t in ts), pii.Counter())
    counts = pii.tallied(spark.createDataFrame([(t,) for t in ts], "t string"))
    assert {(r["what"], r["word"], r["other"]): r["n"] for r in counts.collect()} == dict(whole)
    given = pii._names(GIVEN)
    a, b = pii.Model(given), pii.Model(given)
    pii._lexicon(a, whole)
    pii._lexicon(b, pii._gather(counts, given))
    assert (a.common, a.places, a.leadins) == (b.common, b.places, b.leadins) and "tamtara" in a.places


def test_a_preposition_alone_makes_no_given_name():
    """A verb before "von" and a family name is no given name, however many families follow it."""
    model = train([*texts(), *[f"Geprüft von {f}{e}, {g}" for f in FAMILIES for e in "abcdefghij" for g in GIVEN[:3]]], GIVEN)
    assert "gepruft" not in model.given


def test_a_model_without_corpus_still_reads(spark):
    m = train([], [])
    assert ("email", "a@b.example") in got("mail a@b.example", m)
    assert EMAIL == 1
