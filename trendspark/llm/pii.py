"""Personal information in free text: e-mail addresses, phone numbers, identity numbers, street addresses and names.

A skip-chain conditional random field over the mentions of a document. Formats and a small grammar of names propose
mentions; each is a node with the labels its form allows, ``none`` among them. Node potentials are log-linear in
features of form, word pieces and context. Neighbours on a line are linked (the chain), and so are distant mentions
(the skip chain): with the same key (a number, a family name), with a similar one (a family name that is inflected or
misspelt at its end), and a name with an address whose local part is spelled from it. Overlapping mentions exclude each
other. Loopy belief propagation passes messages over the links until they no longer change, so that one clear mention
of a person decides the unclear ones. Each mention is linked to the one before it that shares its key, so links, and the
time a document takes, grow with its mentions, not with their pairs.

Weights of features and of links are fitted together, by pseudo-likelihood: each labelled mention given its features and
the labels of those it is linked to. Labels come from clear cues (a listed given name, a label before a number) in a bounded
sample of texts, with the cue hidden in half of the cases; what the fitted field then finds in the sample joins them,
weighted by its odds, so that words beside linked mentions are learned too. Weights start from the prior below, so that a small
corpus has a usable model. Words are counted and unlisted given names searched for in all texts. Every document is then
read whole, each on its own; nothing but the model travels to the tasks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
import unicodedata

import numpy as np
import pandas as pd
import regex as re
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed

NONE, EMAIL, PHONE, IDNUM, ADDRESS, NAME = range(6)
KINDS = ("none", "email", "phone", "idnum", "address", "name")
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS[1:]}

#: Documents of the training sample, and the longest text taken into it (in characters).
SAMPLE, SAMPLE_CHARS = 5000, 20_000

#: A word is no common word if it stands as a family name in this share of the texts that use it.
NAMED = 0.25

#: A word is a place, and no name, if it stands as in "museum of W" twice and in this share of its capital occurrences.
OF = 0.02

#: Entries a task counts before it passes them on.
HELD = 500_000

#: A blank, of one to three signs; what separates the groups of a number.
B = r"(?:[ \t   ]{1,3})"
SEP = r"(?:[.\-/‐-–]|[ \t   ]{1,3})"

# --- fixed values: formats -------------------------------------------------------------------------------------------
_AT = rf"(?:{B}?(?:[@＠]|&\#64;|%40){B}?|{B}?[\(\[\{{<]{B}?(?:at|AT|At|@){B}?[\)\]\}}>]{B}?|{B}AT{B})"
_DOT = rf"(?:\.|{B}?[\(\[\{{]{B}?(?:dot|DOT|Dot|punkt|point|punto|kropka|\.){B}?[\)\]\}}]{B}?|{B}DOT{B})"
_LOCAL, _HOST = r"[\p{L}\p{N}](?:[\p{L}\p{N}._%+'\-]*[\p{L}\p{N}_+\-])?", r"[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?"
EMAIL_FORM = re.compile(
    rf"(?<![\p{{L}}\p{{N}}]){_LOCAL}(?:{_AT}{_HOST}(?:{_DOT}{_HOST})*{_DOT}\p{{L}}{{2,24}}|{B}at{B}{_HOST}(?:{B}dot{B}{_HOST})*{B}dot{B}\p{{L}}{{2,24}})(?![\p{{L}}\p{{N}}])"
)

_PHONES = {
    "intl": rf"\(?(?:\+|\b00)\d{{1,3}}\)?(?:{SEP}?\(0\))?(?:{SEP}?\(?\d{{1,12}}\)?){{1,7}}",
    "nanp": rf"(?:\+?1{SEP})?(?:\(\d{{3}}\){SEP}?|\d{{3}}{SEP})\d{{3}}{SEP}\d{{4}}",
    "trunk_br": rf"\(0\d{{1,4}}\){SEP}?\d{{2,4}}(?:{SEP}?\d{{2,5}}){{1,3}}",
    "fr": rf"0\d(?:{SEP}?\d{{2}}){{4}}",
    "trunk": rf"0\d{{1,4}}(?:{SEP}\d{{2,8}}){{1,4}}",
    "three": rf"\d{{3}}{SEP}\d{{3}}{SEP}\d{{3}}",
    "es": rf"\d{{3}}{SEP}\d{{2}}{SEP}\d{{2}}{SEP}\d{{2}}",
    "bare": r"0\d{8,11}|\d{9,10}",
}
_IDS = {
    "ssn": r"\d{3}([\-.]|[    ]{1,2})\d{2}\1\d{4}",
    "ni": rf"[A-Z]{{2}}{B}?\d{{2}}{B}?\d{{2}}{B}?\d{{2}}{B}?[A-Z]",
    "lic_dash": rf"[A-Z]\d{{3}}[\-  ]\d{{4}}[\-  ]\d{{4}}",
    "lic": r"[A-Z]{2}\d{6}[A-Z]\d{2}|[A-Z]{5}\d{6}[A-Z0-9]{5}",
    "pass": rf"[A-Z]{{1,2}}{B}?\d{{7,8}}|\d{{2}}[A-Z]{{2}}\d{{5}}",
    "dni": r"\d{8}[\- ]?[A-Z]|\d{2}\.\d{3}\.\d{3}[\- ]?[A-Z]",
    "nie": r"[XYZ][\- ]?\d{7}[\- ]?[A-Z]",
    "nir": rf"[1-9]{B}?\d{{2}}{B}?\d{{2}}{B}?\d[\dAB]{B}?\d{{3}}{B}?\d{{3}}(?:{B}?\d{{2}})?",
    "taxde": rf"\d{{2}}{B}\d{{3}}{B}\d{{3}}{B}\d{{3}}",
    "eleven": r"\d{11}",
    "card": rf"(?=[A-Z0-9 ]*\d[A-Z0-9 ]*[A-Z][A-Z0-9 ]*\d)[A-Z][A-Z0-9]{{3}}{B}?[A-Z0-9]{{5}}[A-Z0-9]?",
}
NUMBER_FORM = re.compile(
    r"(?=[\d(+A-Z])(?<![\p{L}\p{N}@_]|\d[.\-/]|[\p{L}]-)(?:" + "|".join(f"(?P<{k}>{v})" for k, v in [*((k, v.replace(r"\1", r"(?P=ssnsep)").replace(r"([\-.]|[    ]{1,2})", r"(?P<ssnsep>[\-.]|[    ]{1,2})")) for k, v in _IDS.items()), *_PHONES.items()]) + r")(?![\p{L}\p{N}@_]|[.\-/]\d)"
)

_NO = r"\d{1,5}(?:\p{L}\b)?(?:[–\-/]\d{1,4}\p{L}?)?"
_W = r"\p{L}[\p{L}'’.\-]*"
ADDRESS_FORMS = {
    "en": rf"\b{_NO}{B}(?:{_W}{B}){{1,3}}?(?:(?i:street|road|avenue|lane|drive|court|close|way|terrace|crescent|boulevard|square|place|grove|gardens|row|walk|hill|parade|alley|mews|park|green|st|rd|ave|ln|dr|ct|blvd|sq|ter|cres|pl)\b)(?:{B}(?:North|South|East|West|N|S|E|W|NW|NE|SW|SE)\b)?",
    "fr": rf"\b\d{{1,5}}(?:{B}?(?:bis|ter|quater|\p{{L}}))?(?:[–\-/]\d{{1,4}})?,?{B}(?i:rue|avenue|av\.|place|boulevard|bd|impasse|quai|chemin|allée|cours|square|route|passage|villa|sentier|ruelle|faubourg)(?:{B}(?:de{B}l[’']|d[’']|l[’']|(?:de{B}la|de|du|des|la|le|les)\b{B}?)?\p{{Lu}}?[\p{{L}}'’\-]+){{1,2}}?(?=[\s,;.|<)–\"\-]|$)",
    "es": rf"(?<![\p{{L}}\d])(?i:calle|c/|avenida|avda\.?|av\.|plaza|pza\.?|paseo|p\.º|camino|ronda|travesía|carrera|callejón|cuesta|glorieta|carretera)(?![\p{{Ll}}]){B}?(?:(?:de{B}las?|de{B}los|del|de|la|las|los|el)\b{B})*\p{{L}}[\p{{L}}\-]*(?:{B}(?:(?:de{B}las?|de{B}los|del|de){B})?\p{{L}}[\p{{L}}\-]*){{0,2}},?{B}(?:n\.?[ºo]{B}?)?{_NO}",
    "de": rf"(?:(?:An{B}der|An{B}den|Am|Auf{B}der|Auf{B}dem|In{B}der|Im|Zum|Zur|Unter{B}den){B})?(?:\p{{Lu}}[\p{{L}}\-]*{B})?\p{{L}}[\p{{L}}\-]*(?i:straße|strasse|str\.|weg|gasse|platz|allee|ufer|ring|damm|steig|pfad|graben|chaussee|stieg|promenade){B}{_NO}",
    "bare": rf"\b(?:Am|An{B}der|An{B}den|Auf{B}der|Auf{B}dem|Im|Zum|Zur|Unter{B}den|In{B}der){B}\p{{Lu}}[\p{{L}}\-]{{3,}}{B}\d{{1,3}}\p{{L}}?(?:–\d{{1,3}}\p{{L}}?)?(?![\p{{L}}\d]|{B}\p{{Ll}})",
    "pl": rf"(?<![\p{{L}}\d])(?i:ul\.|ulica|ulicy|al\.|aleja|alei|aleje|pl\.|plac|placu|os\.|osiedle|osiedlu|rondo|skwer|bulwar)(?!\p{{L}}){B}?(?:(?:\d{{1,2}}{B})?\p{{Lu}}[\p{{L}}\-]*\.?{B}){{1,4}}?{_NO}",
}
ADDRESS_FORM = re.compile("|".join(f"(?P<a_{k}>{ADDRESS_FORMS[k]})" for k in ("fr", "en", "es", "de", "pl", "bare")))

TITLES = frozenset("mr mrs ms miss mx dr prof professor sir madam herr frau fräulein mme mlle m monsieur madame señor señora sr sra don doña pan pani dra ing mgr".split())
PARTICLES = frozenset("van von der den de la del du des di da le los las zu ten ter dos das".split())
PHONE_CUES = frozenset("tel telefon telefonisch phone call text mobile mobil fax callback line mail ruf rückruf telephone téléphone tél rappelez joignable appelez teléfono llamen móvil telefono numer dzwonić komórka tel. handy reachable cell whatsapp sms signal".split())
ID_CUES = frozenset("ssn security passport pass passnummer passeport pasaporte paszportu paszport dni nie nir nif insee ni insurance licence license licencia taxpayer tax steuer-id steuer identifikationsnummer personalausweis ausweis pesel dowodu dowód sécurité sociale permis führerschein identity steuernummer curp sin ausweisnummer reisepass reisepassnummer personalausweisnummer versicherungsnummer social identité identidad tożsamości podatkowy".split())
FUNCTION_WORDS = frozenset(
    "could would can should may might must shall did does do will has have had is are was were only please ask thanks by from with for and or as at on in of the a an this that "
    "der die das den dem ein eine und oder von mit bitte nur kann könnte hat haben ist sind le la les un une et ou de du avec par pour est sont peut el los las y o con por para es son puede "
    "i oraz z od do na jest są może czy proszę tylko".split()
)
OTHER_CUES = frozenset("ticket isbn entry revision version build item run registro entrada entrée wpis logeintrag révision revisión wersja server log totals views id order invoice served table page edition".split())
# ---------------------------------------------------------------------------------------------------------------------

WORD = re.compile(r"\p{L}[\p{L}\p{M}'’]*(?:-\p{L}[\p{L}\p{M}'’]*)*|\d+|[^\s\p{L}\d]")
LINE = re.compile(r"[^\n]+")
MAIL_LIKE = re.compile(r"\S*[@＠]\S*")


@lru_cache(maxsize=200_000)
def fold(s: str) -> str:
    """Lower case, letters and digits only, accents off."""
    s = unicodedata.normalize("NFKD", s.lower().replace("ł", "l").replace("ß", "ss").replace("ø", "o").replace("đ", "d"))
    return "".join(c for c in s if c.isalnum())


@dataclass
class Mention:
    start: int
    end: int
    kinds: tuple[int, ...]
    feats: list[str]
    keys: list[str]
    seed: int | None = None
    family: str = ""
    given: tuple[str, ...] = ()
    mail: Mention | None = None


@dataclass
class Model:
    """``weights``: label -> feature -> weight. ``common``: words that are no names.
    ``leadins``: words with a preposition they are often followed by. ``places``: words seen as in "museum of W". ``search``:
    whether common words in capitals may be given names, as in the search for those that are. ``links``: potentials of two linked mentions that both are something, and that
    both are none."""

    given: frozenset[str]
    common: frozenset[str] = frozenset()
    leadins: frozenset[tuple[str, str]] = frozenset()
    places: frozenset[str] = frozenset()
    weights: dict[int, dict[str, float]] = field(default_factory=lambda: defaultdict(dict))
    links: dict[str, list[float]] = field(default_factory=lambda: {k: list(v) for k, v in LINKS.items()})
    search: bool = False
    roles: dict[str, str] = field(default_factory=dict)

    def role(self, w: str) -> str:
        """What a word may be in a name: ``g`` a listed given name, ``f`` an unknown word, ``l`` one in small letters,
        ``i`` a letter that may be an initial, ``c`` a common word in capitals, ``''`` nothing. Kept per word; the store is emptied when it is large."""
        r = self.roles.get(w)
        if r is None:
            base = _strip_possessive(w)
            if not w[0].isalpha():
                r = ""
            elif len(base) == 1:
                r = "i" if base.isupper() else ""
            elif _listed(base, self.given):
                r = "g"
            elif len(base) >= 3 and fold(base) not in self.common and base.lower() not in TITLES and base.lower() not in FUNCTION_WORDS:
                r = "l" if base.islower() else "f"
            elif self.search and len(base) >= 3 and base[0].isupper() and base.lower() not in TITLES and base.lower() not in FUNCTION_WORDS:
                r = "c"
            else:
                r = ""
            if len(self.roles) > 300_000:
                self.roles.clear()
            self.roles[w] = r
        return r

    def __getstate__(self) -> dict:
        return self.__dict__ | {"roles": {}}


#: Potentials of links before any data: of two mentions that both are something, of two that both are none.
LINKS = {"same": (1.5, 1.5), "similar": (1.2, 0.3), "line": (0.5, 0.5), "mail": (3.0, 0.0)}
#: Links that tell of one label, and not only that both mentions are something.
ONE_LABEL = frozenset({"same", "similar"})
#: Most a potential can become, margin from which a label found is learned from, change of a message that is none.
LINK_MOST, LIKELY, STILL = 4.0, 0.7, 1e-3

#: Weights before any data: bias, and what the form says by itself.
PRIOR: dict[int, dict[str, float]] = {
    EMAIL: {"bias": 4.0},
    ADDRESS: {"bias": 2.0, "form=a_en_plain": -2.5, "form=a_bare": -2.5, "alone": 2.0, "row": 1.0, "closed": 2.0},
    NAME: {"bias": -1.5, "listed": 4.0, "initial": 2.5, "title": 1.5, "swapped": -0.5, "row": 1.5, "upper": -0.5, "lower": -1.5, "prev_of": -0.5, "next_common_lower": -1.0, "alone": 2.0, "given_common": -1.0, "cut_short": -5.0, "particle_after_word": -3.0, "particle_first": 3.0, "particle_left": -3.0},
    PHONE: {"bias": -1.0, "cue_phone": 3.0, "cue_id": -4.0, "cue_other": -4.0, "row": 1.0, "alone": 0.5, **{f"form={k}": w for k, w in {"intl": 4.0, "nanp": 3.0, "trunk_br": 3.0, "fr": 3.0, "trunk": 2.0, "three": 2.0, "es": 2.0, "bare": 0.0}.items()}},
    IDNUM: {"bias": -1.0, "cue_id": 4.0, "cue_phone": -2.0, "cue_other": -3.0, "alone": 0.5, **{f"form={k}": w for k, w in {"ssn": 3.0, "ni": 3.0, "lic_dash": 2.5, "lic": 3.0, "pass": 2.0, "dni": 3.0, "nie": 3.0, "nir": 2.0, "taxde": 2.0, "eleven": 2.0, "card": 0.0}.items()}},
}


#: What a line must hold for a form to be looked for in it.
_AT_SIGN = re.compile(r"[@＠]|&\#64;|%40|(?i:\bat\b)")
_LONG_NUMBER = re.compile(r"\d(?:[^\p{L}\n]{0,3}[\dA-Z]){5}|[A-Z]\d[A-Z0-9]")
_STREET = re.compile(
    rf"\d\p{{L}}?(?:[–\-/]\d+\p{{L}}?)?{B}[^\n\d]{{1,60}}?(?i:\b(?:street|road|avenue|lane|drive|court|close|way|terrace|crescent|boulevard|square|place|grove|gardens|row|walk|hill|parade|alley|mews|park|green|st|rd|ave|ln|dr|ct|blvd|sq|ter|cres|pl)\b)"
    rf"|\d(?:.?(?:bis|ter|quater|\p{{L}}))?,?.(?i:rue|avenue|av\.|place|boulevard|bd|impasse|quai|chemin|allée|cours|square|route|passage|villa|sentier|ruelle|faubourg)\b"
    rf"|(?i:straße|strasse|str\.|weg|gasse|platz|allee|ufer|ring|damm|steig|pfad|graben|chaussee|stieg|promenade){B}\d"
    rf"|\b(?i:calle|c/|avenida|avda\.?|av\.|plaza|pza\.?|paseo|p\.º|camino|ronda|travesía|carrera|callejón|cuesta|glorieta|carretera)[^\n\d]{{2,60}}\d"
    rf"|\b(?:Am|An.d|Auf.d|Im|Zu[mr]|Unter.d|In.d)[^\n\d]{{4,40}}\d"
    rf"|(?<![\p{{L}}\d])(?i:ul\.|ulica|ulicy|al\.|aleja|alei|aleje|pl\.|plac|placu|os\.|osiedle|osiedlu|rondo|skwer|bulwar)[^\n\d]{{0,3}}(?:\d{{1,2}}.)?[^\n\d]{{2,60}}\d"
)


# Words, and ends or beginnings of words, one of which every street has.
_STREET_WORDS = frozenset(
    "street road avenue lane drive court close way terrace crescent boulevard square place grove gardens row walk hill parade alley mews park green st rd ave ln dr ct blvd sq ter cres pl "
    "av bd c p ul al os".split()
)
_STREET_LEADS = frozenset("Am An Auf Im Zum Zur Unter In".split())
_STREET_PARTS = (
    "rue avenue place boulevard impasse quai chemin allée cours square route passage villa sentier ruelle faubourg straße strasse str weg gasse platz allee ufer ring damm steig pfad graben "
    "chaussee stieg promenade calle avenida avda plaza pza paseo camino ronda travesía carrera callejón cuesta glorieta carretera ulica ulicy aleja alei aleje plac osiedl rondo skwer bulwar"
).split()


@lru_cache(maxsize=200_000)
def _of_street(w: str) -> bool:
    """Whether a word may belong to a street: lines without one are not searched for streets."""
    parts, small = re.split(r"[-'’]", w), w.lower()
    return not _STREET_LEADS.isdisjoint(parts) or any(p.lower() in _STREET_WORDS or p[-2:].lower() in ("av", "bd") for p in parts) or any(p in small for p in _STREET_PARTS)


_DIGIT = re.compile(r"\d")


@lru_cache(maxsize=200_000)
def _particle(w: str) -> bool:
    return w.lower() in PARTICLES


def _scan(text: str, lines: list[tuple[int, int]], trigger: re.Pattern, form: re.Pattern) -> Iterator[re.Match]:
    """Matches of ``form`` on the lines that hold its trigger; no form reaches over a line's end."""
    for a, b in lines:
        if trigger.search(text, a, b):
            yield from form.finditer(text, a, b)


def _case(w: str) -> str:
    if w.islower():
        return "l"
    return "u" if w.isupper() and len(w) > 2 else "t"


def _listed(w: str, given: frozenset[str]) -> bool:
    return any(fold(p) in given for p in w.split("-"))


def _strip_possessive(w: str) -> str:
    for e in ("'s", "’s", "'S", "’S", "'", "’"):
        if w.endswith(e):
            return w[: -len(e)]
    return w


def _shape(s: str) -> str:
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", re.sub(rf"{B}", " ", s)))


def mentions(text: str, model: Model) -> list[Mention]:
    """All mentions the forms propose, in order of their start."""
    out: list[Mention] = []
    words = [(*m.span(), m[0]) for m in WORD.finditer(text)]
    starts = [w[0] for w in words]
    lines = [m.span() for m in LINE.finditer(text)]
    numbered = [x for x in lines if _DIGIT.search(text, *x)]  # streets and numbers have digits
    streets = [a for a, _, w in words if _of_street(w)]

    def around(a: int, b: int) -> tuple[list[str], list[str], str, str]:
        """Words before and after on the line, and what directly adjoins."""
        i, j = bisect_left(starts, a), bisect_left(starts, b)
        left, right = text.rfind("\n", 0, a) + 1, text.find("\n", b)
        right = len(text) if right < 0 else right
        before = [w[2].lower() for w in words[max(0, i - 6) : i] if w[0] >= left]
        after = [w[2].lower() for w in words[j : j + 5] if w[1] <= right]
        return before, after, text[max(left, a - 40) : a], text[b : min(right, b + 40)]

    def context(a: int, b: int) -> tuple[list[str], bool]:
        before, after, lt, rt = around(a, b)
        f = ["bias"]
        if before:
            f += [f"p1={before[-1]}", f"p2={' '.join(before[-2:])}"]
        if after:
            f += [f"n1={after[0]}", f"n2={' '.join(after[:2])}"]
        alone = not lt.strip() and not rt.strip()
        if alone:
            f.append("alone")
        return f, alone

    for m in _scan(text, lines if _AT_SIGN.search(text) else [], _AT_SIGN, EMAIL_FORM):
        local = fold(re.split(_AT + rf"|{B}at{B}", m.group(), maxsplit=1)[0])
        plain = "@" in m.group() and not any(c.isspace() for c in m.group())
        out.append(Mention(m.start(), m.end(), (NONE, EMAIL), [*context(m.start(), m.end())[0], "form=" + ("plain" if plain else "spelled")], ["x:" + fold(m.group())], EMAIL if plain else None, local))
    emails = list(out)
    spelled: dict[int, dict[str, list[int]]] = {}  # by length: pieces of local parts, and the addresses that have them

    def address_of(name: str, at: int) -> Mention | None:
        """The nearest address whose local part is spelled from a name, the one before it first."""
        if len(name) < 4 or not emails:
            return None
        n = len(name)
        if n not in spelled:
            spelled[n] = {}
            for k, e in enumerate(emails):
                for piece in {e.family[i : i + n] for i in range(len(e.family) - n + 1)}:
                    spelled[n].setdefault(piece, []).append(k)
        those = spelled[n].get(name)
        if not those:
            return None
        k = bisect_right(those, bisect_right(email_starts, at) - 1)
        return emails[those[k - 1] if k else those[0]]

    email_starts = [e.start for e in emails]
    for m in _scan(text, [x for x in numbered if bisect_left(streets, x[0]) < bisect_left(streets, x[1])], _STREET, ADDRESS_FORM):
        s = m.group()
        form = m.lastgroup
        f, _ = context(m.start(), m.end())
        plain = form == "a_en" and s.split()[-1].lower().rstrip(".") in {"way", "place", "green", "park", "court", "close", "row", "hill", "walk", "drive", "square"} and not any(w[:1].isupper() for w in s.split()[1:-1])
        f += [f"form={form}" + ("_plain" if plain else "")]
        if re.match(rf"{B}*(?:$|[\n,;.|–<)\"])", text[m.end() : m.end() + 4]):
            f.append("closed")
        out.append(Mention(m.start(), m.end(), (NONE, ADDRESS), f, ["x:" + fold(s)], None if plain or form == "a_bare" else ADDRESS))
    for m in _scan(text, numbered, _LONG_NUMBER, NUMBER_FORM):
        form = next(k for k, v in m.groupdict().items() if v is not None and k != "ssnsep")
        s = m.group()
        digits = sum(c.isdigit() for c in s)
        if digits > 16 or digits < (7 if form in _PHONES else 5):
            continue
        a, b = m.start(), m.end()
        if s.startswith("(") and s.count("(") > s.count(")"):
            a += 1
        if s.endswith(")") and s.count(")") > s.count("("):
            b -= 1
        f, alone = context(a, b)
        before, after, _, _ = around(a, b)
        cues = {"phone": 0, "id": 0, "other": 0}
        behind = after[:4] if after[:1] == ["("] else []
        for name, lexicon, ws in (("phone", PHONE_CUES, before[-5:] + behind), ("id", ID_CUES, before[-5:] + behind), ("other", OTHER_CUES, before[-3:])):
            cues[name] = sum(w in lexicon for w in ws)
        near = [k for k in ("phone", "id", "other") if cues[k]]
        f += [f"form={form}", f"shape={_shape(s)}"] + [f"cue_{k}" for k in near]
        seed = None
        if near == ["phone"] and form in _PHONES and form != "bare":
            seed = PHONE
        elif near == ["id"]:
            seed = IDNUM
        elif near == ["other"]:
            seed = NONE
        kinds = (NONE, PHONE, IDNUM) if form in _PHONES or form in ("ssn", "nir", "eleven", "taxde") else (NONE, IDNUM)
        out.append(Mention(a, b, kinds, f, ["d:" + fold(s)], seed))
    busy = bytearray(len(text) + 1)
    for m in out:
        busy[m.start : m.end] = b"\x01" * (m.end - m.start)

    # names: given names and initials before, or after a comma behind, a family name
    n = len(words)
    known, role = model.roles.get, model.role
    kind = ["" if busy[a] else r if (r := known(w)) is not None else role(w) for a, _, w in words]
    for k, r in enumerate(kind):
        if r == "i" and text[words[k][1] : words[k][1] + 1] != ".":
            kind[k] = ""

    def blank(i: int, j: int) -> bool:
        gap = text[words[i][1] : words[j][0]]
        return gap.isspace() and "\n" not in gap

    def after_initials(i: int) -> int:
        """Past the initials (each a letter and a full stop) from word i."""
        while i + 1 < n and kind[i] == "i" and words[i + 1][2] == ".":
            i += 2
        return i

    def family_at(i: int) -> tuple[int, int] | None:
        """Word indices of a family name that begins at i, its particles included."""
        j = i
        while j + 1 < n and j - i < 3 and _particle(words[j][2]) and blank(j, j + 1):
            j += 1
        if j < n and kind[j] in ("f", "l"):
            return i, j
        return None

    def add(first: int, last: int, fam: int, given: list[int], swapped: bool, initial: bool) -> None:
        a, b = words[first][0], words[last][1]
        w = words[last][2]
        b -= len(w) - len(_strip_possessive(w))
        if words[last][2] == ".":
            b = words[last][1]
        family = _strip_possessive(words[fam][2])
        listed = any(kind[g] == "g" for g in given)
        case = _case(family)
        if case == "l" and not (listed and all(words[g][2].islower() for g in given)):
            return
        if not listed and not initial and any(_case(words[g][2]) != case for g in given):
            return
        if not listed and not initial and fold(words[given[0]][2]) in model.common and not model.search:
            return
        f, alone = context(a, b)
        before, after, _, _ = around(a, b)
        fd = fold(family)
        f += [f"suf3={fd[-3:]}", f"suf4={fd[-4:]}", f"pre4={fd[:4]}", f"order={swapped}"]
        if listed:
            f.append("listed")
        if initial:
            f.append("initial")
        if before and (before[-1] in TITLES or (before[-1] == "." and len(before) > 1 and before[-2] in TITLES)):
            f.append("title")
        if swapped:
            f.append("swapped")
        if case != "t":
            f.append("upper" if case == "u" else "lower")
        if before and before[-1] == "of":
            f.append("prev_of")
        nxt = text[b : b + 40].split("\n")[0].lstrip()
        if nxt[:1].islower() and after and fold(after[0]) in model.common:
            f.append("next_common_lower")
        head = fold(text[words[first][0] : words[fam][0]]) if swapped else ""
        mail = address_of(head + fd, a) if len(fd) >= 4 else None
        # a preposition before a family name that comes first may be the sentence's own
        if swapped and first < fam:
            led = first == fam - 1 and bool(before) and (before[-1], words[first][2].lower()) in model.leadins
            f.append("particle_after_word" if led else "particle_first")
        elif swapped and before and before[-1] in PARTICLES and blank(first - 1, first) and (before[-2] if len(before) > 1 else "", before[-1]) not in model.leadins:
            f.append("particle_left")
        if not given and not swapped and first and kind[first - 1] in ("g", "f") and blank(first - 1, first):
            f.append("cut_short")
        if not listed and given:
            f.append("given_common" if kind[given[0]] == "c" else "g4=" + fold(words[given[0]][2])[-3:])
        seed = None
        if case == "t" and listed and all(not words[g][2].islower() for g in given):
            seed = NAME
        elif not listed and not mail and not initial and fd in model.places:
            seed = NONE
        parts = [p for p in re.split(r"[-]", family) if len(p) > 2]
        first_names = tuple(fold(p) for g in given for p in _strip_possessive(words[g][2]).split("-"))
        folded = [fold(p) for p in parts]
        keys = [f"n:{p}" for p in folded] + [f"s:{p[:6]}" for p in folded if len(p) > 6]
        out.append(Mention(a, b, (NONE, NAME), f, keys, seed, fd, first_names, mail))

    for i in range(n):
        if kind[i] == "" and not _particle(words[i][2]):
            continue
        if kind[i] in ("g", "f", "i", "l", "c"):
            # given [given] [initials] family
            j, given, initial = i, [], False
            if kind[i] == "i":
                if i and words[i - 1][1] == words[i][0] and words[i - 1][2] in "-’'":
                    continue
                j, initial = after_initials(i), True
                if j == i:
                    continue
            elif kind[i] in ("g", "f", "c"):
                given.append(i)
                j = i + 1
                if j < n and kind[j] == "g" and blank(j - 1, j):
                    given.append(j)
                    j += 1
                if j < n and kind[j] == "i" and blank(j - 1, j):
                    k = after_initials(j)
                    if k > j:
                        j, initial = k, True
            if given or initial:
                if j < n and j > i and (blank(j - 1, j) or (initial and text[words[j - 1][1] : words[j][0]] == "")):
                    fam = family_at(j)
                    if fam and (fam[1] == j or all(blank(x, x + 1) for x in range(j, fam[1]))):
                        add(i, fam[1], fam[1], given, False, initial)
        # family, given [initials]; family given without comma where the given name is listed
        fam = family_at(i) if kind[i] in ("f", "l") or _particle(words[i][2]) else None
        if not fam:
            continue
        j = fam[1] + 1
        comma = j < n and words[j][2] == "," and words[j][0] == words[fam[1]][1]
        k = j + 1 if comma else j
        if k >= n or (comma and "\n" in text[words[j][1] : words[k][0]]) or not (comma or blank(fam[1], k)):
            continue
        if kind[k] in ("g", "f", "c") and (comma or kind[k] == "g"):
            last, given = k, [k]
            if last + 1 < n and kind[last + 1] == "g" and blank(last, last + 1):
                given.append(last + 1)
                last += 1
            if last + 1 < n and kind[last + 1] == "i" and blank(last, last + 1):
                m2 = after_initials(last + 1)
                if m2 > last + 1:
                    add(i, m2 - 1, fam[1], given, True, True)
            ahead = family_at(last + 1) if not comma and last + 1 < n and blank(last, last + 1) else None
            if not ahead:  # else the given name belongs to the family name behind it
                add(i, last, fam[1], given, True, False)
        elif kind[k] == "i" and comma:
            m2 = after_initials(k)
            if m2 > k:
                add(i, m2 - 1, fam[1], [], True, True)
    out.sort(key=lambda m: (m.start, -m.end))
    # beside another mention on the line: rows of contact data
    for a, b in zip(out, out[1:]):
        gap = text[a.end : b.start]
        if 0 < len(gap) <= 6 and "\n" not in gap and not any(c.isalnum() for c in gap) and (a.kinds != b.kinds):
            for x, y in ((a, b), (b, a)):
                if "row" not in x.feats:
                    x.feats.append("row")
    return out


def _links(ms: list[Mention], strength: np.ndarray | None = None) -> list[tuple[int, int, str]]:
    """Chain, skip and exclusion links; linear in the mentions. Of overlapping mentions each is linked to a stronger one
    only, so that exclusion makes no loops of its own."""
    links: list[tuple[int, int, str]] = []
    last: dict[str, int] = {}
    place = {id(m): i for i, m in enumerate(ms) if EMAIL in m.kinds}
    open_: list[int] = []
    stronger: dict[int, list[int]] = defaultdict(list)
    for i, m in enumerate(ms):
        open_ = [j for j in open_ if ms[j].end > m.start]  # a form spans some words at most, so these are few
        if strength is not None:
            for j in open_:
                stronger[i].append(j)
                stronger[j].append(i)
        open_.append(i)
        if i and ms[i - 1].end <= m.start and "row" in m.feats and "row" in ms[i - 1].feats:
            links.append((i - 1, i, "line"))
        if m.mail is not None and id(m.mail) in place:
            links.append((place[id(m.mail)], i, "mail"))
        met: set[int] = set()
        for k in m.keys:
            j = last.get(k)
            if j is not None and ms[j].end <= m.start and j not in met:
                met.add(j)  # whole keys stand before their beginnings: what is the same is not similar besides
                links.append((j, i, "similar" if k[0] == "s" else "same"))
            if j is None or ms[j].end <= m.start:
                last[k] = i
    for i, others in stronger.items():
        best = max(others, key=lambda j: (strength[j], -j))
        if (strength[best], -best) > (strength[i], -i):
            links.append((best, i, "not"))
    return links


def _unary(m: Mention, model: Model) -> np.ndarray:
    u = np.full(len(KINDS), -1e9)
    u[NONE] = 0.0
    for k in m.kinds:
        if k != NONE:
            w = model.weights[k]
            u[k] = sum(w.get(f, 0.0) for f in m.feats)
    return u


def _lse(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=-1)
    return top + np.log(np.exp(a - top[..., None]).sum(axis=-1))


def beliefs(ms: list[Mention], model: Model, rounds: int = 200) -> tuple[np.ndarray, list[tuple[int, int, str]]]:
    """Potential of every label of every mention after messages have passed over the links until they no longer change,
    and the links. Without loops that takes as many rounds as the longest path has links; messages that still swing after
    ``rounds`` / 4 are damped, and end with ``rounds``."""
    u = np.array([_unary(m, model) for m in ms])
    links = _links(ms, u[:, 1:].max(axis=1))
    if links:
        size = len(KINDS)
        tables = {}
        for name, (on, off) in model.links.items():
            tables[name] = np.zeros((size, size))
            tables[name][1:, 1:] = np.eye(size - 1) * on if name in ONE_LABEL else on
            tables[name][0, 0] = off
        tables["not"] = np.zeros((size, size))
        tables["not"][1:, 1:] = -50.0
        src = np.array([x for a, b, _ in links for x in (a, b)])
        dst = np.array([x for a, b, _ in links for x in (b, a)])
        pot = np.array([tables[k] for _, _, k in links for _ in range(2)])
        back = np.arange(len(src)) ^ 1
        msg = np.zeros((len(src), size))
        for r in range(rounds):
            total = u.copy()
            np.add.at(total, dst, msg)
            cavity = total[src] - msg[back]
            new = _lse(cavity[:, None, :] + pot)
            new -= new.max(axis=1, keepdims=True)
            if 4 * r > rounds:
                new = 0.5 * msg + 0.5 * new
            still = np.abs(new - msg).max() < STILL
            msg = new
            if still:
                break
        np.add.at(u, dst, msg)
    return u, links


def infer(ms: list[Mention], model: Model) -> list[int]:
    """Most likely label of every mention, by loopy belief propagation."""
    if not ms:
        return []
    u, _ = beliefs(ms, model)
    label = u.argmax(axis=1)
    # what still overlaps: the stronger stands, then the longer
    keep, order = [0] * len(ms), sorted(range(len(ms)), key=lambda i: (-(u[i, label[i]] - u[i, NONE]), ms[i].start - ms[i].end))
    starts: list[int] = []
    ends: list[int] = []
    for i in order:
        if label[i] != NONE:
            a, b = ms[i].start, ms[i].end
            k = bisect_left(starts, a)
            if (k == 0 or ends[k - 1] <= a) and (k == len(starts) or starts[k] >= b):
                starts.insert(k, a)
                ends.insert(k, b)
                keep[i] = int(label[i])
    return keep


@lru_cache(maxsize=200_000)
def _capital(w: str) -> str:
    """The folded base of a capital word that may be in a name, else nothing."""
    base = _strip_possessive(w)
    return fold(base) if w[0].isupper() and len(base) > 2 and base.lower() not in TITLES and base.lower() not in FUNCTION_WORDS else ""


def tally(text: str) -> Counter:
    """What a text adds to the counts of its corpus, ``(what, word, other) -> count``. Of texts: ``n`` all, ``seen`` and
    ``small`` those that use a word (written small), ``beside`` those in which a capital word stands beside another, as a
    family name beside a given name; the other is empty for an initial, a title or an address spelled from the word.
    Of occurrences: ``total`` of a capital word, ``lead`` before a small one and behind no name, ``of`` as in "museum of W",
    ``pair`` of a word and a preposition behind it."""
    once: set[tuple[str, str, str]] = {("n", "", "")}
    out: Counter = Counter()
    spelled = [fold(re.split(r"[@＠]", m)[0]) for m in MAIL_LIKE.findall(text)]
    lines = [WORD.findall(x) for x in MAIL_LIKE.sub(" ", text).split("\n")]
    ws = [w for x in lines for w in x]
    for w in set(ws):
        if w[0].isalpha():
            once.add(("seen", fold(w), ""))
            if w.islower():
                once.add(("small", fold(w), ""))
    for i, w in enumerate(ws):
        if i and w in PARTICLES and ws[i - 1][0].isalpha() and ws[i - 1].lower() not in PARTICLES:
            out["pair", ws[i - 1].lower(), w] += 1
        k = _capital(w)
        if k:
            before = ws[i - 1] if i else "."
            after = ws[i + 1] if i + 1 < len(ws) else "."
            out["total", k, ""] += 1
            out["of", k, ""] += before == "of" and not after[0].isupper() and after != ","
            out["lead", k, ""] += not (before == "," or before[0].isupper()) and (after.islower() or after == ":")
    for x in lines:
        for i, w in enumerate(x):
            k, j = _capital(w), i - 1
            if not k:
                continue
            while j >= 0 and i - j < 4 and x[j].lower() in PARTICLES:
                j -= 1
            near = [x[j]] if j >= 0 else []
            if i + 1 < len(x):
                near.append(x[i + 2] if x[i + 1] == "," and i + 2 < len(x) else x[i + 1])
            once.update(("beside", k, fold(p)) for o in near if o[0].isupper() and len(o) > 1 for p in _strip_possessive(o).split("-") if fold(p))
            led = x[j - 1] if j > 0 and x[j] == "." else x[j] if j >= 0 and x[j].lower() in TITLES else ""
            if led and (led.lower() in TITLES or len(led) == 1 and led.isupper()) or any(len(k) >= 4 and k in e for e in spelled):
                once.add(("beside", k, ""))
    out.update(once)
    return +out


def _bounds(n: int) -> tuple[int, int, int]:
    """Of ``n`` texts, those that must use a word, use it written small, or use it with a preposition behind it."""
    return max(6, n // 150), max(3, n // 400), max(3, n // 600)


def _lexicon(model: Model, counts: Counter) -> None:
    """The words that are no names, places and lead-ins. Words that many texts use are no names, and written small, fewer
    suffice; but how often a word is used does not exclude one that stands as a family name in a share of its texts."""
    by: dict[str, Counter] = defaultdict(Counter)
    for (what, w, other), c in counts.items():
        if what == "beside":
            by["name"][w] += c if not other or other in model.given else 0
        elif what != "pair":
            by[what][w] += c
    seen, small, name, total = by["seen"], by["small"], by["name"], by["total"]
    n = by["n"][""]
    many, some, pairs = _bounds(n)
    common = {w for w, c in seen.items() if (c >= many or small[w] >= some) and w not in model.given and name[w] < NAMED * c}
    # capital words that stand before small ones, behind no name, introduce names and are none
    rest = {w: c for w, c in total.items() if w not in common and w not in model.given}
    common |= {w for w, c in rest.items() if c >= 4 and by["lead"][w] >= 0.8 * c}
    often = {w for w, c in rest.items() if by["of"][w] >= max(2, OF * c)}
    model.common = frozenset(common | often)
    model.places = frozenset(w for w in rest if by["of"][w] and w not in often)
    model.leadins = frozenset((w, p) for (what, w, p), c in counts.items() if what == "pair" and c >= pairs)


def train(
    texts: list[str], given: list[str], epochs: int = 4, rate: float = 0.15, pull: float = 1e-3,
    gather: Callable[[frozenset[str]], Counter] | None = None, seek: Callable[[Model], list[tuple[str, str, bool]]] | None = None,
) -> Model:
    """A model fitted twice: the given names that the first model finds beside two different family names, once without a
    preposition between at least, join the listed ones for the second, since the list is incomplete. Copies of a text count once. ``gather`` and ``seek`` count and search
    in the whole corpus of which ``texts`` are a sample; without them ``texts`` are the corpus."""
    texts = list(dict.fromkeys(texts))
    if gather is None:
        counts = Counter()
        for t in texts:
            counts.update(tally(t))
        gather = lambda _: counts
    first = _train(texts, given, gather(_names(given)), epochs, rate, pull, search=True)
    families: dict[str, set[str]] = defaultdict(set)
    plain: set[str] = set()
    for g, f, p in seek(first) if seek else (x for t in texts for x in unlisted(t, first)):
        families[g].add(f)
        plain |= {g} if p else set()
    given = [*given, *(g for g, f in families.items() if len(f) >= 2 and g in plain)]
    return _train(texts, given, gather(_names(given)), epochs, rate, pull)


def _names(given: list[str]) -> frozenset[str]:
    return frozenset(fold(g) for g in given if g and fold(g))


def unlisted(text: str, model: Model) -> set[tuple[str, str, bool]]:
    """``(given name, family name, plain)`` of the names in a text none of whose given names is listed. ``plain``: without
    a preposition, which may be the sentence's own."""
    ms = mentions(text, model)
    fits = [bool(m.given) and all(g not in model.given for g in m.given) for m in ms]
    if not any(fits):
        return set()
    plain = lambda m: PARTICLES.isdisjoint(text[m.start : m.end].lower().split())
    return {(g, m.family, plain(m)) for m, k, ok in zip(ms, infer(ms, model), fits) if ok and k == NAME for g in m.given}


def _train(texts: list[str], given: list[str], counts: Counter, epochs: int, rate: float, pull: float, search: bool = False) -> Model:
    """A model fitted on the seeds in ``texts`` and on what it then finds in them. ``given``: given names, the listed ones and those found. ``counts``: of the corpus, from ``tally``."""
    model = Model(_names(given))
    for k, w in PRIOR.items():
        model.weights[k] = dict(w)
    _lexicon(model, counts)
    model.search = search
    model.roles.clear()
    found = [mentions(t, model) for t in texts]
    if search:  # beside a common word, a word that resembles no family name of a clear case is none
        known = {m.family[:4] for ms in found for m in ms if m.seed == NAME}
        for ms in found:
            for m in ms:
                if "given_common" in m.feats and m.family[:4] not in known:
                    m.seed = NONE
    _fit(model, [_labelled(ms, [m.seed for m in ms]) for ms in found if ms], epochs, rate, pull)
    # what the field finds is a label too, of the weight its odds have: words beside linked mentions tell of others without a link
    likely = []
    for ms in found:
        if any(m.seed is None for m in ms):
            u, _ = beliefs(ms, model)
            best, ranked = u.argmax(axis=1), np.sort(u, axis=1)
            margin = ranked[:, -1] - ranked[:, -2]
            known = [m.seed if m.seed is not None else int(k) if x >= LIKELY else None for m, k, x in zip(ms, best, margin)]
            likely.append(_labelled(ms, known, [1.0 if m.seed is not None else float(np.tanh(x / 2)) for m, x in zip(ms, margin)]))
        elif ms:
            likely.append(_labelled(ms, [m.seed for m in ms]))
    _fit(model, likely, max(1, epochs // 2), rate, pull)
    model.weights = {k: {f: v for f, v in w.items() if abs(v) > 0.01} for k, w in model.weights.items()}
    return model


Example = tuple[Mention, int, float, list[tuple[str, int]]]
#: Features that made the label of a mention.
CUES = frozenset({"listed", "cue_phone", "cue_id", "cue_other", "prev_of"})


def _labelled(ms: list[Mention], labels: list[int | None], weights: list[float] | None = None) -> list[Example]:
    """Mentions with a label, its weight, and the labels of those they are linked to."""
    near: dict[int, list[tuple[str, int]]] = defaultdict(list)
    for a, b, kind in _links(ms):
        for x, y in ((a, b), (b, a)):
            if labels[y] is not None:
                near[x].append((kind, labels[y]))
    return [(m, y, weights[i] if weights else 1.0, near[i]) for i, (m, y) in enumerate(zip(ms, labels)) if y is not None]


def _agree(kind: str, label: int, other: int) -> int | None:
    """Which potential of a link two labels bring to bear: 0 if both are something (the same thing, for some links), 1 if both are none."""
    if label == NONE or other == NONE:
        return 1 if label == other else None
    return 0 if label == other or kind not in ONE_LABEL else None


def _fit(model: Model, documents: list[list[Example]], epochs: int, rate: float, pull: float) -> None:
    """Weights of features and links by stochastic gradient on the pseudo-likelihood, from where they are, drawn to the prior.
    The cue that made a label is hidden in half the cases, so that the other features, and the links, learn to do without."""
    rng = np.random.default_rng(7)
    examples = [x for d in documents for x in d]
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for at in rng.permutation(len(examples)):
            m, y, weight, near = examples[at]
            feats = [f for f in m.feats if f not in CUES] if rng.random() < 0.5 else m.feats
            met = [[(kind, which) for kind, other in near if (which := _agree(kind, k, other)) is not None] for k in m.kinds]
            u = np.array([sum(model.links[kind][which] for kind, which in x) + (sum(model.weights[k].get(f, 0.0) for f in feats) if k != NONE else 0.0) for k, x in zip(m.kinds, met)])
            p = np.exp(u - u.max())
            p /= p.sum()
            for k, pk, x in zip(m.kinds, p, met):
                g = weight * step * ((k == y) - pk)
                if k != NONE:
                    w = model.weights[k]
                    for f in feats:
                        if f not in PRIOR[k] or f.startswith("form="):
                            old = w.get(f, 0.0)
                            w[f] = old + g - pull * rate * (old - PRIOR[k].get(f, 0.0))
                for kind, which in x:
                    old = model.links[kind][which]
                    model.links[kind][which] = float(min(LINK_MOST, max(0.0, old + g - pull * rate * (old - LINKS[kind][which]))))


def entities(text: str, model: Model) -> list[tuple[int, int, int]]:
    """``(start, end, label)`` of the personal information in a text."""
    ms = mentions(text, model)
    return [(m.start, m.end, k) for m, k in zip(ms, infer(ms, model)) if k != NONE]


def tallied(texts: DataFrame) -> DataFrame:
    """``(what, word, other, n)``: ``tally`` summed over the texts (column ``t``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for b in batches:
            for t in b["t"]:
                held.update(tally(t))
                if len(held) > HELD:
                    yield _rows(held)
                    held = Counter()
        yield _rows(held)

    return texts.mapInPandas(run, "what string, word string, other string, n bigint").groupBy("what", "word", "other").agg(F.sum("n").alias("n"))


def _rows(counts: Counter) -> pd.DataFrame:
    return pd.DataFrame([(*k, c) for k, c in counts.items()], columns=["what", "word", "other", "n"])


def _gather(counts: DataFrame, given: frozenset[str]) -> Counter:
    """Those of the corpus' counts that ``_lexicon`` decides by."""
    n = counts.where("what = 'n'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    of = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0))
    by = counts.where("what in ('seen', 'small', 'total', 'lead', 'of', 'beside')").groupBy("word").agg(
        *[of(w).alias(w) for w in ("seen", "small", "total", "lead", "of")],
        F.coalesce(F.sum(F.when((F.col("what") == "beside") & ((F.col("other") == "") | F.col("other").isin(*given)), F.col("n"))), F.lit(0)).alias("beside"),
    )
    many, some, pairs = _bounds(n)
    by = by.where((F.col("seen") >= many) | (F.col("small") >= some) | (F.col("of") > 0) | ((F.col("total") >= 4) & (F.col("lead") >= 0.8 * F.col("total"))))
    out = Counter({("n", "", ""): n})
    for r in by.collect():
        out.update({(what, r["word"], ""): r[what] for what in ("seen", "small", "total", "lead", "of", "beside") if r[what]})
    for r in counts.where((F.col("what") == "pair") & (F.col("n") >= pairs)).collect():
        out["pair", r["word"], r["other"]] = r["n"]
    return out


def fit(documents: DataFrame, given_names: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Model:
    """The model of a corpus. Words are counted and given names searched for in all texts; the weights are fitted on at most
    ``sample`` distinct texts of at most ``SAMPLE_CHARS`` characters, those whose hashes lie below a bound. ``given_names`` is a list
    people keep by hand, fixed in size."""
    texts = documents.select(F.col(text_col).alias("t")).where(F.length("t") > 0)
    counts = checkpointed(tallied(texts.distinct()))
    n = counts.where("what = 'n'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # a share of the hashes that gives the sample, seldom more: so much reaches the driver, from however many tasks
    share = min(1.0, (sample - 3 * sample**0.5) / max(1, n)) if n > sample else 1.0
    picked = texts.where((F.length("t") <= SAMPLE_CHARS) & (F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < F.lit(round(share * (1 << 30))))).distinct()
    picked = sorted(r[0] for r in picked.collect())[:sample]

    def seek(model: Model) -> list[tuple[str, str, bool]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame(sorted({x for t in b["t"] for x in unlisted(t, model)}), columns=["g", "f", "p"])

        # two families a name are enough to know
        found = texts.mapInPandas(run, "g string, f string, p boolean").groupBy("g").agg(F.min("f").alias("a"), F.max("f").alias("b"), F.bool_or("p").alias("p"))
        return [(r["g"], f, r["p"]) for r in found.where("a <> b").collect() for f in (r["a"], r["b"])]

    names = [r[0] for r in given_names.select("given_name").where("given_name is not null").distinct().collect()]
    return train(picked, names, gather=lambda given: _gather(counts, given), seek=seek)


def find_personal(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id>, kind, start, stop, mention)``, one row per mention: positions are code points from 0. Null or empty texts
    have none. Documents with one id are each read; other columns are left out, whatever their names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, KINDS[k], s, e, t[s:e]) for i, t in zip(b["_i"], b["_t"]) for s, e, k in entities(t, model)]
            yield pd.DataFrame(rows, columns=["i", "kind", "start", "stop", "mention"])

    src = documents.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")).where(F.length("_t") > 0)
    kind = src.schema["_i"].dataType.simpleString()
    return src.mapInPandas(run, f"i {kind}, kind string, start int, stop int, mention string").withColumnRenamed("i", id_col)


def mask_personal(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``documents`` with every mention in ``text_col`` replaced by its placeholder (``[EMAIL]``, ``[NAME]``, ...); all
    else is unchanged, null stays null."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if not t:
                return t
            parts, at = [], 0
            for s, e, k in sorted(entities(t, model)):
                parts += [t[at:s], PLACEHOLDERS[KINDS[k]]]
                at = e
            return "".join(parts) + t[at:]

        return texts.map(one)

    return documents.withColumn(text_col, masked(F.col(text_col)))


def restored(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id>, restored)`` of texts that are not null: whether the masked text becomes the text again when its placeholders are
    replaced by the mentions found. ``<id>`` must be unique."""
    kinds = "|".join(k.upper() for k in KINDS[1:])
    masked = mask_personal(documents.select(id_col, F.col(text_col).alias("_m"), F.col(text_col).alias("_text")), model, "_m")
    found = find_personal(documents, model, id_col, text_col).groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "mention"))), lambda x: x["mention"]).alias("_f"))
    none = F.array().cast("array<string>")
    rows = masked.where("_text is not null").join(found, id_col, "left").withColumns({"_f": F.coalesce("_f", none), "_p": F.split("_m", rf"\[(?:{kinds})\]", -1)})
    whole = F.array_join(F.flatten(F.transform("_p", lambda p, i: F.array(p, F.coalesce(F.get("_f", i), F.lit(""))))), "")
    return rows.select(id_col, ((whole == F.col("_text")) & (F.size("_p") == F.size("_f") + 1)).alias("restored"))


def personal_items(documents: DataFrame, given_names: DataFrame) -> DataFrame:
    """Distinct ``(doc_id, kind, item)``: the mention in lower case, letters and digits only."""
    found = find_personal(documents, fit(documents, given_names))
    item = F.regexp_replace(F.lower("mention"), r"[^\p{L}\p{N}]", "")
    return found.select("doc_id", "kind", item.alias("item")).where("item <> ''").distinct()
