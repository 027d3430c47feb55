"""Personal information in free text, replaced by typed placeholders.

Regular expressions propose spans; checksums (mod 97 for bank accounts, mod 23 for
Spanish identity numbers, Luhn for cards) confirm or refuse them; words nearby raise or
lower the score; spans at or above `THRESHOLD` stand. Names are proposed by a lexicon of
given names and surnames. It is gathered from the senders and the people named in the
tables, and its surnames also from the texts themselves: a word that stands in capitals
beside a given name, at least twice and hardly ever in lower case.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut_lineage

THRESHOLD = 0.6
#: How often a word of the texts must stand beside a given name to be a surname, and how many times as often as in lower case.
LEAST_BESIDE = 2
OVER_LOWER = 4
#: Name words up to which the lexicon is broadcast (some 3 MB at this size); beyond, the texts' words are joined to it.
MAX_NAMES = 100_000
KINDS = ("email", "identity", "phone", "address", "name")

# A space inside a mention: also a line break, with the marks of a quotation after it.
_S = r"(?:[  ]|[ \t]*\r?\n(?:[ \t]*(?:>|\||[A-Z]{2,3}>))*[ \t]?)"
_SP = rf"{_S}+"

_MAILBOX = re.compile(r"[\w.+'-]*\w$")
_HOST = re.compile(r"[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}")
_AT_MARK = re.compile(r"\s?[\[({<]\s?(?:at|@|ät|arroba|arobase)\s?[\])}>]\s?|\s(?:at|arroba|arobase)\s(?=[\w-]+\s(?:dot|punkt|punto|point)\s)|\s@\s?|@\s", re.I)
_DOT = r"(?:\s?[\[({<]\s?(?:dot|punkt|punto|point|\.)\s?[\])}>]\s?|\s(?:dot|punkt|punto|point)\s|\.)"
_LOCAL = re.compile(rf"(?:[\w+-]+{_DOT})*[\w+-]*\w$", re.I)
_DOMAIN = re.compile(rf"[\w-]+(?:{_DOT}[\w-]+)+", re.I)

#: Candidates that begin with a digit, a plus or a bracket.
_NUMBERS = re.compile(r"[+(\d][\d ()./ >|\r\n-]{7,}")
_N = rf"(?:{_S}|[.-])"
PHONES = (
    (re.compile(rf"\+\d{{1,3}}{_S}?(?:\(0\){_S}?)?\(?\d(?:[-./]?\d|\)?{_S}\d|\)\d){{5,12}}(?!\d)"), 0.8),
    (re.compile(rf"(?<![\d.])\([2-9]\d\d\){_S}?[2-9]\d\d[-.]\d{{4}}(?![\d-])"), 0.8),
    (re.compile(r"(?<![\d./-])(?:1[-. ])?[2-9]\d\d([.-])[2-9]\d\d\1\d{4}(?![\d-]|\.\d)"), 0.7),
    (re.compile(r"(?<![\d./-])1[2-9]\d\d[2-9]\d{6}(?![\d./-]\d|\d)"), 0.6),
    (re.compile(rf"(?<![\d./-])0\d(?:{_N}\d\d){{4}}(?![\d-])"), 0.7),
    (re.compile(rf"(?<![\d./-])0\d{{2,4}}{_S}\d{{3,4}}{_S}\d{{3,4}}(?!\d)"), 0.7),
    (re.compile(r"(?<![\d./-])0\d{1,4}/\d{4,9}(?:-\d{1,4})?(?![\d/])"), 0.7),
    (re.compile(rf"(?<![\d./-])[6789]\d\d{_S}\d\d\d{_S}\d\d\d(?!\d)"), 0.4),
)
_PHONE_NEAR = re.compile(r"\b(?:call|phone|tel|telephone|mobile|mobil|cell|fax|rückruf|anrufen|telefon|rappeler|appel\w*|téléphone|llame|llamar|teléfono|móvil|number|t|or|oder|ou|gave)\b[\s.:(]*(?:\w+\s){0,3}$", re.I)
_NOT_NEAR = re.compile(r"(?:\b(?:order|ticket|invoice|roll|shelf|box|scale|sheet|build|version|reference|catalogue|isbn|checksum|barcode|rule|bestellung|rechnung|commande|facture|pedido|factura)\b[^.!?\n]{0,12}|#)$", re.I)
_ID_NEAR = re.compile(r"\b(?:passport|passeport|pasaporte|reisepass|ausweis\w*|identity|identité|identidad|id card|id|ssn|social security|sozialversicherung\w*|insurance|assurance|versicherung\w*|sécurité sociale|seguridad social|seguro|health|tax|steuer\w*|fiscal|nif|nie|dni|cif|iban|bic|account|konto\w*|compte|cuenta|bank\w*|card)\b", re.I)
IDENTITIES = (
    (re.compile(r"(?<![\d/])\d{2,3}/\d{3}/\d{4,5}(?![\d/])"), 0.55),
    (re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), 0.6),
    (re.compile(rf"(?<![\d-])[12]{_S}\d\d{_S}\d\d{_S}\d[\dAB]{_S}\d{{3}}{_S}\d{{3}}(?:{_S}\d\d)?(?!\d)"), 0.7),
    (re.compile(rf"(?<![\d-])\d{{2}}{_S}\d{{6}}{_S}[A-Z]{_S}\d{{3}}(?!\d)"), 0.6),
)
_SPANISH = re.compile(r"(?<![\w-])(?:\d{8}|[XYZ]\d{7})[- ]?[A-HJ-NP-TV-Z](?![\w-])")
_CARD = re.compile(rf"(?<![\d-])\d{{4}}(?:[ -]?\d{{4}}){{3}}(?![\d-])")
_LETTERED = re.compile(r"[A-Z]\d")
_IBAN = re.compile(rf"(?<![\w-])[A-Z]{{2}}\d\d(?:{_S}?[\dA-Z]{{4}}){{2,7}}(?:{_S}?[\dA-Z]{{1,3}})?(?![\w-])")
_PASSPORT = re.compile(r"(?<![\w-])(?:[A-Z]{1,2}\d{6,8}[A-Z]?|[A-Z]\d\d[A-Z]{2}\d{5}|[A-Z0-9]{9,10})(?![\w-])")
_BRITISH = re.compile(rf"(?<![\w-])[A-CEGHJ-PR-TW-Z]{{2}}{_S}?\d\d{_S}?\d\d{_S}?\d\d{_S}?[A-D](?!\w)")

_CAP = r"[^\W\d_a-zß-ÿ][\w'’-]*"
_NUM = r"\d{1,4}\s?[a-zA-Z]?(?:[-/]\d{1,4}[a-z]?)?"
_POST = r"[A-Z]{1,2}\d{1,2}[A-Z]?\s\d[A-Z]{2}"
_TOWN = rf"(?:{_CAP}(?:(?:[ -]|{_S})(?:{_CAP}|le|la|les|sur|sous|de|del|des|du|en|am|an|der|bei|im|upon|on)(?![\w'’])){{0,4}})"
_EN = rf"(?<![\w/.-]){_NUM}{_S}(?:{_CAP}{_S}){{1,3}}(?:Street|St\.|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Row|Close|Mews|Way|Drive|Court|Terrace|Crescent|Square|Gardens|Place|Hill|Walk|Green|Boulevard|Blvd\.?|Parade|Wharf|Quay|Yard|Gate)\b(?:,{_S}{_TOWN}(?:,?{_S}{_POST})?)?"
_DE_KIND = r"(?:straße|strasse|str\.|weg|gasse|allee|kamp|platz|ring|damm|ufer|steig|stieg|markt|graben|wall|chaussee|pfad|promenade|zeile|twiete|kai)"
_DE = rf"(?<![\w])(?:{_CAP}{_DE_KIND}|(?:{_CAP}[- ]){{1,2}}(?:Straße|Strasse|Str\.|Weg|Gasse|Allee|Platz|Ring|Damm|Ufer)|(?:Am|An{_S}der|An{_S}den|Im|In{_S}der|Auf{_S}dem|Auf{_S}der|Zum|Zur|Unter{_S}den|Hinter{_S}dem|Vor{_S}dem){_S}{_CAP}(?:{_S}{_CAP})?){_S}{_NUM}(?![\w-])(?:,{_S}\d{{5}}{_S}{_TOWN})?"
_FR = rf"(?<![\w/.-]){_NUM}(?:{_S}(?:bis|ter))?,?{_S}(?:rue|avenue|av\.|boulevard|bd|impasse|quai|place|chemin|allée|cours|passage|route|square|sentier|ruelle|faubourg|venelle|montée){_S}(?:(?:de{_S}la|de{_S}l['’]|du|des|de|d['’]|la|le|les){_S}?)*{_CAP}(?:(?:-|{_S})(?:{_CAP}|de|des|du|la|le)){{0,3}}(?:,{_S}\d{{5}}{_S}{_TOWN})?"
_ES = rf"(?<!\w)(?:Calle|C/|Plaza|Avenida|Avda\.|Paseo|Camino|Carretera|Ronda|Travesía|Callejón|Rambla|Glorieta|Cuesta){_S}(?:(?:de{_S}la|de{_S}los|de{_S}las|del|de|la|el|los){_S})*{_CAP}(?:{_S}(?:{_CAP}|de|del|la|los|y)){{0,3}}?,?{_S}(?:n\.?º{_S}?)?{_NUM}(?![\w-])(?:,{_S}\d{{5}}{_S}{_TOWN})?"
_BOX = rf"(?<!\w)(?:P\.?{_S}?O\.?{_S}?Box|Post{_S}Office{_S}Box|Postfach|B\.?P\.?|Boîte{_S}postale|Apartado(?:{_S}de{_S}correos)?){_S}\d[\d ]{{0,6}}\d?(?!\w)(?:,{_S}(?:\d{{5}}{_S})?{_TOWN}(?:,?{_S}{_POST})?)?"
ADDRESSES = {kind: re.compile(text) for kind, text in (("en", _EN), ("de", _DE), ("fr", _FR), ("es", _ES), ("box", _BOX))}
#: Strings of which an address of that kind has at least one.
_ADDRESS_GATES = {
    "en": ("Street", "St.", "Road", "Rd", "Lane", "Ln", "Ave", "Row", "Close", "Mews", "Way", "Drive", "Court", "Terrace", "Crescent", "Square", "Gardens", "Place", "Hill", "Walk", "Green", "Boulevard", "Blvd", "Parade", "Wharf", "Quay", "Yard", "Gate"),
    "de": ("straße", "strasse", "str.", "weg", "gasse", "allee", "kamp", "platz", "ring", "damm", "ufer", "steig", "stieg", "markt", "graben", "wall", "chaussee", "pfad", "promenade", "zeile", "twiete", "kai", "Straße", "Weg", "Platz", "Am ", "An ", "Im ", "In ", "Auf ", "Zum ", "Zur ", "Unter ", "Hinter ", "Vor "),
    "fr": ("rue", "avenue", "av.", "boulevard", "bd", "impasse", "quai", "place", "chemin", "allée", "cours", "passage", "route", "square", "sentier", "ruelle", "faubourg", "venelle", "montée"),
    "es": ("Calle", "C/", "Plaza", "Avenida", "Avda", "Paseo", "Camino", "Carretera", "Ronda", "Travesía", "Callej", "Rambla", "Glorieta", "Cuesta"),
    "box": ("Box", "BOX", "Postfach", "BP", "B.P", "postale", "Apartado"),
}
#: Capitalised words after "Am", "Im" and the like that name no street.
_NO_STREET = re.compile(r"^(?:Am|Im|In|An|Auf|Zum|Zur|Vor|Unter|Hinter)\s(?:der\s|den\s|dem\s)?(?:Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonntag|Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahr|Frühjahr|Sommer|Herbst|Winter|Raum|Zimmer|Regal|Fach|Seite|Band|Nr|Quartal\w*|Kapitel|Abschnitt|Tag|Ende|Anfang)\b")

#: Words before an address that speak of a place, and words around what is none.
_LIVES = re.compile(r"\b(?:address|adresse|anschrift|dirección|domicile|domicilio|lives?|living|wohnt|wohnhaft|habite|vive|at|to|in|an|au|à|en|bei|chez|deliver\w*|send|sent|ship\w*|visit|office|büro|bureau|oficina|entrance|eingang)\b[\s:,]*(?:\w+\s)?$", re.I)
_NO_PLACE = re.compile(r"\b(?:chapter|kapitel|chapitre|capítulo|page|seite|version|volume|band|tome|figure|table|tabelle|line|zeile|ligne|item|ticket|order)\b[\s:.]*$", re.I)
_A_THING = re.compile(r"^\s(?:folder|file|box|map|photograph|picture|series|album|ordner|akte|karte|dossier|carte|carpeta|mapa)\b", re.I)

_PARTICLE = r"(?:von|van|de|der|den|di|da|du|la|le|del|della|zu|zur|af|el|ter|ten|dos|y)"
_TITLE = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Herrn|Frau|Mme|Mlle|M|Monsieur|Madame|Sr|Sra|Señor|Señora|Don|Doña)\.?\s+)$")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_LETTERS = re.compile(r"[^\W\d_]{2,}")
_JOINED = re.compile(r"(?<![^\W\d_])[^\W\d_]+(?:['’-][^\W\d_]+)+")
_GAP = r"(?:[ \u00a0]+|[ \t]*\r?\n(?:[ \t]*(?:>|\||[A-Z]{2,3}>))*[ \t]*)"
_BETWEEN = re.compile(rf"{_GAP}(?:(?:{_PARTICLE}){_GAP}){{0,2}}$", re.I)
_COMMA = re.compile(rf",{_GAP}$")
#: Capitalised words before a surname that are no given names.
_NO_GIVEN = re.compile(
    r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Professor|Herr|Herrn|Frau|Mme|Mlle|Monsieur|Madame|Señora?|Don|Doña|Hi|Hello|Hey|Dear|Hallo|Liebe[rs]?|Salut|Bonjour|Chère?|Hola|Estimad[oa]|Querid[oa]|Cheers|Thanks|Regards|Quoting|From|Von|Desde|And|Und|The|Der|Die|Das|Les|Los|Las|Una?|Ask|Call|Team|Family|Familie|Famille|Familia|Gruß|Grüßen?|Saludos?|Cordialement|Atentamente|Journée|Morning|Tag|Días|Am|On|El|Le|La|Van|De|Del|Den|Di|Sent|To|An|Para|Cc)"
)
_SIGNED = re.compile(rf"^{_SP}(?:hat{_S}unterschrieben|a{_S}signé|firmó|signed|gave|who|wrote|schrieb|escribió|a{_S}écrit|says|said|asked|collected|called)\b")
#: What follows a name that is part of a company's, an institution's or a street's.
_NO_PERSON = re.compile(rf"^(?:[ \u00a0](?:&|and|und|et|y)[ \u00a0](?:Co|Sons|Söhne|Fils|Hijos|Partners?|Partner|Cie)\b|,?[ \u00a0](?:GmbH|AG|KG|OHG|Ltd|Limited|LLC|LLP|Inc|Corp|Corporation|Company|plc|S\.?A\.?R?\.?L?\.?|S\.?L\.?|Stiftung|Foundation|Verlag|Holding|Bros)\b|[ \u00a0-](?:Street|Road|Lane|Avenue|Straße|Strasse|Platz|Weg|Allee)\b)")
_ALONE = re.compile(r"(?:[ \t]*(?:>|\||[A-Z]{2,3}>))*[ \t]*[-–—/~]?[ \t]*(?:(?:\w+,? ){1,3})?")
_BEFORE = re.compile(r"(?:\b(?:hi|hello|hey|dear|hallo|liebe|lieber|liebe\(r\)|sehr geehrte[rs]?|salut|bonjour|cher|chère|hola|estimad[oa]|querid[oa]|(?:good|guten|buen[ao]?s) \w+|cheers|regards|thanks|wishes|br|mfg|grüßen?|saludos?|journée|vous|atentamente|cordialement|sincerely|for|by|from|to|with|reach|ist|est|de|pidió|von|ask for|quoting)[,:]?\s*[-–—]?\s*|^[-–—/]\s?)$", re.I)


#: Frequent given names of the four languages, beside those that the tables tell.
GIVEN = frozenset(
    "adam alan albert alejandro alex alexander alice amelie ana andrea andreas andrew angela anke anna anne antoine antonio arthur astrid barbara beatriz ben benjamin bernd birgit brigitte camille carlos carmen caroline catherine cecile charles charlotte chloe christian christine "
    "christopher claire claudia clemens daniel david diana diego dieter edith eduardo elena elisabeth elizabeth ella emma eric erik ernst eva fernando florian francisco francois frederic fritz gabriel georg george gisela gonzalo greta guillaume hana hannah hans heike heinz helen helena helga henry "
    "hugo ingrid isabel isabelle ivan jacques james jane javier jens joachim johann john jonas jorge jose joseph juan julia julian julie jutta karin karl katharina kevin klaus konrad laura lea leon leo linda lisa lorenzo louise lucas lucia lucie ludwig luis luise lukas manuel marc margot maria marie marion markus martha mateo mathieu matthias "
    "mia michael michel miguel monika monique nicolas nicole nina nora olivier pascal patricia paul paula pauline pedro philipp philippe pierre pilar rachel rafael ralf raquel renate richard robert roberto sabine samuel sandra sara sarah sebastian sergio silvia simone sophie stephan stephanie susan susanne sven sylvie teresa theo thomas tim ursula uwe valentin veronica victor vincent werner wilhelm william wolfgang yann yves".split()
)


@dataclass
class Lexicon:
    """Name words in lower case."""

    given: frozenset[str] = frozenset()
    surnames: frozenset[str] = frozenset()
    #: Given names that are words of a language too.
    common: frozenset[str] = frozenset("will mark rose grace faith hope joy may april june august dawn frank bill jack art ray rich victor sunny star angel luz rosa paz sol mar clara alma marta pia chance summer autumn ivy daisy lily olive iris violet heather basil max miles reed skip drew grant chase penny holly robin dean earl guy gene pat sue sandy terry nick rob bob dick harry jean martin laurent blanche reine fleur aurore constance prudence victoire felix milan rafa otto".split())
    all: frozenset[str] = field(default_factory=frozenset)
    #: The name words of tokens between white space that were looked at.
    seen: dict[str, frozenset[str]] = field(default_factory=dict, repr=False)
    #: A lexicon too large to be broadcast: `word`, `given`, `family`.
    table: DataFrame | None = None

    def __post_init__(self) -> None:
        self.all = self.given | self.surnames

    def is_surname(self, word: str) -> bool:
        return word in self.surnames or ("-" in word and all(p in self.surnames for p in word.split("-")))

    def _words_of(self, token: str) -> frozenset[str]:
        words = self.all.intersection(_LETTERS.findall(token))
        for whole in _JOINED.findall(token):
            for word in (whole, whole[:-2]) if whole.endswith(("'s", "’s")) else (whole,):
                for part in (word, *word.split("-")):
                    if part in self.all:
                        words |= frozenset(_LETTERS.findall(part))
        return words

    def name_words(self, low: str) -> set[str]:
        """The letter runs of a text in lower case that are names, or parts of names with an apostrophe or a hyphen."""
        found: set[str] = set()
        for token in set(low.split()):
            words = self.seen.get(token)
            if words is None:
                if len(self.seen) > 300_000:
                    self.seen.clear()
                words = self.seen[token] = self._words_of(token)
            if words:
                found |= words
        return found


#: Countries of the public register of bank account numbers, whose numbers have two check digits.
IBAN_COUNTRIES = frozenset("AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SD SE SI SK SM ST SV TL TN TR UA VA VG XK".split())
#: A Spanish number that is called so counts even if its letter was written wrong.
_LABELLED = re.compile(r"\b(?:dni|nie|nif)\b[^.!?\d]{0,40}$", re.I)

_LABEL_AFTER = re.compile(rf"{_SP}?\(?(?:dni|nie|nif)\b", re.I)


def _iban(text: str) -> bool:
    plain = re.sub(r"[^0-9A-Z]", "", text)
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _spanish(text: str) -> bool:
    plain = re.sub(r"[- ]", "", text)
    number = plain[:-1].translate(str.maketrans("XYZ", "012"))
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(number) % 23] == plain[-1]


#: Digits of a full number, with the country's own, by country code; others have ten or more.
_FULL = {"1": 11, "44": 12, "33": 11, "34": 11, "39": 12, "41": 11, "49": 11}


def _phone_end(text: str, a: int, b: int) -> int:
    """Where an international number ends: at the first space after it has all its digits."""
    digits = re.sub(r"\D", "", text[a:b].replace("(0)", ""))
    full = next((_FULL[digits[:k]] for k in (1, 2) if digits[:k] in _FULL), 10)
    seen = 0
    skip = text.find("(0)", a, b)
    for k in range(a, b):
        if text[k].isspace() and seen >= full:
            return k
        seen += text[k].isdigit() and not (skip >= 0 and skip <= k < skip + 3)
    return b


def _emails(text: str) -> Iterator[tuple[str, int, int, float]]:
    """Addresses around each at sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isalnum() or text[start - 1] in "_.+'-"):
            start -= 1
        host = _HOST.match(text, at + 1)
        if host and _MAILBOX.match(text, start, at):
            yield "email", start, host.end(), 0.95
            done = host.end()
        at = text.find("@", max(at + 1, done))


@cache
def _address_gate() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for kind, keys in _ADDRESS_GATES.items():
        for key in keys:
            machine.add_word(key, frozenset({kind}) | machine.get(key, frozenset()))
    machine.make_automaton()
    return machine


def _spelt(text: str) -> list[tuple[str, int, int, float]]:
    """Addresses with a spelt or bracketed at sign."""
    found = []
    for m in _AT_MARK.finditer(text):
        local = _LOCAL.search(text, max(0, m.start() - 80), m.start())
        domain = _DOMAIN.match(text, m.end(), min(len(text), m.end() + 120))
        if local and domain and ("@" not in m[0] or m[0].strip() != "@" or re.search(r"\.(?:com|org|net|test|example|invalid|de|fr|es|uk|info|eu)\b", domain[0], re.I)):
            found.append(("email", local.start(), domain.end(), 0.9))
    return found


def _near(text: str, start: int, end: int, pattern: re.Pattern) -> bool:
    return bool(pattern.search(text[max(0, start - 60) : start]) or pattern.search(text[end : end + 30]))


def _numbers(text: str) -> list[tuple[str, int, int, float]]:
    found = []
    for m in _NUMBERS.finditer(text):
        a = m.start()
        b = a + len(m[0].rstrip(" ()./\u00a0>|\r\n-"))
        if b - a < 8 or sum(c.isdigit() for c in m[0]) < 8:
            continue
        low, high = max(0, a - 1), min(len(text), b + 3)
        for pattern, base in IDENTITIES:
            for x in pattern.finditer(text, low, high):
                score = base + 0.35 * _near(text, *x.span(), _ID_NEAR) - 0.5 * bool(_NOT_NEAR.search(text[max(0, x.start() - 24) : x.start()]))
                found.append(("identity", *x.span(), score))
        for x in _CARD.finditer(text, low, high):
            if _luhn(re.sub(r"\D", "", x[0])):
                found.append(("identity", *x.span(), 0.5 + 0.3 * _near(text, *x.span(), _ID_NEAR)))
        for x in _SPANISH.finditer(text, low, high):
            if _spanish(x[0]):
                found.append(("identity", *x.span(), 0.75 + 0.2 * _near(text, *x.span(), _ID_NEAR)))
            else:
                found.append(("identity", *x.span(), 0.1 + 0.5 * bool(_LABELLED.search(text[max(0, x.start() - 60) : x.start()]) or _LABEL_AFTER.match(text, x.end(), x.end() + 24))))
        for pattern, base in PHONES:
            for x in pattern.finditer(text, low, high):
                before = text[max(0, x.start() - 30) : x.start()]
                score = base + 0.2 * bool(_PHONE_NEAR.search(before)) - 0.5 * bool(_NOT_NEAR.search(before))
                end = _phone_end(text, *x.span()) if x[0][0] == "+" else x.end()
                found.append(("phone", x.start(), end, score))
    return found


def _lettered(text: str) -> list[tuple[str, int, int, float]]:
    found = []
    for m in _IBAN.finditer(text):
        # Where no check digits are known, words nearby decide.
        score = 0.9 if _iban(m[0]) else 0.1 if m[0][:2] in IBAN_COUNTRIES else 0.4
        found.append(("identity", *m.span(), score + 0.25 * _near(text, *m.span(), _ID_NEAR)))
    for m in _BRITISH.finditer(text):
        found.append(("identity", *m.span(), 0.4 + 0.3 * _near(text, *m.span(), _ID_NEAR)))
    for m in _PASSPORT.finditer(text):
        if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
            found.append(("identity", *m.span(), 0.3 + 0.35 * _near(text, *m.span(), _ID_NEAR)))
    return found


def _places(text: str, low: str, words: set[str]) -> Iterator[re.Match]:
    """The whole words, with their hyphenated parts, around each occurrence of the given words, in order."""
    if len(low) != len(text):  # letters whose lower case is longer
        yield from _WORD.finditer(text)
        return
    starts = set()
    for word in words:
        at = low.find(word)
        while at >= 0:
            end = at + len(word)
            if not (at and low[at - 1].isalpha()) and not (end < len(low) and low[end].isalpha()):
                while at >= 2 and low[at - 1] in "-'’" and low[at - 2].isalpha():
                    at -= 1
                    while at and low[at - 1].isalpha():
                        at -= 1
                starts.add(at)
            at = low.find(word, end)
    for at in sorted(starts):
        found = _WORD.match(text, at)
        if found:
            yield found


def _names(text: str, low_text: str, words: set[str], lexicon: Lexicon, taken: list[tuple[int, int]]) -> list[tuple[str, int, int, float]]:
    """Spans of person names: runs of given names, surnames, initials and particles; `words` are the text's name words."""
    hits = []
    for m in _places(text, low_text, words):
        low = m[0].lower()
        given, family = low in lexicon.given, lexicon.is_surname(low)
        if not given and not family:
            if "-" in low and all(p in lexicon.given for p in low.split("-")):
                given = True
            elif low.endswith(("'s", "’s")) and (low[:-2] in lexicon.given or lexicon.is_surname(low[:-2])):
                given, family = low[:-2] in lexicon.given, lexicon.is_surname(low[:-2])
            else:
                continue
        a, b = m.span()
        if any(s < b and a < e for s, e in taken):
            continue
        if (a and text[a - 1] in "@._+\\") or (b < len(text) and text[b] in "@_\\") or (b + 1 < len(text) and text[b] in ".+" and text[b + 1].isalnum() and not text[b + 1].isupper()):
            continue
        hits.append((a, b, given, family, m[0]))
    found = []
    k = 0
    while k < len(hits):
        a, b, given, family, word = hits[k]
        end, last = b, k
        solid = False
        while last + 1 < len(hits):
            na, nb, ngiven, nfamily, nword = hits[last + 1]
            gap = text[end:na]
            if _BETWEEN.fullmatch(gap) and (hits[last][2] or hits[last][3]) and nfamily and (word[0].isupper() == nword[0].isupper() or word.isupper()):
                end, last, solid = nb, last + 1, True
                break
            if _COMMA.fullmatch(gap) and last == k and family and ngiven and not (given and not nfamily and not family) and word[0].isupper() and nword[0].isupper() and not (given and ngiven):
                end, last, solid = nb, last + 1, True
                break
            break
        if not solid and given and word[0].isupper():
            # A given name and a surname that the lexicon doesn't know.
            more = re.match(rf"{_SP}(?:{_PARTICLE}{_SP}){{0,2}}({_CAP}(?:-{_CAP})?)", text[end:])
            if more and "\n" not in more[0] and len(more[1]) > 3 and (re.match(rf"{_SP}(?:{_PARTICLE}{_SP})+", text[end:]) or re.match(r"\s*[<(]", text[end + more.end() :])) and more[1].lower() not in lexicon.common:
                end, solid = end + more.end(), True
        start = a
        before = text[max(0, start - 40) : start]
        part = re.search(rf"(?:(?<![\w'’])(?:{_PARTICLE}){_SP}){{1,2}}$", before, re.I)
        if part and family and (not given or solid) and hits[k][3]:
            lead = before[: part.start()]
            comma = bool(solid and _COMMA.search(text[b : b + 6]))
            if comma and not re.search(r"\w\s*$", lead):
                start -= len(before) - part.start()
        if family and not given and not solid and word[0].isupper():
            # A given name that the lexicon doesn't know.
            lead = re.search(rf"(?<![\w'’.@-])([^\W\d_a-zß-ÿ][^\W\d_]{{2,}}){_GAP}$", text[max(0, start - 40) : start])
            if lead and not _NO_GIVEN.fullmatch(lead[1]) and not (lead[1].isupper() and not word.isupper()) and "\n" not in lead[0]:
                start -= len(lead[0])
                solid = True
        initial = re.search(rf"(?<![\w.])((?:[^\W\d_a-z]\.{_S}?){{1,2}}(?:{_PARTICLE}{_SP})?)$", text[max(0, start - 16) : start])
        if initial and family and not _TITLE.search(text[max(0, start - 16) : start]):
            start -= len(initial[1])
            solid = True
        ok = solid
        if not ok and family and (word[0].isupper() or word.isupper()):
            ok = True
        if not ok and given and word[0].isupper():
            sentence = text[max(0, a - 60) : a]
            follows = text[b : b + 24]
            if word.lower() in lexicon.common:
                row = text[text.rfind("\n", 0, a) + 1 : a]
                alone = bool(re.match(r"[ \t]*(?:\r?\n|$)", follows)) and bool(_ALONE.fullmatch(row))
                ok = alone or bool(_SIGNED.match(follows)) or bool(_BEFORE.search(sentence)) or bool(re.match(r"[ \t]*[,:.!)]", follows))
            else:
                ok = True
            if ok and (m := re.match(r"-[A-Za-z]", follows)):
                ok = False
        if ok:
            lead, follows = text[max(0, start - 60) : start], text[end : end + 40]
            score = (0.8 if solid else 0.65) + 0.1 * bool(_TITLE.search(lead[-12:])) + 0.1 * bool(_BEFORE.search(lead)) + 0.1 * bool(_SIGNED.match(follows)) - 0.5 * bool(_NO_PERSON.match(follows))
            found.append(("name", start, end, score))
        k = last + 1
    return found


def detect(text: str, lexicon: Lexicon) -> list[tuple[str, int, int]]:
    """Mentions as (kind, start, end), in order, none inside another."""
    proposed: list[tuple[str, int, int, float]] = []
    if "@" in text:
        proposed += _emails(text)
    low = text.lower()
    if any(k in low for k in ("at)", "at]", "at}", "at>", "ät)", "(@", "[@", " dot ", " punkt ", " punto ", " point ", "arroba", "arobase", " @", "@ ")):
        proposed += _spelt(text)
    proposed += _numbers(text)
    if _LETTERED.search(text):
        proposed += _lettered(text)
    for kind in sorted(frozenset().union(*(kinds for _, kinds in _address_gate().iter(text)))):
        for m in ADDRESSES[kind].finditer(text):
            if kind != "de" or not _NO_STREET.match(m[0]):
                before, after = text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 24]
                score = 0.62 + 0.15 * ("," in m[0]) + 0.15 * bool(_LIVES.search(before)) - 0.3 * bool(_NO_PLACE.search(before) or _A_THING.match(after))
                proposed.append(("address", *m.span(), score))
    proposed = [p for p in proposed if p[3] >= THRESHOLD]
    proposed.sort(key=lambda p: (KINDS.index(p[0]), p[1] - p[2], p[1]))
    kept: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []
    for kind, a, b, _ in proposed:
        if not any(s < b and a < e for s, e in taken):
            taken.append((a, b))
            kept.append((kind, a, b))
    words = lexicon.name_words(low)
    if words:
        kept += [(kind, a, b) for kind, a, b, score in _names(text, low, words, lexicon, taken) if score >= THRESHOLD]
    return sorted(kept, key=lambda x: x[1])


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each mention replaced by its placeholder."""
    out, at = [], 0
    for kind, a, b in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


#: Words of senders' names that name no person.
DROP = frozenset({"scan", "desk", "team", "office", "service", "archive", "archiv", "support", "info", "records", "room"})


_BIGRAM = re.compile(rf"(?<![\w.-])([^\W\d_a-zß-ÿ][^\W\d_]+)(?:{_GAP}(?:{_PARTICLE}{_GAP}){{0,2}}|(?P<comma>, ))([^\W\d_a-zß-ÿ][^\W\d_]{{2,}}(?:-[^\W\d_a-zß-ÿ][^\W\d_]{{2,}})?)(?![\w@-])")


def _beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of capitalised words that stand together, as (name, word) in lower case, and of words in lower case."""
    for batch in batches:
        pairs: Counter = Counter()
        plain: Counter = Counter()
        for text in batch["_text"]:
            plain.update(w for w in set(text.split()) if w.islower())
            at = 0
            while m := _BIGRAM.search(text, at):
                first, second = m[1].lower(), m[3].lower()
                if m["comma"]:
                    first, second = second, first
                pairs.update((first, part) for part in second.split("-") if len(part) > 2)
                at = m.start(3)  # a word may stand between two others
        rows = [(a, b, n) for (a, b), n in pairs.items()] + [(None, w, n) for w, n in plain.items() if len(w) > 2 and w.isalpha()]
        yield pd.DataFrame(rows, columns=["name", "word", "n"])


def _names_of_texts(texts: DataFrame, given: DataFrame) -> DataFrame:
    """Surnames (`word`, `f`) that stand beside a name of `given` (`word`) in a column `_text`."""
    seen = cut_lineage(texts.where("_text <> ''").select("_text").mapInPandas(_beside, "name string, word string, n long"))
    pairs = seen.where("name IS NOT NULL").groupBy("name", "word").agg(F.sum("n").alias("n"))
    beside = pairs.join(given.select(F.col("word").alias("name")), "name").groupBy("word").agg(F.sum("n").alias("f")).where(F.col("f") >= LEAST_BESIDE)
    plain = seen.where("name IS NULL").join(beside.select("word"), "word", "left_semi").groupBy("word").agg(F.sum("n").alias("low"))
    return beside.join(plain, "word", "left").where(F.coalesce("low", F.lit(0)) * OVER_LOWER <= F.col("f")).select("word", "f")


def lookups(low: str) -> set[str]:
    """Every word that may be looked up for a text in lower case."""
    words = set(_LETTERS.findall(low))
    for whole in set(_JOINED.findall(low)):
        for word in (whole, whole[:-2]) if whole.endswith(("'s", "’s")) else (whole,):
            words.update((word, *word.split("-")))
    return words


def _lookups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), 500):
            part = batch.iloc[start : start + 500]
            yield pd.DataFrame([(row, w) for row, text in zip(part["_row"], part["_text"]) for w in lookups(text.lower())], columns=["_row", "word"])


def _own_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """For each `_row` the arrays `_given` and `_family` of the names in its `_text`."""
    tokens = rows.where("_text <> ''").select("_row", "_text").mapInPandas(_lookups, "_row long, word string")
    return tokens.join(names, "word").groupBy("_row").agg(F.collect_set(F.when(F.col("given"), F.col("word"))).alias("_given"), F.collect_set(F.when(F.col("family"), F.col("word"))).alias("_family"))


def gather_names(named: DataFrame, texts: DataFrame | None = None, least: int = 1) -> Lexicon:
    """The lexicon of a column `_name` of display names ('Given Surname <address>', 'Surname, Given', 'Given')
    and of a column `_text` of texts that name people.

    A word that is mostly a surname isn't a given name, and the other way round. All words are
    counted by Spark. They come to the driver while there are at most MAX_NAMES; a larger
    lexicon stays a table that the texts' words are joined to, with the same result.
    """
    plain = F.trim(F.regexp_replace(F.regexp_replace("_name", r"<[^>]*>|\([^)]*\)|\"|\S+@\S+", " "), r"\s+", " "))
    own = named.select(plain.alias("n")).where(F.col("n").rlike(r"^[\p{Lu}\p{Ll}][\p{L}'’., -]{1,60}$"))
    particle = r"(?i)\b(?:von|van|de|der|den|di|da|du|la|le|del|zu)\b"
    comma = F.split(F.col("n"), r"\s*,\s*")
    given = F.when(F.contains(F.col("n"), F.lit(",")), F.try_element_at(comma, F.lit(2))).otherwise(F.try_element_at(F.split("n", " "), F.lit(1)))
    family = F.when(F.contains(F.col("n"), F.lit(",")), F.try_element_at(comma, F.lit(1))).otherwise(F.regexp_replace("n", r"^\S+\s*", ""))
    family = F.trim(F.regexp_replace(family, particle, ""))
    rows = own.select(F.inline(F.array(F.struct(F.lit("given").alias("kind"), F.lower(given).alias("w")), F.struct(F.lit("family").alias("kind"), F.lower(family).alias("w")))))
    rows = rows.where(F.col("w").rlike(r"^\p{L}[\p{L}'’]+(?:-\p{L}+)?$"))
    counts = cut_lineage(rows.groupBy("kind", "w").agg(F.count("*").alias("n")).where(F.col("n") >= least))
    givens = counts.where("kind = 'given'").select(F.col("w").alias("word"), F.col("n").alias("g"))
    families = counts.where("kind = 'family'").select(F.explode(F.split("w", "-")).alias("word"), F.col("n").alias("f")).groupBy("word").agg(F.sum("f").alias("f"))
    listed = counts.sparkSession.createDataFrame([(w,) for w in sorted(GIVEN)], "word string")
    known = givens.join(families, "word", "full").join(listed.withColumn("_listed", F.lit(True)), "word", "full").fillna(0, ["g", "f"])
    known = cut_lineage(known.select("word", ((F.col("g") > F.col("f")) | (F.col("_listed").isNotNull() & (F.col("f") == 0))).alias("given"), ((F.col("f") > 0) & (F.col("f") >= F.col("g"))).alias("family")))
    if texts is not None:
        # Names that are words of a language too say nothing about what stands beside them.
        sure = known.where(F.col("given") & ~F.col("word").isin(*sorted(Lexicon.common)))
        new = _names_of_texts(texts, sure).join(known, "word", "left_anti")
        known = cut_lineage(known.unionByName(new.select("word", F.lit(False).alias("given"), F.lit(True).alias("family"))))
    known = known.where((F.col("given") | F.col("family")) & ~F.col("word").isin(*sorted(DROP)))
    if known.count() > MAX_NAMES:
        return Lexicon(table=known)
    rows = known.collect()
    return Lexicon(frozenset(r.word for r in rows if r.given), frozenset(r.word for r in rows if r.family))


def mentions(df: DataFrame, keys: list[Column], text: Column, lexicon: Lexicon) -> DataFrame:
    """Each row's keys with `spans`, the array of (`pii_kind`, `start_pos`, `end_pos`), and `masked_text`.

    Positions count code points from 1, the end is exclusive. Null and empty texts have no
    spans and stay as they are; rows count by themselves; other columns are dropped.
    """
    own = df.select(*keys, text.alias("_text"))
    names = own.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    if lexicon.table is None:
        shared = df.sparkSession.sparkContext.broadcast(lexicon)
    else:
        shared = None
        own = cut_lineage(own.withColumn("_row", F.monotonically_increasing_id()))
        own = own.join(_own_names(own, lexicon.table), "_row", "left").drop("_row")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if shared is not None:
                found = [detect(t, shared.value) if t else [] for t in batch["_text"]]
            else:
                sets = ([frozenset(x) if x is not None else frozenset() for x in batch[c]] for c in ("_given", "_family"))
                found = [detect(t, Lexicon(g, f)) if t else [] for t, g, f in zip(batch["_text"], *sets)]
            out = batch[names].copy()
            out["spans"] = [[{"pii_kind": k, "start_pos": a + 1, "end_pos": b + 1} for k, a, b in spans] for spans in found]
            out["masked_text"] = [masked(t, spans) if spans else t for t, spans in zip(batch["_text"], found)]
            yield out

    return own.mapInPandas(run, f"{schema}, spans array<struct<pii_kind string, start_pos int, end_pos int>>, masked_text string")
