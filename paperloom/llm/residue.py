"""Template residue, filler, error pages and script notices in place of content.

Lines are normalised and counted by host (any column that says where a record came
from). A line that recurs in at least `SHARE` of a host's distinct texts (and in
`LEAST` of them) is boilerplate and is subtracted; no record is judged by a line that
stands on every page. Copies of a page, also with other numbers or ids in it, are one
text, so a page that is repeated doesn't make its own lines boilerplate. There are at
most 1/SHARE such lines for each line of an average text, so the list per host is small
whatever the table's size. What is left of a record is searched for evidence of four
kinds; a record of which nothing else is left is searched whole. Text that only speaks
about such text doesn't count: quoted or fenced spans are blanked first, and evidence
beside words of reporting is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from re import _parser

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import unaccented
from paperloom.session import cut_lineage

SHARE = 0.02
LEAST = 20
#: Boilerplate lines up to this many (8 bytes each) are broadcast; beyond it hosts are joined, each in SALTS parts.
BROADCAST_KEYS = 500_000
SALTS = 64

_NAME = r"[A-Za-zÀ-ÿ][\wÀ-ÿ.-]{0,40}"
_FILL = (
    r"einfügen|eintragen|ergänzen|ausfüllen|einsetzen|to be (?:added|inserted|filled in|completed|supplied|confirmed)|goes here|here|tbd|"
    r"à (?:compléter|insérer|indiquer|remplir|préciser)|por (?:completar|rellenar|definir|indicar)|a completar"
)
_ASK = r"your|insert|enter|add|fill in|type|indiquer|insérer|votre|saisir|compléter|préciser|ihre?|name des|einfügen|bitte|insertar|indicar|indique|su|introducir|completar|rellenar|escriba"
PLACEHOLDER = re.compile(
    r"\{\{[#/>!&]?\s*" + _NAME + r"(?:\s*\|[^{}\n]{1,40})?\s*\}\}|\{%-?\s*" + _NAME + r"[^{}%\n]{0,60}%\}|\*\|" + _NAME + r"\|\*|<<\s*" + _NAME + r"\s*>>|%\(" + _NAME + r"\)s|(?<!\w)%%" + _NAME + r"%%|(?<![\w$])\$[A-Z][A-Z_]{2,40}\$|<\?=?\s*\$?" + _NAME + r"\s*\?>|"
    r"\$\{\s*" + _NAME + r"\s*\}|(?<![\w\"$:{])\{\s*" + _NAME + r"\s*\}(?!\})|<%=?\s*" + _NAME + r"\s*%>|(?<![\w%])%" + _NAME + r"%(?!\w)"
    r"|\[\[\s*" + _NAME + r"\s*\]\]|(?<![\w_])__[A-Za-z]\w{0,40}?__(?!\w)|(?<![\w#])#[A-Za-z]\w{1,40}#(?![\w#])|(?<!\w)@@" + _NAME + r"@@|(?<!\w)~" + _NAME + r"~"
    r"|[<\[{(](?i:" + _ASK + r")\s[\w .'-]{1,40}[>\]})]|[<\[{][\w .'-]{1,40}\s(?i:" + _FILL + r")[>\]}]|<[A-Z][A-Z_ ]{2,40}>|\[[A-Z]+(?:_[A-Z]+)+\]"
)

ERROR = re.compile(
    r"\b(?:4\d\d|5\d\d) ?[-:–]? ?(?:not found|forbidden|unauthori[sz]ed|bad request|bad gateway|gone|internal (?:server )?error|service (?:temporarily )?unavailable|gateway time-?out|too many requests|error)\b"
    r"|\b(?:http|error|erreur|fehler|código|code|status) ?(?:code )?[:#-]? ?(?:4\d\d|5\d\d)\b"
    r"|\b(?:internal server error|service unavailable|bad gateway|gateway time-?out|page (?:not found|unavailable)|access denied|session (?:has )?expired|request timed out)\b"
    r"|\binterner serverfehler|\bseite nicht (?:gefunden|verfügbar)|\bzugriff verweigert|\bsitzung (?:ist )?abgelaufen|\bangeforderte (?:adresse|seite) (?:gibt es nicht|existiert nicht|wurde nicht)"
    r"|\bmelden sie sich (?:bitte )?(?:neu|erneut) an|\bversuchen sie es (?:bitte )?(?:später|in \d+)|\bdienst nicht verfügbar|\bkeine berechtigung"
    r"|\berror interno del servidor|\bdirección solicitada no existe|\bacceso denegado|\bpágina no (?:encontrada|disponible)|\b(?:la )?sesión (?:ha )?(?:caducad[oa]|expirad[oa]|caducó|expiró)|\binicie sesión de nuevo|\bvuelva a intentarlo|\bservicio no disponible|\bno tiene permiso para"
    r"|\berreur interne du serveur|\bpage (?:introuvable|indisponible|non trouvée)|\baccès refusé|\bsession expirée|\badresse demandée n['’]existe|\bveuillez (?:vous reconnecter|réessayer)|\bréessayez (?:plus tard|dans)|\bservice indisponible|\bvous n['’]avez pas (?:la permission|l['’]autorisation|le droit)"
    r"|\bupstream connect error|\bdisconnect before headers|\bupstream did not answer|\btraceback \(most recent call last\)|\b(?:key|value|type|name|index|attribute|import|runtime|os|io)error: |\bfile \"[^\"]+\", line \d+, in |\bnullpointerexception|\bsegmentation fault|\bfatal error: |\bexception in thread"
    r"|\bsomething went wrong|\bsorry, (?:that|this|something) (?:did not|didn['’]t) work|(?:^|[.!?-] )oops\b|\b(?:the )?link you (?:followed|clicked) (?:may|might) be|\byou do not have (?:the )?permission to|\byou don['’]t have (?:the )?permission to|\bplease sign in again|\bsign in again to continue"
    r"|\bwe (?:lost|can['’]?t (?:seem to )?find|cannot find|couldn['’]?t find|could not find) (?:that|this|the|what) ?(?:page|you)|\bcan['’]t seem to find what|\btry again in \d+ (?:minutes|seconds|hours)|\bif the problem persists, contact|\bcontact the webmaster|\brequest id: ?\w|\breference #\w"
    r"|\bare you a robot\b|\b(?:confirm|pass|solve) the (?:\w+ )?(?:check|challenge|puzzle)\b(?= to| before| and|[.,:;]|$)|prove (?:that )?you are (?:human|not a robot)|\bverify (?:that )?you are (?:human|not a robot)|\bcomplete the captcha|\bchecking your browser before|\bunusual traffic from your"
    r"|\b(?:an )?(?:unexpected|unknown|internal|fatal) (?:error|exception) (?:has )?(?:occurred|happened)|\b(?:an error|a problem) (?:has )?occurred\b|\bthis (?:site|page|address) can['’]?t be (?:reached|displayed|loaded|found)|\bthis page (?:isn['’]t|is not) (?:working|available)|\bthe (?:page|document|file|resource) (?:you (?:requested|are looking for|were looking for)|requested) (?:could not|cannot|can['’]t|was not|does not|is not|no longer|has been)"
    r"|\b(?:temporarily|currently) (?:unavailable|offline|down for maintenance)|\b(?:site|service|system|page) is (?:under|down for) maintenance|\bback (?:online )?soon after maintenance|\berr_[a-z]+_[a-z_]+|\bdns_probe_|\btoo many connections\b|\bmysql_connect\(|\bparse error: syntax error|\bstack ?trace:|\buncaught (?:\w+error|exception)|\bat [\w$.]+\(\w+\.java:\d+\)|\bcore dumped\b|\bout of memory error"
    r"|\b(?:ein )?(?:unerwarteter|unbekannter|interner|schwerer) fehler (?:ist )?(?:aufgetreten|passiert)|\b(?:es )?ist ein (?:\w+ )?fehler aufgetreten|\bseite (?:konnte|kann) nicht (?:gefunden|geladen|angezeigt|aufgerufen)|\bvorübergehend nicht (?:erreichbar|verfügbar)|\bzeitüberschreitung (?:der|bei der) (?:anforderung|anfrage|verbindung)|\bwegen wartungsarbeiten"
    r"|\bune erreur (?:\w+ )?(?:est survenue|s['’]est produite|inattendue)|\bla page (?:demandée|que vous (?:cherchez|recherchez|demandez)) (?:n['’]existe|est introuvable|n['’]a pas)|\b(?:momentanément|temporairement) indisponible|\bdélai d['’]attente dépassé|\ben cours de maintenance"
    r"|\b(?:se ha producido|se produjo|ha ocurrido|ocurrió) un error|\bla página (?:solicitada|que busca|que buscas) no (?:existe|está|se)|\bno se (?:ha encontrado|encontró|pudo (?:encontrar|cargar|mostrar)) (?:la|esta) página|\btemporalmente (?:fuera de servicio|no disponible)|\btiempo de espera agotado|\ben mantenimiento\b"
    r"|\"(?:status|code)\" ?: ?\"?[45]\d\d\b|\"error\" ?: ?\"",
)

_SCRIPT = r"(?:java ?scripts?|ecmascript|\bjs\b|no-?script|\bscripts?\b|\bscripting\b|\bskripte?n?\b|\bsecuencias de comandos\b)"
_NEED = (
    r"enable[ds]?\b|activat|allow|turn(?:ed|ing)? (?:on|off)|switch(?:ed)? (?:on|off)|\boff\b|\bon\b|must|need|requir|disabled?|deactivat|block|not (?:support|enabled|available)|unsupported|without|missing|"
    r"aktivier|erlaub|zulass|einschalt|benötig|erforderlich|deaktivier|abgeschaltet|ausgeschaltet|blockiert|ohne|nicht unterstützt|"
    r"activ[eo]|autoris|désactiv|bloqué|nécessaire|nécessite|requiert|sans\b|prend pas en charge|necesita|permit|habilit|desactiv|bloquead|requier|\bsin\b|no admite|encienda"
)
#: A word for scripts, or a notice without one.
SCRIPT = re.compile(
    rf"({_SCRIPT})"
    r"|\bchange your browser settings|\bsome parts of [^.!?]{1,40} will not (?:load|work)|\bthe \w+ cannot be (?:drawn|displayed|rendered)\b",
)
_NEEDED = re.compile(_NEED)
_STOP = re.compile(r"[.!?]")


#: No match of a pattern is longer.
LONGEST = 300


def _around(pattern: re.Pattern, text: str, places: list[int]) -> Iterator[re.Match]:
    """The pattern's matches near the given places, which are in order."""
    done = 0
    for k, at in enumerate(places):
        if k + 1 < len(places) and places[k + 1] - at < LONGEST:
            continue
        first = k
        while first and places[first] - places[first - 1] < LONGEST:
            first -= 1
        yield from pattern.finditer(text, max(done, places[first] - LONGEST), min(len(text), at + LONGEST))
        done = at + 1


def scripts(line: str, places: list[int]) -> Iterator[tuple[int, int]]:
    """Spans of words for scripts that in their sentence, at most 60 characters off, stand with a word of need."""
    for m in _around(SCRIPT, line, places):
        if not m[1] or _NEEDED.search(_STOP.split(line[max(0, m.start() - 60) : m.start()])[-1]) or _NEEDED.search(_STOP.split(line[m.end() : m.end() + 60], maxsplit=1)[0]):
            yield m.span()


FILLER = re.compile(
    r"\b(?:lorem ipsum|dolor sit amet|consectetur|platzhaltertext|blindtext|fülltext|texto de (?:relleno|ejemplo|muestra)|texto simulado|texte d['’]exemple|texte de remplissage|faux[- ]texte|texte fictif)\b"
    r"|\bdummy text\b|\bplaceholder text\b|\bfiller text\b|\bsample (?:paragraph|text) (?:for|to)\b|\b(?:your )?(?:content|text|heading|title|copy) goes here\b|\breplace this text\b|\badd your (?:heading|text|title|content) here\b|\binsert (?:your )?(?:text|content|heading) here\b|\btype your text here\b"
    r"|\bis a dummy for\b|\b(?:asdf|qwer(?:ty)?|jkl)(?: (?:asdf|qwer(?:ty)?|jkl))+\b|\basdf ?jkl\b|\bbla(?:[ ,]+bla)+\b|\btest(?: test)+\b|\b(?:foo bar(?: baz)?|xxx(?: xxx)+)\b|\b(?:hier steht ein|hier kommt (?:ihr|der)) \w*text\b|\bremplacer ce texte\b|\bvotre texte ici\b|\bsu texto aquí\b|\bihr text hier\b",
)

#: Stems of typesetters' filler Latin, and its short words.
_LATIN = re.compile(
    r"lorem|ipsum|dolor\w*|amet|consec\w*|adipi\w*|elit|eiusmod|tempor\w*|incid\w*|labor\w*|magna|aliqu\w*|enim|minim|veniam|quis\w*|nostrud|exerc\w*|ullam\w*|nisi|commodo|duis|aute|irure|repreh\w*|volup\w*|velit|esse|cillum|fugia\w*|nulla|pariat\w*|except\w*|sint|occaec\w*|cupid\w*|proident|sunt|culpa|offic\w*|deser\w*|mollit|anim|porta|vitae|nunc|justo|etiam|donec|mauris|viverra|"
    r"praesent|vestibulum|pellentesque|curabitur|phasellus|suspendisse|integer|morbi|fusce|nullam|quisque|sodales|lectus|ultric\w*|tincidunt|mattis|maecenas|vivamus|aenean|cras|proin|sagittis|malesuada|egestas|semper|congue|dictum|feugiat|vehicula|rhoncus|ornare|tellus|turpis|risus|metus|purus|libero|augue|ligula|lacus|massa|urna|neque|ante|orci|felis|odio|leo|erat"
)
_LATIN_SHORT = frozenset("sit sed et ut in ad ex ea do eu id est non at ac".split())
_WORD = re.compile(r"[^\W\d_]+")
_NUMBERED = re.compile(r"\d")

#: Words of reporting: beside them, evidence is spoken about.
ABOUT = re.compile(
    r"\be\.g\.|\bfor (?:example|instance)\b|\bexamples? (?:from|of|in)\b|\bsuch as\b|\bask(?:s|ed|ing)? (?:the |its |all |their )?(?:visitors?|users?|readers?|people|customers?|guests?|for)\b|\b(?:logs?|reports?|messages?|notices?|errors?|screens?|windows?|banners?) (?:that )?(?:says?|said|reads?|saying|reading|shows?|showed)\b|\b(?:says?|said|reads?|shows?|called|named|labelled|marked|titled|entitled) [\"“'«‘„]"
    r"|\b(?:the|a|an) (?:words?|phrase|term|message|notice|placeholder|string|label|error) [\"“'«‘„]|\bplaceholders?\b (?:in|such|like|are|were|of)|\bfields? (?:such as|like)\b|\b(?:described|explained|discussed|mentioned|listed) (?:as|in|by|here|there|above|below)\b|\bwhen(?:ever)? a (?:link|page|server|site|user|visitor) (?:answers|returns|shows|reports|sees|meets|gets)|\bis filled in by\b|\bmust be replaced before\b|\btaken out of\b"
    r"|\bdie (?:meldung|fehlermeldung|angabe|formel|wörter|worte|platzhalter)\b|\bzum beispiel\b|\bz\. ?b\.|\bbeispiele? (?:aus|für|von)\b|\bbittet (?:die )?(?:besucher|leser|nutzer)|\ble message [\"“«]|\bpar exemple\b|\bp\. ?ex\.|\bdemand\w+ aux (?:visiteurs|lecteurs|utilisateurs)|\bel mensaje [\"“«]|\bpor ejemplo\b|\bp\. ?ej\.|\bpid\w+ a los (?:visitantes|lectores|usuarios)",
)

_FENCE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]{1,400}`", re.S)
_QUOTE = re.compile(r"\"[^\"\n{}]{1,200}\"|“[^”]{1,200}”|«[^»]{1,200}»|„[^“”\"]{1,200}[“”\"]|‚[^‘]{1,200}‘")
_JOIN = re.compile(r"(?<=\w)[-\u00ad\u2010¬][ \t]*\n(?:>+ ?)*(?=[a-zà-ÿ])")
_BROKEN = re.compile(r"[-\u00ad\u2010¬][ \t]*\n")
_SPACES = re.compile(r"[ \t\u00a0]{2,}|[\t\u00a0]")
_PREFIX = re.compile(r"\n[ \t]*(?:>[> ]*)")

#: Errors whose own text is in quotes.
_RAW = re.compile(r"\"(?:status|code)\" ?: ?\"?[45]\d\d\b|\"error\" ?: ?\"|\btraceback \(most recent")

KINDS = ("error", "placeholder", "filler", "script")

def _language(op, arg) -> frozenset[str] | None:
    """All strings (in lower case) that an element of a parsed pattern matches, where they are few."""
    name = str(op)
    if name == "LITERAL":
        return frozenset({chr(arg).lower()})
    if name == "IN" and all(str(kind) == "LITERAL" for kind, _ in arg):
        return frozenset(chr(c).lower() for _, c in arg)
    if name in ("AT", "ASSERT", "ASSERT_NOT"):
        return frozenset({""})
    if name == "SUBPATTERN":
        return _product(arg[3])
    if name == "BRANCH":
        parts = [_product(x) for x in arg[1]]
        return frozenset().union(*parts) if all(parts) else None
    if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] == 1:
        inner = _product(arg[2])
        return inner and (inner if arg[0] else inner | {""})
    return None


def _product(tree) -> frozenset[str] | None:
    whole = frozenset({""})
    for op, arg in tree:
        part = _language(op, arg)
        if not part or len(whole) * len(part) > 400:
            return None
        whole = frozenset(a + b for a in whole for b in part)
    return whole


def _rarity(strings: frozenset[str]) -> tuple[int, int]:
    """Long strings and signs are rare; of equal sets, the smaller."""
    return min(len(x) + 2 * sum(not c.isalnum() and c != " " for c in x) for x in strings), -len(strings)


def required(tree) -> frozenset[str] | None:
    """Strings of a parsed pattern, in lower case, of which every match holds at least one; None where there are none."""
    best: frozenset[str] | None = None
    run = frozenset({""})

    def offer(strings: frozenset[str] | None) -> None:
        nonlocal best
        if strings and "" not in strings and (best is None or _rarity(strings) > _rarity(best)):
            best = strings

    for op, arg in tree:
        part = _language(op, arg)
        if part and len(run) * len(part) <= 400:
            run = frozenset(a + b for a in run for b in part)
            offer(run)
            continue
        offer(run)
        run = part or frozenset({""})
        name = str(op)
        if name == "SUBPATTERN":
            offer(required(arg[3]))
        elif name == "BRANCH":
            parts = [required(x) for x in arg[1]]
            offer(frozenset().union(*parts) if all(parts) else None)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0]:
            offer(required(arg[2]))
    offer(run)
    return best


@cache
def _gate() -> ahocorasick.Automaton:
    """The strings that the patterns of each kind require; a text without any of a kind's needs no search for it."""
    machine = ahocorasick.Automaton()
    for kind, patterns in (("error", (ERROR, _RAW)), ("placeholder", (PLACEHOLDER,)), ("filler", (FILLER,)), ("script", (SCRIPT,))):
        for pattern in patterns:
            keys = required(_parser.parse(pattern.pattern, pattern.flags))
            if not keys:
                raise ValueError(f"a pattern of kind {kind} has an alternative without a fixed string")
            for key in keys:
                machine.add_word(key, frozenset({kind}) | machine.get(key, frozenset()))
    machine.make_automaton()
    return machine


def _spoken(text: str, start: int, end: int) -> bool:
    """Whether words of reporting stand in the same sentence, or just before it; `text` is in lower case."""
    a = max(text.rfind(c, 0, start) for c in (". ", "! ", "? ", ".\n", "\n\n"))
    if text[max(0, a - 3) : a + 1].endswith((".g.", "z.b.", ".ex.", ".ej.", "z. b.")):
        a = max(0, start - 90)
    ends = [k for k in (text.find(c, end) for c in (". ", "! ", "? ", ".\n", "\n\n")) if k >= 0]
    return bool(ABOUT.search(text[max(a + 1, start - 160, 0) : min([*ends, end + 90, len(text)])]))


def _is_latin(word: str) -> int:
    """2 for a long word of filler Latin, 1 for a short one."""
    return 2 if _LATIN.fullmatch(word) else 1 if word in _LATIN_SHORT else 0


class _LongLatin(dict):
    """Of a token between white space, how many long words of filler Latin it holds."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[token] = n = sum(_is_latin(w) == 2 for w in _WORD.findall(token))
        return n


_LONG = _LongLatin()


def _latin(text: str) -> bool:
    """Ten words in a row of which four fifths are filler Latin, three of them long (all of six to nine, where there are no more)."""
    hits = [_is_latin(w) for w in _WORD.findall(text)]
    size = min(10, len(hits))
    total, long = sum(map(bool, hits[:size])), hits[:size].count(2)
    for k in range(size, len(hits) + 1):
        if size >= 6 and total >= 0.8 * size and long >= 3:
            return True
        if k < len(hits):
            total += bool(hits[k]) - bool(hits[k - size])
            long += (hits[k] == 2) - (hits[k - size] == 2)
    return False


def evidence(text: str) -> list[str]:
    """The kinds of evidence that a text holds, in the order of KINDS."""
    flat = text.replace("\r\n", "\n")
    if "  " in flat or "\t" in flat or "\u00a0" in flat:
        flat = _SPACES.sub(" ", flat)
    if _BROKEN.search(flat):
        flat = _JOIN.sub("", flat)
    if ">" in flat:
        flat = _PREFIX.sub("\n", flat)
    low = flat.lower()
    likely: dict[str, list[int]] = {}
    for at, kinds in _gate().iter(" " + low.replace("\n", " ") + " "):
        for kind in kinds:
            likely.setdefault(kind, []).append(max(0, at - 1))
    latin = sum(map(_LONG.__getitem__, low.split())) >= 3
    if not likely and not latin:
        return []
    if len(low) != len(flat):  # letters whose lower case is longer
        flat = low
    if "`" in flat:
        flat = _FENCE.sub(lambda m: " " * len(m[0]), flat)
    raw = flat.lower()
    flat = _QUOTE.sub(lambda m: '"' + " " * (len(m[0]) - 2) + '"', flat)
    low = flat.lower()
    line = re.sub(r"(?<!\n)\n(?!\n)", " ", low)
    found = []
    for kind, places in likely.items():
        pattern, source = {"error": (ERROR, line), "placeholder": (PLACEHOLDER, flat), "filler": (FILLER, line), "script": (SCRIPT, line)}[kind]
        spans = scripts(line, places) if kind == "script" else (m.span() for m in _around(pattern, source, places))
        if any(not _spoken(low if kind == "placeholder" else line, *span) for span in spans):
            found.append(kind)
    if "error" in likely and "error" not in found and _RAW.search(raw):
        found.append("error")
    if latin and "filler" not in found and _latin(line):
        found.append("filler")
    return sorted(found, key=KINDS.index)


def _line_key(line: Column) -> Column:
    """A line without case, accents, digits and outer white space, as a hash; null where nothing is left."""
    key = F.trim(F.regexp_replace(unaccented(line), r"[\p{N}\s]+", " "))
    return F.when(F.length(key) > 2, F.xxhash64(key))


def _page_key(text: Column) -> Column:
    """A text without case and without words that hold a digit, as a hash: equal for copies with another number, id or time."""
    return F.xxhash64(F.regexp_replace(F.concat(F.lit(" "), F.lower(text)), r"\s[^\s\p{N}]*+\p{N}\S*", ""))


def boilerplate(docs: DataFrame, text: str, host: str, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """`_host` and the array of its recurrent line keys; hosts without any don't appear. Null is a host of its own.

    Texts are counted once by their page key. A host with fewer than `least` of these, but
    with as many texts that differ in their numbers, has the lines that stand in all of them.
    """
    own = docs.select(F.col(f"`{host}`").alias("_host"), F.col(f"`{text}`").alias("_text")).where(F.col("_text").rlike(r"\S")).withColumn("_page", _page_key(F.col("_text")))
    texts = own.select("_host", "_page", F.xxhash64("_text").alias("_exact")).distinct().groupBy("_host", "_page").agg(F.count("*").alias("_exact"))
    sizes = texts.groupBy("_host").agg(F.count("*").alias("_n"), F.sum("_exact").alias("_texts")).where(F.col("_texts") >= least)
    lines = own.select("_host", "_page", F.explode(F.array_distinct(F.transform(F.split("_text", r"\r?\n"), _line_key))).alias("_key")).where("_key IS NOT NULL")
    counts = lines.distinct().groupBy("_host", "_key").agg(F.count("*").alias("_in"))
    often = counts.join(sizes, counts["_host"].eqNullSafe(sizes["_host"])).where((F.col("_in") >= F.least(F.lit(least), "_n")) & (F.col("_in") >= F.col("_n") * share))
    return often.groupBy(counts["_host"].alias("_host")).agg(F.collect_list("_key").alias("_often"))


def _bare(whole: str, rest: str) -> bool:
    """Whether a text without its boilerplate holds nothing, and its boilerplate no line of its own number beside the evidence."""
    if _WORD.search(rest):
        return False
    return not any(_NUMBERED.search(x) and _WORD.search(x) and not evidence(x) for x in whole.splitlines())


def judged(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """Each record with `evidence`, the array of kinds found in its residual text.

    Result: `doc_id` and `evidence` (empty where the record is kept). A null or empty
    text has no evidence. A record that consists of boilerplate alone is judged by its
    whole text. Rows repeated under another id are judged each, but count once for the
    boilerplate; an id that comes twice is judged twice. Extra columns are dropped first.
    """
    common = cut_lineage(boilerplate(docs, text, host)).withColumnRenamed("_host", "_of")
    own = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{host}`").alias("_host"), F.col(f"`{text}`").alias("_text"))
    same = F.col("_host").eqNullSafe(F.col("_of"))
    keys = common.agg(F.sum(F.size("_often"))).first()[0] or 0
    if keys <= BROADCAST_KEYS:
        own = own.join(F.broadcast(common), same, "left")
    else:
        common = common.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = own.withColumn("_salt", F.pmod(F.xxhash64("_text"), F.lit(SALTS))).join(common, same & (F.col("_salt") == F.col("_part")), "left")
    lines = F.filter(F.split("_text", r"\r?\n"), lambda x: ~F.coalesce(F.array_contains("_often", _line_key(x)), F.lit(False)))
    own = own.select("_id", "_text", F.when(F.col("_often").isNotNull(), F.array_join(lines, "\n")).alias("_rest"))
    kind = own.schema["_id"].dataType.simpleString()

    def kinds(whole: str | None, rest: str | None) -> list[str]:
        if not whole:
            return []
        found = evidence(whole if rest is None else rest)
        return evidence(whole) if not found and rest is not None and _bare(whole, rest) else found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_id": batch["_id"], "evidence": [kinds(t, r) for t, r in zip(batch["_text"], batch["_rest"])]})

    return own.mapInPandas(run, f"_id {kind}, evidence array<string>").withColumnRenamed("_id", doc_id)
