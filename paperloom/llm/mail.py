"""The text of an email that its sender wrote.

A body is read by a recursive grammar of layouts:

    body     = block*
    block    = written | quoted | forwarded
    quoted   = intro? (prefixed line | blank)+     its lines, without their prefix, are a body
    forwarded= (separator | header block | strong intro) enclosed
    enclosed = quoted                              where prefixed lines follow at once and nothing is written before: the
                                                   answer, and so the enclosing body, resumes after them
             | body closing separator              the enclosing body resumes after it
             | body                                to the end of the enclosing body
    written  = text* tail?
    tail     = signature? notice*
    signature= closing line? delimiter? (name | role | contact | device line)*
    notice   = rule? heading? legal paragraph

`parse` gives the tree of a body, whatever its depth: each node has its kind, its lines and
the nodes that it encloses. Only `text` nodes that no quotation encloses are serialised as
newly written; text that resumes after a quotation or a forward is one of them. The tails of
enclosed bodies are told apart only for those who ask for the whole tree. A body is one row
and its tree lives in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = re.compile(r"^[ \t]{0,3}(?:>|\|(?=[\s|>]|$)|[A-Z]{1,3}>)[ \t]?")
_DATE = r"(?:\d{1,2}[./ -]\s?(?:\w{3,10}\.?|\d{1,2})[./ -]\s?\d{2,4}|\d{4}-\d\d-\d\d|\w{3,10}\.? \d{1,2},? \d{4})"
_VERB = r"(?:wrote|writes|said|schrieb(?: am| um)?|a écrit|écrivait|escribió|ha scritto|wrote on)"
INTRO = re.compile(rf"(?:{_VERB}\b.{{0,80}}|^quoting\b.{{0,120}}|{_DATE}.{{0,120}}|<[^<>\s]+@[^<>\s]+>\s*)[::]\s*$", re.I)
STRONG = re.compile(rf"^(?:(?:on|am|le|el|den|il)\b.{{0,160}}\b{_VERB}|.{{0,80}}\b{_VERB}\b.{{0,60}}{_DATE}|quoting\b.{{0,80}}<[^<>]+>)[^:]{{0,60}}[::]\s*$|^\S.{{0,160}}<[^<>\s]+@[^<>\s]+>\s*{_VERB}\s*[::]\s*$", re.I)
SEPARATOR = re.compile(
    r"^[ \t]*(?:[-_=*]{2,}\s*(?:original message|original appointment|forwarded (?:message|by)|ursprüngliche (?:nachricht|e-?mail)|(?:weitergeleitete|originale?) (?:nachricht|e-?mail)|message (?:d['’]origine|transféré|original|transmis)|mensaje (?:original|reenviado)|messaggio originale)\b.{0,40}"
    r"|(?:begin forwarded message|anfang der weitergeleiteten (?:nachricht|e-?mail)|début du message (?:réexpédié|transféré)|inicio del mensaje reenviado)\s*:?)\s*$",
    re.I,
)
_CLOSES = re.compile(
    r"^[ \t]*[-_=*]{0,12}\s*(?:end (?:of )?(?:the )?(?:forwarded|original) (?:message|mail|e-?mail)|ende der (?:weitergeleiteten|ursprünglichen) (?:nachricht|e-?mail)|fin du message (?:transféré|réexpédié|d['’]origine)|fin del mensaje (?:reenviado|original))\s*[-_=*]{0,12}[ \t]*$",
    re.I,
)
HEADER = re.compile(r"^[ \t]*\*{0,2}(from|sent|date|to|cc|subject|reply-to|von|gesendet|datum|an|betreff|de|envoyé|date d['’]envoi|à|objet|enviado(?: el)?|fecha|para|asunto|desde)\*{0,2}\s?:\*{0,2}\s*\S?", re.I)
FROM = {"from", "von", "de", "desde"}
CLOSING = re.compile(
    r"^(?:(?:with |my )?(?:best|kind|kindest|warm|warmest)(?: (?:regards|wishes))?|regards|cheers|many thanks(?: and (?:best|kind) (?:wishes|regards))?|thanks(?: (?:again|in advance|a lot|and regards))?|thank you(?: very much)?|thx|br|rgds|yours(?: (?:sincerely|faithfully|truly|ever))?|(?:very )?(?:sincerely|respectfully)(?: yours)?|all the best|take care|talk soon|"
    r"(?:mit )?(?:freundlichen?|besten?|vielen|herzlichen?|lieben?|schönen?) (?:grüßen?|gruß|grüssen?|dank)|(?:viele|beste|liebe|herzliche|schöne|freundliche) (?:grüße|grüsse)|mfg|lg|vg|gruß|grüße|hochachtungsvoll|danke(?: und gruß)?|bis bald|"
    r"(?:bien )?(?:cordialement|amicalement|sincèrement)|bien à (?:vous|toi)|bonne (?:journée|soirée|réception)|salutations(?: distinguées)?|meilleures salutations|merci(?: d['’]avance| beaucoup)?|cdlt|à bientôt|"
    r"(?:un|unos)? ?(?:cordial(?:es)? )?salud(?:o|os)(?: cordial(?:es)?)?|atentamente|atte|un abrazo|abrazos|(?:muchas )?gracias|quedo a su disposición|hasta pronto)"
    r"(?:\s*[,.!;:–—-]+\s*|\s+|$)",
    re.I,
)
DELIMITER = re.compile(r"^[ \t]*(?:--|—|–|[-_*=~#]{2,})[ \t]*$")
DEVICE = re.compile(
    r"^[ \t]*(?:sent (?:from|via|with|using) (?:my|an?|the) \w+.{0,40}|sent from (?:mail|outlook|\w+ for \w+).{0,30}|get (?:the )?\w+(?: app)?(?: for \w+)?|von (?:unterwegs|meinem \w+|mobil)\b.{0,30}gesendet.{0,30}|gesendet (?:von|mit) .{1,40}|diese nachricht wurde von .{1,40} gesendet|envoyé (?:de|depuis|à partir de) (?:mon|ma|un|une) .{1,40}|enviado (?:desde|con) (?:mi|un|una) .{1,40})[ \t]*\.?[ \t]*$",
    re.I,
)
_EXCUSE = re.compile(r",\s*(?:please|so please|excuse|sorry|apologies|forgive|bitte|entschuldig|sorry|désolé|merci de|excusez|pardon|disculp|perdon)", re.I)
CONTACT = re.compile(r"^[ \t]*(?:(?:e|m|t|f|w|p|tel|phone|mobile|mobil|cell|fax|office|direct|mail|e-?mail|web|tél|móvil|teléfono|telefon|büro|correo)\s?[.:]|phone\b|\+?[\d(][\d ()./-]{5,}\d\s*$|\S+@\S+\w\s*$|(?:https?://|www\.)\S+\s*$)", re.I)
LEGAL = re.compile(
    r"registered (?:office|number|in )|company (?:number|registration)|handelsregister|registergericht|siège social|domicilio social|registro mercantil|for its recipient alone|meant only for the|intended (?:solely|only|exclusively|recipient)|(?:may|might) be privileged|(?:may|might) (?:hold|contain|include) (?:protected|confidential|privileged|legally)|reached you (?:by mistake|in error)|received (?:it|this[\w -]{1,20}) (?:in error|by mistake)|delete (?:every copy|all copies|it immediately)|use by others is not permitted|"
    r"copying or passing on|our (?:prior )?written consent|accept no (?:liability|responsibility)|no liability|(?:mail|email|e-mail) is not secure|(?:views|opinions) (?:given|expressed)|those of the author and not|think of the trees|before printing|confidentiality notice|unauthori[sz]ed (?:use|copying|disclosure)|legal notice|"
    r"nur für (?:die|den) (?:\w+ )?(?:genannten |bezeichneten |vorgesehenen )?empfänger|inhalt kann vertraulich|irrtümlich erhalten|löschen sie (?:sie|diese)|zur vertraulichkeit|jede (?:weitergabe|andere|unbefugte)|nicht gestattet|keine haftung|haften nicht|haftungsausschluss|rechtlicher hinweis|"
    r"réservé à (?:son|ses|leur) destinataire|contenu peut être confidentiel|en cas d['’]erreur|merci de le détruire|avis de confidentialité|mentions? légales?|aucune responsabilité|toute (?:diffusion|copie|utilisation|reproduction)|"
    r"dirigido (?:solo|únicamente|exclusivamente) a|contenido puede ser confidencial|recibió por error|bórrelo|aviso (?:legal|de confidencialidad)|no (?:nos hacemos|se hace) responsable|prohibida (?:su|la)",
    re.I,
)
#: A text without any of these (in lower case) has no legal sentence.
_LEGAL_KEYS = (
    "recipient|meant only|intended|privileged|protected|confidential|legally|by mistake|in error|every copy|all copies|immediately|not permitted|passing on|written consent|liability|responsib|not secure|views |opinions |of the author|the trees|before printing|unauthor|legal notice|registered|company |"
    "handelsregister|registergericht|siège social|domicilio social|registro mercantil|empfänger|vertraulich|irrtümlich|löschen sie|jede |nicht gestattet|haftung|haften|hinweis|responsabilit|destinataire|confident|d'erreur|d’erreur|détruire|avis de|mention|toute |dirigido|confidencial|por error|bórrelo|aviso|hace responsable|hacemos responsable|prohibida"
).split("|")
HEADING = re.compile(r"^[ \t*_#-]*(?:disclaimer|confidentiality notice|legal notice|important notice|(?:wichtiger |rechtlicher )?hinweis(?: zur vertraulichkeit)?|haftungsausschluss|avis (?:de confidentialité|important)|mentions? légales?|aviso (?:legal|de confidencialidad|importante)|confidentialité|confidencialidad)[ \t*_:#-]*$", re.I)
_GREETING = re.compile(r"^(?:hi|hello|hey|dear|good (?:morning|afternoon|evening|day)|hallo|guten (?:tag|morgen|abend)|liebe[rs]?|sehr geehrte[rs]?|moin|servus|bonjour|bonsoir|salut|cher|chère|buenos días|buenas (?:tardes|noches)|hola|estimad[oa]s?|querid[oa]s?)\b", re.I)
_NAME = re.compile(r"^(?:[-–—/~]\s?)?(?:(?:dr|prof|mr|mrs|ms|herr|frau|mme|m|sr|sra)\.? )?[^\W\d_a-zß-ÿ][\w'’.-]*(?: (?:von|van|de|der|den|di|la|le|del|zu|af|el|y)\b){0,2}(?: [^\W\d_a-zß-ÿ][\w'’.-]*){0,3}$")


@dataclass
class Node:
    """A piece of a body: its kind, its line numbers (from 1) and the nodes that it encloses."""

    kind: str
    lines: list[int]
    parts: list[Node] = field(default_factory=list)


#: Characters of a line beyond which it is no name, contact or closing.
LONGEST_TAIL = 1000


def _is_name(line: str) -> bool:
    return not re.search(r"\w{3}\.$", line[-4:]) and not any(c.isdigit() for c in line) and bool(_NAME.match(line)) and not _GREETING.match(line)


def _tail_kind(line: str) -> str:
    """What a line could be in the tail of a written block; 'text' if nothing."""
    line = line.strip()
    if len(line) > LONGEST_TAIL:
        return "text"
    if DELIMITER.match(line):
        return "delimiter"
    if DEVICE.match(line) and len(line.split()) <= 8 and ("," not in line or _EXCUSE.search(line)):
        return "device"
    closing = CLOSING.match(line)
    if closing:
        rest = line[closing.end() :].strip()
        if not rest or _is_name(rest):
            return "closing"
    if CONTACT.match(line):
        return "contact"
    if _is_name(line):
        return "name"
    if len(line) <= 64 and not re.search(r"[.?!:;,]$", line) and not re.match(r"^(?:--? .* --?$|[-*•]\s|\d+[.)]\s)", line) and not _GREETING.match(line) and len(line.split()) <= 9:
        return "short"
    return "text"


def _notices(lines: list[tuple[int, str]]) -> set[int]:
    """Positions of legal notices: paragraphs of which half the sentences or more are legal, with rules and headings before them."""
    out: set[int] = set()
    whole = " ".join(x.strip() for _, x in lines)
    low = whole.lower()
    if not any(key in low for key in _LEGAL_KEYS) or not LEGAL.search(whole):
        return out
    at = 0
    while at < len(lines):
        if not lines[at][1].strip():
            at += 1
            continue
        end = at
        while end < len(lines) and lines[end][1].strip():
            end += 1
        # A rule, heading or signature may stand on top of the notice without a blank line.
        for start in range(at, end):
            if start > at and not (DELIMITER.match(lines[start - 1][1]) or HEADING.match(lines[start - 1][1]) or LEGAL.search(lines[start][1]) or HEADING.match(lines[start][1])):
                continue
            text = " ".join(x.strip() for _, x in lines[start:end])
            sentences = [s for s in re.split(r"(?<=[.!?])\s+", text) if s]
            if LEGAL.search(text) and sum(bool(LEGAL.search(s)) for s in sentences) * 2 >= len(sentences):
                out |= set(range(start, end))
                break
        at = end
    for k in sorted(out):
        back = k - 1
        while back >= 0 and back not in out:
            line = lines[back][1]
            if HEADING.match(line) or DELIMITER.match(line):
                out |= set(range(back, k))
            elif line.strip():
                break
            back -= 1
    return out


def _written(lines: list[tuple[int, str]], final: bool) -> list[Node]:
    """A written block as text, signature and notice nodes."""
    notices = _notices(lines)
    solid = [k for k, (_, x) in enumerate(lines) if x.strip()]
    zone: list[tuple[int, str]] = []
    for k in reversed([k for k in solid if k not in notices]):
        kind = _tail_kind(lines[k][1])
        if kind == "text":
            break
        zone.append((k, kind))
        if kind == "closing":
            break
    zone.reverse()
    start = None
    for k, kind in zone:
        if kind in ("closing", "device"):
            start = k
            break
    if start is None:
        kinds = [kind for _, kind in zone]
        anchored = any(x in ("name", "delimiter", "contact") for x in kinds)
        if anchored:
            first = next((k for k, kind in zone if kind in ("name", "delimiter")), None)
            start = first if first is not None else next(k for k, kind in zone if kind == "contact")
    elif lines and start is not None:
        # A device notice may follow a name or a delimiter that opens the signature.
        earlier = [k for k, kind in zone if kind in ("name", "delimiter") and k < start]
        start = min([start, *earlier])
    if start is not None and start == (solid[0] if solid else None) and not final:
        only = [kind for k, kind in zone]
        if only == ["name"]:
            start = None
    text, signature, legal = [], [], []
    for k, (n, _) in enumerate(lines):
        (legal if k in notices else signature if start is not None and k >= start else text).append(n)
    return [Node(kind, own) for kind, own in (("text", text), ("signature", signature), ("notice", legal)) if own]


def _header_block(lines: list[tuple[int, str]], at: int) -> int:
    """How many lines a block of message headers has that starts here: a sender, and two headers or more; 0 if there is none."""
    first = HEADER.match(lines[at][1]) if ":" in lines[at][1] else None
    if not first or first[1].lower() not in FROM:
        return 0
    seen, k, off = 1, at + 1, 0
    while k < len(lines) and lines[k][1].strip() and off < 2:  # a header may go on in the next line
        header = bool(HEADER.match(lines[k][1]))
        seen, off, k = seen + header, 0 if header else off + 1, k + 1
    return k - off - at if seen >= 2 else 0


def _intro(lines: list[tuple[int, str]], at: int) -> int:
    """How many lines, ending before `at`, introduce the quotation that starts at `at`."""
    k = at - 1
    while k >= 0 and not lines[k][1].strip():
        k -= 1
    if k < 0 or at - k > 3:
        return 0
    for size in (1, 2, 3):
        if k - size + 1 < 0 or not lines[k - size + 1][1].strip():
            break
        joined = " ".join(x.strip() for _, x in lines[k - size + 1 : k + 1])
        if not INTRO.search(joined):
            if size == 1 and not re.search(r"[::]\s*$", joined):
                break
            continue
        if size == 1 and re.match(r"^\s*(?:<|\S+\s*<?\S+@|(?:wrote|schrieb|escribió|a écrit)\b|\d|\w+ (?:wrote|schrieb|escribió|a écrit)\b)", lines[k][1]) and not re.match(r"^\s*\d{4}-\d\d-\d\d", lines[k][1]):
            above = lines[k - 1][1].strip() if k else ""
            if above and not re.search(r"[.!?]$", above) and len(above) < 90 and re.match(r"^(?:on|am|le|el|quoting|\d{4}-)\b|^[^\W\d_a-z]\w+ ", above, re.I):
                return at - (k - 1)
        return at - (k - size + 1)
    return 0


_OPENERS = frozenset("-_=*bBaAdDiI")


def _opens(lines: list[tuple[int, str]], at: int) -> int:
    """How many lines open a forwarded message here; 0 if none does."""
    line = lines[at][1]
    if line.lstrip()[:1] in _OPENERS and SEPARATOR.match(line):
        return 1
    if ":" in line or "：" in line:
        size = _header_block(lines, at)
        if size:
            return size
    if DELIMITER.match(line) and at + 1 < len(lines):
        size = _header_block(lines, at + 1)
        if size:
            return 1 + size
    if line.strip() and (":" in line or "：" in line or (at + 1 < len(lines) and ":" in lines[at + 1][1])):
        for size in (1, 2):
            joined = " ".join(x.strip() for _, x in lines[at : at + size])
            if joined[-1:] in "::" and STRONG.match(joined):
                ahead = at + size
                while ahead < len(lines) and not lines[ahead][1].strip():
                    ahead += 1
                # Followed by prefixed lines it only introduces those.
                return size if ahead < len(lines) and not PREFIX.match(lines[ahead][1]) else 0
    return 0


def _prefixed_end(lines: list[tuple[int, str]], at: int) -> int:
    """Where the run of prefixed lines (and blank ones between them) that starts here ends."""
    end = at
    while end < len(lines):
        if PREFIX.match(lines[end][1]):
            end += 1
            continue
        ahead = end
        while ahead < len(lines) and not lines[ahead][1].strip():
            ahead += 1
        if ahead == end or ahead == len(lines) or not PREFIX.match(lines[ahead][1]):
            break
        end = ahead
    return end


def _blocks(lines: list[tuple[int, str]]) -> list[tuple[Node, list[tuple[int, str]]]]:
    """The blocks of a body in order, each with the lines of what it encloses (of a written block, its own)."""
    blocks: list[tuple[Node, list[tuple[int, str]]]] = []
    written: list[tuple[int, str]] = []

    def close() -> None:
        if any(x.strip() for _, x in written):
            blocks.append((Node("written", [n for n, _ in written]), list(written)))
        written.clear()

    at = 0
    while at < len(lines):
        if PREFIX.match(lines[at][1]):
            size = _intro(lines, at) if written else 0
            intro = lines[at - size : at] if size else []
            if size:
                del written[len(written) - size :]
            close()
            end = _prefixed_end(lines, at)
            blocks.append((Node("quoted", [n for n, _ in [*intro, *lines[at:end]]]), [(n, PREFIX.sub("", x, count=1)) for n, x in lines[at:end]]))
            at = end
            continue
        size = _opens(lines, at)
        if not size:
            written.append(lines[at])
            at += 1
            continue
        close()
        before = any(node.kind == "written" for node, _ in blocks)
        start = body = at + size
        while body < len(lines) and not lines[body][1].strip():
            body += 1
        if not before and body < len(lines) and PREFIX.match(lines[body][1]):
            end = stop = _prefixed_end(lines, body)
        else:
            stop = next((k for k in range(start, len(lines)) if _CLOSES.match(lines[k][1])), len(lines))
            end = min(len(lines), stop + 1)
        blocks.append((Node("forwarded", [n for n, _ in lines[at:end]]), lines[start:stop]))
        at = end
    close()
    return blocks


def parse(lines: list[tuple[int, str]], whole: bool = False) -> list[Node]:
    """The nodes of a body, given as numbered lines, with all that they enclose.

    Written blocks become text, signature and notice nodes in the outermost body, and with
    `whole` in every body. Bodies wait on a list, so that no depth of nesting is too deep.
    """
    top: list[Node] = []
    waiting = [(lines, top, True)]
    while waiting:
        own, out, outer = waiting.pop()
        blocks = _blocks(own)
        for k, (node, inner) in enumerate(blocks):
            if node.kind != "written":
                out.append(node)
                waiting.append((inner, node.parts, False))
            elif outer or whole:
                out.extend(_written(inner, k == len(blocks) - 1))
            else:
                out.append(node)
    return top


def serialised(nodes: list[Node]) -> set[int]:
    """The lines of the newly written nodes: text that nothing encloses."""
    return {n for node in nodes if node.kind == "text" for n in node.lines}


def flattened(nodes: list[Node]) -> list[tuple[int, str, int, int]]:
    """Every node as (depth, kind, first line, number of lines), in the order of its first line."""
    out = []
    waiting = [(node, 0) for node in nodes]
    while waiting:
        node, depth = waiting.pop()
        out.append((depth, node.kind, node.lines[0], len(node.lines)))
        waiting.extend((part, depth + 1) for part in node.parts)
    return sorted(out, key=lambda x: (x[2], x[0], x[1]))


def split_body(body: str) -> tuple[list[int], str]:
    """Numbers of the lines that aren't newly written (blank ones aside), and the newly written text."""
    raw = body.split("\n")
    lines = [(k, x.rstrip("\r")) for k, x in enumerate(raw, 1)]
    kept = serialised(parse(lines))
    other = [n for n, x in lines if x.strip() and n not in kept]
    text = "\n".join(x.rstrip() for n, x in lines if n in kept or not x.strip())
    return other, re.sub(r"\n{3,}", "\n\n", text).strip("\n")


def newly_written(df: DataFrame, email_id: str, body: str) -> DataFrame:
    """Each message with the numbers of its other lines and its own text.

    Result: `email_id`, `other_lines` (array, from 1, without blank lines) and `new_text`.
    A null body has no lines and a null text, an empty one an empty text; LF and CRLF
    bodies are read alike; rows repeated count by themselves; extra columns are dropped.
    """
    own = df.select(F.col(f"`{email_id}`").alias("_id"), F.col(f"`{body}`").alias("_body"))
    kind = own.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [split_body(b) if b else ([], b) for b in batch["_body"]]
            yield pd.DataFrame({"_id": batch["_id"], "other_lines": [a for a, _ in both], "new_text": [t for _, t in both]})

    return own.mapInPandas(run, f"_id {kind}, other_lines array<int>, new_text string").withColumnRenamed("_id", email_id)


def layout(df: DataFrame, email_id: str, body: str) -> DataFrame:
    """The whole tree of each body, a row per node: `email_id`, `depth` (0 outermost), `node_kind`, `first_line`, `n_lines`.

    Kinds are text, signature, notice, quoted and forwarded. Null and empty bodies have no
    nodes; rows repeated count by themselves; extra columns are dropped.
    """
    own = df.select(F.col(f"`{email_id}`").alias("_id"), F.col(f"`{body}`").alias("_body")).where("_body <> ''")
    kind = own.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, *node) for key, text in zip(batch["_id"], batch["_body"]) for node in flattened(parse([(k, x.rstrip("\r")) for k, x in enumerate(text.split("\n"), 1)], whole=True))]
            yield pd.DataFrame(rows, columns=["_id", "depth", "node_kind", "first_line", "n_lines"])

    return own.mapInPandas(run, f"_id {kind}, depth int, node_kind string, first_line int, n_lines int").withColumnRenamed("_id", email_id)
