"""Expressions over text: tokens, previews, names of files, clock times."""

from __future__ import annotations

import unicodedata
from functools import cache
from urllib.parse import unquote, unquote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a question doesn't search for.
STOPWORDS = "a an and are as at be by did do does for from how in is it of on or say said the that this to was were what when where which who why with".split()


@cache
def fold_maps() -> tuple[str, str]:
    """Letters that decompose to one letter and marks, and that letter."""
    source, target = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x0370, 0x0530), *range(0x1E00, 0x2000)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code).lower()) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


def unaccented(text: Column) -> Column:
    """Lower case without accents; a text of one byte a character has none."""
    source, target = fold_maps()
    folded = F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}", ""), source, target)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded)


def words(text: Column) -> Column:
    """The runs of letters or digits, without case and accents."""
    return F.regexp_extract_all(unaccented(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def index_tokens(text: Column) -> Column:
    """Tokens of the full-text index: runs of letters, digits and private-use characters, without accents."""
    return F.filter(F.split(unaccented(text), r"[^\p{L}\p{N}\p{Co}]+"), lambda w: w != "")


def index_text(text: Column) -> Column:
    """The index tokens as one string with single spaces."""
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    return F.trim(F.when(F.octet_length(text) == F.length(text), plain).otherwise(F.regexp_replace(unaccented(text), r"[^\p{L}\p{N}\p{Co}]+", " ")))


def question_tokens(text: Column) -> Column:
    """Tokens of questions and passages: lower case, accents kept, without stop words."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~F.array_contains(stop, w))


def clipped(text: Column, size: int) -> Column:
    """Trimmed, and cut to `size` characters with an ellipsis."""
    plain = F.trim(text)
    return F.when(F.length(plain) > size, F.concat(F.substring(plain, 1, size), F.lit("…"))).otherwise(plain)


def preview(text: Column, size: int = 160) -> Column:
    """One line of at most `size` characters."""
    return clipped(F.regexp_replace(text, r"\s+", " "), size)


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, white space collapsed; a block needs a letter."""
    blocks = F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n[ \t]*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.filter(blocks, lambda p: p.rlike(r"\p{L}"))


def slug(text: Column, size: int = 60) -> Column:
    """Lower-case letters and digits with single dashes."""
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(plain, "^-+|-+$", ""), 1, size), "-+$", "")


def safe_file_name(name: Column, size: int = 96) -> Column:
    """The last component of an untrusted name, with odd characters as underscores."""
    last = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"[^\p{L}\p{N}._ -]", "_")
    last = F.regexp_replace(F.trim(last), r"^\.+", "")
    return F.when(last == "", F.lit("file")).otherwise(F.substring(last, 1, size))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def key_suffix(key: Column) -> Column:
    """What follows the last colon or dot of a metadata key."""
    return F.regexp_extract(key, r"([^:.]*)$", 1)


def clock(seconds: Column) -> Column:
    """h:mm:ss or m:ss, truncated."""
    whole = F.floor(F.greatest(seconds, F.lit(0.0))).cast("long")
    h, m, s = F.floor(whole / 3600).cast("long"), F.floor(F.pmod(whole, F.lit(3600)) / 60).cast("long"), F.pmod(whole, F.lit(60))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def stamp(seconds: Column) -> Column:
    """hh:mm:ss.mmm, rounded to the millisecond."""
    ms = F.round(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    part = lambda size, top: F.pmod(F.floor(ms / size).cast("long"), F.lit(top))
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000).cast("long"), part(60_000, 60), part(1000, 60), F.pmod(ms, F.lit(1000)))


def citations(text: Column) -> Column:
    """Numbers cited as [n] or [n, m], distinct and ascending."""
    groups = F.regexp_extract_all(text, F.lit(r"\[(\d{1,6}(?:\s*,\s*\d{1,6})*)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r"\s*,\s*"), lambda n: n.cast("int"))))))


#: Words that open a question, and phrases by tone.
QUESTION_OPENERS = ("who", "what", "when", "where", "why", "how", "which", "whose")
URGENT = (
    "urgent", "urgently", "asap", "as soon as possible", "immediately", "emergency", "right away", "right now", "time-sensitive", "time sensitive", "act now", "at once", "hurry", "deadline", "critical",
)
COMPLAINT = (
    "complain", "complaint", "complaints", "refund", "unacceptable", "disappointed", "disappointing", "frustrated", "frustrating", "broken", "doesn't work", "does not work", "didn't work", "did not work", "not working", "stopped working",
    "worst", "terrible", "awful", "horrible", "rip-off", "ripoff", "rip off", "useless", "waste of", "still waiting", "never arrived", "no response", "never answered", "faulty", "defective", "overcharged", "poor service",
)


def tones(text: Column, label: Column | None = None) -> Column:
    """Tags of a text: question, urgent, and complaint where its `label` is negative."""
    edge = r"[!-&(-/:-@\[-`{-~]+"
    words = F.transform(F.split(F.trim(text, F.lit(" \n\r\t\f")), r"\s+"), lambda w: F.replace(F.lower(F.regexp_replace(w, f"^{edge}|{edge}$", "")), F.lit("’"), F.lit("'")))
    words = F.filter(words, lambda w: w != "")
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    holds = lambda phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(line, F.concat(F.lit(" "), p, F.lit(" "))))
    end = F.regexp_replace(text, r"\s+$", "")
    asks = F.endswith(end, F.lit("?")) | F.contains(end, F.lit("? ")) | ((F.size(words) >= 3) & F.try_element_at(words, F.lit(1)).isin(*QUESTION_OPENERS))
    urgent = holds(URGENT) | (F.regexp_count(text, F.lit("!")) >= 3)
    complaint = (F.lit("neutral") if label is None else label).eqNullSafe(F.lit("negative")) & holds(COMPLAINT)
    return F.array_compact(F.array(F.when(asks, F.lit("question")), F.when(urgent, F.lit("urgent")), F.when(complaint, F.lit("complaint"))))


def percent_decoded(text: Column, plus: bool = True) -> Column:
    """%XX as bytes of UTF-8, and + as a space in queries; what is no code stays."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else (unquote_plus if plus else unquote)(t, errors="replace"))

    return run(text)


def query_parameters(query: Column) -> Column:
    """A map of the parameters of a URL's query; the first of a repeated name counts."""

    @F.pandas_udf("map<string,string>")
    def run(batch: pd.Series) -> pd.Series:
        def one(q):
            out: dict[str, str] = {}
            for part in (q or "").lstrip("?").split("&"):
                name, _, value = part.partition("=")
                if name:
                    out.setdefault(unquote_plus(name, errors="replace"), unquote_plus(value, errors="replace"))
            return out

        return batch.map(one)

    return run(query)


def wrapped(text: Column, width: int) -> Column:
    """Lines of at most `width` characters, cut at white space where they can; tabs are four spaces, other control characters go."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\t", "    "), "\r\n?", "\n"), r"[\p{Cntrl}&&[^\n]]", "")
    fold = lambda line: F.when(line == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(line, F.lit(rf"(?:\S.{{0,{width - 2}}}\S|\S)(?=\s|$)|\S{{{width}}}|\S+"), F.lit(0)))
    return F.flatten(F.transform(F.split(plain, "\n"), fold))


def table_name(name: Column) -> Column:
    """The table of options of a plugin: trimmed, with _ for -."""
    return F.replace(F.trim(name), F.lit("-"), F.lit("_"))


def base_type(content_type: Column) -> Column:
    """A media type without its parameters, in lower case."""
    return F.lower(F.trim(F.split(content_type, ";")[0]))


def tidied(text: Column) -> Column:
    """Lines without white space at their ends; runs of blank lines become one, and none stands at either end."""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"(?m)[^\S\n]+$", "")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^\n+|\s+$", "")


def picked(answer: Column, categories: list[str]) -> Column:
    """The category that an answer names first, without regard to case; of equal places the first of the list."""
    low = F.lower(answer)
    places = F.array(*(F.struct(F.locate(c.lower(), low).alias("at"), F.lit(k).alias("k"), F.lit(c).alias("name")) for k, c in enumerate(categories)))
    return F.array_min(F.filter(places, lambda p: p["at"] > 0))["name"]


def topics(answer: Column, most: int = 5, longest: int = 60) -> Column:
    """Short topics of an answer, from its lines and commas, without the marks of lists; each once without regard to case."""
    clean = lambda t: F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(t), r"^[0-9*•.)\-]+", "")), r'^[".]+|[".]+$', ""))
    parts = F.filter(F.transform(F.split(answer, r"[\n,]"), clean), lambda t: (t != "") & (F.length(t) <= longest) & ~F.endswith(t, F.lit(":")))
    fresh = F.filter(F.transform(parts, lambda t, i: F.when(~F.exists(F.slice(parts, 1, i), lambda o: F.lower(o) == F.lower(t)), t)), lambda t: t.isNotNull())
    return F.slice(fresh, 1, most)
