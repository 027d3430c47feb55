"""HTML, bookmarks, word boxes of pages, subtitles."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SKIP = {"script", "style", "template", "noscript", "svg", "math", "iframe", "object"}
_BLOCK = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "table", "tr", "ul", "ol", "dl", "dt", "dd", "blockquote", "figure", "figcaption", "form", "fieldset", "address", "hr", "body", "html"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title: str | None = None
        self.skip = 0
        self.lists = 0
        self.pre = 0
        self.in_title = False
        self.cells = 0

    def line(self, blank: bool = False) -> None:
        while self.out and self.out[-1] == " ":
            self.out.pop()
        if self.out and not self.out[-1].endswith("\n"):
            self.out.append("\n")
        if blank and self.out:
            self.out.append("\n")

    def handle_starttag(self, tag, attrs) -> None:
        if tag in _SKIP:
            self.skip += 1
        if self.skip:
            return
        if tag == "title":
            self.in_title = self.title is None
        elif re.fullmatch("h[1-6]", tag):
            self.line(True)
            self.out.append("#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.line()
            self.lists += 1
        elif tag == "li":
            self.line()
            self.out.append("  " * max(0, self.lists - 1) + "- ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "pre":
            self.line()
            self.pre += 1
        elif tag in ("td", "th"):
            if self.cells:
                self.out.append("\t")
            self.cells += 1
        elif tag == "img":
            alt = (dict(attrs).get("alt") or "").strip()
            if alt:
                self.out.append(f" [image: {alt}] ")
        elif tag in _BLOCK:
            self.line()
            if tag == "tr":
                self.cells = 0

    def handle_endtag(self, tag) -> None:
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag == "title":
            self.in_title = False
        elif re.fullmatch("h[1-6]", tag):
            self.line(True)
        elif tag in ("ul", "ol"):
            self.lists = max(0, self.lists - 1)
            self.line()
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.line()
        elif tag in _BLOCK or tag == "li":
            self.line()

    def handle_data(self, data) -> None:
        if self.skip:
            return
        if self.in_title:
            self.title = (self.title or "") + data
        elif self.pre:
            self.out.append(data)
        else:
            plain = re.sub(r"\s+", " ", data.replace("\xa0", " "))
            if plain == " " and (not self.out or self.out[-1].endswith(("\n", " "))):
                return
            if self.out and self.out[-1].endswith(("\n", " ")):
                plain = plain.lstrip(" ")
            if plain:
                self.out.append(plain)


def html_to_text(source: str) -> tuple[str, str | None]:
    """Readable text of an HTML source, and its title. A single main element, else a single article, stands for the page."""
    scope = source
    for tag in ("main", "article"):
        found = re.findall(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", source)
        if len(found) == 1:
            scope = found[0]
            break
    reader = _Reader()
    reader.feed(scope)
    reader.close()
    title = reader.title
    if title is None and (m := re.search(r"(?is)<title[^>]*>(.*?)</title>", source)):
        title = html.unescape(m[1])
    text = re.sub(r"[ \t]+\n", "\n", "".join(reader.out))
    text = re.sub(r"\n{3,}", "\n\n", text).strip("\n")
    return (text + "\n" if text else "", " ".join(title.split()) if title and title.strip() else None)


def readable(source: Column) -> Column:
    """`text` and `title` of HTML; a text without a first-level heading gets its title as one."""

    @F.pandas_udf("text string, title string")
    def run(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for s in batch:
            text, title = html_to_text(s) if s is not None else (None, None)
            if text is not None and title and not re.search(r"(?m)^# ", text):
                text = f"# {title}\n\n{text}"
            rows.append((text, title))
        return pd.DataFrame(rows, columns=["text", "title"])

    return run(source)


_TIME = re.compile(r"^\s*(?:(\d+):)?(\d{1,2}):(\d{2})[,.](\d{3})\s*-->\s*(?:(\d+):)?(\d{1,2}):(\d{2})[,.](\d{3})")


def cues(source: str) -> tuple[list[tuple[float, float, str]], int]:
    """Cues of SRT or WebVTT as (start, end, text), and how many time lines couldn't be read."""
    out, bad = [], 0
    for block in re.split(r"\n[ \t]*\n", source.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")):
        lines = block.split("\n")
        at = next((i for i, x in enumerate(lines) if "-->" in x), None)
        if at is None:
            continue
        m = _TIME.match(lines[at])
        if not m:
            bad += 1
            continue
        a, b = (int(m[k] or 0) * 3600 + int(m[k + 1]) * 60 + int(m[k + 2]) + int(m[k + 3]) / 1000 for k in (1, 5))
        if b < a:
            bad += 1
            continue
        text = re.sub(r"<[^>]*>", "", "\n".join(lines[at + 1 :]))
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
            text = text.replace(entity, char)
        if text.strip():
            out.append((a, b, text.strip()))
    return sorted(out, key=lambda c: c[:2]), bad


def cue_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """`key`, `start_seconds`, `end_seconds`, `text`, in the order of time."""
    parse = F.pandas_udf(lambda s: s.map(lambda t: [{"start_seconds": a, "end_seconds": b, "text": c} for a, b, c in cues(t)[0]] if t else []), "array<struct<start_seconds double, end_seconds double, text string>>")
    return df.select(F.col(key), F.inline(parse(F.col(text))))


def bookmarks(source: Column) -> Column:
    """Links of a Netscape bookmark file as (`url`, `title`, `folders`); of a repeated link the first."""

    @F.pandas_udf("array<struct<url string, title string, folders array<string>>>")
    def run(batch: pd.Series) -> pd.Series:
        def one(s):
            out, folders, pending, seen = [], [], None, set()
            for m in re.finditer(r'(?is)<h3[^>]*>(.*?)</h3>|<dl\b[^>]*>|</dl>|<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', s or ""):
                token = m[0].lower()
                if token.startswith("<h3"):
                    pending = html.unescape(re.sub("<[^>]*>", "", m[1])).strip()
                elif token.startswith("<dl"):
                    folders.append(pending)
                    pending = None
                elif token.startswith("</dl"):
                    folders = folders[:-1]
                elif m[2] is not None and re.match("(?i)https?://", m[2]) and m[2] not in seen:
                    seen.add(m[2])
                    out.append({"url": html.unescape(m[2]), "title": html.unescape(re.sub("<[^>]*>", "", m[3])).strip(), "folders": [f for f in folders if f]})
            return out

        return batch.map(one)

    return run(source)


def link_list(source: Column) -> Column:
    """Links of a plain list, a line each: only http and https, each once, the first counts."""
    lines = F.transform(F.split(source, r"\r?\n"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(lines, lambda x: x.rlike(r"(?i)^https?://\S+$")))


def page_words(xhtml: Column) -> Column:
    """Words of `<page>` and `<word>` elements as boxes in parts of the page: `page`, `text`, `x`, `y`, `width`, `height`."""

    @F.pandas_udf("array<struct<page int, text string, x double, y double, width double, height double>>")
    def run(batch: pd.Series) -> pd.Series:
        def one(s):
            out, page, w, h = [], 0, 1.0, 1.0
            for m in re.finditer(r'(?is)<page\s+width="([\d.]+)"\s+height="([\d.]+)"|<word\s+xMin="([\d.]+)"\s+yMin="([\d.]+)"\s+xMax="([\d.]+)"\s+yMax="([\d.]+)"\s*>(.*?)</word>', s or ""):
                if m[1]:
                    page, w, h = page + 1, float(m[1]) or 1.0, float(m[2]) or 1.0
                elif m[7].strip():
                    x0, y0, x1, y1 = (float(m[k]) for k in (3, 4, 5, 6))
                    out.append({"page": page, "text": html.unescape(m[7]).strip(), "x": x0 / w, "y": y0 / h, "width": (x1 - x0) / w, "height": (y1 - y0) / h})
            return out

        return batch.map(one)

    return run(xhtml)


def recognised_words(tsv: Column, width: Column, height: Column) -> Column:
    """Words of a recogniser's table (level ... left top width height conf text) as boxes; words of negative confidence are dropped."""
    rows = F.transform(F.filter(F.split(tsv, "\n"), lambda r: F.size(F.split(r, "\t")) >= 12), lambda r: F.split(r, "\t", 12))
    number = lambda r, k: F.try_element_at(r, F.lit(k)).try_cast("double")
    words = F.transform(rows, lambda r: F.struct(F.try_element_at(r, F.lit(12)).alias("text"), (number(r, 7) / width).alias("x"), (number(r, 8) / height).alias("y"), (number(r, 9) / width).alias("width"), (number(r, 10) / height).alias("height"), (number(r, 11) / 100).alias("confidence")))
    return F.filter(words, lambda w: (w["confidence"] >= 0) & (F.trim(w["text"]) != ""))
