"""Dates and times mentioned in text.

A text is read as tokens: numbers, words and signs, each with whether white space stands
before it. Small readers try to read a mention from a token on. They come in an order;
an earlier reader takes its tokens from the later ones, whatever their place in the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, timedelta
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NAMES = "january february march april may june july august september october november december".split()
_MONTHS = {name: i for i, name in enumerate(_NAMES, 1)} | {name[:3]: i for i, name in enumerate(_NAMES, 1)} | {"sept": 9}
_DAYS = {name: i for i, name in enumerate("monday tuesday wednesday thursday friday saturday sunday".split())}
#: Short names of days, which only lead a date.
_SHORT_DAYS = frozenset("mon tue tues wed thu thur thurs fri sat sun".split())
_COUNTS = {"a": 1} | {word: i for i, word in enumerate("one two three four five six seven".split(), 1)}
_SHIFTS = {"today": 0, "tonight": 0, "yesterday": -1, "tomorrow": 1}
_ORDINALS = frozenset(("st", "nd", "rd", "th"))
_TOKEN = re.compile(r"\d+|[^\W\d_]+|\S")


class _Token(NamedTuple):
    text: str
    start: int
    end: int
    apart: bool

    @property
    def number(self) -> int | None:
        return int(self.text) if self.text.isascii() and self.text.isdigit() else None


class Mention(NamedTuple):
    """Characters from `start` to `end`; `kind` is date, time or datetime."""

    start: int
    end: int
    kind: str
    iso: str | None
    relative: bool


class _Reader:
    """Tokens of a text, and the mentions that may begin at one of them."""

    def __init__(self, text: str, reference: date | None, order: str) -> None:
        found = [(m[0].lower(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
        ends = [0, *(e for *_, e in found)]
        self.tokens = [_Token(w, a, b, k == 0 or a > ends[k]) for k, (w, a, b) in enumerate(found)]
        self.reference, self.order = reference, order

    def at(self, k: int) -> _Token:
        return self.tokens[k] if k < len(self.tokens) else _Token("", 0, 0, True)

    def joined(self, k: int, *texts: str) -> bool:
        """Whether the token stands right after the one before and is one of these."""
        return not self.at(k).apart and self.at(k).text in texts

    def digits(self, k: int, least: int, most: int, apart: bool | None = None) -> int | None:
        t = self.at(k)
        return t.number if least <= len(t.text) <= most and (apart is None or t.apart == apart) else None

    def bounded(self, first: int, after: int) -> bool:
        """Whether no letter, digit or underscore stands right before the first token or right after the last."""
        glued = lambda t: not t.apart and (t.text[:1].isalnum() or t.text == "_")
        before = first and not self.at(first).apart and (self.at(first - 1).text[-1:].isalnum() or self.at(first - 1).text == "_")
        return not before and not glued(self.at(after))

    def clock(self, k: int) -> tuple[str, int] | None:
        """hh:mm or hh:mm:ss from a token on, and the token after it."""
        hour = self.digits(k, 1, 2)
        minute = self.digits(k + 2, 2, 2, False) if self.joined(k + 1, ":") else None
        if hour is None or minute is None or hour > 23 or minute > 59:
            return None
        second = self.digits(k + 4, 2, 2, False) if self.joined(k + 3, ":") else None
        if second is not None and second < 60:
            return f"{hour:02d}:{minute:02d}:{second:02d}", k + 5
        return f"{hour:02d}:{minute:02d}:00", k + 3

    def written_first(self, k: int) -> tuple[str, str | None, bool, int] | None:
        """Year first, with - or /; a time may follow."""
        y, m, d = self.digits(k, 4, 4), self.digits(k + 2, 1, 2, False), self.digits(k + 4, 1, 2, False)
        if None in (y, m, d) or not self.joined(k + 1, "-", "/") or not self.joined(k + 3, "-", "/"):
            return None
        day = _calendar(y, m, d)
        if not day:
            return None
        after = k + 5
        time = self.clock(after + 1) if self.joined(after, "t") else self.clock(after) if self.at(after).apart else None
        if time and self.bounded(k, time[1]):
            return "datetime", f"{day}T{time[0]}", False, time[1]
        return "date", day.isoformat(), False, after

    def _led(self, k: int) -> int:
        """The token after the name of a day that leads a date."""
        if self.at(k).text in _SHORT_DAYS or self.at(k).text in _DAYS:
            k += 1
            k += self.joined(k, ".")
            k += self.joined(k, ",")
        return k

    def _month(self, k: int) -> tuple[int, int] | None:
        month = _MONTHS.get(self.at(k).text)
        return (month, k + 1 + self.joined(k + 1, ".")) if month else None

    def _day(self, k: int) -> tuple[int, int] | None:
        day = self.digits(k, 1, 2)
        return None if day is None else (day, k + 1 + self.joined(k + 1, *_ORDINALS))

    def _year(self, k: int) -> tuple[int | None, int]:
        at = k + (self.at(k).text == "," and not self.at(k).apart)
        year = self.digits(at, 4, 4)
        return (year, at + 1) if year is not None and (self.at(at).apart or at > k) else (None, k)

    def named(self, k: int) -> tuple[str, str | None, bool, int] | None:
        """Day and month in words, in either order; the year may be left out."""
        at = self._led(k)
        if day := self._day(at):
            month = self._month(day[1] + (self.at(day[1]).text == "of"))
            after = month[1] if month else at
        else:
            month = self._month(at)
            day = self._day(month[1]) if month else None
            if day and self.joined(day[1], ":"):
                return None  # a time
            after = day[1] if day else at
        if not month or not day:
            return None
        year, after = self._year(after)
        if year is not None:
            found = _calendar(year, month[0], day[0])
            return ("date", found.isoformat(), False, after) if found else None
        if not _calendar(2000, month[0], day[0]):
            return None
        if self.reference is None:
            return "date", f"--{month[0]:02d}-{day[0]:02d}", True, after
        found = _calendar(self.reference.year, month[0], day[0])
        return ("date", found.isoformat(), True, after) if found else None

    def numeric(self, k: int) -> tuple[str, str | None, bool, int] | None:
        """Numbers with slashes or dots, the year last; two digits of a year turn over at 70."""
        a, b = self.digits(k, 1, 2), self.digits(k + 2, 1, 2, False)
        year, size = self.digits(k + 4, 2, 4, False), len(self.at(k + 4).text)
        if None in (a, b, year) or size == 3 or not self.joined(k + 1, "/", ".") or not self.joined(k + 3, self.at(k + 1).text):
            return None
        if (size == 2 and self.at(k + 1).text == ".") or self.joined(k + 5, ".", "/") and self.digits(k + 6, 1, 9, False) is not None:
            return None  # a version
        if k >= 2 and not self.at(k).apart and self.at(k - 1).text in "./" and not self.at(k - 1).apart:
            return None
        year += (2000 if year < 70 else 1900) if size == 2 else 0
        day_first = a > 12 or (b <= 12 and self.order == "dmy")
        found = _calendar(year, b if day_first else a, a if day_first else b)
        return ("date", found.isoformat(), False, k + 5) if found else None

    def _from_reference(self, days: int, after: int) -> tuple[str, str | None, bool, int]:
        return "date", (self.reference + timedelta(days=days)).isoformat() if self.reference else None, True, after

    def day_word(self, k: int) -> tuple[str, str | None, bool, int] | None:
        shift = _SHIFTS.get(self.at(k).text)
        return None if shift is None else self._from_reference(shift, k + 1)

    def weekday(self, k: int) -> tuple[str, str | None, bool, int] | None:
        """last, next or this before the name of a day; alone it is the nearest one, past or to come."""
        which = self.at(k).text if self.at(k).text in ("last", "next", "this") else None
        at = k + (which is not None)
        day = _DAYS.get(self.at(at).text)
        if day is None:
            return None
        ahead = (day - self.reference.weekday()) % 7 if self.reference else 0
        shift = {"last": ahead - 7, "next": ahead or 7, "this": ahead}.get(which, ahead if ahead <= 3 else ahead - 7)
        return self._from_reference(shift, at + 1)

    def offset(self, k: int) -> tuple[str, str | None, bool, int] | None:
        """in N days or weeks, N days or weeks ago."""
        ahead = self.at(k).text == "in"
        at = k + ahead
        n = _COUNTS.get(self.at(at).text, self.digits(at, 1, 3))
        unit = {"day": 1, "days": 1, "week": 7, "weeks": 7}.get(self.at(at + 1).text)
        if n is None or unit is None or not (ahead or self.at(at + 2).text == "ago"):
            return None
        return self._from_reference(n * unit * (1 if ahead else -1), at + 2 + (not ahead))

    def half_day(self, k: int) -> tuple[str, str | None, bool, int] | None:
        """A time with a.m. or p.m."""
        hour = self.digits(k, 1, 2)
        if hour is None or not 1 <= hour <= 12:
            return None
        parts, at = [], k + 1
        while len(parts) < 2 and self.joined(at, ":") and (n := self.digits(at + 1, 2, 2, False)) is not None and n < 60:
            parts.append(n)
            at += 2
        word = self.at(at).text
        if word in ("am", "pm"):
            at += 1
        elif word in ("a", "p"):
            at += 1
            at += self.joined(at, ".")
            if self.at(at).text != "m":
                return None
            at += 1
        else:
            return None
        minute, second = (*parts, 0, 0)[:2]
        return "time", f"{hour % 12 + 12 * (word[0] == 'p'):02d}:{minute:02d}:{second:02d}", False, at + self.joined(at, ".") if word in ("a", "p") else at

    def full_day(self, k: int) -> tuple[str, str | None, bool, int] | None:
        time = self.clock(k)
        if not time or (k and self.joined(k, self.at(k).text) and self.at(k - 1).text in (":", ".")) or self.joined(time[1], ":"):
            return None
        return "time", time[0], False, time[1]


def _calendar(y: int, m: int, d: int) -> date | None:
    try:
        return date(y, m, d)
    except ValueError:
        return None


_READERS: tuple[Callable, ...] = (_Reader.written_first, _Reader.named, _Reader.numeric, _Reader.day_word, _Reader.weekday, _Reader.offset, _Reader.half_day, _Reader.full_day)


def _linked(gap: str, word: str) -> bool:
    """Whether a date and a time belong together: white space, a comma, or a word between them."""
    rest = gap.strip().removeprefix(",").strip().lower()
    return rest in ("", *word.split())


def find_dates(text: str, reference: date | None = None, order: str = "dmy") -> list[Mention]:
    """Mentions in the order of the text. A date and a time that stand together become one."""
    reader = _Reader(text, reference, order)
    taken = [False] * (len(reader.tokens) + 1)
    found: list[Mention] = []
    for read in _READERS:
        k = 0
        while k < len(reader.tokens):
            got = read(reader, k)
            if not got or any(taken[k : got[3]]) or not reader.bounded(k, got[3]):
                k += 1
                continue
            kind, iso, relative, after = got
            taken[k:after] = [True] * (after - k)
            found.append(Mention(reader.tokens[k].start, reader.tokens[after - 1].end, kind, iso, relative))
            k = after
    out: list[Mention] = []
    for x in sorted(found):
        last = out[-1] if out else None
        if last and {last.kind, x.kind} == {"date", "time"} and _linked(text[last.end : x.start], "at @" if x.kind == "time" else "on"):
            day, time = (last, x) if x.kind == "time" else (x, last)
            out[-1] = Mention(last.start, x.end, "datetime", f"{day.iso}T{time.iso}" if day.iso else None, day.relative)
        else:
            out.append(x)
    return out


def date_mentions(text: Column, reference: Column | None = None, order: str = "dmy") -> Column:
    """Mentions of a text as an array; `reference` is the day that relative dates count from."""

    @F.pandas_udf("array<struct<start int, end int, kind string, iso string, relative boolean>>")
    def run(texts: pd.Series, days: pd.Series) -> pd.Series:
        return pd.Series([[m._asdict() for m in find_dates(t, None if pd.isna(d) else d, order)] if t else [] for t, d in zip(texts, days)])

    return run(text, F.lit(None).cast("date") if reference is None else reference.cast("date"))


#: Keys of metadata that tell when something was made, the best first.
CAPTURE_KEYS = ("DateTimeOriginal", "CreationDate", "CreateDate", "MediaCreateDate", "creation_time")


def capture_date(metadata: Column) -> Column:
    """The day that a map of metadata tells: of the first of CAPTURE_KEYS, by suffix, that holds a date (the smallest key first)."""
    suffix = lambda k: F.regexp_extract(k, r"([^:.]*)$", 1)
    day = lambda v: F.to_date(F.when(v.rlike(r"^\d{4}[:-]\d{2}[:-]\d{2}"), F.replace(F.substring(v, 1, 10), F.lit(":"), F.lit("-"))).try_cast("date"))
    rows = F.array_sort(F.transform(F.map_entries(metadata), lambda e: F.struct(F.array_position(F.array(*map(F.lit, CAPTURE_KEYS)), suffix(e["key"])).alias("rank"), e["key"].alias("key"), day(e["value"]).alias("day"))))
    return F.try_element_at(F.filter(rows, lambda r: (r["rank"] > 0) & r["day"].isNotNull()), F.lit(1))["day"]
