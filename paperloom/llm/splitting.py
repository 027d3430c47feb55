"""Oversized texts in pieces that end at natural boundaries and overlap.

Boundaries have levels: paragraph (a form feed, or a line break before a blank line),
line, sentence (white space after . ! ?), word (white space) and, inside words that are
themselves too large, any character. The table has an entry per boundary of a text.
The farthest legal successor of a boundary is the last boundary of the strongest level
within the limit, counted from where a piece that starts there begins its overlap.
The successors of all boundaries are found at once (a merge join of sorted offsets),
and squaring the successor table - each entry followed by itself, so that it leaps
1, 2, 4, ... cuts - gives all greedy cuts in a number of rounds that is the logarithm
of the number of pieces. The level at which a text can be cut is told by the same
squaring: it is the first whose own successor table leads from the start to the end.
The table belongs to one text and lives in arrays; no row is shuffled. Texts within the
limit never leave the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 4096
OVERLAP = 300
LEVELS = ("paragraph", "line", "sentence", "word", "char")

_ENDS = {
    "paragraph": re.compile(r"\f|\r?\n(?=[^\S\n\f]*(?:\n|\f|\Z))"),
    "line": re.compile(r"\f|\r?\n"),
    "sentence": re.compile(r"(?<=[.!?])\s+"),
    "word": re.compile(r"\s+"),
}


def _measure(text: str) -> Callable[[np.ndarray], np.ndarray]:
    """Tells the UTF-8 bytes before given characters."""
    if text.isascii():
        return lambda at: at
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    leads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    return lambda at: leads[at]


def _boundaries(text: str, limit: int, measure: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where segments end (after the separator), with the start and the end of the text, and the strongest level of each."""
    n = len(text)
    at, level = np.array([0, n], dtype=np.int64), np.array([0, 0], dtype=np.int8)
    for k, name in enumerate(LEVELS[:-1]):
        ends = np.fromiter((m.end() for m in _ENDS[name].finditer(text)), dtype=np.int64)
        ends = np.setdiff1d(ends, at)
        at, level = np.concatenate([at, ends]), np.concatenate([level, np.full(len(ends), k, dtype=np.int8)])
        order = np.argsort(at, kind="stable")
        at, level = at[order], level[order]
    size = measure(at)
    wide = np.flatnonzero(np.diff(size) > limit)
    if len(wide):
        inside = np.concatenate([np.arange(at[k] + 1, at[k + 1]) for k in wide])
        at, level = np.concatenate([at, inside]), np.concatenate([level, np.full(len(inside), len(LEVELS) - 1, dtype=np.int8)])
        order = np.argsort(at, kind="stable")
        at, level = at[order], level[order]
    if n == 0:
        return at[:1], level[:1]
    return at, level


def _leads_through(successor: np.ndarray) -> bool:
    """Whether a table of successors (itself where there is none) leads from its first entry to its last."""
    end, leap, reach = len(successor) - 1, successor, 1
    while leap[0] < end and reach < end:
        leap, reach = leap[leap], reach * 2
    return bool(leap[0] == end)


def _cut_level(text: str, at: np.ndarray, level: np.ndarray, limit: int, measure: Callable[[np.ndarray], np.ndarray]) -> str:
    """The first level whose segments, without outer white space, are all within the limit."""
    blanks = np.array([m.span() for m in _ENDS["word"].finditer(text)], dtype=np.int64).reshape(-1, 2)
    for k, name in enumerate(LEVELS[:-1]):
        own = at[level <= k]
        ahead, back = own, own
        if len(blanks):
            run = np.searchsorted(blanks[:, 0], own, side="right") - 1
            ahead = np.where((run >= 0) & (own < blanks[run, 1]), blanks[run, 1], own)
            run = np.searchsorted(blanks[:, 1], own, side="left")
            inside = np.minimum(run, len(blanks) - 1)
            back = np.where((run < len(blanks)) & (own > blanks[inside, 0]), blanks[inside, 0], own)
        ahead, back = measure(ahead), measure(back)
        here = np.arange(len(own))
        successor = np.maximum(here, np.searchsorted(back, ahead + limit, side="right") - 1)
        # A segment of white space alone is within any limit.
        successor = np.maximum(successor, np.where(np.append(back[1:], 0) <= ahead, np.minimum(here + 1, len(own) - 1), 0))
        if _leads_through(successor):
            return name
    return LEVELS[-1]


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[str, list[tuple[int, int, int]]]:
    """The cut level of a text, and its pieces as (start, new, end) in characters: the piece is
    text[start:end], and text[start:new] repeats the end of the piece before.

    The pieces' new parts are the whole text. A piece is within `limit` bytes (a limit of
    less than four is taken as four). An overlap starts at a word where it can, and is cut
    down where it would leave a new part less than half the room.
    """
    n, limit = len(text), max(4, limit)
    measure = _measure(text)
    at, level = _boundaries(text, limit, measure)
    cut_level = _cut_level(text, at, level, limit, measure)
    size = measure(at)
    end = len(at) - 1
    if size[end] <= limit:
        return cut_level, [(0, 0, n)]
    # Where the piece that follows a cut begins: up to `overlap` characters before it, at the start of a word.
    here = np.arange(len(at))
    least = np.maximum(np.searchsorted(at, at - overlap), np.searchsorted(size, size - limit // 2))
    words = np.flatnonzero(level < len(LEVELS) - 1)
    start = words[np.minimum(np.searchsorted(words, least), len(words) - 1)]
    start = np.minimum(np.where(start <= here, start, least), here)
    start = np.where(size[np.minimum(here + 1, end)] - size[start] > limit, here, start)
    reach = np.searchsorted(size, size[start] + limit, side="right") - 1
    # The farthest boundary of the strongest level that lies beyond the cut and uses a fair part of the room.
    step = reach.copy()
    for k in reversed(range(len(LEVELS) - 1)):
        own = np.flatnonzero(level <= k)
        last = own[np.maximum(0, np.searchsorted(own, reach, side="right") - 1)]
        step = np.where((last > here) & (size[last] - size[here] >= limit // 4), last, step)
    step = np.where(reach >= end, end, step)
    # Squaring: `marked` holds the cuts found; each round adds those as many cuts further as all rounds before.
    marked, leap = np.zeros(1, dtype=np.int64), step
    while marked[-1] < end:
        marked = np.union1d(marked, leap[marked])
        leap = leap[leap]
    return cut_level, [(int(at[start[a]]) if a else 0, int(at[a]), int(at[b])) for a, b in zip(marked[:-1], marked[1:])]


def page_ranges(text: str, pieces: list[tuple[int, int, int]], first: float | None, last: float | None) -> list[tuple[int | None, int | None]]:
    """The pages that each piece covers. Form feeds count pages where they agree with the range
    (or the range has no last page); otherwise a piece's place in the text does, by proportion."""
    if first is None or pd.isna(first):
        return [(None, None)] * len(pieces)
    first = int(first)
    feeds = np.fromiter((m.start() for m in re.finditer("\f", text)), dtype=np.int64)
    page_of = lambda at: int(np.searchsorted(feeds, at))  # noqa: E731  (feeds before a character)
    if last is None or pd.isna(last):
        return [(first + page_of(a), first + page_of(max(a, b - 1))) for a, _, b in pieces]
    pages = max(1, int(last) - first + 1)
    if len(feeds) == pages - 1:
        return [(first + page_of(a), first + page_of(max(a, b - 1))) for a, _, b in pieces]
    n = max(1, len(text))
    return [(first + min(pages - 1, a * pages // n), first + min(pages - 1, max(a, b - 1) * pages // n)) for a, _, b in pieces]


def pieces(df: DataFrame, item_id: str, text: str, first: Column | None = None, last: Column | None = None, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every text of more than `limit` bytes.

    Result: `item_id`, `cut_level`, `piece_no` (from 1), `start_char` (from 1, of the
    piece with its overlap), `overlap_chars`, `text`, `page_first`, `page_last`. Null,
    empty and small texts have no pieces; rows count by themselves; extra columns are
    dropped first.
    """
    none = F.lit(None).cast("int")
    own = df.select(F.col(f"`{item_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"), (none if first is None else first.cast("int")).alias("_first"), (none if last is None else last.cast("int")).alias("_last"))
    own = own.where(F.octet_length("_text") > limit)
    kind = own.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["_id", "cut_level", "piece_no", "start_char", "overlap_chars", "text", "page_first", "page_last"]
        for batch in batches:
            rows = []
            for key, body, a, b in zip(batch["_id"], batch["_text"], batch["_first"], batch["_last"]):
                level, cuts = split(body, limit, overlap)
                for k, ((s, new, e), (p, q)) in enumerate(zip(cuts, page_ranges(body, cuts, a, b)), 1):
                    rows.append((key, level, k, s + 1, new - s, body[s:e], p, q))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"page_first": "Int32", "page_last": "Int32"})

    schema = f"_id {kind}, cut_level string, piece_no int, start_char int, overlap_chars int, text string, page_first int, page_last int"
    return own.mapInPandas(run, schema).withColumnRenamed("_id", item_id)
