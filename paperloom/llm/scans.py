"""Text of scanned pages repaired: running heads, page numbers, divided and misread words.

A first pass reads every page once and emits, already combined per batch, the counts of
its words, its divided words and the lines at its edges. From these come, for the whole corpus:

* running heads: edge lines that recur on other pages of the scan, or in other scans.
  Lines are compared by a skeleton in which letters that recognition confuses are the same,
  and skeletons of a scan that differ in a few letters (by edit distance) are one class;
* page numbers: edge lines whose number follows the scan's sequence of pages;
* misread words: words that turn, by one exchange that recognition is known to make,
  into a word that is many times as frequent;
* kept hyphens: divided words that the vocabulary knows with their own hyphen rather than joined.

A second pass reads the pages with these tables. They are broadcast after their sizes
have been checked, and otherwise joined to the pages by the same keys, with the same result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut_lineage

#: What recognition makes of letters: (written, read).
CONFUSIONS = (
    ("e", "c"), ("t", "f"), ("i", "1"), ("l", "1"), ("o", "0"), ("s", "5"), ("g", "9"), ("b", "6"), ("é", "6"), ("d", "cl"), ("u", "ii"),
    ("m", "rn"), ("h", "li"), ("w", "vv"), ("li", "h"), ("rn", "m"), ("b", "8"), ("z", "2"), ("q", "9"), ("n", "ri"), ("l", "i"), ("i", "l"), ("c", "e"), ("f", "t"),
)
#: A word is right when it is this many times as frequent as what was read.
RATIO = 20
LEAST = 5
#: Scans in which an edge line must recur to be a head wherever it stands.
SCANS = 3
#: Lines on each side of a page that may belong to its frame.
EDGE = 2
#: Letters at the start or the end of a skeleton that two of a class share, and letters for each edit.
AFFIX, PER_EDIT = 8, 10
#: Rows of a broadcast table (of some 60 bytes each).
BROADCAST_ROWS = 500_000

HYPHENS = "-­‐¬"
_HYPHENS = frozenset(HYPHENS)
_OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’‚…–—¿¡·•" + HYPHENS
_DIVIDED = re.compile(rf"(?<!\S)\S*[^\W\d_][{HYPHENS}][ \t]*\r?\n[ \t]*\S*")
_LEFT = re.compile(rf"((?:[^\W_]+['’-])*[^\W\d_]+)[{HYPHENS}][ \t\r]*$")
_RIGHT = re.compile(r"[ \t]*([^\W\d_]+(?:['’-][^\W_]+)*)")
_CLASSES = str.maketrans({"e": "c", "t": "f", "i": "l", "1": "l", "j": "l", "0": "o", "5": "s", "9": "g", "q": "g", "6": "b", "8": "b", "é": "b", "è": "c", "u": "h", "2": "z"})
_NUMBER = re.compile(r"^\W*(?:[^\W\d_]{2,7}\.?\s+|[^\W\d_]{1,4}\.\s*)?([\dlIiOoSB]{1,5})(?:\s*(?:/|of|von|de|sur|out of)\s*[\dlIiOoSB]{1,5})?\W*$", re.I)
_ROMAN = re.compile(r"^\W*(c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))\W*$")
#: Runs of signs, which say nothing of a line beyond their first.
_SIGNS = re.compile(r"(\W{2})\W{2,}")
#: Letters and digits that a line with nothing but a page number can have.
_MOST = 40
_DIGITS = str.maketrans("lIiOoSB", "1110058")
_ENDS = re.compile(r"^\W*[\dlIO]{1,4}(?=\s)\W*|\s\W*[\dlIO]{1,4}\W*$")


def skeleton(line: str) -> str:
    """A line without its page number, with confusable letters alike."""
    low = _ENDS.sub(" ", _SIGNS.sub(r"\1", line.strip())).strip().lower().translate(_CLASSES)
    for a, b in (("cl", "d"), ("ll", "h"), ("rn", "m"), ("vv", "w")):
        low = low.replace(a, b)
    return " ".join(low.split())


def page_number(line: str) -> int | None:
    """The number of a line that holds nothing else than a page number."""
    line = _SIGNS.sub(r"\1", line.strip())
    if len(line) > 4 * _MOST or sum(map(str.isalnum, line)) > _MOST:
        return None
    found = _NUMBER.match(line)
    if found and (any(c.isdigit() for c in found[1]) or len(found[1]) > 1 and set(found[1]) <= set("lI")):
        return int(found[1].translate(_DIGITS))
    roman = _ROMAN.match(line.lower())
    if not roman or not roman[1]:
        return None
    values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in roman[1]]
    return sum(-a if a < b else a for a, b in zip(values, [*values[1:], 0]))


def edges(lines: list[str]) -> list[int]:
    """Numbers of the first and the last EDGE lines that aren't blank."""
    solid = [i for i, x in enumerate(lines) if x.strip()]
    return solid if len(solid) <= 2 * EDGE else [*solid[:EDGE], *solid[-EDGE:]]


def _open_line(line: str) -> bool:
    """A line that may be a head: without the end of a sentence."""
    line = line.strip()
    return len(line) > 2 and not re.search(rf"[{HYPHENS}.!?:;,]$", line)


def _short(lines: list[str]) -> float:
    """What a line must be shorter than to be told from those of the body; 0 on pages of few lines."""
    widths = sorted(len(x.strip()) for x in lines if x.strip())
    return 0.85 * widths[len(widths) * 3 // 4] if len(widths) > 3 else 0


def _edge_lines(lines: list[str]) -> Iterator[tuple[str, bool]]:
    """Skeletons of the edge lines that may be heads, and whether they are short."""
    most = _short(lines)
    for i in edges(lines):
        if page_number(lines[i]) is None and _open_line(lines[i]):
            yield skeleton(lines[i]), len(lines[i].strip()) < most


def edge_keys(lines: list[str]) -> list[str]:
    """Skeletons of the edge lines that may be heads."""
    return [key for key, _ in _edge_lines(lines)]


def divided(line: str, after: str) -> tuple[re.Match, re.Match] | None:
    """The two parts of a word that is divided between two lines."""
    left = _LEFT.search(line) if line.rstrip()[-1:] in _HYPHENS else None
    right = _RIGHT.match(after) if left else None
    return (left, right) if left and right else None


def _first_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words: Counter = Counter()
        heads: Counter = Counter()
        numbers: Counter = Counter()
        parts: Counter = Counter()
        for source, page, text in zip(batch["_source"], batch["_page"], batch["_text"]):
            words.update(_DIVIDED.sub(" ", text).lower().split())
            lines = text.split("\n")
            for i in edges(lines):
                n = page_number(lines[i])
                if n is not None and page == page:
                    numbers[source, int(n - page), int(page)] += 1
            # A page without a number is told apart by its text, so that a copy of it isn't another page.
            place = int(page) if page == page else xxhash.xxh64_intdigest(text) >> 1
            heads.update((source, key, place, short) for key, short in _edge_lines(lines))
            for line, after in zip(lines, lines[1:]):
                pair = divided(line, after)
                if pair:
                    parts[pair[0][1].lower(), pair[1][1].lower()] += 1
        clean: Counter = Counter()
        for word, n in words.items():
            word = word.strip(_OUTER)
            if len(word) > 1 and not word.isdigit():
                clean[word] += n
        rows = [("word", None, w, None, n) for w, n in clean.items()]
        rows += [("short" if short else "head", s, k, p, n) for (s, k, p, short), n in heads.items() if k]
        rows += [("number", s, str(off), p, n) for (s, off, p), n in numbers.items()]
        rows += [("divided", a, b, None, n) for (a, b), n in parts.items()]
        yield pd.DataFrame(rows, columns=["kind", "source", "key", "page", "n"]).astype({"page": "Int64"})


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each word with what it may have been: one exchange undone, and no digit left."""
    for batch in batches:
        rows = []
        for word, n in zip(batch["word"], batch["n"]):
            if sum(c.isalpha() for c in word) < 2 or len(word) < 3:
                continue
            seen = set()
            for right, read in CONFUSIONS:
                at = word.find(read)
                while at >= 0:
                    other = word[:at] + right + word[at + len(read) :]
                    if other not in seen and not any(c.isdigit() for c in other):
                        seen.add(other)
                        rows.append((word, n, other))
                    at = word.find(read, at + 1)
        yield pd.DataFrame(rows, columns=["word", "n", "other"])


def _heads(seen: DataFrame) -> DataFrame:
    """Running heads (`source`, `key`): those of a scan, and with a null source those that recur in several scans.

    A key with a tilde recurs in its scan only together with the others of its class.
    """
    lines = seen.where("kind IN ('head', 'short')").groupBy("source", "key", "page").agg(F.max(F.col("kind") == "short").alias("short"))
    own = cut_lineage(lines.groupBy("source", "key").agg(F.count("*").alias("pages"), F.max("short").alias("short")))
    # Classes by edit distance, of short lines: the most frequent key among those that begin or end alike stands for its neighbours.
    bare = F.regexp_replace("key", " ", "")
    ends = F.array(F.xxhash64(F.lit("<"), "source", F.left(bare, F.lit(AFFIX))), F.xxhash64(F.lit(">"), "source", F.right(bare, F.lit(AFFIX))))
    affixes = own.where("short").select("source", "key", "pages", F.explode(ends).alias("affix"))
    leads = affixes.groupBy("affix").agg(F.max_by(F.struct("key", "source"), F.struct("pages", "key")).alias("l"), F.count("*").alias("_n")).where("_n > 1").select("affix", F.col("l.key").alias("lead"), F.col("l.source").alias("_of"))
    off = F.levenshtein("key", "lead")
    near = affixes.join(leads, "affix").where("key <> lead AND source = _of").withColumn("off", off).where(F.col("off") <= F.greatest(F.lit(1), F.floor(F.length("lead") / PER_EDIT)))
    leader = near.groupBy("source", "key").agg(F.min_by("lead", F.struct("off", "lead")).alias("lead"))
    # Only lines of a class of several keys meet again by page.
    classes = cut_lineage(leader.unionByName(leader.select("source", F.col("lead").alias("key"), "lead")).distinct())
    often = lines.join(classes, ["source", "key"]).groupBy("source", "lead").agg(F.count_distinct("page").alias("pages")).where("pages >= 2")
    fuzzy = classes.join(often.select("source", "lead"), ["source", "lead"], "left_semi").join(own.where("pages < 2"), ["source", "key"]).select("source", F.concat(F.lit("~"), "key").alias("key")).distinct()
    scan = own.where("pages >= 2").select("source", "key").unionByName(fuzzy)
    wide = own.groupBy("key").agg(F.count("*").alias("scans")).where(F.col("scans") >= SCANS)
    return scan.unionByName(wide.select(F.lit(None).cast("string").alias("source"), "key"))


def _tables(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Fixes (word, right), kept hyphens (word), heads (source, key) and page-number offsets (source, offset)."""
    seen = cut_lineage(pages.select("_source", "_page", "_text").mapInPandas(_first_pass, "kind string, source string, key string, page long, n long"))
    words = cut_lineage(seen.where("kind = 'word'").groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("n")))
    parts = cut_lineage(seen.where("kind = 'divided'").groupBy(F.col("source").alias("a"), F.col("key").alias("b")).agg(F.sum("n").alias("n")))
    whole = parts.select(F.concat("a", "b").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n")).join(words, "word", "left_anti")
    options = words.unionByName(whole).mapInPandas(_candidates, "word string, n long, other string")
    other = words.select(F.col("word").alias("other"), F.col("n").alias("often"))
    digit = F.col("word").rlike("[0-9]")
    good = options.join(other, "other").where((F.col("often") >= LEAST) & (F.col("often") >= F.col("n") * F.when(digit, 2).otherwise(RATIO)))
    fixes = good.groupBy("word").agg(F.max_by("other", F.struct("often", "other")).alias("right"))
    # What the vocabulary says of a divided word: the hyphen is its own where it is the more frequent spelling.
    asked = parts.select(F.concat("a", F.lit("-"), "b").alias("word"), F.concat("a", "b").alias("plain")).distinct()
    count = lambda name, n: words.select(F.col("word").alias(name), F.col("n").alias(n))
    asked = asked.join(count("word", "n"), "word").join(count("plain", "m"), "plain", "left")
    kept = asked.where("(n >= 2 OR m IS NULL) AND n >= coalesce(m, 0)").select("word").distinct()
    offsets = seen.where("kind = 'number'").groupBy("source", "key").agg(F.count_distinct("page").alias("pages"))
    best = offsets.where("pages >= 3").groupBy("source").agg(F.min_by("key", F.struct(-F.col("pages"), "key")).alias("key"))
    return fixes, kept, _heads(seen), best.select(F.col("source").alias("_for"), F.col("key").cast("int").alias("_offset"))


def read_page(text: str, page: int | None, heads: set[str], offset: int | None, fixes: dict[str, str], compounds: set[str]) -> tuple[list[tuple[str, int, str]], str]:
    """The noise of a page as (kind, line number, token), and the page repaired."""
    lines = text.split("\n")
    noise: list[tuple[str, int, str]] = []
    frame: set[int] = set()
    most = _short(lines)
    at_edge = edges(lines)
    for i in at_edge:
        line = lines[i].strip()
        n = page_number(line)
        if n is not None:
            if page is not None and n - page in (0, offset):
                noise.append(("page_number", i + 1, ""))
                frame.add(i)
            continue
        if not _open_line(line):
            continue
        key = skeleton(line)
        if key in heads or (("~" + key) in heads and len(line) < most):
            noise.append(("header", i + 1, ""))
            frame.add(i)
    # Only lines that stand at the very edge belong to the frame: a body line between them and the edge ends it.
    solid = [i for i, x in enumerate(lines) if x.strip()]
    for order, other in ((solid[:EDGE], solid[-EDGE:]), (solid[: -EDGE - 1 : -1], solid[:EDGE])):
        ended = False
        for i in order:
            ended = ended or i not in frame
            if ended and i in frame and i not in other:
                frame.discard(i)
                noise = [x for x in noise if x[1] != i + 1]
    out: list[str] = []
    carry = ""
    for i, line in enumerate(lines):
        if i in frame:
            continue
        taken = 0
        if carry:
            taken = 1
        pair = divided(line, lines[i + 1]) if i + 1 < len(lines) and (i + 1) not in frame else None
        left, right = pair or (None, None)
        tokens = line.split()
        words = []
        for k, raw in enumerate(tokens):
            if (k == 0 and taken) or (right and k == len(tokens) - 1):
                words.append(raw)
                continue
            low = raw.lower()
            good = fixes.get(low) or fixes.get(low.strip(_OUTER))
            if good:
                noise.append(("misread", i + 1, good))
                core = raw.strip(_OUTER)
                shaped = good.upper() if core.isupper() and len(core) > 1 else good[:1].upper() + good[1:] if core[:1].isupper() else good
                raw = raw.replace(core, shaped)
            words.append(raw)
        if carry and words:
            words[0] = carry + words[0]
        carry = ""
        if right:
            a, b = left[1].lower(), right[1].lower()
            mark = line.rstrip()[-1]
            whole = a + b
            kept = a + "-" + b
            own = kept in compounds or (mark == "-" and right[1][0].isupper() and left[1][0].isupper() and not left[1].isupper())
            token = kept if own else fixes.get(whole, whole)
            noise.append(("hyphenation", i + 1, token))
            carry = words.pop().rstrip(HYPHENS) + ("-" if own else "")
        out.append(" ".join(words))
    if carry:
        out.append(carry)
    paragraphs = [" ".join(x for x in block.split("\n") if x) for block in re.split(r"\n\s*\n", "\n".join(out))]
    return noise, "\n\n".join(p for p in paragraphs if p)


def lookups(text: str) -> set[str]:
    """Every word that `read_page` may look up in the fixes or the kept hyphens, whatever lines are its frame."""
    lines = text.split("\n")
    words = {w for line in lines for raw in line.split() for w in (raw.lower(), raw.lower().strip(_OUTER))}
    for line, after in zip(lines, lines[1:]):
        pair = divided(line, after)
        if pair:
            a, b = pair[0][1].lower(), pair[1][1].lower()
            words |= {a + b, a + "-" + b}
    return words


def _lookups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), 500):
            part = batch.iloc[start : start + 500]
            rows = [(row, None, w) for row, text in zip(part["_row"], part["_text"]) for w in lookups(text)]
            rows += [(row, source, mark + key) for row, source, text in zip(part["_row"], part["_source"], part["_text"]) for key in set(edge_keys(text.split("\n"))) for mark in ("", "~")]
            yield pd.DataFrame(rows, columns=["_row", "source", "word"])


def repaired(df: DataFrame, entry_id: str, text: str, source: str, page: str) -> DataFrame:
    """Each page with its noise and its repaired text.

    Result: `entry_id`, `noise` (array of `noise_kind`, `line_no`, `token`) and
    `clean_text` (paragraphs as single lines, a blank line between them). Null and empty
    texts have no noise and a null or empty text; a null page number leaves page-number
    lines alone; a page with a null source is a scan of its own; pages repeated under another id
    count by themselves but don't make their lines recur. Extra columns are dropped.
    """
    alone = F.concat(F.lit("?"), F.xxhash64(F.col(f"`{text}`")).cast("string"))
    pages = df.select(F.col(f"`{entry_id}`").alias("_id"), F.coalesce(F.col(f"`{source}`").cast("string"), alone).alias("_source"), F.col(f"`{page}`").cast("int").alias("_page"), F.col(f"`{text}`").alias("_text"))
    kind = pages.schema["_id"].dataType.simpleString()
    fixes, kept, heads, offsets = (cut_lineage(t) for t in _tables(pages.where("_text IS NOT NULL")))
    counts = [t.count() for t in (fixes, kept, heads, offsets)]
    own = pages.join(F.broadcast(offsets) if counts[3] <= BROADCAST_ROWS else offsets, F.col("_source") == F.col("_for"), "left").drop("_for")
    if sum(counts[:3]) <= BROADCAST_ROWS:
        found = heads.toArrow()
        scans = set(zip(found.column("source").to_pylist(), found.column("key").to_pylist()))
        tables = df.sparkSession.sparkContext.broadcast(({r.word: r.right for r in fixes.collect()}, {r.word for r in kept.collect()}, scans))
        own = own.withColumns({"_fixes": F.lit(None).cast("map<string,string>"), "_kept": F.lit(None).cast("array<string>"), "_heads": F.lit(None).cast("array<string>")})
    else:
        tables = None
        # A row's own number: an id that comes twice stays two rows, and a null id finds its words.
        own = cut_lineage(own.withColumn("_row", F.monotonically_increasing_id()))
        asked = cut_lineage(own.where("_text <> ''").select("_row", "_source", "_text").mapInPandas(_lookups, "_row long, source string, word string"))
        token, edge = asked.where("source IS NULL").drop("source"), asked.where("source IS NOT NULL").withColumnRenamed("word", "key")
        by_scan = edge.join(heads, ["source", "key"]).select("_row", "key")
        by_any = edge.join(heads.where("source IS NULL").select("key"), "key").select("_row", F.concat(F.lit("~"), "key").alias("key"))
        parts = [
            token.join(fixes, "word").groupBy("_row").agg(F.map_from_entries(F.collect_set(F.struct("word", "right"))).alias("_fixes")),
            token.join(kept, "word").groupBy("_row").agg(F.collect_set("word").alias("_kept")),
            by_scan.unionByName(by_any).groupBy("_row").agg(F.collect_set("key").alias("_heads")),
        ]  # a page's own words and edge lines
        for part in parts:
            own = own.join(part, "_row", "left")
        own = own.drop("_row")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fixed, hyphens, known = tables.value if tables is not None else (None, None, None)
        for batch in batches:
            ids, noise, texts = [], [], []
            for key, p, body, off, scan, own_fixes, own_kept, own_heads in zip(*(batch[c] for c in ("_id", "_page", "_text", "_offset", "_source", "_fixes", "_kept", "_heads"))):
                ids.append(key)
                if not body:
                    noise.append([])
                    texts.append(body)
                    continue
                if known is not None:
                    keys = edge_keys(body.split("\n"))
                    head = {k for k in keys if (scan, k) in known} | {"~" + k for k in keys if (None, k) in known or (scan, "~" + k) in known}
                    found, whole = fixed, hyphens
                else:
                    head, found, whole = set(own_heads) if own_heads is not None else set(), dict(own_fixes) if own_fixes is not None else {}, set(own_kept) if own_kept is not None else set()
                rows, text_ = read_page(body, None if p != p or p is None else int(p), head, None if off is None or off != off else int(off), found, whole)
                noise.append([{"noise_kind": a, "line_no": b, "token": c} for a, b, c in rows])
                texts.append(text_)
            yield pd.DataFrame({"_id": ids, "noise": noise, "clean_text": texts})

    out = own.mapInPandas(run, f"_id {kind}, noise array<struct<noise_kind string, line_no int, token string>>, clean_text string")
    return out.withColumnRenamed("_id", entry_id)
