"""JSON as units of text: order of members and spelling of numbers are kept."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLIT_LINES = 60


class Number(str):
    """A number as it was written."""


def load(text: str):
    """A JSON tree: objects as lists of pairs, so that order and repeated names survive; numbers as text."""
    return json.loads(text, object_pairs_hook=lambda pairs: ("object", pairs), parse_int=Number, parse_float=Number, parse_constant=Number)


def _is_object(node) -> bool:
    return isinstance(node, tuple) and node[0] == "object"


def _scalar(node) -> str | None:
    if node is None:
        return "null"
    if isinstance(node, bool):
        return "true" if node else "false"
    return str(node) if isinstance(node, str) else None


def inline(node) -> str | None:
    """A value that stands on one line: a scalar, an empty container, an array of scalars."""
    if (plain := _scalar(node)) is not None:
        return plain
    if _is_object(node):
        return "{}" if not node[1] else None
    if not node:
        return "[]"
    parts = [_scalar(x) for x in node]
    return None if None in parts else "[" + ", ".join(parts) + "]"


def flat_lines(node, path: str = "") -> list[str]:
    """`path: value` for each leaf; further lines of a value are indented by two."""
    if (value := inline(node)) is not None:
        value = value.replace("\n", "\n  ")
        return [f"{path}: {value}" if path else value]
    if _is_object(node):
        return [line for name, child in node[1] for line in flat_lines(child, f"{path}.{name}" if path else name)]
    return [line for i, child in enumerate(node) for line in flat_lines(child, f"{path}[{i}]")]


def outline(node, depth: int = 0) -> list[str]:
    """The tree indented, a member per line."""
    pad = "  " * depth
    if (value := inline(node)) is not None:
        return [pad + value.replace("\n", "\n" + pad)]
    out = []
    for name, child in node[1] if _is_object(node) else (("-", c) for c in node):
        lead = f"{name}:" if _is_object(node) else "-"
        value = inline(child)
        if value is not None:
            out.append(f"{pad}{lead} " + value.replace("\n", "\n" + pad + "  "))
        else:
            out += [pad + lead, *outline(child, depth + 1)]
    return out


def pointer(path: list[str]) -> str:
    """An RFC 6901 pointer."""
    return "".join("/" + part.replace("~", "~0").replace("/", "~1") for part in path)


def records_path(node) -> list[str] | None:
    """Where the records are: the root array, else the longest array of objects at most two levels down."""
    if isinstance(node, list):
        return [] if len(node) and all(map(_is_object, node)) else None
    best: tuple[int, list[str]] = (1, [])
    found = False
    for name, child in node[1] if _is_object(node) else []:
        options = [([name], child)] + ([([name, n], c) for n, c in child[1]] if _is_object(child) else [])
        for path, value in options:
            if isinstance(value, list) and len(value) > best[0] and all(map(_is_object, value)):
                best, found = (len(value), path), True
    return best[1] if found else None


def _at(node, path: list[str]):
    for name in path:
        node = next(c for n, c in node[1] if n == name)
    return node


def _without(node, path: list[str], note: str):
    if not path:
        return Number(note)
    return ("object", [(n, _without(c, path[1:], note) if n == path[0] else c) for n, c in node[1]])


def units(text: str, lines: bool) -> list[tuple[str | None, str, str | None]]:
    """Units of a JSON text as (pointer, text, warning): lines of JSON Lines, records, members, or the outline as a whole."""
    if lines:
        out, n, bad = [], 0, False
        for at, line in enumerate(text.split("\n"), 1):
            if not line.strip():
                continue
            n += 1
            try:
                body = "\n".join(flat_lines(load(line)))
                out.append((None, f"Record {n} (line {at})\n{body}", None))
            except ValueError:
                out.append((None, f"Record {n} (line {at})\n{line.strip()}", None if bad else "a line isn't JSON"))
                bad = True
        return out
    try:
        tree = load(text)
    except ValueError:
        return [(None, text, "not JSON")]
    whole = outline(tree)
    path = records_path(tree)
    if path is not None and (path == [] or len(whole) > SPLIT_LINES):
        records = _at(tree, path)
        out = []
        if path:
            out.append(("", "\n".join(flat_lines(_without(tree, path, f"[{len(records)} records below]"))), None))
        label = ".".join(path)
        for i, record in enumerate(records, 1):
            head = f"Record {i} ({label}[{i - 1}])" if path else f"Record {i}"
            out.append((pointer([*path, str(i - 1)]), head + "\n" + "\n".join(flat_lines(record)), None))
        return out
    if len(whole) > SPLIT_LINES and _is_object(tree):
        return [(pointer([name]), "\n".join(outline(("object", [(name, child)]))), None) for name, child in tree[1]]
    return [("", "\n".join(whole), None)]


def json_units(df: DataFrame, key: str, text: str, lines: Column) -> DataFrame:
    """`key`, `unit_no` (from 1), `pointer`, `text`, `warning`; null texts have no units."""
    own = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"), lines.alias("_lines")).where("_text IS NOT NULL")
    kind = own.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, p, t, w) for i, body, by_line in zip(batch["_id"], batch["_text"], batch["_lines"]) for n, (p, t, w) in enumerate(units(body, bool(by_line)), 1)]
            yield pd.DataFrame(rows, columns=["_id", "unit_no", "pointer", "text", "warning"])

    return own.mapInPandas(run, f"_id {kind}, unit_no int, pointer string, text string, warning string").withColumnRenamed("_id", key)


def segments(text: Column) -> Column:
    """Spoken segments of a recogniser's JSON (`segments` of `start`, `end`, `text`) as `start_seconds`, `end_seconds`, `text`; empty ones and those that end before they start are left out."""
    read = F.from_json(text, "segments array<struct<start double, end double, text string>>")["segments"]
    fine = F.filter(read, lambda s: (s["end"] >= s["start"]) & (F.trim(s["text"]) != ""))
    return F.transform(fine, lambda s: F.struct(s["start"].alias("start_seconds"), s["end"].alias("end_seconds"), F.trim(s["text"]).alias("text")))


_SPACE = " \t\r\n"


def begins_as_json(text: str) -> bool:
    """Whether a text begins as an object or an array of JSON; it may be cut off anywhere."""
    plain = text.lstrip("\ufeff" + _SPACE)
    if plain[:1] not in ("{", "["):
        return False
    after = plain[1:].lstrip(_SPACE)
    if not after:
        return True
    if plain[0] == "{":
        return after[0] in "\"}"
    return after[0] in "{[]\"-0123456789" or any(word.startswith(after[: len(word)]) or after.startswith(word) for word in ("true", "false", "null"))


def looks_like_json(text: Column) -> Column:
    """`begins_as_json` of a column."""
    return F.pandas_udf(lambda s: s.map(lambda t: bool(t) and begins_as_json(t)), "boolean")(text)


def _value_end(text: str, at: int) -> int:
    """Where the JSON value that starts at `at` ends."""
    depth, inside, k = 0, False, at
    while k < len(text):
        c = text[k]
        if inside:
            k += c == "\\"
            inside = c != '"'
        elif c == '"':
            inside = True
        elif c in "{[":
            depth += 1
        elif c in "}],":
            if depth == 0:
                break
            depth -= c != ","
        k += 1
        if depth == 0 and not inside and c in '}]"':
            return k
    return len(text[:k].rstrip(_SPACE))


def spans(text: str) -> list[tuple[str, int, int]]:
    """Members of the outermost object or array as (name or index, first byte, byte after the last), in UTF-8; none for other texts."""
    json.loads(text)
    at = len(text) - len(text.lstrip("\ufeff" + _SPACE))
    if text[at : at + 1] not in ("{", "["):
        return []
    named, out, at = text[at] == "{", [], at + 1
    measure, done = 0, 0  # bytes before the character `done`
    while True:
        while at < len(text) and text[at] in _SPACE + ",":
            at += 1
        if at >= len(text) or text[at] in "}]":
            return out
        name = str(len(out))
        if named:
            end = _value_end(text, at)
            name = json.loads(text[at:end])
            at = text.index(":", end) + 1
            while text[at] in _SPACE:
                at += 1
        end = _value_end(text, at)
        start = measure + len(text[done:at].encode())
        measure, done = start + len(text[at:end].encode()), end
        out.append((name, start, measure))
        at = end


def member_spans(text: Column) -> Column:
    """`spans` of a column as (`name`, `byte_start`, `byte_end`); a text that isn't JSON has none."""

    @F.pandas_udf("array<struct<name string, byte_start long, byte_end long>>")
    def run(batch: pd.Series) -> pd.Series:
        def one(t):
            try:
                return [{"name": n, "byte_start": a, "byte_end": b} for n, a, b in spans(t)] if t else []
            except ValueError:
                return []

        return batch.map(one)

    return run(text)


def _members(node, path: str = "") -> list[tuple[str, str]]:
    if _is_object(node):
        return [row for name, child in node[1] for row in _members(child, f"{path}.{name}" if path else name)]
    if isinstance(node, list):
        return [row for i, child in enumerate(node) for row in _members(child, f"{path}[{i}]")]
    return [] if node is None else [(path, _scalar(node))]


def flattened(text: Column) -> Column:
    """A map of the leaves of a JSON text by dotted keys, `a.b[0]`; nulls are left out, and of repeated keys the last counts."""

    @F.pandas_udf("map<string,string>")
    def run(batch: pd.Series) -> pd.Series:
        def one(t):
            try:
                return dict(_members(load(t))) if t else {}
            except ValueError:
                return {}

        return batch.map(one)

    return run(text)


RMETA_BYTES, RMETA_FIELDS = 8 << 20, 200


def rmeta_units(text: str) -> list[tuple[int, str, dict[str, str]]]:
    """Units of an array of parsed documents (`X-TIKA:content` and metadata): position, tidied text, metadata.

    Texts share a budget of 8 MiB; runs of blank lines become one; keys of the parser itself are left out.
    """
    import re

    left, out = RMETA_BYTES, []
    for position, item in enumerate(json.loads(text), 1):
        body = re.sub(r"[ \t]+\n", "\n", str(item.get("X-TIKA:content") or "").replace("\r\n", "\n"))
        body = re.sub(r"\n{3,}", "\n\n", body).strip()
        body = body.encode()[:left].decode("utf-8", "ignore")
        left -= len(body.encode())
        if not body:
            continue
        fields = {k: v if isinstance(v, str) else ", ".join(map(str, v)) if isinstance(v, list) else str(v) for k, v in sorted(item.items()) if not k.startswith("X-TIKA:")}
        out.append((position, body, dict(list(fields.items())[:RMETA_FIELDS])))
    return out
