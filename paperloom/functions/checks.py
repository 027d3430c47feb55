"""Values against a small part of JSON Schema; layered settings."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The keywords that are understood; any other is an error.
KEYWORDS = frozenset("type properties required additionalProperties items enum const minimum maximum minLength maxLength pattern".split())
_NOTES = frozenset("$schema $id title description default".split())
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES[kind])


def problems(value, schema: dict, path: str = "") -> list[tuple[str, str]]:
    """(path, message) for everything in which a value differs from a schema."""
    out = [(path, f"unknown keyword {k}") for k in schema if k not in KEYWORDS and k not in _NOTES]
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [*out, (path, "is not " + " or ".join(kinds))]
    if "enum" in schema and value not in schema["enum"]:
        out.append((path, "is none of the values"))
    if "const" in schema and value != schema["const"]:
        out.append((path, "is not the value"))
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append((path, "is too small"))
        if value > schema.get("maximum", value):
            out.append((path, "is too large"))
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            out.append((path, "has the wrong length"))
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append((path, "doesn't match the pattern"))
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [(path, f"{name} is missing") for name in schema.get("required", []) if name not in value]
        for name, child in value.items():
            extra = schema.get("additionalProperties", True)
            if name in known:
                out += problems(child, known[name], f"{path}.{name}" if path else name)
            elif extra is False:
                out.append((path, f"{name} isn't allowed"))
            elif isinstance(extra, dict):
                out += problems(child, extra, f"{path}.{name}" if path else name)
    if isinstance(value, list) and "items" in schema:
        out += [p for i, child in enumerate(value) for p in problems(child, schema["items"], f"{path}[{i}]")]
    return out


def json_problems(text: Column, schema: dict) -> Column:
    """`problems` of JSON texts as an array; a text that isn't JSON has one."""

    @F.pandas_udf("array<struct<path string, message string>>")
    def run(batch: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            try:
                found = problems(json.loads(t), schema)
            except ValueError:
                found = [("", "is not JSON")]
            return [{"path": p, "message": m} for p, m in found]

        return batch.map(one)

    return run(text)


def layered(*settings: tuple[str, Column]) -> Column:
    """Maps merged, later ones first in rank: each key with its value and the name of the layer that it comes from."""
    out = None
    for name, layer in settings:
        tagged = F.map_from_entries(F.transform(F.map_entries(layer), _tag(name)))
        out = tagged if out is None else F.map_zip_with(out, tagged, lambda k, a, b: F.coalesce(b, a))
    return out


def _tag(name: str):
    return lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("value"), F.lit(name).alias("origin")).alias("value"))
