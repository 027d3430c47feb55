"""Content-derived identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def derived_uuid(domain: str, *parts: Column) -> Column:
    """A version 8 UUID from SHA-256 over the domain and the parts, zero bytes between them."""
    raw = F.encode(F.lit(domain), "UTF-8")
    for part in parts:
        raw = F.concat(raw, F.unhex(F.lit("00")), F.encode(part.cast("string"), "UTF-8"))
    h = F.sha2(raw, 256)
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1).cast("int"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
