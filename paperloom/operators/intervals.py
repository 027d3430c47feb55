"""Continuous periods and gaps of overlapping intervals, by run bitmaps.

Time is discretised to half units: unit t is slot 2t, and the open stretch between
t and t+1 is slot 2t+1. A closed interval [s, e] sets the slots 2s..2e, so that
intervals that only touch share a slot, intervals one unit apart keep a clear slot
between them, and an interval of zero length still sets one slot. The bitmap of an
entity is cut into shards of `SHARD_SLOTS` slots and held run-compressed, as
ascending (lo, hi) pairs of set slots.

Steps: cut each interval at shard borders (head and tail in their shards, all whole
shards between them as one row); union the runs of each Arrow batch before the
shuffle; union them per entity and shard; then walk the shards of an entity in order
and read off set runs (periods) and clear runs (gaps). Both walks stream over rows
that Spark has sorted (externally, with spill): no group is ever held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (sort_indices)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of a shard: 2**22 half milliseconds are about 35 minutes.
SHARD_SLOTS = 1 << 22


def _same_as_before(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """For rows 1.., whether all of `names` equal those of the row before (null equals null)."""
    same = np.ones(max(0, batch.num_rows - 1), dtype=bool)
    for name in names:
        codes = batch.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        same &= codes[1:] == codes[:-1]
    return same


def _runs(lo: np.ndarray, hi: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of rows sorted by key and lo: index of each run's first row, and each run's last slot."""
    n = len(lo)
    group = np.concatenate([[0], np.cumsum(~same)]) if n else np.zeros(0, dtype=np.int64)
    top = hi.copy()
    starts = np.flatnonzero(np.concatenate([[True], ~same])) if n else np.zeros(0, dtype=np.int64)
    for a, b in zip(starts, np.append(starts[1:], n)):
        np.maximum.accumulate(hi[a:b], out=top[a:b])
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (group[1:] != group[:-1]) | (lo[1:] > top[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], n) - 1 if n else first
    return first, top[last]


def _combine(keys: list[str]):
    """Map-side union: the runs of one Arrow batch, per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = pa.compute.sort_indices(batch, sort_keys=[(k, "ascending") for k in [*keys, "lo"]])
            batch = batch.take(order)
            lo, hi = batch.column("lo").to_numpy(), batch.column("hi").to_numpy()
            first, top = _runs(lo, hi, _same_as_before(batch, keys))
            out = batch.take(pa.array(first))
            yield out.set_column(out.schema.get_field_index("hi"), "hi", pa.array(top, pa.int64()))

    return run


def _stream(keys: list[str], gaps: bool, schema: pa.Schema):
    """Union over a partition sorted by keys and lo, carrying the open run from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key: tuple | None = None
        open_lo = open_hi = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple] = []
            first, top = _runs(batch.column("lo").to_numpy(), batch.column("hi").to_numpy(), _same_as_before(batch, keys))
            head = batch.take(pa.array(first))
            columns = [head.column(k).to_pylist() for k in keys]
            for *key, lo, hi in zip(*columns, head.column("lo").to_pylist(), top.tolist()):
                key = tuple(key)
                if key == open_key and lo <= open_hi + 1:
                    open_hi = max(open_hi, hi)
                    continue
                if open_key is not None:
                    out.append((*open_key, "period", open_lo, open_hi))
                    if gaps and key == open_key:
                        out.append((*key, "gap", open_hi, lo))
                open_key, open_lo, open_hi = key, lo, hi
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if open_key is not None:
            row = [(*open_key, "period", open_lo, open_hi)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*row), schema)], schema=schema)

    return run


def periods_and_gaps(df: DataFrame, keys: list[str], start: Column, end: Column, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Maximal periods and the gaps between them, per entity.

    `keys` name the entity's columns; `start` and `end` are int64 time units. Result:
    the keys, `span_kind` ('period' or 'gap'), `start_unit`, `end_unit`. Rows with a
    null bound or an end before the start don't count; null keys form an entity of
    their own; repeated rows change nothing; touching intervals join; an interval of
    zero length is a period. An empty table gives an empty result. Other columns of
    `df` are dropped first, whatever their names. Units may be negative; their size is below 2**51.
    """
    own = [f"_k{i}" for i in range(len(keys))]
    cut = df.select(*(F.col(f"`{k}`").alias(o) for k, o in zip(keys, own)), start.cast("long").alias("_s"), end.cast("long").alias("_e"))
    cut = cut.where("_s IS NOT NULL AND _e IS NOT NULL AND _e >= _s")
    slots = cut.select(*own, (F.col("_s") * 2).alias("lo"), (F.col("_e") * 2).alias("hi"))
    size = F.lit(shard_slots).cast("long")
    # Integer floor division that also holds for negative slots.
    shard = lambda c: ((F.col(c) - F.pmod(F.col(c), size)) / size).cast("long")
    parts = slots.withColumn("_a", shard("lo")).withColumn("_b", shard("hi"))
    piece = lambda sh, lo, hi: F.struct(sh.alias("shard"), lo.alias("lo"), hi.alias("hi"))
    a, b, lo, hi = (F.col(c) for c in ("_a", "_b", "lo", "hi"))
    parts = parts.select(
        *own,
        F.inline(
            F.when(a == b, F.array(piece(a, lo, hi)))
            .when(b == a + 1, F.array(piece(a, lo, b * size - 1), piece(b, b * size, hi)))
            .otherwise(F.array(piece(a, lo, (a + 1) * size - 1), piece(a + 1, (a + 1) * size, b * size - 1), piece(b, b * size, hi)))
        ),
    )
    combined = parts.mapInArrow(_combine([*own, "shard"]), parts.schema)
    types = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    arrow = lambda names: pa.schema([(n, _arrow_type(types.get(n, "string" if n == "span_kind" else "bigint"))) for n in names])
    by_shard = [*own, "shard"]
    shard_names = [*by_shard, "span_kind", "lo", "hi"]
    unions = (
        combined.repartition(*by_shard)
        .sortWithinPartitions(*by_shard, "lo")
        .mapInArrow(_stream(by_shard, False, arrow(shard_names)), ", ".join(f"{n} {types.get(n, 'string')}" for n in shard_names))
        .drop("span_kind")
    )
    names = [*own, "span_kind", "lo", "hi"]
    spans = (
        unions.select(*own, "lo", "hi")
        .repartition(*own)
        .sortWithinPartitions(*own, "lo")
        .mapInArrow(_stream(own, True, arrow(names)), ", ".join(f"{n} {types.get(n, 'string')}" for n in names))
    )
    return spans.select(
        *(F.col(o).alias(k) for o, k in zip(own, keys)),
        "span_kind",
        (F.col("lo") / 2).cast("long").alias("start_unit"),
        (F.col("hi") / 2).cast("long").alias("end_unit"),
    )


def _arrow_type(name: str) -> pa.DataType:
    simple = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string(), "boolean": pa.bool_(), "date": pa.date32(), "binary": pa.binary()}
    if name not in simple:
        raise TypeError(f"an entity column of type {name} isn't supported")
    return simple[name]


def seconds_to_ms(column: Column) -> Column:
    """Seconds as whole milliseconds; null for null, NaN, infinite or beyond 10**12 seconds."""
    ok = ~F.isnan(column) & (F.abs(column) < F.lit(1e12))
    return F.when(ok, F.round(column * 1000).cast("long"))
