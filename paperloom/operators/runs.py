"""Runs in ordered rows: islands, scenes, range joins, kept-lookback suppression."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], index: str, bridge: int = 2) -> DataFrame:
    """Adds `island`, a number per run of `index` values that are at most `bridge` apart, within `keys`."""
    order = Window.partitionBy(*keys).orderBy(index)
    fresh = F.when(F.col(index) - F.lag(index).over(order) <= bridge, 0).otherwise(1)
    return df.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_fresh")


def scenes(df: DataFrame, keys: list[str], order: list[str], starts: Column) -> DataFrame:
    """Adds `scene`, the number of scene starts up to a row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("scene", F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def near(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, pad: float, bin_size: float = 60.0, open_end: bool = False) -> DataFrame:
    """Points within a span of the same key, `pad` on both sides: an equi-join on time bins, then the exact test.

    A span is copied to the bins of a size of its own, the powers of four of `bin_size`: to five of
    them at most, however long it is, and a point looks into a bin of each size. With `open_end`
    a span doesn't hold its end. Bounds that are null, NaN or infinite count for nothing.
    """
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(1e12))
    bins = lambda c, level: F.floor(c / (F.lit(bin_size) * F.pow(F.lit(4.0), level))).cast("long")
    right = spans.where(fine(start) & fine(end) & (F.col(end) >= F.col(start)))
    size = F.greatest(F.lit(1.0), (F.col(end) - F.col(start) + 2 * pad) / bin_size)
    right = right.withColumn("_level", F.floor(F.log(4.0, size)).cast("int"))
    levels = [r["_level"] for r in right.select("_level").distinct().collect()]  # a few dozen at most
    right = right.withColumn("_bin", F.explode(F.sequence(bins(F.col(start) - pad, F.col("_level")), bins(F.col(end) + pad, F.col("_level")))))
    left = points.where(fine(at)).withColumn("_level", F.explode(F.array(*map(F.lit, sorted(levels))).cast("array<int>"))).withColumn("_bin", bins(F.col(at), F.col("_level")))
    before_end = F.col(at) < F.col(end) + pad if open_end else F.col(at) <= F.col(end) + pad
    return left.join(right, [key, "_level", "_bin"]).where((F.col(at) >= F.col(start) - pad) & before_end).drop("_level", "_bin")


def greedy_boxes(df: DataFrame, keys: list[str], order: str, score: str, box: list[str], threshold: float = 0.5, limit: int | None = None) -> DataFrame:
    """Non-maximum suppression: by falling score, a box is kept unless it overlaps a kept one of its group by more than `threshold`; of each group `limit` boxes at most."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([score, order], ascending=[False, True], kind="stable")
        kept: list[int] = []
        boxes = group[box].to_numpy()
        for i, (x, y, w, h) in enumerate(boxes):
            for k in kept:
                a, b, c, d = boxes[k]
                width, height = max(0.0, min(x + w, a + c) - max(x, a)), max(0.0, min(y + h, b + d) - max(y, b))
                union = w * h + c * d - width * height
                if union > 0 and width * height / union > threshold:
                    break
            else:
                kept.append(i)
                if len(kept) == limit:
                    break
        return group.iloc[kept]

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def drop_near_copies(df: DataFrame, keys: list[str], order: str, fingerprint: str, distance: int, lookback: int = 12) -> DataFrame:
    """In order, drop a row whose 64-bit fingerprint is within `distance` bits of one of the last `lookback` rows kept.

    The rows of a key stream through one sorted partition; only the lookback is held.
    """
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        kept: list[int] = []
        for batch in batches:
            mask = []
            for row in batch[[*keys, fingerprint]].itertuples(index=False, name=None):
                if row[:-1] != key:
                    key, kept = row[:-1], []
                value = int(row[-1]) & (1 << 64) - 1
                good = all((value ^ other).bit_count() > distance for other in kept[-lookback:])
                if good:
                    kept = [*kept[-lookback:], value]
                mask.append(good)
            yield batch.loc[mask, names]

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, df.schema)


def flow_pages(df: DataFrame, key: str, order: str, rows: str, per_page: int = 59) -> DataFrame:
    """Units of `rows` lines on pages: a unit after another takes a blank line; one that fits a page isn't divided."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", page_first int, page_last int"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        page, used = 1, 0
        first, last = [], []
        for n in group[rows]:
            if used and (used + 2 > per_page or (n <= per_page and used + 1 + n > per_page)):
                page, used = page + 1, 0
            elif used:
                used += 1
            first.append(page)
            left = max(1, int(n))
            while left > per_page - used:
                left -= per_page - used
                page, used = page + 1, 0
            used += left
            last.append(page)
        return group.assign(page_first=first, page_last=last)

    return df.groupBy(key).applyInPandas(run, schema)


def flow_runs(df: DataFrame, key: str, order: str, flows: Column) -> DataFrame:
    """Adds `run`, a number per stretch of rows that flow into each other; a row that doesn't is a run of its own."""
    w = Window.partitionBy(key).orderBy(order)
    starts = F.when(flows & F.coalesce(F.lag(flows).over(w), F.lit(False)), 0).otherwise(1)
    return df.withColumn("_starts", starts).withColumn("run", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_starts")


def text_blocks(lines: DataFrame, key: str, order: str = "y") -> DataFrame:
    """Adds `block` to lines of text (`y`, `height`): a new one where the gap to the line above is as high as that line or higher."""
    w = Window.partitionBy(key).orderBy(order)
    gap = F.col("y") - (F.lag("y").over(w) + F.lag("height").over(w))
    starts = F.when(gap < F.lag("height").over(w), 0).otherwise(1)
    return lines.withColumn("_starts", starts).withColumn("block", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_starts")
