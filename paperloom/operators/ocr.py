"""Recognised words as lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lines(words: DataFrame, key: str) -> DataFrame:
    """Words (`text`, `x`, `y`, `width`, `height`, `confidence`) of a key as lines.

    A word begins a row when its centre is farther from the row's first word than half the
    larger height; a row is cut where a gap is wider than three of its heights. A line has
    the union of its boxes and its least confidence.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        items = sorted(group.to_dict("records"), key=lambda w: (w["y"] + w["height"] / 2, w["x"]))
        rows: list[list[dict]] = []
        for w in items:
            centre = w["y"] + w["height"] / 2
            if rows and abs(centre - rows[-1][0]["y"] - rows[-1][0]["height"] / 2) <= max(w["height"], rows[-1][0]["height"]) / 2:
                rows[-1].append(w)
            else:
                rows.append([w])
        out = []
        for row in rows:
            row.sort(key=lambda w: w["x"])
            tall = max(w["height"] for w in row)
            parts = [[row[0]]]
            for w in row[1:]:
                if w["x"] - (parts[-1][-1]["x"] + parts[-1][-1]["width"]) > 3 * tall:
                    parts.append([w])
                else:
                    parts[-1].append(w)
            for p in parts:
                x, y = min(w["x"] for w in p), min(w["y"] for w in p)
                scores = [w["confidence"] for w in p if w["confidence"] is not None and w["confidence"] == w["confidence"]]
                out.append((p[0][key], " ".join(w["text"] for w in p), x, y, max(w["x"] + w["width"] for w in p) - x, max(w["y"] + w["height"] for w in p) - y, min(scores) if scores else None))
        return pd.DataFrame(out, columns=[key, "text", "x", "y", "width", "height", "confidence"])

    kind = words.schema[key].dataType.simpleString()
    return words.groupBy(key).applyInPandas(run, f"{key} {kind}, text string, x double, y double, width double, height double, confidence double")


def joined_text(words: DataFrame, key: str, position: str) -> DataFrame:
    """A unit's words as one text: a space where a word follows in the same line, else a line break."""
    w = Window.partitionBy(key).orderBy(position)
    centre = lambda lag: (F.lag("y").over(w) + F.lag("height").over(w) / 2) if lag else F.col("y") + F.col("height") / 2
    near = F.abs(centre(False) - centre(True)) <= F.greatest(F.col("height"), F.lag("height").over(w)) / 2
    follows = (F.col("x") > F.lag("x").over(w)) & near
    gap = F.when(F.lag("text").over(w).isNull(), "").when(follows, " ").otherwise("\n")
    parts = words.withColumn("_part", F.concat(gap, "text")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(position, "_part"))).alias("r"))
    return parts.select(key, F.array_join("r._part", "").alias("text"))
