"""Faces to people: matching with learning, names, enrolment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut_lineage

THRESHOLD, LEARN, OBSERVED = 0.40, 0.60, 32


def _unit(v) -> np.ndarray:
    x = np.asarray(v, dtype=np.float64)
    n = np.sqrt((x * x).sum())
    return x / n if n else x


class Gallery:
    """Unit vectors of people in one matrix; a person keeps the newest OBSERVED. Vectors of other lengths match nothing."""

    def __init__(self, vectors: dict[int, list] | None = None) -> None:
        self.own: dict[int, list[np.ndarray]] = {p: [_unit(v) for v in vs][-OBSERVED:] for p, vs in (vectors or {}).items()}
        self.rows: np.ndarray | None = None

    def add(self, person: int, vector: np.ndarray) -> None:
        self.own[person] = [*self.own.get(person, []), vector][-OBSERVED:]
        at = len(self.own[person]) - 1
        if self.rows is not None and at < OBSERVED - 1 and len(vector) == self.rows.shape[1] and self.used < len(self.rows):
            self.rows[self.used], self.people[self.used] = vector, person
            self.used += 1
        else:
            self.rows = None

    def best(self, vector: np.ndarray, taken: set[int]) -> tuple[float, int]:
        """The highest cosine of a person who isn't taken, and the person; of equal ones the larger id."""
        if self.rows is None or self.rows.shape[1] != len(vector):
            flat = [(p, v) for p, vs in self.own.items() for v in vs if len(v) == len(vector)]
            self.used, room = len(flat), 2 * len(flat) + 64
            self.rows, self.people = np.zeros((room, len(vector))), np.zeros(room, dtype=np.int64)
            for k, (p, v) in enumerate(flat):
                self.rows[k], self.people[k] = v, p
        people = self.people[: self.used]
        near = self.rows[: self.used] @ vector if vector.any() else np.full(self.used, -1.0)
        near = np.where(np.isin(people, list(taken)), -1.0, near) if taken else near
        top = near.max(initial=-1.0)
        return (float(top), int(people[near == top].max())) if top > -1.0 else (-1.0, 0)


def recognise(faces: list[tuple], gallery: dict[int, list[list[float]]], labels: dict[int, str], counter: int, threshold: float = THRESHOLD) -> tuple[list[tuple], dict[int, list], int]:
    """Faces (unit, vector) of one model in order, against people's vectors.

    A face is the person of the highest cosine from `threshold` on who isn't yet in its
    unit (of equal ones the larger id), else a new person with the next number. Its vector
    is learnt where it is new or similar enough; a person keeps the newest 32.
    Gives (unit, person, similarity, new) per face, the gallery, and the last number.
    """
    known = Gallery(gallery)
    out, taken, unit_now = [], set(), None
    for unit, vector in faces:
        if unit != unit_now:
            unit_now, taken = unit, set()
        own = _unit(vector)
        similarity, person = known.best(own, taken)
        new = similarity < threshold
        if new:
            counter += 1
            similarity, person = 1.0, counter
            labels[person] = f"person-{person}"
        taken.add(person)
        if new or similarity >= max(LEARN, threshold):
            known.add(person, own)
        out.append((unit, person, round(similarity, 3), new))
    return out, known.own, counter


def learn(faces: DataFrame, model: str, order: str, unit: str, vector: str) -> DataFrame:
    """New people of each model, in the order of the faces: `model`, `order`, `person`, `similarity`, `is_new`. Numbers start anew in each model."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        rows, _, _ = recognise(list(zip(group[unit], group[vector])), {}, {}, 0)
        return pd.DataFrame({model: group[model].to_numpy(), order: group[order].to_numpy(), "person": [r[1] for r in rows], "similarity": [r[2] for r in rows], "is_new": [r[3] for r in rows]})

    kinds = {f.name: f.dataType.simpleString() for f in faces.schema.fields}
    return faces.groupBy(model).applyInPandas(run, f"{model} {kinds[model]}, {order} {kinds[order]}, person int, similarity double, is_new boolean")


def good_name(name: Column) -> Column:
    """A name for a person: 1 to 100 printable characters, and no number of an unnamed one."""
    plain = F.trim(name)
    return F.length(plain).between(1, 100) & ~plain.rlike(r"\p{Cntrl}") & ~F.lower(plain).rlike(r"^person-\d+$")


def created(new: DataFrame, order: str, last_number: int) -> DataFrame:
    """Rows with the next labels; numbers are never used again."""
    # Rows of a partition are numbered after those of the partitions before; only the partitions' counts come to the driver.
    rows = new.orderBy(order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    rows = cut_lineage(rows)
    counts = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, total = {}, last_number
    for part in sorted(counts):
        before[part] = total
        total += counts[part]
    first = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else F.create_map().cast("map<int,int>")
    n = F.try_element_at(first, F.col("_part")) + F.col("_at") + 1
    return rows.withColumn("label", F.concat(F.lit("person-"), n.cast("string"))).drop("_part", "_at")


def merged(rows: DataFrame, person: str, pairs: DataFrame) -> DataFrame:
    """Rows re-keyed by (`from_id`, `to_id`)."""
    joined = rows.join(pairs, rows[person] == pairs["from_id"], "left")
    return joined.withColumn(person, F.coalesce("to_id", person)).drop("from_id", "to_id")


def largest_face(faces: DataFrame, photo: str) -> DataFrame:
    """The face of the largest box of each photo."""
    return faces.groupBy(photo).agg(F.max_by(F.struct(*faces.columns), F.struct(F.col("w") * F.col("h"), -F.col("sighting_id"))).alias("f")).select("f.*")
