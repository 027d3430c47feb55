"""A stated set of vectors against all rows, in blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Asking vectors of a block: with 1,024 components they take 32 MB in double precision.
BLOCK_ROWS = 4096

_FOUND = "asked_id long, found_id long, owner long, similarity double"


def _units(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    size = np.sqrt((x * x).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(size[:, None] > 0, x / size[:, None], np.nan)


def _against(asked: dict, k: int, least: float):
    """Of each batch, the k best rows (of k owners) for every asking vector of the same group and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            rows["_n"] = rows["vector"].map(len)
            for key, part in rows.groupby(["grp", "_n"], sort=False):
                if key not in asked:
                    continue
                ids, x = asked[key]
                near = np.nan_to_num(x @ _units(part["vector"].tolist()).T, nan=-2.0)
                own, owner = part["id"].to_numpy(), part["owner"].to_numpy()
                near[ids[:, None] == own[None, :]] = -2.0
                near[near < least] = -2.0
                # Columns by larger owners and smaller ids: among equal similarities the first ones count.
                order = np.lexsort((own, -owner))
                near, own, owner = np.round(near[:, order], 9), own[order], owner[order]
                starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                for start in range(0, len(ids), 512):
                    piece = near[start : start + 512]
                    best = np.maximum.reduceat(piece, starts, axis=1) if len(starts) < len(owner) else piece
                    m = min(k, best.shape[1])
                    edge = np.partition(best, best.shape[1] - m, axis=1)[:, best.shape[1] - m][:, None]
                    equal = best == edge
                    keep = (best > edge) | (equal & (np.cumsum(equal, axis=1) <= m - (best > edge).sum(axis=1)[:, None]))
                    ask, group = np.nonzero(keep & (best > -2.0))
                    ends = np.append(starts[1:], len(owner))
                    column = group if len(starts) == len(owner) else np.array([starts[g] + int(piece[a, starts[g] : ends[g]].argmax()) for a, g in zip(ask, group)], dtype=np.int64)
                    if len(ask):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[start : start + 512][ask]), pa.array(own[column]), pa.array(owner[column]), pa.array(piece[ask, column])], names=["asked_id", "found_id", "owner", "similarity"])

    return run


def top_matches(asked: DataFrame, rows: DataFrame, k: int, least: float = -1.5) -> DataFrame:
    """For each asking row (`id`, `grp`, `vector`), the `k` rows (`id`, `grp`, `vector`, and `owner` where rows belong to
    owners) of its group and length that are most similar to it, of each owner the best only.

    Result: `asked_id`, `found_id`, `owner`, `similarity`, `place`. Similarities are told apart by nine
    places; equal ones are put in the order of larger owners and smaller ids. A row isn't its own match; zero
    vectors match nothing. Asking rows go to the executors in blocks of BLOCK_ROWS, so that a broadcast has a
    bound; each block is a pass over the rows, which are not shuffled.
    """
    spark = asked.sparkSession
    owned = "owner" in rows.columns
    rows = rows.select("id", "grp", "vector", F.col("owner").cast("long").alias("owner") if owned else F.col("id").cast("long").alias("owner")).where("vector IS NOT NULL")
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    numbered = asked.where("vector IS NOT NULL").withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        ready = _block(numbered.where(F.col("_block") == block))
        part = rows.mapInArrow(_against(ready, k, least), _FOUND)
        found = part if found is None else found.unionByName(part)
    if owned:
        best = F.max_by(F.struct("found_id", "similarity"), F.struct("similarity", -F.col("found_id")))
        found = found.groupBy("asked_id", "owner").agg(best.alias("b")).select("asked_id", "b.found_id", "owner", "b.similarity")
    order = Window.partitionBy("asked_id").orderBy(F.desc("similarity"), *([F.desc("owner")] if owned else []), "found_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def all_matches(asked: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """For each asking row every row of its group and length of at least that similarity: `asked_id`, `found_id`, `similarity` (nine places). In blocks, as `top_matches`."""
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    numbered = asked.where("vector IS NOT NULL").withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    rows = rows.select("id", "grp", "vector").where("vector IS NOT NULL")
    found = None
    for block in range(blocks):
        part = rows.mapInArrow(_within(_block(numbered.where(F.col("_block") == block)), least), "asked_id long, found_id long, similarity double")
        found = part if found is None else found.unionByName(part)
    return found


def _block(asked: DataFrame) -> dict:
    """The asking vectors of a block (BLOCK_ROWS or so), by group and length."""
    own: dict = {}
    for r in asked.select("id", "grp", "vector").toPandas().itertuples(index=False):
        own.setdefault((r.grp, len(r.vector)), []).append((r.id, r.vector))
    return {key: (np.array([i for i, _ in v], dtype=np.int64), _units([x for _, x in v])) for key, v in own.items()}


def _within(asked: dict, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            rows["_n"] = rows["vector"].map(len)
            for key, part in rows.groupby(["grp", "_n"], sort=False):
                if key not in asked:
                    continue
                ids, x = asked[key]
                own, units = part["id"].to_numpy(), _units(part["vector"].tolist())
                for start in range(0, len(ids), 512):
                    near = np.round(np.nan_to_num(x[start : start + 512] @ units.T, nan=-2.0), 9)
                    ask, column = np.nonzero((near >= least) & (ids[start : start + 512][:, None] != own[None, :]))
                    if len(ask):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[start : start + 512][ask]), pa.array(own[column]), pa.array(near[ask, column])], names=["asked_id", "found_id", "similarity"])

    return run
