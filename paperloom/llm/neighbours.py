"""The k most similar vectors of every vector, by a hierarchical k-means tree.

Per model and dimension a tree is fitted on a bounded sample (`FIT_ROWS`, documented
here and in the README). Leaves that the sample is too small to split, as they hold many
more rows than `LEAF_ROWS`, are fitted again, in parallel, each on a second sample of its
own rows, until all are small enough or the tree has `TREE_BYTES`; so the leaves grow in
number with the rows. Every row is indexed and every row asks. A row belongs to the
leaf that a best-bin-first walk reaches first: a priority queue holds the nodes seen,
the one most similar to the row is taken, its children are compared and put in, and so on.
As a query, the row goes on popping leaves: as many as a calibration needs to reach the
wanted recall (visits are widened one by one until it does). It asks with held-out rows,
whose true neighbours among all rows are found by brute force.

Rows of a leaf meet in one task. A leaf of more than `BLOCK_ROWS` rows is cut into
blocks of members that each see all of the leaf's queries; members of a block come
first in its sorted partition and queries stream past them, so that a task holds one
block and one batch. Vectors travel in 16 bits a component; pairs for which the rounding
could decide are scored again from the vectors themselves. Equal vectors are searched once, by
their smallest id, and all rows get their lists back at the end; a group of copies never
meets itself pairwise.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.vectors import cosine
from paperloom.session import cut_lineage

#: Rows of one model (and dimension) that a tree is fitted and calibrated on; all models together take FIT_TOTAL.
FIT_ROWS = 16_384
FIT_TOTAL = 131_072
LEAF_ROWS = 2_048
BLOCK_ROWS = 16_384
BRANCHES = 8
#: Copies' keys up to this many rows (of about 40 bytes) are broadcast; beyond it they are joined.
BROADCAST_ROWS = 500_000
#: Bytes of all trees' centres, which are sent to every executor.
TREE_BYTES = 64 << 20
#: Held-out rows that ask for the calibration, of all models together.
ASKS = 4096
#: Neighbours beyond the wanted ones that are kept until the rounding has been dealt with.
SPARE = 3


@dataclass
class Tree:
    """Nodes by number, root 0: unit centres, first child and number of children (0: a leaf), leaf numbers."""

    centres: np.ndarray
    child: np.ndarray
    children: np.ndarray
    leaf: np.ndarray
    share: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def leaves(self) -> int:
        return int((self.children == 0).sum())

    def visit(self, rows: np.ndarray, visits: int) -> np.ndarray:
        """Best-bin-first for many rows at once: for each, the first `visits` leaves popped (-1 where there are no more).

        Each row's queue is a line of nodes and similarities; only children of nodes that were taken are compared.
        """
        out = np.full((len(rows), visits), -1, dtype=np.int32)
        if self.children[0] == 0:
            out[:, 0] = 0
            return out
        width = int(self.children.max())
        similar = np.full((len(rows), 4 * width), -np.inf, dtype=np.float32)
        nodes = np.zeros(similar.shape, dtype=np.int32)
        used = np.zeros(len(rows), dtype=np.int64)
        got = np.zeros(len(rows), dtype=np.int32)

        def expand(who: np.ndarray, node: np.ndarray) -> None:
            nonlocal similar, nodes
            while used[who].max() + width > similar.shape[1]:
                similar = np.hstack([similar, np.full_like(similar, -np.inf)])
                nodes = np.hstack([nodes, np.zeros_like(nodes)])
            order = np.argsort(node, kind="stable")
            cuts = np.flatnonzero(np.diff(node[order])) + 1
            for part in np.split(order, cuts):
                mine, k = who[part], node[part[0]]
                kids = np.arange(self.child[k], self.child[k] + self.children[k])
                place = used[mine][:, None] + np.arange(len(kids))
                similar[mine[:, None], place] = rows[mine] @ self.centres[kids].T
                nodes[mine[:, None], place] = kids
                used[mine] += len(kids)

        active = np.arange(len(rows))
        expand(active, np.zeros(len(rows), dtype=np.int64))
        while len(active):
            sub = similar[active]
            best = sub.argmax(axis=1)
            live = sub[np.arange(len(active)), best] > -np.inf
            active, best = active[live], best[live]
            node = nodes[active, best]
            similar[active, best] = -np.inf
            is_leaf = self.children[node] == 0
            at = active[is_leaf]
            out[at, got[at]] = self.leaf[node[is_leaf]]
            got[at] += 1
            if not is_leaf.all():
                expand(active[~is_leaf], node[~is_leaf])
            active = active[got[active] < visits]
        return out

    def grafted(self, parts: dict[int, Tree]) -> Tree:
        """This tree with trees in place of some of its leaves."""
        centres, child, children, share = [self.centres], self.child.copy(), self.children.copy(), self.share
        more_child, more_children, shares = [], [], {}
        at = len(self.centres)
        for node in np.flatnonzero(self.children == 0):
            part = parts.get(int(self.leaf[node]))
            if part is None or part.leaves < 2:
                shares[int(node)] = share[self.leaf[node]]
                continue
            # The part's root is the leaf itself; its other nodes are put at the end.
            child[node], children[node] = at + part.child[0] - 1, part.children[0]
            centres.append(part.centres[1:])
            more_child.append(np.where(part.children[1:] > 0, part.child[1:] + at - 1, 0))
            more_children.append(part.children[1:])
            for k in np.flatnonzero(part.children == 0):
                shares[at + int(k) - 1] = share[self.leaf[node]] * part.share[part.leaf[k]]
            at += len(part.centres) - 1
        children = np.concatenate([children, *more_children])
        leaf = np.full(len(children), -1, dtype=np.int32)
        ends = np.flatnonzero(children == 0)
        leaf[ends] = np.arange(len(ends))
        return Tree(np.concatenate(centres).astype(np.float32), np.concatenate([child, *more_child]), children, leaf, np.array([shares[int(k)] for k in ends]))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        out = x / norm[:, None]
    return np.nan_to_num(out).astype(np.float32)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; empty means take the rows that fit worst."""
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    owner = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        near = x @ centres.T
        owner = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, x)
        empty = np.flatnonzero(np.bincount(owner, minlength=k) == 0)
        if len(empty):
            sums[empty] = x[np.argsort(near.max(axis=1))[: len(empty)]]
        centres = _unit(sums)
    return centres, (x @ centres.T).argmax(axis=1)


def fit_tree(sample: np.ndarray, rows: int, seed: int = 1, leaf_rows: int = LEAF_ROWS) -> Tree:
    """A tree whose leaves hold about `leaf_rows` of `rows` rows; no leaf is split below 16 rows of the sample."""
    rng = np.random.default_rng(seed)
    least = max(16, round(leaf_rows * len(sample) / max(1, rows)))
    centres, child, children, members = [_unit(sample.sum(axis=0, keepdims=True))[0] if len(sample) else np.zeros(sample.shape[1])], [0], [0], [np.arange(len(sample))]
    at = 0
    while at < len(centres):
        own = members[at]
        k = min(BRANCHES, len(own) // least)
        if k >= 2:
            means, owner = _kmeans(sample[own], k, rng)
            kept = [j for j in range(k) if (owner == j).any()]
            if len(kept) >= 2:
                child[at], children[at] = len(centres), len(kept)
                for j in kept:
                    centres.append(means[j])
                    child.append(0)
                    children.append(0)
                    members.append(own[owner == j])
        at += 1
    children_, leaf = np.array(children), np.full(len(centres), -1, dtype=np.int32)
    ends = np.flatnonzero(children_ == 0)
    leaf[ends] = np.arange(len(ends))
    tree = Tree(np.array(centres, dtype=np.float32), np.array(child), children_, leaf)
    counts = np.bincount(tree.visit(sample, 1)[:, 0], minlength=len(ends)) if len(sample) else np.zeros(len(ends))
    tree.share = counts / max(1, counts.sum())
    return tree


def calibrate(tree: Tree, asking: np.ndarray, wanted: np.ndarray, recall: float) -> int:
    """Leaf visits at which `recall` of the wanted rows' leaves (-1 for none, a line for each asking row) have been visited."""
    total = (wanted >= 0).sum()
    if tree.leaves < 2 or not total:
        return 1
    visits = 1
    while visits < tree.leaves:
        seen = tree.visit(asking, visits)
        if ((seen[:, :, None] == wanted[:, None, :]).any(axis=1) & (wanted >= 0)).sum() >= recall * total:
            break
        visits += 1
    return visits


def _keyed(trees: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of batches of `_id`, `_model`, `_dim`, `_v`: for each key of `trees`, its rows' ids and unit vectors."""
    for batch in batches:
        dims = batch.column("_dim").fill_null(-1).to_numpy()
        ids = batch.column("_id").to_numpy()
        models = np.array(batch.column("_model").to_pylist(), dtype=object)
        _, groups, vectors = _matrix(batch.column("_v"), dims)
        for at, v in zip(groups, vectors):
            for model in set(models[at]):
                key = (model, v.shape[1])
                if key in trees:
                    mine = np.flatnonzero(models[at] == model)
                    yield key, ids[at[mine]], _unit(v[mine])


_NEAREST = "key int, ask int, similarity float, id long, leaf int"


def _truth(trees: dict, numbers: dict, asks: dict, k: int):
    """Each batch's k rows most similar to each asking row, with their leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, unit in _keyed(asks, batches):
            own, asking = asks[key]
            near = asking @ unit.T
            near[(own[:, None] == ids[None, :]) | (near > 1 - 1e-6)] = -2  # copies are found by their hashes
            m = min(k, near.shape[1])
            top = np.argpartition(-near, m - 1, axis=1)[:, :m]
            ask = np.repeat(np.arange(len(own)), m)
            leaf = trees[key].visit(unit[top.ravel()], 1)[:, 0]
            columns = [np.full(len(ask), numbers[key], dtype=np.int32), ask.astype(np.int32), near[ask, top.ravel()].astype(np.float32), ids[top.ravel()], leaf]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "ask", "similarity", "id", "leaf"])

    return run


def _second_sample(trees: dict, numbers: dict, chances: dict, seed: int):
    """A sample of the rows of each leaf that is too large, with the number of its tree and leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, unit in _keyed(trees, batches):
            leaf = trees[key].visit(unit, 1)[:, 0]
            draw = (ids.view(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64) / (1 << 53)
            at = np.flatnonzero(draw < chances[key][leaf])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), numbers[key], dtype=np.int32)), pa.array(leaf[at]), pa.array(list(unit[at]), pa.list_(pa.float32()))], names=["key", "leaf", "v"])

    return run


def _fit_part(expected: dict, leaf_rows: int):
    """A tree for the sample of one leaf, as one row."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        key, leaf = int(group["key"].iloc[0]), int(group["leaf"].iloc[0])
        part = fit_tree(np.stack(group["v"].to_numpy()).astype(np.float32), expected[key, leaf], leaf_rows=leaf_rows)
        return pd.DataFrame({"key": [key], "leaf": [leaf], "tree": [pickle.dumps(part)]})

    return run


def grown(own: DataFrame, trees: dict, sizes: dict, leaf_rows: int, fit_rows: int, rounds: int = 4) -> dict:
    """The trees with second fits for leaves of more than four times `leaf_rows` rows, within TREE_BYTES."""
    numbers = {key: k for k, key in enumerate(trees)}
    names = {k: key for key, k in numbers.items()}
    for seed in range(rounds):
        size = sum(t.centres.nbytes for t in trees.values())
        big = sorted(((t.share[leaf] * sizes[key], key, leaf) for key, t in trees.items() for leaf in np.flatnonzero(t.share * sizes[key] > 4 * leaf_rows)), key=lambda x: -x[0])
        # A part of n sample rows has at most n / 16 leaves, and a seventh more inner nodes.
        chosen, chances, expected = [], {key: np.zeros(t.leaves) for key, t in trees.items()}, {}
        for rows, key, leaf in big:
            nodes = min(rows / leaf_rows, min(fit_rows, rows) / 16) * 8 / 7
            if size + nodes * 4 * key[1] > TREE_BYTES:
                break
            size += nodes * 4 * key[1]
            chosen.append((key, leaf))
            chances[key][leaf], expected[numbers[key], int(leaf)] = min(1.0, fit_rows / rows), int(rows)
        if not chosen:
            break
        live = {key: trees[key] for key, _ in chosen}
        sample = own.mapInArrow(_second_sample(live, numbers, chances, seed), "key int, leaf int, v array<float>")
        rows = sample.groupBy("key", "leaf").applyInPandas(_fit_part(expected, leaf_rows), "key int, leaf int, tree binary").collect()  # TREE_BYTES at most
        parts: dict = {}
        for r in rows:
            parts.setdefault(names[r.key], {})[r.leaf] = pickle.loads(r.tree)
        before = {key: trees[key].leaves for key in parts}
        trees = trees | {key: trees[key].grafted(own_parts) for key, own_parts in parts.items()}
        if all(trees[key].leaves == n for key, n in before.items()):
            break
    return trees


def _matrix(column: pa.ChunkedArray | pa.Array, dims: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of a column of lists: usable rows, and per dimension their row numbers and vectors."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = array.offsets.to_numpy()
    lengths = np.diff(offsets)
    ok = np.asarray(array.is_valid()) & (lengths == dims) & (dims > 0)
    values = array.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float32)
    whole = np.isfinite(flat)
    if values.null_count:
        whole &= np.asarray(values.is_valid())
    rows, vectors = [], []
    for d in np.unique(dims[ok]):
        at = np.flatnonzero(ok & (dims == d))
        index = offsets[at][:, None] + np.arange(d)[None, :]
        good = whole[index].all(axis=1) & (flat[index] != 0).any(axis=1)
        ok[at[~good]] = False
        rows.append(at[good])
        vectors.append(flat[index[good]])
    return ok, rows, vectors


def pack(unit: np.ndarray) -> np.ndarray:
    """Unit vectors in 16 bits a component, after a scale of their own (two 16-bit words)."""
    scale = (np.abs(unit).max(axis=1) / 32767).astype(np.float32)
    out = np.empty((len(unit), unit.shape[1] + 2), dtype=np.int16)
    out[:, :2] = scale[:, None].view(np.int16)
    out[:, 2:] = np.rint(unit / scale[:, None])
    return out


def unpack(packed: np.ndarray) -> np.ndarray:
    return packed[:, 2:].astype(np.float32) * np.ascontiguousarray(packed[:, :2]).view(np.float32)


def rounding(dim: int) -> float:
    """By how much a similarity of packed vectors may be off: half a step in each component of both, and float32 sums."""
    return 2 * float(np.sqrt(dim)) / 65534 + 1e-6 * dim**0.5


_ROUTED = pa.schema([("cell", pa.int32()), ("asks", pa.bool_()), ("id", pa.int64()), ("v", pa.binary())])


def _route(trees: dict, visits: dict, first_cell: dict, blocks: dict):
    """Rows to cells: once as a member, and once for each visited leaf (and each of its blocks) as a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own, unit in _keyed(trees, batches):
            seen = trees[key].visit(unit, visits[key])
            packed = pack(unit)
            n_blocks, start = blocks[key], first_cell[key]
            member = start[seen[:, 0]] + (own.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n_blocks[seen[:, 0]]
            row, visit = np.nonzero(seen >= 0)
            leaf = seen[row, visit]
            each = n_blocks[leaf]
            row = np.repeat(row, each)
            cell = np.repeat(start[leaf], each) + (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each))
            for cells, rows, asks in ((member, np.arange(len(own)), False), (cell, row, True)):
                for a in range(0, len(rows), 20_000):
                    part = packed[rows[a : a + 20_000]]
                    size = part.shape[1] * 2
                    data = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((np.arange(len(part) + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(part))])
                    yield pa.RecordBatch.from_arrays([pa.array(cells[a : a + 20_000].astype(np.int32)), pa.array(np.full(len(part), asks)), pa.array(own[rows[a : a + 20_000]]), data], schema=_ROUTED)

    return run


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float32())])


def _search(k: int, least: float | None, off: float):
    """Of partitions sorted by cell, members first: each query's best members in that cell."""

    def floats(column: pa.Array) -> np.ndarray:
        size = len(column[0].as_py()) // 2
        offset = int(np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset])  # rows before may be of other sizes
        return unpack(np.frombuffer(column.buffers()[2], dtype=np.int16, count=len(column) * size, offset=offset).reshape(len(column), size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, parts, members = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("cell").to_numpy()
            asks = np.asarray(batch.column("asks"))
            cuts = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])]))
            for a, b in zip(cuts, np.append(cuts[1:], len(cells))):
                piece = batch.slice(a, b - a)
                own, v = piece.column("id").to_numpy(), floats(piece.column("v"))
                if cells[a] != current:
                    current, ids, parts, members = cells[a], [], [], None
                if not asks[a]:
                    ids.append(own.copy())
                    parts.append(v)
                    continue
                if not parts:
                    continue
                if members is None:
                    members, member_ids = np.concatenate(parts), np.concatenate(ids)
                for s in range(0, len(own), 2048):
                    near = v[s : s + 2048] @ members.T
                    asking = own[s : s + 2048]
                    if least is not None:
                        row, col = np.nonzero(near >= least - off)
                        other = member_ids[col] != asking[row]
                        row, col = row[other], col[other]
                        value = near[row, col]
                        order = np.lexsort((member_ids[col], -value, row))
                        row, col, value = row[order], col[order], value[order]
                        place = np.arange(len(row)) - np.searchsorted(row, row)
                        top = place < k
                        row, col, value = row[top], col[top], value[top]
                    else:
                        m = min(k + 1, near.shape[1])
                        col = np.argpartition(-near, m - 1, axis=1)[:, :m]
                        row = np.repeat(np.arange(len(asking)), m)
                        col = col.ravel()
                        value = near[row, col]
                        other = member_ids[col] != asking[row]
                        row, col, value = row[other], col[other], value[other]
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(asking[row]), pa.array(member_ids[col]), pa.array(value.astype(np.float32))], schema=_PAIRS)

    return run


def _top(df: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("similarity"), "b")
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _settled(found: DataFrame, own: DataFrame, k: int, least: float | None, off: float) -> DataFrame:
    """Lists of more than k candidates cut to k; where the rounding could decide, similarities are taken from the vectors."""
    found = cut_lineage(_top(found, "a", k + SPARE))
    last = Window.partitionBy("a")
    at = lambda place: F.max(F.when(F.col("place") == place, F.col("similarity"))).over(last)
    unsure = F.coalesce(F.when(F.col("place") <= k, F.col("similarity") - at(k + 1)).otherwise(at(k) - F.col("similarity")) < 2 * off, F.lit(False))
    if least is not None:
        unsure = unsure | (F.abs(F.col("similarity") - least) < off)
    marked = cut_lineage(found.withColumn("unsure", unsure))
    ids = cut_lineage(marked.where("unsure").select(F.explode(F.array("a", "b")).alias("_id")).distinct())
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    vectors = cut_lineage(own.join(ids, "_id", "left_semi").select("_id", "_v"))
    side = lambda name, v: vectors.select(F.col("_id").alias(name), F.col("_v").alias(v))
    exact = marked.where("unsure").join(side("a", "_x"), "a").join(side("b", "_y"), "b").select("a", "b", cosine(F.col("_x"), F.col("_y")).cast("float").alias("similarity"))
    whole = marked.where("NOT unsure").select("a", "b", "similarity").unionByName(exact)
    return _top(whole if least is None else whole.where(F.col("similarity") >= F.lit(float(least)).cast("float")), "a", k)


def nearest(df: DataFrame, vec_id: str, vector: str, model: str, dim: str, k: int = 5, least: float | None = None, recall: float = 0.95, leaf_rows: int = LEAF_ROWS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Each usable row's `k` most similar rows of the same model and dimension.

    Result: `a` (the asking row's id), `b`, `similarity`, `place` (from 1; equal
    similarities in the order of ids). A usable vector isn't null, has exactly `dim`
    components, all finite, not all zero. With `least`, only neighbours of at least that
    similarity come out, and the search is calibrated for them. Unusable rows neither ask nor
    answer; a null model is a model of its own; copies of a vector answer each other with
    similarity 1. Ids are int64 and unique; an empty table gives an empty result; extra
    columns are dropped.
    """
    own = df.select(F.col(f"`{vec_id}`").cast("long").alias("_id"), F.col(f"`{model}`").cast("string").alias("_model"), F.col(f"`{dim}`").cast("int").alias("_dim"), F.col(f"`{vector}`").cast("array<float>").alias("_v"))
    # array_max takes NaN for the largest value and skips nulls.
    own = own.where("_id IS NOT NULL AND _dim > 0 AND size(_v) = _dim AND size(array_compact(_v)) = _dim")
    top, low, far = F.array_max("_v"), F.array_min("_v"), F.lit(float("inf"))
    own = own.where(~F.isnan(top) & (top < far) & (low > -far) & ((top != 0) | (low != 0)))
    spark = df.sparkSession
    sizes = {(r["_model"], r["_dim"]): r["n"] for r in own.groupBy("_model", "_dim").agg(F.count("*").alias("n")).collect()}  # a row per model
    if not sizes:
        return spark.createDataFrame([], "a long, b long, similarity float, place int")
    bound, asked = min(fit_rows, max(64, FIT_TOTAL // len(sizes))), max(8, ASKS // len(sizes))
    unit = 1 << 30
    limits = spark.createDataFrame([(m, d, int(min(1.0, bound / n) * unit), int(min(1.0, asked / n) * unit)) for (m, d), n in sizes.items()], "_m string, _d int, _fit long, _ask long")
    draw = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(unit))
    drawn = own.withColumn("_draw", draw).join(F.broadcast(limits), F.col("_model").eqNullSafe(F.col("_m")) & (F.col("_dim") == F.col("_d")))
    # Rows that ask are held out of the fit while there are rows enough.
    drawn = drawn.withColumn("_asks", F.col("_draw") >= unit - F.col("_ask")).where("_draw < _fit OR _asks")
    sample = drawn.select("_id", "_model", "_dim", "_v", "_asks", (F.col("_draw") < F.col("_fit")).alias("_fits")).toArrow()
    trees, asks = {}, {}
    fits, asking = np.asarray(sample.column("_fits")), np.asarray(sample.column("_asks"))
    fits = fits & (~asking | (fits.sum() < 2 * asking.sum()))
    for chosen, take in ((fits, lambda key, ids, v: trees.__setitem__(key, v)), (asking, lambda key, ids, v: asks.__setitem__(key, (ids, v)))):
        for key, ids, v in _keyed(sizes, sample.filter(pa.array(chosen)).combine_chunks().to_batches() if chosen.any() else []):
            take(key, ids, v)
    trees = {key: fit_tree(trees.get(key, np.zeros((0, key[1]), dtype=np.float32)), n, leaf_rows=leaf_rows) for key, n in sorted(sizes.items(), key=lambda x: (x[0][0] is None, x[0]))}
    trees = grown(own, trees, sizes, leaf_rows, fit_rows)
    numbers = {key: n for n, key in enumerate(trees)}
    asks = {key: pair for key, pair in asks.items() if trees[key].leaves > 1}
    wanted = {key: np.full((len(asks[key][0]), k), -1) for key in asks}
    if asks:
        near = _top(own.mapInArrow(_truth(trees, numbers, asks, k), _NEAREST).withColumn("a", F.struct("key", "ask")).withColumnRenamed("id", "b"), "a", k)
        names = {n: key for key, n in numbers.items()}
        rows = near.select("key", "ask", "place", "leaf", "similarity").collect()  # ASKS times k
        enough = {key: sum(names[r.key] == key and r.similarity >= least for r in rows) >= 100 for key in asks} if least is not None else {}
        for r in rows:
            key = names[r.key]
            if least is None or r.similarity >= least or not enough[key]:
                wanted[key][r.ask, r.place - 1] = r.leaf
    visits, first_cell, blocks, cell = {}, {}, {}, 0
    for key, tree in trees.items():
        visits[key] = calibrate(tree, asks[key][1], wanted[key], recall) if key in asks else 1
        blocks[key] = np.maximum(1, np.ceil(tree.share * sizes[key] / BLOCK_ROWS)).astype(np.int64)
        first_cell[key] = cell + np.cumsum(blocks[key]) - blocks[key]
        cell += int(blocks[key].sum())
    off = rounding(max(d for _, d in sizes))
    # Copies: equal vectors by two hashes (96 bits); the smallest id stands for all.
    hashed = own.withColumn("_h", F.xxhash64("_v")).withColumn("_g", F.hash("_v"))
    keys = ["_model", "_dim", "_h", "_g"]
    copies = cut_lineage(hashed.groupBy(keys).agg(F.count("*").alias("n"), F.min("_id").alias("rep")).where("n > 1").drop("n"))
    n_copies = copies.count()
    kept = own
    if n_copies:
        small = F.broadcast(copies) if n_copies <= BROADCAST_ROWS else copies
        same = [hashed["_model"].eqNullSafe(copies["_model"]), *(hashed[c] == copies[c] for c in keys[1:])]
        grouped = hashed.join(small, same, "left").select(*(hashed[c] for c in own.columns), "rep")
        kept = grouped.where("rep IS NULL OR rep = _id").drop("rep")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    routed = kept.mapInArrow(_route(trees, visits, first_cell, blocks), "cell int, asks boolean, id long, v binary")
    met = routed.repartition(parts, "cell").sortWithinPartitions("cell", "asks").mapInArrow(_search(k + SPARE, least, off), "a long, b long, similarity float")
    found = _settled(met, own, k, least, off)
    if not n_copies:
        return found
    members = hashed.select(*keys, "_id").join(small, [hashed["_model"].eqNullSafe(copies["_model"]), *(hashed[c] == copies[c] for c in keys[1:])]).select("rep", F.col("_id").alias("x"))
    heads = members.withColumn("_r", F.row_number().over(Window.partitionBy("rep").orderBy("x"))).where(F.col("_r") <= k + 1).select("rep", "x")
    spread = found.join(heads, found["b"] == heads["rep"], "left").select("a", F.coalesce("x", "b").alias("b"), "similarity")
    own_group = heads.select(F.col("rep").alias("a"), F.col("x").alias("b"), F.lit(1.0).cast("float").alias("similarity"))
    lists = _top(spread.unionByName(own_group), "a", k + 1)
    everyone = lists.join(members, lists["a"] == members["rep"], "left").select(F.coalesce("x", "a").alias("a"), "b", "similarity")
    return _top(everyone.where("a <> b"), "a", k)


def pairs(found: DataFrame) -> DataFrame:
    """Each pair of which one is among the other's neighbours, smaller id first."""
    return found.select(F.least("a", "b").alias("vec_id_a"), F.greatest("a", "b").alias("vec_id_b"), "similarity").groupBy("vec_id_a", "vec_id_b").agg(F.max("similarity").alias("similarity"))
