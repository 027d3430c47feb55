"""A training mix of several sources at target shares of the total size in tokens.

A source's records are put in a seeded order within shards (as many as its size asks
for) and cut into blocks of equal tokens. Blocks are the seats of an apportionment:
Sainte-Laguë quotients (share / 1, 3, 5, ...) give them to sources, never more than
`max_repeats` times a source's blocks, and then, within a source, to its shards by
their sizes. A shard uses every block as often as its quota goes round, and a seeded
choice of blocks once more for the remainder.

Only per-source and per-shard totals come to the driver: a row per target source, and
at most `MAX_SHARDS` rows for each of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the public byte-level vocabulary splits a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_TOKENS = 1024
#: Blocks of a shard.
SHARD_BLOCKS = 4096
MAX_SHARDS = 4096


@cache
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """`df` with `_tokens`, the size of `text` (0 for null), in place of the text."""
    rest = [c for c in df.columns if c != text]
    schema = df.select(*(F.col(f"`{c}`") for c in rest)).withColumn("_tokens", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(tokenizer)
        for batch in batches:
            out = batch[rest].copy()
            out["_tokens"] = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch[text]]
            yield out

    return df.mapInPandas(run, schema)


def apportion(seats: int, weights: dict, caps: dict) -> dict:
    """Sainte-Laguë with caps; ties go to the smaller key. Seats beyond all caps stay empty.

    A divisor that gives out no more than the seats is found by halving, and the few seats
    that are left go by the highest quotients; the work doesn't grow with the seats.
    """
    weights = {k: w for k, w in sorted(weights.items()) if w > 0 and caps[k] > 0}
    given = lambda rate: {k: min(caps[k], int(w * rate + 0.5)) for k, w in weights.items()}
    low, high = 0.0, max(((min(seats, caps[k]) + 1) / w for k, w in weights.items()), default=0.0)
    for _ in range(100):
        middle = (low + high) / 2
        if sum(given(middle).values()) <= seats:
            low = middle
        else:
            high = middle
    # One seat less for each, so that ties at the divisor are decided by the quotients.
    quota = {k: max(0, n - 1) for k, n in given(low).items()}
    left = seats - sum(quota.values())
    heap = [(-w / (2 * quota[k] + 1), k) for k, w in weights.items() if quota[k] < caps[k]]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, k = heapq.heappop(heap)
        quota[k] += 1
        left -= 1
        if quota[k] < caps[k]:
            heapq.heappush(heap, (-weights[k] / (2 * quota[k] + 1), k))
    return quota


def mix(docs: DataFrame, targets: DataFrame, doc_id: str, text: str, source: str, seed: int = 7, block_tokens: int = BLOCK_TOKENS, total_tokens: int | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    `targets` has `doc_source`, `target_share` and `max_repeats`; a source that comes
    twice has its shares added and its smaller cap; rows without a positive share or cap
    are ignored. Records with a null source, or of a source without a target, are left
    out. Without `total_tokens` the mix is the largest in which every source that has
    records reaches its share; with it, sources that run into their caps stay short and
    the report shows it.

    Mix: `doc_id`, `doc_source`, `n_tokens`, `n_uses` (at least 1). Report, a row per
    target: `doc_source`, `target_share`, `reached_share`, `n_tokens_available`,
    `n_tokens_used`, `most_uses`. Null texts have no tokens and may be used; repeated
    rows count by themselves; an empty table gives an empty mix and a report of zeros.
    """
    wanted: dict[str, tuple[float, int]] = {}
    for r in targets.select("doc_source", "target_share", "max_repeats").collect():  # a row per source
        if r.doc_source is not None and (r.target_share or 0) > 0 and (r.max_repeats or 0) > 0:
            share, cap = wanted.get(r.doc_source, (0.0, r.max_repeats))
            wanted[r.doc_source] = (share + r.target_share, min(cap, r.max_repeats))
    own = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{source}`").alias("_source"), F.col(f"`{text}`").alias("_text"))
    sized = cut_lineage(with_tokens(own.where(F.col("_source").isin(list(wanted))), "_text", tokenizer))
    spark = docs.sparkSession
    available = {r["_source"]: r["n"] for r in sized.groupBy("_source").agg(F.sum("_tokens").alias("n")).collect()}
    live = {s: wanted[s] for s in sorted(wanted) if available.get(s, 0) > 0}
    weight = sum(share for share, _ in live.values())
    shards = {s: min(MAX_SHARDS, max(1, round(available[s] / block_tokens / SHARD_BLOCKS))) for s in live}
    number = F.create_map(*(F.lit(x) for s, n in shards.items() for x in (s, n))) if shards else F.create_map().cast("map<string,int>")
    placed = sized.where(F.col("_source").isin(list(live))).withColumn("_shard", F.pmod(F.xxhash64("_id", F.lit(seed)), F.try_element_at(number, F.col("_source"))))
    sizes = placed.groupBy("_source", "_shard").agg(F.sum("_tokens").alias("n"), F.count("*").alias("rows")).collect()
    blocks = {(r["_source"], r["_shard"]): max(1, round(r["n"] / block_tokens)) for r in sizes if r["n"] > 0}
    tokens = {(r["_source"], r["_shard"]): r["n"] for r in sizes if r["n"] > 0}
    per_source = {s: sum(b for (x, _), b in blocks.items() if x == s) for s in live}
    if total_tokens is None and live:
        total_tokens = int(min(cap * available[s] * weight / share for s, (share, cap) in live.items()))
    # A source's blocks hold its own mean number of tokens; shares are of tokens, so weights are set right by it.
    mean = {s: available[s] / per_source[s] for s in live}
    by_blocks = {s: live[s][0] / mean[s] for s in live}
    seats = round(sum((total_tokens or 0) * live[s][0] / weight / mean[s] for s in live)) if live else 0
    quotas = apportion(seats, by_blocks, {s: live[s][1] * per_source[s] for s in live}) if live else {}
    rows = []
    for s, quota in quotas.items():
        own_shards = {k: b for (x, k), b in blocks.items() if x == s}
        for k, q in apportion(quota, own_shards, {k: live[s][1] * b for k, b in own_shards.items()}).items():
            b = own_shards[k]
            rows.append((s, k, b, tokens[s, k], q // b, q % b))
    plan = spark.createDataFrame(rows, "_source string, _shard long, _blocks long, _total long, _rounds long, _extra long")
    order = Window.partitionBy("_source", "_shard").orderBy(F.xxhash64("_id", F.lit(seed + 1)), "_id")
    before = F.sum("_tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_tokens")
    cut = placed.withColumn("_before", before).join(F.broadcast(plan), ["_source", "_shard"])
    cut = cut.withColumn("_block", F.least(F.col("_blocks") - 1, F.floor(F.col("_before") * F.col("_blocks") / F.col("_total"))))
    # The seeded choice of `_extra` blocks: those of the smallest hashes.
    listed = plan.where("_extra > 0").select("_source", "_shard", "_extra", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"))
    rank = F.row_number().over(Window.partitionBy("_source", "_shard").orderBy(F.xxhash64("_source", "_shard", "_block", F.lit(seed + 2)), "_block"))
    chosen = listed.withColumn("_rank", rank).where("_rank <= _extra").select("_source", "_shard", "_block", F.lit(1).alias("_more"))
    used = cut.join(chosen, ["_source", "_shard", "_block"], "left").withColumn("n_uses", F.col("_rounds") + F.coalesce(F.col("_more"), F.lit(0)))
    result = used.where("n_uses > 0").select(F.col("_id").alias(doc_id), F.col("_source").alias("doc_source"), F.col("_tokens").alias("n_tokens"), "n_uses")
    names = spark.createDataFrame([(s, share, int(available.get(s, 0))) for s, (share, _) in sorted(wanted.items())], "doc_source string, target_share double, n_tokens_available long")
    sums = result.groupBy("doc_source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("n_tokens_used"), F.max("n_uses").alias("most_uses"))
    report = names.join(F.broadcast(sums), "doc_source", "left").na.fill(0, ["n_tokens_used", "most_uses"])
    everything = F.sum("n_tokens_used").over(Window.partitionBy(F.lit(1)))  # a row per target source
    report = report.withColumn("reached_share", F.when(everything > 0, F.col("n_tokens_used") / everything).otherwise(F.lit(0.0)))
    return result, report.select("doc_source", "target_share", "reached_share", "n_tokens_available", "n_tokens_used", "most_uses")
