"""A stored full-text index: postings in the order of their tokens, lengths of rows, totals.

A search reads the postings of its own terms: files are sorted by token, so that the
filter on the token skips all other row groups. Nothing reads the texts again.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.operators.search import Term, parse_query, without_chunk_echo
from paperloom.session import ensure_checkpoint_dir

#: The last code point: what sorts after every token of a prefix.
_LAST = "\U0010ffff"
#: Hits up to this many rows (an id and a score each) are broadcast to the entries.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class StoredIndex:
    """Tables below `path`: postings (`token`, `id`, `tf`, `positions`), lengths (`id`, `size`), totals (`n`, `avg_size`)."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def term(self, term: Term) -> DataFrame:
        """Rows (`id`, `tf`) that hold a term: a token, a prefix, or a phrase by its positions."""
        postings = self.table("postings")
        whole = lambda token: postings.where(F.col("token") == token)
        if len(term.tokens) == 1:
            token = term.tokens[0]
            if not term.prefix:
                return whole(token).select("id", "tf")
            return postings.where(F.col("token").between(token, token + _LAST)).groupBy("id").agg(F.sum("tf").alias("tf"))
        places = whole(term.tokens[0]).select("id", "positions")
        for k, token in enumerate(term.tokens[1:], 1):
            last = term.prefix and k == len(term.tokens) - 1
            rows = postings.where(F.col("token").between(token, token + _LAST)) if last else whole(token)
            after = rows.select("id", F.explode("positions").alias("p")).groupBy("id").agg(F.collect_set(F.col("p") - k).alias("q")) if last else rows.select("id", F.transform("positions", lambda p: p - k).alias("q"))  # noqa: B023
            places = places.join(after, "id").select("id", F.array_intersect("positions", "q").alias("positions"))
        return places.where(F.size("positions") > 0).select("id", F.size("positions").cast("long").alias("tf"))

    def scored(self, terms: list[Term], every: bool = True, floor: float | None = 1e-6, plus: float = 0.0, least_avg: float = 0.0) -> DataFrame:
        """(`id`, `weight`) by BM25 with k1 1.2 and b 0.75; all terms are required, or any."""
        totals = self.table("totals").first()
        n, avg = totals["n"] or 0, max(totals["avg_size"] or 1.0, least_avg)
        parts = []
        for term in terms:
            hits = self.term(term)
            d = hits.count()
            weight = log((n - d + 0.5) / (d + 0.5) + plus)
            weight = max(weight, floor) if floor is not None else weight
            parts.append(hits.select("id", F.lit(weight).alias("w"), F.col("tf").cast("double").alias("tf")))
        found = reduce(DataFrame.unionByName, parts).join(self.table("lengths"), "id")
        one = F.col("w") * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("size") / F.lit(avg)))
        found = found.groupBy("id").agg(F.sum(one).alias("weight"), F.count("*").alias("_terms"))
        return (found.where(F.col("_terms") == len(terms)) if every else found).drop("_terms")


def build_index(rows: DataFrame, key: str, tokens: Column, path: str) -> StoredIndex:
    """Write the index of an array of tokens; rows with null tokens don't count."""
    own = rows.select(F.col(key).alias("id"), tokens.alias("_t")).where("_t IS NOT NULL")
    words = own.select("id", F.posexplode("_t").alias("p", "token")).groupBy("token", "id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("p")).alias("positions"))  # the places of one token in one row
    words.repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.mode("overwrite").option("parquet.block.size", str(8 << 20)).parquet(f"{path}/postings")
    sizes = own.select("id", F.size("_t").alias("size"))
    sizes.write.mode("overwrite").parquet(f"{path}/lengths")
    rows.sparkSession.read.parquet(f"{path}/lengths").agg(F.count("*").alias("n"), F.avg("size").alias("avg_size")).write.mode("overwrite").parquet(f"{path}/totals")
    return StoredIndex(rows.sparkSession, path)


_BUILT: dict[tuple, str] = {}


def stored_index(rows: DataFrame, key: str, tokens: Column, name: str, origin: str) -> StoredIndex:
    """The index of a table in the shared checkpoint folder, built on first use in an application."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    known = (spark.sparkContext.applicationId, name, origin)
    if known not in _BUILT:
        path = f"{spark.sparkContext.getCheckpointDir()}/index-{name}-{zlib.crc32(origin.encode()):08x}"
        build_index(rows, key, tokens, path)
        _BUILT[known] = path
    return StoredIndex(spark, _BUILT[known])


def full_text(index: StoredIndex, query: str) -> DataFrame:
    """(`id`, `score`) of the rows that hold every term of a query; lower is better. A query without terms has no hits."""
    terms = parse_query(query)
    if not terms:
        return index.table("lengths").where(F.lit(False)).select("id", F.lit(0.0).alias("score"))
    return index.scored(terms).select("id", (-F.col("weight")).alias("score"))


def snippet(tokens: Column, terms: list[Term], size: int = 16) -> Column:
    """`size` tokens from shortly before the first hit, hits in brackets."""
    hit = lambda w: reduce(lambda a, b: a | b, (F.startswith(w, F.lit(t)) if term.prefix and k == len(term.tokens) - 1 else w == t for term in terms for k, t in enumerate(term.tokens)))
    first = F.coalesce(F.array_min(F.filter(F.transform(tokens, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull())), F.lit(0))
    start = F.greatest(F.lit(0), first - 4)
    part = F.transform(F.slice(tokens, start + 1, size), lambda w: F.when(hit(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return F.concat(F.when(start > 0, F.lit("…")).otherwise(""), F.array_join(part, " "), F.when(F.size(tokens) > start + size, F.lit("…")).otherwise(""))


def search(index: StoredIndex, entries: DataFrame, documents: DataFrame, text: str | None = None, kinds: list[str] | None = None, person: str | None = None, collection: str | None = None, limit: int = 20) -> DataFrame:
    """Entries (`entry_id`, `document_id`, `source_id`, `unit_id`, `kind`, `page_first`, `start_seconds`, `attributes`) of a search, in order: `rank` and the columns of the entry, with `pdf` and `score`.

    With a text, by score and then id; a unit's chunk gives way to its other hits unless kinds
    are asked for. Without one, by document, page and time, nulls first. Neither a text nor a
    filter is an error, as is a limit outside 1 to 10000; a text without terms has no hits.
    """
    if text is None and not kinds and person is None and collection is None:
        raise ValueError("give search text or at least one filter")
    if not 1 <= limit <= 10_000:
        raise ValueError("a limit is between 1 and 10000")
    own = entries
    if text is not None:
        hits = full_text(index, text).withColumnRenamed("id", "entry_id")
        own = own.join(F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits, "entry_id")
        if not kinds:
            own = without_chunk_echo(own)
    else:
        own = own.withColumn("score", F.lit(None).cast("double"))
    if kinds:
        own = own.where(F.col("kind").isin(*kinds))
    if person is not None:
        own = own.where((F.col("kind") == "face") & (F.lower(F.get_json_object("attributes", "$.person")) == person.lower()))
    docs = documents.select("document_id", "pdf", "collection_name")
    if collection is not None:
        docs = docs.where(F.col("collection_name") == collection)
    own = own.join(docs, "document_id")
    order = [F.asc("score"), F.asc("entry_id")] if text is not None else [F.asc_nulls_first("pdf"), F.asc_nulls_first("page_first"), F.asc_nulls_first("start_seconds"), F.asc("entry_id")]
    top = own.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # over `limit` rows at most


def ask(index: StoredIndex, passages: DataFrame, key: str, text: str, terms: list[str], top: int = 8, clip: int = 1500) -> DataFrame:
    """The best passages for the words of a question: `n` (1 is best), the key, `score` (3 places), the passage.

    Any word counts; weight ln((N - n + .5) / (n + .5) + 1); equal scores in the order of the key.
    """
    from paperloom.functions.text import clipped

    if not 1 <= top <= 100:
        raise ValueError("between 1 and 100 passages can be asked for")
    if not terms:
        return passages.where(F.lit(False)).select(F.lit(1).alias("n"), key, F.lit(0.0).alias("score"), F.col(text).alias("passage"))
    scored = index.scored([Term((t,)) for t in terms], every=False, floor=None, plus=1.0, least_avg=1.0).where("weight > 0")
    best = scored.orderBy(F.desc("weight"), "id").limit(top)
    rank = F.row_number().over(Window.orderBy(F.desc("weight"), "id"))  # over `top` rows
    best = best.select(rank.alias("n"), F.col("id").alias(key), F.round("weight", 3).alias("score"))
    return passages.join(F.broadcast(best), key).select("n", key, "score", clipped(F.col(text), clip).alias("passage"))
