"""Queries over the search index: entries, documents, vectors, people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.identity import derived_uuid
from paperloom.functions.vectors import cosine
from paperloom.functions import text as T
from paperloom.operators.blocks import top_matches
from paperloom.operators.index import StoredIndex, ask, full_text, search, snippet, stored_index
from paperloom.operators.search import parse_query, question_terms, without_chunk_echo
from paperloom.plans.registry import Registry
from paperloom.session import table

REGISTRY = Registry()
add = REGISTRY.add

SOURCE_DOMAIN = "paperloom/source/v1"
_TOKENS = r"list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@add(
    "content_ids",
    sql=f"""
    WITH s AS (SELECT doc_id, sha256(text) AS sha, row_number() OVER (PARTITION BY text ORDER BY doc_id) - 1 AS occurrence FROM documents),
    h AS (SELECT *, sha256(encode('{SOURCE_DOMAIN}') || unhex('00') || encode(sha) || unhex('00') || encode(CAST(occurrence AS VARCHAR))) AS d FROM s)
    SELECT doc_id, sha AS sha256, occurrence, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-8' || substr(d, 14, 3) || '-' ||
      substr('89ab', CAST((CAST('0x' || substr(d, 17, 1) AS INTEGER) % 4) + 1 AS INTEGER), 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS source_id FROM h
    """,
)
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sha = docs.select("doc_id", F.sha2("text", 256).alias("sha256"))
    numbered = sha.withColumn("occurrence", (F.row_number().over(Window.partitionBy("sha256").orderBy("doc_id")) - 1).cast("long"))
    return numbered.withColumn("source_id", derived_uuid(SOURCE_DOMAIN, F.col("sha256"), F.col("occurrence")))


@add(
    "graph_violations",
    sql="""
    SELECT 'confidence' AS rule, entry_id FROM entries WHERE confidence < 0 OR confidence > 1 OR isnan(confidence)
    UNION ALL SELECT 'region', entry_id FROM entries WHERE isnan(x) OR isnan(y) OR isnan(width) OR isnan(height) OR isinf(x) OR isinf(y) OR isinf(width) OR isinf(height)
    UNION ALL SELECT 'time', entry_id FROM entries WHERE end_seconds < start_seconds
    UNION ALL SELECT 'provider', entry_id FROM entries WHERE provider IS NULL OR trim(provider) = ''
    UNION ALL SELECT 'document', entry_id FROM entries e WHERE NOT EXISTS (SELECT 1 FROM indexed_pdfs d WHERE d.document_id = e.document_id)
    UNION ALL SELECT 'repeated', entry_id FROM (SELECT entry_id, row_number() OVER (PARTITION BY document_id, source_id, unit_id, kind, text, start_seconds, x, y ORDER BY entry_id) AS r FROM entries) WHERE r > 1
    """,
)
def graph_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entries")
    bad = lambda rule, cond: F.when(cond, F.lit(rule))
    odd = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    first = Window.partitionBy("document_id", "source_id", "unit_id", "kind", "text", "start_seconds", "x", "y").orderBy("entry_id")
    known = table(spark, sf_dir, "indexed_pdfs").select(F.col("document_id").alias("_known"))
    rows = e.withColumn("_r", F.row_number().over(first)).join(known, F.col("document_id") == F.col("_known"), "left")
    rules = F.array(
        bad("confidence", (F.col("confidence") < 0) | (F.col("confidence") > 1) | F.isnan("confidence")),
        bad("region", odd("x") | odd("y") | odd("width") | odd("height")),
        bad("time", F.col("end_seconds") < F.col("start_seconds")),
        bad("provider", F.col("provider").isNull() | (F.trim("provider") == "")),
        bad("document", F.col("_known").isNull()),
        bad("repeated", F.col("_r") > 1),
    )
    return rows.select(F.explode(F.array_compact(rules)).alias("rule"), "entry_id")


@add(
    "unit_anchors",
    sql="""
    SELECT document_id, unit_id, CASE WHEN min(start_seconds) IS NOT NULL THEN 'time-span' WHEN any_value(unit_kind) = 'visual' THEN 'region' ELSE 'byte-range' END AS anchor,
      min(start_seconds) AS start_seconds, max(coalesce(end_seconds, start_seconds)) AS end_seconds
    FROM entries GROUP BY document_id, unit_id
    """,
)
def unit_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entries")
    spans = e.groupBy("document_id", "unit_id").agg(F.min("start_seconds").alias("start_seconds"), F.max(F.coalesce("end_seconds", "start_seconds")).alias("end_seconds"), F.any_value("unit_kind", True).alias("k"))
    anchor = F.when(F.col("start_seconds").isNotNull(), F.lit("time-span")).when(F.col("k") == "visual", F.lit("region")).otherwise(F.lit("byte-range"))
    return spans.select("document_id", "unit_id", anchor.alias("anchor"), "start_seconds", "end_seconds")


@add(
    "documents_summary",
    sql="""
    SELECT d.document_id, d.pdf, d.collection_name, coalesce(c.n_sources, 0) AS n_sources, coalesce(c.n_entries, 0) AS n_entries FROM indexed_pdfs d
    LEFT JOIN (SELECT document_id, count(DISTINCT source_id) AS n_sources, count(*) AS n_entries FROM entries GROUP BY document_id) c USING (document_id)
    """,
)
def documents_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_source = table(spark, sf_dir, "entries").groupBy("document_id", "source_id").agg(F.count("*").alias("n"))
    counts = per_source.groupBy("document_id").agg(F.count("source_id").alias("n_sources"), F.sum("n").alias("n_entries"))
    docs = table(spark, sf_dir, "indexed_pdfs").select("document_id", "pdf", "collection_name")
    return docs.join(counts, "document_id", "left").na.fill(0, ["n_sources", "n_entries"])


@add(
    "search_listing",
    sql="""
    SELECT entry_id, pdf, kind, page_first, start_seconds FROM (
      SELECT e.entry_id, d.pdf, e.kind, e.page_first, e.start_seconds FROM entries e JOIN indexed_pdfs d USING (document_id)
      WHERE e.kind IN ('face', 'object') AND d.collection_name = 'coll-11'
      ORDER BY d.pdf NULLS FIRST, e.page_first NULLS FIRST, e.start_seconds NULLS FIRST, e.entry_id LIMIT 20)
    """,
)
def search_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters without a text: kinds and a collection, in the order of the pages; the first twenty."""
    e = table(spark, sf_dir, "entries").where(F.col("kind").isin("face", "object"))
    d = table(spark, sf_dir, "indexed_pdfs").where("collection_name = 'coll-11'").select("document_id", "pdf")
    hits = e.join(d, "document_id").select("entry_id", "pdf", "kind", "page_first", "start_seconds")
    return hits.orderBy(F.asc_nulls_first("pdf"), F.asc_nulls_first("page_first"), F.asc_nulls_first("start_seconds"), "entry_id").limit(20)


def _fts_sql(conditions: list[str], tfs: list[str], tail: str = "", columns: str = "entry_id, round(score, 6) AS score") -> str:
    names = ", ".join(f"{tf} AS f{i}" for i, tf in enumerate(tfs))
    idf = ", ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) AS w{i}" for i in range(len(tfs)))
    score = " + ".join(f"w{i} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / avg_size))" for i in range(len(tfs)))
    counts = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(tfs)))
    every = " AND ".join(f"f{i} > 0" for i in range(len(tfs)))
    return f"""
    WITH t AS (SELECT *, {_TOKENS} AS ts FROM entries WHERE text IS NOT NULL),
    f AS (SELECT * EXCLUDE (ts), len(ts) AS size, {names} FROM t),
    s AS (SELECT count(*) AS n, avg(size) AS avg_size, {counts} FROM f),
    w AS (SELECT avg_size, {idf} FROM s),
    hits AS (SELECT f.*, -({score}) AS score FROM f, w WHERE {every}){tail}
    SELECT {columns} FROM {'kept' if tail else 'hits'}
    """


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entries")


def _index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    return stored_index(_entries(spark, sf_dir), "entry_id", T.index_tokens(F.col("text")), "entries", sf_dir)


def _scores(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return full_text(_index(spark, sf_dir), query).select(F.col("id").alias("entry_id"), F.round("score", 6).alias("score"))


@add("search_words", sql=_fts_sql([], ["len(list_filter(ts, lambda w: w = 'warranty'))", "len(list_filter(ts, lambda w: w = 'stamp'))"]))
def search_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words, both required, with their rank."""
    return _scores(spark, sf_dir, "Warranty stamp")


@add("search_prefix", sql=_fts_sql([], ["len(list_filter(ts, lambda w: starts_with(w, 'photogr')))"]))
def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "photogr*")


@add("search_phrase", sql=_fts_sql([], ["len(list_filter(range(1, len(ts)), lambda i: ts[i] = 'map' AND ts[i + 1] = 'cabinet'))"]))
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, '"Map cabinet"')


@add(
    "search_units",
    sql=_fts_sql(
        [],
        ["len(list_filter(ts, lambda w: w = 'bruno'))"],
        tail=", kept AS (SELECT * FROM hits h WHERE kind <> 'chunk' OR NOT EXISTS (SELECT 1 FROM hits o WHERE o.kind <> 'chunk' AND o.document_id IS NOT DISTINCT FROM h.document_id AND o.unit_id IS NOT DISTINCT FROM h.unit_id))",
        columns="entry_id, kind, round(score, 6) AS score",
    ),
)
def search_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits without the chunk of a unit that another kind of entry already stands for."""
    hits = _entries(spark, sf_dir).select("entry_id", "document_id", "unit_id", "kind").join(_scores(spark, sf_dir, "bruno"), "entry_id")
    return without_chunk_echo(hits).select("entry_id", "kind", "score")


_CARD = _fts_sql([], ["len(list_filter(ts, lambda w: w = 'permit'))"], tail=", kept AS (SELECT * FROM hits h WHERE kind IN ('transcript', 'ocr'))", columns="*")


@add(
    "search_hits",
    sql=f"""
    WITH k AS ({_CARD})
    SELECT row_number() OVER (ORDER BY score, entry_id) AS rank, entry_id, kind, pdf, page_first, round(score, 6) AS score FROM (
      SELECT k.entry_id, k.kind, d.pdf, k.page_first, k.score FROM k JOIN indexed_pdfs d USING (document_id) ORDER BY k.score, k.entry_id LIMIT 25)
    """,
)
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best twenty-five entries of two kinds for a word, with their documents."""
    found = search(_index(spark, sf_dir), _entries(spark, sf_dir), table(spark, sf_dir, "indexed_pdfs"), "permit", kinds=["transcript", "ocr"], limit=25)
    return found.select("rank", "entry_id", "kind", "pdf", "page_first", F.round("score", 6).alias("score"))


@add("search_snippets")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten entries for a phrase, each with the tokens around its first hit."""
    query = '"map cabinet"'
    found = search(_index(spark, sf_dir), _entries(spark, sf_dir), table(spark, sf_dir, "indexed_pdfs"), query, limit=10)
    return found.select("rank", "entry_id", snippet(T.index_tokens(F.col("text")), parse_query(query)).alias("snippet"))


@add(
    "search_person",
    sql="""
    SELECT row_number() OVER (ORDER BY pdf NULLS FIRST, page_first NULLS FIRST, start_seconds NULLS FIRST, entry_id) AS rank, entry_id, pdf, start_seconds FROM (
      SELECT e.entry_id, d.pdf, e.page_first, e.start_seconds FROM entries e JOIN indexed_pdfs d USING (document_id) WHERE e.kind = 'face' AND lower(e.text) = 'person-1'
      ORDER BY d.pdf NULLS FIRST, e.page_first NULLS FIRST, e.start_seconds NULLS FIRST, e.entry_id LIMIT 50)
    """,
)
def search_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty faces of a person, whose name stands in the attributes of their entries."""
    named = _entries(spark, sf_dir).withColumn("attributes", F.when(F.col("kind") == "face", F.to_json(F.struct(F.col("text").alias("person")))).otherwise(F.col("attributes")))
    found = search(_index(spark, sf_dir), named, table(spark, sf_dir, "indexed_pdfs"), person="PERSON-1", limit=50)
    return found.select("rank", "entry_id", "pdf", "start_seconds")


_STOP = "'a','an','and','are','as','at','be','by','did','do','does','for','from','how','in','is','it','of','on','or','say','said','the','that','this','to','was','were','what','when','where','which','who','why','with'"


@add(
    "ask_passages",
    sql=f"""
    WITH t AS (SELECT chunk_id, text, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND w NOT IN ({_STOP})) AS ts FROM chunks WHERE trim(text) <> ''),
    f AS (SELECT chunk_id, text, len(ts) AS size, len(list_filter(ts, lambda w: w = 'torn')) AS f0, len(list_filter(ts, lambda w: w = 'warranty')) AS f1, len(list_filter(ts, lambda w: w = 'scanned')) AS f2 FROM t),
    s AS (SELECT count(*) AS n, greatest(avg(size), 1) AS av, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2 FROM f),
    r AS (SELECT chunk_id, text, ln((n - d0 + .5) / (d0 + .5) + 1) * f0 * 2.2 / (f0 + 1.2 * (.25 + .75 * size / av)) + ln((n - d1 + .5) / (d1 + .5) + 1) * f1 * 2.2 / (f1 + 1.2 * (.25 + .75 * size / av))
      + ln((n - d2 + .5) / (d2 + .5) + 1) * f2 * 2.2 / (f2 + 1.2 * (.25 + .75 * size / av)) AS score FROM f, s)
    SELECT row_number() OVER (ORDER BY score DESC, chunk_id) AS n, chunk_id, round(score, 3) AS score,
      CASE WHEN length(trim(text)) > 1500 THEN substr(trim(text), 1, 1500) || '…' ELSE trim(text) END AS passage
    FROM (SELECT * FROM r WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 8)
    """,
)
def ask_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best passages for a question."""
    chunks = table(spark, sf_dir, "chunks")
    index = stored_index(chunks.where(F.trim("text") != ""), "chunk_id", T.question_tokens(F.col("text")), "chunks", sf_dir)
    return ask(index, chunks, "chunk_id", "text", question_terms("When was the torn warranty scanned?"))


_FINE = "vector IS NOT NULL AND len(vector) = dim AND len(list_filter(vector, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(vector, lambda v: v <> 0)) > 0"


@add(
    "nearest_units",
    sql=f"""
    WITH e AS (SELECT vec_id, document_id, unit_id, model, dim, CAST(vector AS DOUBLE[]) AS v FROM unit_embeddings WHERE {_FINE}),
    p AS (SELECT document_id, unit_id, min(page_first) AS page_first, max(page_last) AS page_last FROM entries GROUP BY document_id, unit_id),
    s AS (SELECT q.vec_id AS asked_id, e.vec_id, e.document_id, e.unit_id, list_cosine_similarity(e.v, q.v) AS sim FROM e JOIN e q ON e.model = q.model AND e.dim = q.dim AND e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
    t AS (SELECT *, row_number() OVER (PARTITION BY asked_id ORDER BY round(sim, 9) DESC, vec_id) AS place FROM s)
    SELECT asked_id, place, t.vec_id, round(sim, 5) AS similarity, d.pdf, p.page_first, p.page_last FROM t JOIN indexed_pdfs d USING (document_id) LEFT JOIN p ON p.document_id = t.document_id AND p.unit_id = t.unit_id WHERE place <= 10
    """,
)
def nearest_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each unit vector whose id is divisible by fifty, the ten others most similar to it of its model and dimension, with their pages."""
    e = table(spark, sf_dir, "unit_embeddings").where("vector IS NOT NULL AND size(vector) = dim")
    e = e.where(~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vector", lambda v: v != 0))
    group = F.concat_ws("/", "model", F.col("dim").cast("string"))
    found = top_matches(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), group.alias("grp"), "vector"), e.select(F.col("vec_id").alias("id"), group.alias("grp"), "vector"), 10)
    units = e.select(F.col("vec_id").alias("found_id"), "document_id", "unit_id")
    pages = table(spark, sf_dir, "entries").groupBy("document_id", "unit_id").agg(F.min("page_first").alias("page_first"), F.max("page_last").alias("page_last"))
    docs = table(spark, sf_dir, "indexed_pdfs").select("document_id", "pdf")
    rows = found.join(units, "found_id").join(docs, "document_id").join(pages, ["document_id", "unit_id"], "left")
    return rows.select("asked_id", "place", F.col("found_id").alias("vec_id"), F.round("similarity", 5).alias("similarity"), "pdf", "page_first", "page_last")


@add(
    "embedding_upsert",
    sql="""
    SELECT document_id, unit_id, model, vec_id FROM (
      SELECT *, row_number() OVER (PARTITION BY document_id, unit_id, model ORDER BY vec_id DESC) AS r FROM unit_embeddings WHERE vector IS NOT NULL) WHERE r = 1
    """,
)
def embedding_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last vector put for each document, unit and model."""
    e = table(spark, sf_dir, "unit_embeddings").where("vector IS NOT NULL")
    return e.groupBy("document_id", "unit_id", "model").agg(F.max("vec_id").alias("vec_id"))


@add(
    "index_upsert",
    sql="""
    WITH old AS (SELECT document_id, pdf, pdf_sha256, origin, collection_name FROM indexed_pdfs),
    new AS (SELECT document_id + 1000000 AS document_id, pdf, CASE WHEN document_id % 2 = 0 THEN pdf_sha256 ELSE sha256(pdf_sha256) END AS pdf_sha256, 'pdf' AS origin, 'again' AS collection_name FROM indexed_pdfs WHERE document_id % 3 <> 0)
    SELECT coalesce(n.pdf, o.pdf) AS pdf, CASE WHEN n.pdf IS NULL OR (n.pdf_sha256 = o.pdf_sha256 AND o.origin = 'convert') THEN o.document_id ELSE n.document_id END AS document_id,
      CASE WHEN n.pdf IS NULL OR (n.pdf_sha256 = o.pdf_sha256 AND o.origin = 'convert') THEN o.origin ELSE n.origin END AS origin, CASE WHEN n.pdf IS NULL THEN o.collection_name ELSE n.collection_name END AS collection_name
    FROM old o FULL OUTER JOIN new n ON o.pdf = n.pdf
    """,
)
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second indexing of two thirds of the documents: replaced by path, but a richer record of the same bytes stays."""
    old = table(spark, sf_dir, "indexed_pdfs").select("document_id", "pdf", "pdf_sha256", "origin", "collection_name")
    again = old.where("document_id % 3 <> 0")
    digest = F.when(F.col("document_id") % 2 == 0, F.col("pdf_sha256")).otherwise(F.sha2("pdf_sha256", 256))
    new = again.select((F.col("document_id") + 1000000).alias("n_id"), F.col("pdf").alias("n_pdf"), digest.alias("n_sha"), F.lit("pdf").alias("n_origin"), F.lit("again").alias("n_collection"))
    both = old.join(new, old["pdf"] == new["n_pdf"], "full_outer")
    keep = F.col("n_pdf").isNull() | (F.col("n_sha") == F.col("pdf_sha256")) & (F.col("origin") == "convert")
    pick = lambda a, b, cond: F.when(cond, F.col(a)).otherwise(F.col(b))
    return both.select(F.coalesce("n_pdf", "pdf").alias("pdf"), pick("document_id", "n_id", keep).alias("document_id"), pick("origin", "n_origin", keep).alias("origin"), pick("collection_name", "n_collection", F.col("n_pdf").isNull()).alias("collection_name"))


@add(
    "people_summary",
    sql="""
    SELECT p.person_id, p.label, coalesce(p.person_name, p.label) AS display, coalesce(s.n, 0) AS n_sightings, coalesce(s.m, 0) AS n_models FROM people p
    LEFT JOIN (SELECT person_id, count(*) AS n, count(DISTINCT model) AS m FROM sightings GROUP BY person_id) s USING (person_id)
    """,
)
def people_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "sightings").groupBy("person_id").agg(F.count("*").alias("n_sightings"), F.count_distinct("model").alias("n_models"))
    people = table(spark, sf_dir, "people")
    return people.join(counts, "person_id", "left").select("person_id", "label", F.coalesce("person_name", "label").alias("display"), F.coalesce("n_sightings", F.lit(0)).alias("n_sightings"), F.coalesce("n_models", F.lit(0)).alias("n_models"))


@add("people_gallery", sql="SELECT person_id, model, sighting_id FROM (SELECT *, row_number() OVER (PARTITION BY person_id, model ORDER BY sighting_id DESC) AS r FROM sightings WHERE vector IS NOT NULL) WHERE r <= 32")
def people_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 32 vectors of each person and model."""
    newest = Window.partitionBy("person_id", "model").orderBy(F.desc("sighting_id"))
    s = table(spark, sf_dir, "sightings").where("vector IS NOT NULL")
    return s.withColumn("_r", F.row_number().over(newest)).where("_r <= 32").select("person_id", "model", "sighting_id")


@add(
    "people_match",
    sql="""
    WITH g AS (SELECT * FROM (SELECT person_id, model, sighting_id, vector, row_number() OVER (PARTITION BY person_id, model ORDER BY sighting_id DESC) AS r FROM sightings WHERE vector IS NOT NULL) WHERE r <= 32),
    m AS (SELECT q.sighting_id, g.person_id, max(list_cosine_similarity(CAST(q.vector AS DOUBLE[]), CAST(g.vector AS DOUBLE[]))) AS sim FROM sightings q JOIN g ON g.model = q.model AND g.sighting_id <> q.sighting_id
      WHERE q.sighting_id % 50 = 0 AND q.vector IS NOT NULL GROUP BY 1, 2)
    SELECT sighting_id, person_id, round(sim, 3) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY sighting_id ORDER BY sim DESC, person_id DESC) AS r FROM m WHERE sim >= 0.4) WHERE r = 1
    """,
)
def people_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of a stated query set (every fiftieth sighting): the person whose gallery is most similar, from 0.4 on."""
    s = table(spark, sf_dir, "sightings").where("vector IS NOT NULL")
    gallery = people_gallery(spark, sf_dir).join(s.select("sighting_id", "vector"), "sighting_id")
    asked = s.where("sighting_id % 50 = 0").select(F.col("sighting_id").alias("id"), F.col("model").alias("grp"), "vector")
    best = top_matches(asked, gallery.select(F.col("sighting_id").alias("id"), F.col("model").alias("grp"), "vector", F.col("person_id").alias("owner")), 1, 0.4)
    return best.select(F.col("asked_id").alias("sighting_id"), F.col("owner").alias("person_id"), F.round("similarity", 3).alias("similarity"))


@add(
    "people_appearances",
    sql="""
    SELECT person_id, source_path, list(DISTINCT start_seconds ORDER BY start_seconds) AS times FROM sightings WHERE start_seconds IS NOT NULL AND NOT isnan(start_seconds) GROUP BY person_id, source_path
    """,
)
def people_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sightings").where("start_seconds IS NOT NULL AND NOT isnan(start_seconds)")
    return s.groupBy("person_id", "source_path").agg(F.array_sort(F.collect_set("start_seconds")).alias("times"))


@add(
    "people_merge",
    sql="""
    WITH m AS (SELECT lower(person_name) AS k, min(person_id) AS keep FROM people WHERE person_name IS NOT NULL GROUP BY 1),
    r AS (SELECT p.person_id, coalesce(m.keep, p.person_id) AS keep FROM people p LEFT JOIN m ON lower(p.person_name) = m.k)
    SELECT r.keep AS person_id, count(*) AS n_sightings FROM sightings s JOIN r USING (person_id) GROUP BY 1
    """,
)
def people_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings re-keyed to the first person of the same name, without regard to case."""
    people = table(spark, sf_dir, "people")
    keep = people.where("person_name IS NOT NULL").groupBy(F.lower("person_name").alias("k")).agg(F.min("person_id").alias("keep"))
    remap = people.join(keep, F.lower("person_name") == F.col("k"), "left").select("person_id", F.coalesce("keep", "person_id").alias("keep"))
    return table(spark, sf_dir, "sightings").join(remap, "person_id").groupBy(F.col("keep").alias("person_id")).agg(F.count("*").alias("n_sightings"))
