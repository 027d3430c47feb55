"""Queries that join and filter sources, units and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import graph
from paperloom.operators.blocks import all_matches, top_matches
from paperloom.operators.runs import flow_runs, text_blocks
from paperloom.plans.registry import Registry
from paperloom.session import table
from paperloom.sources import structured

REGISTRY = Registry()
add = REGISTRY.add


@add(
    "sidecar_media",
    sql=r"""
    WITH m AS (SELECT DISTINCT source_path AS p, regexp_replace(regexp_extract(source_path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem FROM sightings WHERE source_path IS NOT NULL),
    t AS (SELECT '/texts/' || stem || '.srt' AS text_path, stem FROM m UNION SELECT '/texts/none' || length(stem) || '.vtt', 'none' || length(stem) FROM m),
    u AS (SELECT stem, any_value(p) AS p, count(*) AS n FROM m GROUP BY stem)
    SELECT text_path, CASE WHEN n = 1 THEN p END AS media_path FROM t LEFT JOIN u USING (stem)
    """,
)
def sidecar_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts with the recordings of their name; those of no or of several recordings stay alone."""
    media = table(spark, sf_dir, "sightings").where("source_path IS NOT NULL").select(F.col("source_path").alias("media_path")).distinct()
    name = graph.stem(F.col("media_path"))
    texts = media.select(F.concat(F.lit("/texts/"), name, F.lit(".srt")).alias("text_path")).unionByName(media.select(F.concat(F.lit("/texts/none"), F.length(name).cast("string"), F.lit(".vtt")).alias("text_path"))).distinct()
    pairs, rest = graph.sidecars(media, texts)
    return pairs.unionByName(rest.withColumn("media_path", F.lit(None).cast("string")))


_SPANS = "isnan(start_seconds) = false AND isnan(end_seconds) = false AND end_seconds >= start_seconds"


@add(
    "scene_lines",
    sql=f"""
    SELECT s.entry_id AS scene_id, t.entry_id AS line_id FROM entries s JOIN entries t ON s.document_id = t.document_id WHERE s.kind IN ('scene', 'caption') AND t.kind = 'transcript'
      AND s.start_seconds IS NOT NULL AND t.end_seconds >= t.start_seconds AND s.end_seconds >= s.start_seconds AND t.end_seconds >= s.start_seconds AND t.start_seconds <= s.end_seconds
    """,
)
def scene_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken lines that overlap a scene of the same document."""
    e = table(spark, sf_dir, "entries")
    scenes = e.where(F.col("kind").isin("scene", "caption")).select("document_id", F.col("entry_id").alias("scene_id"), F.col("start_seconds").alias("a0"), F.col("end_seconds").alias("a1"))
    lines = e.where("kind = 'transcript'").select("document_id", F.col("entry_id").alias("line_id"), F.col("start_seconds").alias("b0"), F.col("end_seconds").alias("b1"))
    return graph.overlapping(scenes, lines, "document_id", "a0", "a1", "b0", "b1").select("scene_id", "line_id")


@add(
    "unit_chapters",
    sql="""
    WITH c AS (SELECT source_path, sighting_id AS position, 'chapter ' || sighting_id AS title, start_seconds AS a, start_seconds + 30 + sighting_id % 50 AS b FROM sightings WHERE sighting_id % 4 = 0 AND source_path IS NOT NULL AND start_seconds IS NOT NULL AND NOT isnan(start_seconds)),
    u AS (SELECT source_path, sighting_id, start_seconds AS t FROM sightings WHERE source_path IS NOT NULL AND start_seconds IS NOT NULL AND NOT isnan(start_seconds))
    SELECT sighting_id, arg_min(title, position) AS chapter FROM u JOIN c ON u.source_path = c.source_path AND u.t >= c.a AND u.t < c.b GROUP BY sighting_id
    """,
)
def unit_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings with the first chapter of their recording that holds them; every fourth sighting opens a chapter."""
    s = table(spark, sf_dir, "sightings").where("source_path IS NOT NULL")
    chapters = s.where("sighting_id % 4 = 0").select("source_path", F.col("sighting_id").alias("position"), F.concat(F.lit("chapter "), F.col("sighting_id").cast("string")).alias("title"), F.col("start_seconds").alias("start"), (F.col("start_seconds") + 30 + F.col("sighting_id") % 50).alias("end"))
    return graph.chapters_of(s.select("source_path", "sighting_id", F.col("start_seconds").alias("at")), chapters, "source_path", "sighting_id", "at")


@add(
    "attachment_files",
    sql=r"""
    WITH f AS (SELECT DISTINCT source_path AS path, regexp_extract(source_path, '([^/]*)$', 1) AS name FROM sightings WHERE source_path IS NOT NULL),
    n AS (SELECT name, any_value(path) AS path FROM f GROUP BY name HAVING count(*) = 1),
    r AS (SELECT sighting_id, CASE sighting_id % 3 WHEN 0 THEN source_path WHEN 1 THEN 'media/' || regexp_extract(source_path, '([^/]*)$', 1) ELSE 'lost.bin' END AS reference FROM sightings WHERE source_path IS NOT NULL)
    SELECT sighting_id, coalesce(f.path, n.path) AS path FROM r LEFT JOIN f ON r.reference = f.path LEFT JOIN n ON regexp_extract(r.reference, '([^/]*)$', 1) = n.name
    """,
)
def attachment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a message refers to, by its path or by its name alone."""
    s = table(spark, sf_dir, "sightings").where("source_path IS NOT NULL")
    k = F.col("sighting_id") % 3
    said = F.when(k == 0, F.col("source_path")).when(k == 1, F.concat(F.lit("media/"), T.base_name(F.col("source_path")))).otherwise(F.lit("lost.bin"))
    return graph.resolved_files(s.select("sighting_id", said.alias("reference")), s.select(F.col("source_path").alias("path"))).select("sighting_id", "path")


@add("sources_not_inline", sql="SELECT DISTINCT source_path AS path FROM sightings WHERE source_path IS NOT NULL AND source_path NOT IN (SELECT source_path FROM sightings WHERE source_path IS NOT NULL AND unit_no = 0)")
def sources_not_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sightings").where("source_path IS NOT NULL").select(F.col("source_path").alias("path"), "unit_no")
    return graph.without_inline(s.select("path").distinct(), s.where("unit_no = 0"))


@add(
    "entry_sources",
    sql="SELECT e.entry_id, e.kind, s.n_chunks FROM entries e LEFT JOIN (SELECT document_id, source_id, count(*) AS n_chunks FROM chunks WHERE source_id IS NOT NULL GROUP BY 1, 2) s ON e.document_id = s.document_id AND e.source_id = s.source_id WHERE e.kind IN ('transcript', 'face')",
)
def entry_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with what is known of their sources, which may be nothing."""
    sources = table(spark, sf_dir, "chunks").where("source_id IS NOT NULL").groupBy("document_id", "source_id").agg(F.count("*").alias("n_chunks"))
    return table(spark, sf_dir, "entries").where(F.col("kind").isin("transcript", "face")).join(sources, ["document_id", "source_id"], "left").select("entry_id", "kind", "n_chunks")


@add("passage_names", sql=r"SELECT c.chunk_id, coalesce(regexp_extract(d.pdf, '([^/]*)$', 1), c.source_id, 'unknown') AS name FROM chunks c LEFT JOIN indexed_pdfs d USING (document_id)")
def passage_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "indexed_pdfs").select("document_id", T.base_name(F.col("pdf")).alias("_name"))
    return table(spark, sf_dir, "chunks").join(docs, "document_id", "left").select("chunk_id", F.coalesce("_name", "source_id", F.lit("unknown")).alias("name"))


@add("fetched_sources", sql="WITH f AS (SELECT pdf AS path, 'https://x.test/' || document_id AS url FROM indexed_pdfs WHERE document_id % 2 = 0) SELECT d.document_id, f.url FROM indexed_pdfs d LEFT JOIN f ON d.pdf = f.path")
def fetched_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the address they were fetched from."""
    d = table(spark, sf_dir, "indexed_pdfs")
    fetched = d.where("document_id % 2 = 0").select("pdf", F.concat(F.lit("https://x.test/"), F.col("document_id").cast("string")).alias("url"))
    return d.select("document_id", "pdf").join(fetched, "pdf", "left").select("document_id", "url")


@add(
    "units_to_transcribe",
    sql="SELECT DISTINCT document_id, unit_id FROM entries e WHERE start_seconds IS NOT NULL AND NOT EXISTS (SELECT 1 FROM entries t WHERE t.kind = 'transcript' AND t.document_id IS NOT DISTINCT FROM e.document_id AND t.unit_id IS NOT DISTINCT FROM e.unit_id)",
)
def units_to_transcribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with a time and no transcript yet."""
    e = table(spark, sf_dir, "entries")
    return graph.to_be_annotated(e.where("start_seconds IS NOT NULL").select("document_id", "unit_id").distinct(), e, ["document_id", "unit_id"], "transcript")


@add("permitted_kinds", sql="SELECT DISTINCT kind, kind IN ('ocr', 'face') AS listed, kind NOT IN ('face', 'chunk') AS open FROM entries")
def permitted_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "entries").select("kind").distinct()
    return kinds.select("kind", graph.permitted(F.col("kind"), ["ocr", "face", "chunk"], ["chunk"]).alias("listed"), graph.permitted(F.col("kind"), None, ["face", "chunk"]).alias("open"))


@add(
    "searchable_lines",
    sql="""
    WITH a AS (SELECT *, CASE WHEN kind IN ('custom', 'timestamp') AND entry_id % 2 = 0 THEN 'date' WHEN kind = 'scene' AND entry_id % 2 = 0 THEN 'scene-tag' END AS entity, kind = 'location' AND entry_id % 2 = 0 AS read FROM entries)
    SELECT entry_id, '[' || upper(kind[1]) || kind[2:] || '][' || coalesce(provider, '') || '] ' || coalesce(text, '') || CASE WHEN entity = 'date' THEN ' (2024-03-01)' ELSE '' END AS line FROM a
    WHERE kind IN ('ocr', 'caption', 'transcript', 'object', 'face', 'barcode') OR entity IS NOT NULL OR read
    """,
)
def searchable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of the hidden text as lines; every other one is taken as an entity, a tag or a place read from the text."""
    kind, even = F.col("kind"), F.col("entry_id") % 2 == 0
    none = F.create_map().cast("map<string,string>")
    meta = F.when(kind.isin("custom", "timestamp") & even, F.create_map(F.lit("entity"), F.lit("date"), F.lit("iso"), F.lit("2024-03-01"))).when((kind == "scene") & even, F.create_map(F.lit("entity"), F.lit("scene-tag")))
    meta = meta.when((kind == "location") & even, F.create_map(F.lit("source"), F.lit("text"))).otherwise(none)
    e = table(spark, sf_dir, "entries").withColumn("m", meta)
    line = graph.annotation_line(kind, F.col("provider"), F.col("text"), F.try_element_at(F.col("m"), F.lit("iso")))
    return e.where(graph.searchable(kind, F.col("m"))).select("entry_id", line.alias("line"))


@add(
    "faces_find",
    sql="""
    WITH s AS (SELECT sighting_id, person_id, model, source_path, start_seconds, unit_no, CAST(vector AS DOUBLE[]) AS v FROM sightings WHERE vector IS NOT NULL),
    g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id, model ORDER BY sighting_id DESC) AS r FROM s) WHERE r <= 32),
    b AS (SELECT asked_id, arg_max(person_id, (sim, person_id)) AS person_id FROM (SELECT q.sighting_id AS asked_id, g.person_id, round(max(list_cosine_similarity(q.v, g.v)), 9) AS sim FROM s q JOIN g ON g.model = q.model AND g.sighting_id <> q.sighting_id WHERE q.sighting_id % 50 = 0 GROUP BY 1, 2) WHERE sim >= 0.6 GROUP BY 1),
    h AS (SELECT q.sighting_id AS asked_id, t.sighting_id FROM s q JOIN s t ON t.model = q.model AND t.sighting_id <> q.sighting_id WHERE q.sighting_id % 50 = 0 AND round(list_cosine_similarity(q.v, t.v), 9) >= 0.6
      UNION SELECT q.sighting_id, t.sighting_id FROM s q JOIN b ON b.asked_id = q.sighting_id JOIN s t ON t.person_id = b.person_id AND t.model = q.model AND t.sighting_id <> q.sighting_id)
    SELECT asked_id, sighting_id, row_number() OVER (PARTITION BY asked_id ORDER BY source_path NULLS FIRST, CASE WHEN start_seconds IS NULL OR isnan(start_seconds) THEN 0 ELSE start_seconds END, unit_no, sighting_id) AS place FROM h JOIN s USING (sighting_id)
    """,
)
def faces_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every fiftieth face: sightings that resemble it, and all of the person whose gallery is most similar, by recording and time."""
    from paperloom.plans.retrieval import people_gallery

    s = table(spark, sf_dir, "sightings").where("vector IS NOT NULL")
    rows = s.select(F.col("sighting_id").alias("id"), F.col("model").alias("grp"), "vector", F.col("person_id").alias("owner"))
    asked = rows.where("id % 50 = 0").select("id", "grp", "vector")
    gallery = rows.join(people_gallery(spark, sf_dir).select(F.col("sighting_id").alias("id")), "id", "left_semi")
    best = top_matches(asked, gallery, 1, 0.6).select("asked_id", F.col("owner").alias("person_id")).join(asked.select(F.col("id").alias("asked_id"), F.col("grp").alias("model")), "asked_id")
    same = s.select("sighting_id", "person_id", "model").join(best, ["person_id", "model"]).where("sighting_id <> asked_id").select("asked_id", "sighting_id")
    direct = all_matches(asked, rows.drop("owner"), 0.6).select("asked_id", F.col("found_id").alias("sighting_id"))
    hits = same.unionByName(direct).distinct().join(s.select("sighting_id", "source_path", "start_seconds", "unit_no"), "sighting_id")
    at = F.coalesce(F.nanvl("start_seconds", F.lit(0.0)), F.lit(0.0))
    place = F.row_number().over(Window.partitionBy("asked_id").orderBy(F.asc_nulls_first("source_path"), at, "unit_no", "sighting_id"))
    return hits.select("asked_id", "sighting_id", place.alias("place"))


@add(
    "flow_stretches",
    sql="""
    WITH u AS (SELECT document_id, chunk_id, coalesce(unit_kind, '') IN ('text', 'generic') AS flows FROM chunks WHERE document_id IS NOT NULL),
    f AS (SELECT *, CASE WHEN flows AND coalesce(lag(flows) OVER (PARTITION BY document_id ORDER BY chunk_id), false) THEN 0 ELSE 1 END AS fresh FROM u)
    SELECT document_id, chunk_id, sum(fresh) OVER (PARTITION BY document_id ORDER BY chunk_id ROWS UNBOUNDED PRECEDING) AS run FROM f
    """,
)
def flow_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of units that flow into each other."""
    u = table(spark, sf_dir, "chunks").where("document_id IS NOT NULL").select("document_id", "chunk_id", F.coalesce("unit_kind", F.lit("")).isin("text", "generic").alias("flows"))
    return flow_runs(u, "document_id", "chunk_id", F.col("flows")).select("document_id", "chunk_id", "run")


@add(
    "line_blocks",
    sql="""
    WITH l AS (SELECT source_path, sighting_id, y, h, lag(y) OVER w + lag(h) OVER w AS bottom, lag(h) OVER w AS tall FROM sightings WHERE source_path IS NOT NULL AND y IS NOT NULL AND h IS NOT NULL WINDOW w AS (PARTITION BY source_path ORDER BY sighting_id))
    SELECT source_path, sighting_id, sum(CASE WHEN y - bottom < tall THEN 0 ELSE 1 END) OVER (PARTITION BY source_path ORDER BY sighting_id ROWS UNBOUNDED PRECEDING) AS block FROM l
    """,
)
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as lines of text in blocks, by the gaps between them."""
    s = table(spark, sf_dir, "sightings").where("source_path IS NOT NULL AND y IS NOT NULL AND h IS NOT NULL").select("source_path", "sighting_id", "y", F.col("h").alias("height"))
    return text_blocks(s, "source_path", "sighting_id").select("source_path", "sighting_id", "block")


@add(
    "folder_outline",
    sql="""
    WITH c AS (SELECT document_id, coalesce(pages.page_first, 0) AS page, [coalesce(unit_kind, 'none'), coalesce(anchor_kind, 'none')] AS folders FROM chunks WHERE document_id IS NOT NULL)
    SELECT document_id, 1 AS depth, folders[1] AS folder, min(page) AS page_first FROM c GROUP BY ALL UNION ALL SELECT document_id, 2, folders[1] || '/' || folders[2], min(page) FROM c GROUP BY ALL
    """,
)
def folder_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of a document's links as a tree, with the first page of each."""
    c = table(spark, sf_dir, "chunks").where("document_id IS NOT NULL")
    links = c.select("document_id", F.coalesce("pages.page_first", F.lit(0)).alias("page_first"), F.array(F.coalesce("unit_kind", F.lit("none")), F.coalesce("anchor_kind", F.lit("none"))).alias("folders"))
    return graph.folders_outline(links, "document_id").select("document_id", "depth", "folder", "page_first")


@add("source_positions", sql="SELECT document_id, source_id, entry_id, text FROM (SELECT *, row_number() OVER (PARTITION BY document_id, source_id ORDER BY entry_id) AS r FROM entries WHERE kind = 'location') WHERE r = 1")
def source_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first position of each source."""
    e = table(spark, sf_dir, "entries").where("kind = 'location'").select("document_id", "source_id", "entry_id", "text")
    return graph.first_only(e, ["document_id", "source_id"], "entry_id")


@add("member_parents", sql="SELECT chunk_id AS unit_id, CASE WHEN chunk_id % 3 = 0 THEN 'archive' ELSE 'm' || chunk_id END AS source_id, CASE WHEN chunk_id % 3 <> 0 THEN CASE WHEN chunk_id % 2 = 0 THEN 'inner' END WHEN chunk_id % 2 = 0 THEN 'inner' ELSE 'a/' || chunk_id END AS member FROM chunks")
def member_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of members under their container, with the innermost name."""
    c = table(spark, sf_dir, "chunks")
    key = F.col("chunk_id").cast("string")
    units = c.select(F.col("chunk_id").alias("unit_id"), F.concat(F.lit("m"), key).alias("source_id"), F.when(F.col("chunk_id") % 2 == 0, F.create_map(F.lit("container.member"), F.lit("inner"))).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"))
    containers = c.where("chunk_id % 3 = 0").select(F.concat(F.lit("m"), key).alias("source_id"), F.lit("archive").alias("container_id"), F.concat(F.lit("a/"), key).alias("member"))
    return graph.reparented(units, containers).select("unit_id", "source_id", F.try_element_at("metadata", F.lit("container.member")).alias("member"))


@add(
    "pooled_events",
    sql="SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN 'seen' ELSE event_type END AS event, max(value) AS score FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1, 2",
)
def pooled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's labels as events, by their highest score."""
    names = spark.createDataFrame([("click", "seen"), ("view", "seen"), ("error", "error")], "label string, event string")
    return graph.pooled(table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("label"), F.col("value").alias("score")), names, ["user_id"])


@add("retry_waits", sql="SELECT DISTINCT user_id % 12 AS failures, least(300.0, 5.0 * pow(2, greatest(user_id % 12 - 1, 0))) AS seconds FROM events")
def retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 12).alias("failures")).distinct().withColumn("seconds", graph.backoff(F.col("failures")))


@add(
    "option_names",
    sql="SELECT p_partkey, replace(replace(p_name, ' ', '-'), '-', '_') AS table_name, lower(p_type) AS base, CASE WHEN contains(lower(p_type), 'economy') THEN 'Economy' WHEN contains(lower(p_type), 'promo') THEN 'Promo' END AS category FROM part",
)
def option_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.table_name(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(" "))).alias("table_name"), T.base_type(F.concat("p_type", F.lit(" ; charset=UTF-8"))).alias("base"), T.picked(F.concat(F.lit("It is "), "p_type"), ["Promo", "Economy"]).alias("category"))


@add("answer_topics", sql="SELECT p_partkey, ['Part ' || p_partkey, p_name, 'b', 'c', 'd'] AS topics FROM part")
def answer_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.lit("Topics:\n1. Part "), F.col("p_partkey").cast("string"), F.lit('\n- "'), F.col("p_name"), F.lit('".\n* '), F.upper("p_name"), F.lit(", b, c\n• d, e, f"))
    return table(spark, sf_dir, "part").select("p_partkey", T.topics(answer).alias("topics"))


@add("tidied_texts", sql=r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[^\S\n]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\s+$', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def tidied_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(T.tidied(F.col("text"))).alias("digest"))


@add("spoken_once", sql="SELECT DISTINCT document_id, start_seconds, end_seconds, text FROM entries WHERE kind = 'transcript'")
def spoken_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken lines of a document, each once by its times and text."""
    return table(spark, sf_dir, "entries").where("kind = 'transcript'").select("document_id", "start_seconds", "end_seconds", "text").distinct()


@add("places_once", sql="SELECT document_id, unit_id, text FROM (SELECT document_id, unit_id, text, row_number() OVER (PARTITION BY document_id, unit_id, lower(text) ORDER BY entry_id) AS r FROM entries WHERE kind IN ('location', 'object') AND text IS NOT NULL) WHERE r = 1")
def places_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and things of a unit, the first of each name."""
    e = table(spark, sf_dir, "entries").where("kind IN ('location', 'object') AND text IS NOT NULL")
    return graph.first_only(e.withColumn("_k", F.lower("text")), ["document_id", "unit_id", "_k"], "entry_id").select("document_id", "unit_id", "text")


@add(
    "people_listing",
    sql="SELECT row_number() OVER (ORDER BY person_name IS NULL, person_name, person_id) AS place, person_id, coalesce(person_name, label) AS display FROM people",
)
def people_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gallery (240 people at any scale), named people first."""
    place = F.row_number().over(Window.orderBy(F.col("person_name").isNull(), "person_name", "person_id"))
    return table(spark, sf_dir, "people").select(place.alias("place"), "person_id", F.coalesce("person_name", "label").alias("display"))


@add("people_forgotten", sql="SELECT count(*) AS n_sightings, count(DISTINCT person_id) AS n_people FROM sightings WHERE person_id NOT IN (SELECT person_id FROM people WHERE person_id % 10 = 0)")
def people_forgotten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings that stay when every tenth person is forgotten."""
    gone = table(spark, sf_dir, "people").where("person_id % 10 = 0").select("person_id")
    left = table(spark, sf_dir, "sightings").where("person_id IS NOT NULL").join(gone, "person_id", "left_anti")
    return left.groupBy("person_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_sightings"), F.count("*").alias("n_people"))


@add("index_removed", sql="SELECT count(*) AS n FROM entries e JOIN indexed_pdfs d USING (document_id) WHERE d.document_id % 5 <> 0")
def index_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that stay when every fifth document is removed."""
    docs = table(spark, sf_dir, "indexed_pdfs")
    gone = docs.where("document_id % 5 = 0").select("document_id")
    kept = table(spark, sf_dir, "entries").join(docs.select("document_id"), "document_id", "left_semi").join(gone, "document_id", "left_anti")
    return kept.agg(F.count("*").alias("n"))


@add("spoken_segments", sql="SELECT entry_id, round(start_seconds, 3) AS start_seconds, round(end_seconds, 3) AS end_seconds, trim(text) AS text FROM entries WHERE kind = 'transcript' AND start_seconds IS NOT NULL AND NOT isnan(start_seconds) AND NOT isnan(end_seconds) AND end_seconds >= start_seconds AND trim(text) <> ''")
def spoken_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a recogniser's JSON, and read back; a broken and an empty one are left out."""
    e = table(spark, sf_dir, "entries").where("kind = 'transcript' AND NOT isnan(start_seconds) AND NOT isnan(end_seconds)")
    segment = F.struct(F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"), F.concat(F.lit(" "), "text", F.lit(" ")).alias("text"))
    empty = F.struct(F.lit(1.0).alias("start"), F.lit(0.5).alias("end"), F.lit("back").alias("text"))
    doc = F.to_json(F.struct(F.lit("en").alias("language"), F.array(segment, empty, F.struct(F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.lit("  ").alias("text"))).alias("segments")))
    read = e.select("entry_id", F.inline(structured.segments(doc)))
    return read.select("entry_id", F.round("start_seconds", 3).alias("start_seconds"), F.round("end_seconds", 3).alias("end_seconds"), "text")


@add("hook_payloads", sql="SELECT job, state, n FROM (SELECT user_id AS job, arg_max(event_type, event_id) AS state, count(*) AS n FROM events GROUP BY 1)")
def hook_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of jobs as the JSON that a hook sends, without any path, and read back."""
    jobs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job")).agg(F.max_by("event_type", "event_id").alias("state"), F.count("*").alias("n"), F.lit("/home/a/b.pdf").alias("path"))
    sent = jobs.select(F.to_json(F.struct("job", "state", "n")).alias("body"))
    return sent.select(F.from_json("body", "job long, state string, n long").alias("b")).select("b.*")


@add("face_regions_kept", sql="SELECT entry_id, x, y, width, height FROM entries WHERE kind = 'face' AND x IS NOT NULL AND y IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL")
def face_regions_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as little-endian bytes in base64, and read back."""
    e = table(spark, sf_dir, "entries").where("kind = 'face' AND x IS NOT NULL AND y IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL")
    from paperloom.functions.vectors import from_bytes, to_bytes

    back = from_bytes(F.unbase64(F.base64(to_bytes(F.array("x", "y", "width", "height"), True))), True)
    return e.select("entry_id", *(F.element_at(back, k).alias(c) for k, c in enumerate(("x", "y", "width", "height"), 1)))
