"""Queries that derive rows from units, events, texts and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.vectors import clamp, cosine, haversine_km
from paperloom.operators.runs import drop_near_copies, flow_pages, greedy_boxes, islands, near, scenes
from paperloom.plans.registry import Registry
from paperloom.session import table

REGISTRY = Registry()
add = REGISTRY.add


@add(
    "event_islands",
    sql="""
    WITH w AS (SELECT DISTINCT user_id, event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour FROM events),
    f AS (SELECT *, CASE WHEN hour - lag(hour) OVER (PARTITION BY user_id, event_type ORDER BY hour) <= 2 THEN 0 ELSE 1 END AS fresh FROM w),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY hour ROWS UNBOUNDED PRECEDING) AS island FROM f)
    SELECT user_id, event_type, min(hour) AS first_hour, max(hour) + 1 AS end_hour FROM i GROUP BY user_id, event_type, island HAVING max(hour) + 1 - min(hour) >= 2
    """,
)
def event_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of hours with an event, one empty hour bridged, of two hours and more."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long")
    w = table(spark, sf_dir, "events").select("user_id", "event_type", hour.alias("hour")).distinct()
    runs = islands(w, ["user_id", "event_type"], "hour").groupBy("user_id", "event_type", "island").agg(F.min("hour").alias("first_hour"), (F.max("hour") + 1).alias("end_hour"))
    return runs.where("end_hour - first_hour >= 2").drop("island")


@add(
    "event_timeline",
    sql="""
    SELECT user_id, string_agg(event_type || ' ' || event_id, ' · ' ORDER BY event_id) AS timeline FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id
    """,
)
def event_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    notable = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase"))
    rows = notable.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("r"))
    return rows.select("user_id", F.array_join(F.transform("r", lambda x: F.concat(x["event_type"], F.lit(" "), x["event_id"].cast("string"))), " · ").alias("timeline"))


@add(
    "scene_spans",
    sql="""
    WITH s AS (SELECT user_id, event_id, ts, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS scene FROM events),
    b AS (SELECT user_id, scene, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) AS last_us, count(*) AS n FROM s GROUP BY user_id, scene)
    SELECT user_id, scene, start_us, coalesce(lead(start_us) OVER (PARTITION BY user_id ORDER BY scene), last_us) AS end_us, n FROM b
    """,
)
def scene_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes open at each sign-up and last to the next scene, else to the last event."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    cut = scenes(e, ["user_id"], ["us", "event_id"], F.col("event_type") == "signup")
    spans = cut.groupBy("user_id", "scene").agg(F.min("us").alias("start_us"), F.max("us").alias("last_us"), F.count("*").alias("n"))
    following = F.lead("start_us").over(Window.partitionBy("user_id").orderBy("scene"))
    return spans.select("user_id", "scene", "start_us", F.coalesce(following, "last_us").alias("end_us"), "n")


@add(
    "cue_frames",
    sql="""
    SELECT f.entry_id AS frame_id, c.entry_id AS cue_id FROM entries f JOIN entries c ON f.document_id = c.document_id
    WHERE f.kind IN ('object', 'caption', 'scene', 'face') AND c.kind = 'transcript' AND f.start_seconds >= c.start_seconds - 0.25 AND f.start_seconds <= c.end_seconds + 0.25 AND c.end_seconds >= c.start_seconds
    """,
)
def cue_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken lines at a frame of the same document, a quarter second on both sides."""
    e = table(spark, sf_dir, "entries")
    frames = e.where(F.col("kind").isin("object", "caption", "scene", "face")).select("document_id", F.col("entry_id").alias("frame_id"), F.col("start_seconds").alias("at"))
    cues = e.where("kind = 'transcript'").select("document_id", F.col("entry_id").alias("cue_id"), "start_seconds", "end_seconds")
    return near(frames, cues, "document_id", "at", "start_seconds", "end_seconds", 0.25).select("frame_id", "cue_id")


@add(
    "page_spans",
    sql="SELECT document_id, source_id, min(page_first) AS page_first, max(page_last) AS page_last, count(DISTINCT unit_id) AS n_units FROM entries GROUP BY document_id, source_id",
)
def page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "entries").groupBy("document_id", "source_id", "unit_id").agg(F.min("page_first").alias("a"), F.max("page_last").alias("b"))
    return units.groupBy("document_id", "source_id").agg(F.min("a").alias("page_first"), F.max("b").alias("page_last"), F.count("unit_id").alias("n_units"))


@add(
    "unit_texts",
    sql="""
    SELECT document_id, unit_id, string_agg(text, chr(10) ORDER BY entry_id) AS text, list(DISTINCT provider ORDER BY provider) FILTER (provider IS NOT NULL) AS providers
    FROM entries WHERE trim(text) <> '' AND kind IN ('caption', 'object', 'scene', 'transcript') GROUP BY document_id, unit_id
    """,
)
def unit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit's annotations as one text, in their order, with their providers."""
    e = table(spark, sf_dir, "entries").where(F.col("kind").isin("caption", "object", "scene", "transcript") & (F.trim("text") != ""))
    rows = e.groupBy("document_id", "unit_id").agg(F.array_sort(F.collect_list(F.struct("entry_id", "text"))).alias("r"), F.array_sort(F.collect_set("provider")).alias("p"))
    return rows.select("document_id", "unit_id", F.array_join("r.text", "\n").alias("text"), F.when(F.size("p") > 0, F.col("p")).alias("providers"))


@add(
    "object_counts",
    sql="""
    WITH c AS (SELECT document_id, text, count(*) AS n FROM entries WHERE kind = 'object' GROUP BY 1, 2)
    SELECT document_id, string_agg(text || ' ×' || n, ', ' ORDER BY n DESC, text) AS objects, sum(n) AS total FROM c GROUP BY document_id
    """,
)
def object_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "entries").where("kind = 'object'").groupBy("document_id", "text").agg(F.count("*").alias("n"))
    rows = c.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "text"))).alias("r"), F.sum("n").alias("total"))
    return rows.select("document_id", F.array_join(F.transform("r", lambda x: F.concat(x["text"], F.lit(" ×"), (-x["m"]).cast("string"))), ", ").alias("objects"), "total")


@add(
    "weighted_tone",
    sql="""
    WITH s AS (SELECT document_id, confidence AS score, greatest(len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')), 1) AS words FROM entries WHERE kind = 'transcript' AND confidence IS NOT NULL AND text IS NOT NULL)
    SELECT document_id, round(sum(score * words) / sum(words), 6) AS score, count(*) FILTER (score >= 0.9) AS n_high, count(*) AS n FROM s GROUP BY document_id HAVING count(*) > 1
    """,
)
def weighted_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's mean over its segments, weighted by words; only of more than one segment."""
    s = table(spark, sf_dir, "entries").where("kind = 'transcript' AND confidence IS NOT NULL AND text IS NOT NULL")
    words = F.greatest(F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")), F.lit(1))
    rows = s.withColumn("words", words).groupBy("document_id").agg(F.round(F.sum(F.col("confidence") * F.col("words")) / F.sum("words"), 6).alias("score"), F.count_if(F.col("confidence") >= 0.9).alias("n_high"), F.count("*").alias("n"))
    return rows.where("n > 1")


@add(
    "clip_tags",
    sql="""
    WITH p AS (SELECT vec_id AS tag, embedding AS v, vec_id // 2 AS grp FROM embeddings WHERE vec_id < 6),
    c AS (SELECT e.vec_id, p.grp, p.tag, 100 * list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.v AS DOUBLE[])) AS logit FROM embeddings e, p WHERE e.vec_id >= 6),
    m AS (SELECT *, max(logit) OVER (PARTITION BY vec_id, grp) AS top FROM c),
    s AS (SELECT *, exp(logit - top) / sum(exp(logit - top)) OVER (PARTITION BY vec_id, grp) AS share FROM m)
    SELECT vec_id, grp AS tag_group, tag, round(share, 6) AS share FROM s WHERE share >= 0.75
    """,
)
def clip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-shot tags: softmax of 100 times the cosine within each group of prompts (the first six vectors)."""
    e = table(spark, sf_dir, "embeddings")
    prompts = F.broadcast(e.where("vec_id < 6").select(F.col("vec_id").alias("tag"), F.col("embedding").alias("v"), F.floor(F.col("vec_id") / 2).cast("long").alias("tag_group"), F.lit(1).alias("one")))  # six rows
    logits = e.where("vec_id >= 6").withColumn("one", F.lit(1)).join(prompts, "one").select("vec_id", "tag_group", "tag", (100 * cosine(F.col("embedding"), F.col("v"))).alias("logit"))
    w = Window.partitionBy("vec_id", "tag_group")
    shares = logits.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(w))).withColumn("share", F.col("e") / F.sum("e").over(w))
    return shares.where("share >= 0.75").select("vec_id", "tag_group", "tag", F.round("share", 6).alias("share"))


_PLACES = [("Dunmere", 54.1, -6.2), ("Ostermoor", 53.6, 9.9), ("Torrealbina", 38.2, -3.4), ("Valcourt", 46.3, 2.1), ("Port Tavish", 56.4, -5.5), ("Ashcombe", 51.2, -1.1)]


@add(
    "nearest_place",
    sql=f"""
    WITH g AS (SELECT entry_id, CAST(regexp_extract(text, '\\((-?[0-9.]+), (-?[0-9.]+)\\)', 1) AS DOUBLE) AS lat, CAST(regexp_extract(text, '\\((-?[0-9.]+), (-?[0-9.]+)\\)', 2) AS DOUBLE) AS lon
      FROM entries WHERE kind = 'location' AND regexp_matches(text, '\\((-?[0-9.]+), (-?[0-9.]+)\\)')),
    p(place, plat, plon) AS (VALUES {', '.join(f"('{n}', {a}, {b})" for n, a, b in _PLACES)}),
    k AS (SELECT entry_id, place, 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(plat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * pow(sin(radians(plon - lon) / 2), 2)))) AS km FROM g, p)
    SELECT entry_id, place, round(km, 3) AS km FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY km, place) AS r FROM k) WHERE r = 1
    """,
)
def nearest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest place of a gazetteer for each position; the gazetteer is a literal array, so rows aren't multiplied."""
    pattern = r"\((-?[0-9.]+), (-?[0-9.]+)\)"
    g = table(spark, sf_dir, "entries").where((F.col("kind") == "location") & F.col("text").rlike(pattern))
    g = g.select("entry_id", F.regexp_extract("text", pattern, 1).cast("double").alias("lat"), F.regexp_extract("text", pattern, 2).cast("double").alias("lon"))
    options = F.array(*(F.struct(haversine_km(F.col("lat"), F.col("lon"), F.lit(a), F.lit(b)).alias("km"), F.lit(n).alias("place")) for n, a, b in _PLACES))
    best = F.array_min(options)
    return g.select("entry_id", best["place"].alias("place"), F.round(best["km"], 3).alias("km"))


@add(
    "chat_participants",
    sql=r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE source = 'chat_export' AND text IS NOT NULL),
    m AS (SELECT doc_id, i, regexp_extract(line, '^\[([0-9]{2}:[0-9]{2})\] ([^:\r\n]{1,64}): (.*)$', 2) AS sender, regexp_extract(line, '^\[([0-9]{2}:[0-9]{2})\] ([^:\r\n]{1,64}): (.*)$', 1) AS tm FROM l
      WHERE regexp_matches(line, '^\[([0-9]{2}:[0-9]{2})\] ([^:\r\n]{1,64}): (.*)$')),
    s AS (SELECT doc_id, sender, min(i) AS first, count(*) AS n FROM m GROUP BY 1, 2),
    e AS (SELECT doc_id, arg_min(tm, i) AS first_at, arg_max(tm, i) AS last_at FROM m GROUP BY 1)
    SELECT doc_id, string_agg(sender, ', ' ORDER BY first) AS participants, sum(n) AS n_messages, any_value(first_at) AS first_at, any_value(last_at) AS last_at FROM s JOIN e USING (doc_id) GROUP BY doc_id
    """,
)
def chat_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senders of a chat in the order of their first message, and its messages and bounds."""
    pattern = r"^\[([0-9]{2}:[0-9]{2})\] ([^:\r\n]{1,64}): (.*)$"
    lines = table(spark, sf_dir, "documents").where("source = 'chat_export' AND text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    m = lines.where(F.col("line").rlike(pattern)).select("doc_id", "i", F.regexp_extract("line", pattern, 2).alias("sender"), F.regexp_extract("line", pattern, 1).alias("at"))
    s = m.groupBy("doc_id", "sender").agg(F.min("i").alias("first"), F.count("*").alias("n"), F.min_by("at", "i").alias("a"), F.max(F.struct("i", "at")).alias("b"))
    rows = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "sender"))).alias("r"), F.sum("n").alias("n_messages"), F.min_by("a", "first").alias("first_at"), F.max("b").alias("b"))
    return rows.select("doc_id", F.array_join("r.sender", ", ").alias("participants"), "n_messages", "first_at", F.col("b.at").alias("last_at"))


@add(
    "record_units",
    sql=r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents WHERE source = 'jsonl_records' AND text IS NOT NULL),
    b AS (SELECT *, octet_length(encode(line)) AS bytes, coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS record, line_no, 'Record ' || row_number() OVER (PARTITION BY doc_id ORDER BY line_no) || ' (line ' || line_no || ')' AS heading, CAST(start AS BIGINT) AS byte_start, CAST(start + bytes AS BIGINT) AS byte_end
    FROM b WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
    """,
)
def record_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit for each line that isn't blank, with its heading and its bytes."""
    lines = table(spark, sf_dir, "documents").where("source = 'jsonl_records' AND text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i")
    before = F.coalesce(F.sum(F.octet_length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    own = lines.withColumn("byte_start", before).withColumn("byte_end", F.col("byte_start") + F.octet_length("line")).where(F.trim(F.col("line"), F.lit(" \t\r")) != "")
    n = F.row_number().over(w)
    return own.select("doc_id", n.cast("long").alias("record"), (F.col("i") + 1).cast("long").alias("line_no"), F.format_string("Record %d (line %d)", n, F.col("i") + 1).alias("heading"), "byte_start", "byte_end")


@add("event_props", sql="SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value, 'k: ' || json_extract_string(props, '$.k') AS line FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of a flat JSON object as `path: value` lines."""
    pairs = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("path", "value"))
    return pairs.select("event_id", "path", "value", F.concat_ws(": ", "path", "value").alias("line"))


@add(
    "entities_email",
    sql=r"""
    WITH m AS (SELECT email_id, unnest(regexp_extract_all(lower(body), '[a-z0-9._%+-]+@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}')) AS value FROM emails WHERE body IS NOT NULL)
    SELECT email_id, value, count(*) AS n FROM m GROUP BY email_id, value
    """,
)
def entities_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = r"[a-z0-9._%+-]+@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}"
    return table(spark, sf_dir, "emails").select("email_id", F.explode(F.regexp_extract_all(F.lower("body"), F.lit(pattern), F.lit(0))).alias("value")).groupBy("email_id", "value").agg(F.count("*").alias("n"))


@add(
    "entities_web",
    sql=r"""
    WITH m AS (SELECT email_id, unnest(regexp_extract_all(body, '(?:https?://|www\.)[^\s<>"'']+')) AS raw FROM emails WHERE body IS NOT NULL),
    t AS (SELECT email_id, regexp_replace(raw, '[.,;:!?)\]}]+$', '') AS value FROM m)
    SELECT email_id, value, lower(regexp_extract(value, '^(?:https?://)?([^/?#]+)', 1)) AS host, count(*) AS n FROM t GROUP BY ALL
    """,
)
def entities_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "emails").select("email_id", F.explode(F.regexp_extract_all("body", F.lit(r"(?:https?://|www\.)[^\s<>\"']+"), F.lit(0))).alias("raw"))
    value = raw.select("email_id", F.regexp_replace("raw", r"[.,;:!?)\]}]+$", "").alias("value"))
    return value.groupBy("email_id", "value").agg(F.count("*").alias("n")).withColumn("host", F.lower(F.regexp_extract("value", r"^(?:https?://)?([^/?#]+)", 1)))


@add(
    "iso_dates",
    sql=r"SELECT email_id, unnest(list_distinct(regexp_extract_all(body, '(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]'))) AS iso FROM emails WHERE body IS NOT NULL",
)
def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "emails").select("email_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit("(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]"), F.lit(0)))).alias("iso"))


@add(
    "citations",
    sql=r"""
    WITH g AS (SELECT doc_id, unnest(regexp_extract_all(text, '\[(\d{1,6}(?:\s*,\s*\d{1,6})*)\]', 1)) AS grp FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, list(DISTINCT n ORDER BY n) AS cited FROM (SELECT doc_id, CAST(unnest(regexp_split_to_array(grp, '\s*,\s*')) AS INTEGER) AS n FROM g) GROUP BY doc_id
    """,
)
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.citations(F.col("text")).alias("cited")).where(F.size("cited") > 0)


@add(
    "paragraph_rows",
    sql=r"""
    WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n[ \t]*\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: regexp_matches(x, '\p{L}'))) AS paragraph FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, count(*) AS n, sum(length(paragraph)) AS n_chars, count(*) FILTER (contains(paragraph, '?')) AS n_questions FROM p GROUP BY doc_id
    """,
)
def paragraph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.paragraphs(F.col("text"))).alias("paragraph"))
    return p.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("paragraph")).alias("n_chars"), F.count_if(F.contains("paragraph", F.lit("?"))).alias("n_questions"))


def _any_phrase(phrases: tuple[str, ...]) -> str:
    return " OR ".join("contains(line, ' " + p.replace("'", "''") + " ')" for p in phrases)


_EDGE = r"[!-&(-/:-@\[-`{-~]+"


@add(
    "tone_tags",
    sql=rf"""
    WITH w AS (SELECT email_id, body, list_filter(list_transform(regexp_split_to_array(trim(body, ' ' || chr(10) || chr(13) || chr(9) || chr(12)), '\s+'), lambda x: replace(lower(regexp_replace(x, '^{_EDGE}|{_EDGE}$', '', 'g')), '’', '''')), lambda x: x <> '') AS ws FROM emails WHERE body IS NOT NULL),
    t AS (SELECT *, ' ' || array_to_string(ws, ' ') || ' ' AS line, regexp_replace(body, '\s+$', '') AS shown FROM w)
    SELECT email_id, ends_with(shown, '?') OR contains(shown, '? ') OR (len(ws) >= 3 AND ws[1] IN {T.QUESTION_OPENERS}) AS question,
      {_any_phrase(T.URGENT)} OR len(body) - len(replace(body, '!', '')) >= 3 AS urgent, email_id % 2 = 0 AND ({_any_phrase(T.COMPLAINT)}) AS complaint FROM t
    """,
)
def tone_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of emails, of which those with an even id are taken as negative."""
    label = F.when(F.col("email_id") % 2 == 0, "negative").otherwise("positive")
    tags = table(spark, sf_dir, "emails").where("body IS NOT NULL").select("email_id", T.tones(F.col("body"), label).alias("t"))
    return tags.select("email_id", *(F.array_contains("t", tag).alias(tag) for tag in ("question", "urgent", "complaint")))


_META = {"source.filename": "regexp_extract(pdf, '([^/]*)$', 1)", "source.path": "pdf", "exif:Directory": "pdf", "exif:OwnerName": "origin", "exif:ImageSize": "'800x600'", "ffprobe.duration": "'12.5'", "exif:GPSLatitude": "'48.1'", "exif:ColorSpace": "'sRGB'", "pdf.PageCount": "'3'", "outline.title": "profile", "fs.size-bytes": "'9'", "x:FileAccessDate": "'2024'"}


@add(
    "share_profile",
    sql=f"""
    WITH m AS (SELECT document_id, unnest([{', '.join(f"{{'key': '{k}', 'value': {v}}}" for k, v in _META.items())}]) AS e FROM indexed_pdfs WHERE profile = 'share')
    SELECT document_id, e.key AS key, e.value AS value FROM m WHERE e.key IN ('source.filename', 'exif:ImageSize', 'ffprobe.duration', 'pdf.PageCount', 'outline.title', 'fs.size-bytes')
    """,
)
def share_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the share profile leaves of a document's metadata."""
    from paperloom.operators.publish import share_metadata

    d = table(spark, sf_dir, "indexed_pdfs").where("profile = 'share'")
    value = lambda v: T.base_name(F.col("pdf")) if v.startswith("regexp") else F.lit(v.strip("'")) if v.startswith("'") else F.col(v)
    meta = F.create_map(*(x for k, v in _META.items() for x in (F.lit(k), value(v))))
    return d.select("document_id", F.explode(share_metadata(meta)).alias("key", "value"))


@add(
    "file_names",
    sql=r"""
    WITH n AS (SELECT email_id, unnest(attachment_names) AS name FROM emails)
    SELECT email_id, name, regexp_replace(substr(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') AS slug FROM n WHERE name IS NOT NULL
    """,
)
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "emails").select("email_id", F.explode("attachment_names").alias("name")).where("name IS NOT NULL").withColumn("slug", T.slug(F.col("name")))


@add(
    "clock_times",
    sql="""
    WITH t AS (SELECT entry_id, CAST(floor(greatest(start_seconds, 0)) AS BIGINT) AS s, CAST(round(greatest(start_seconds, 0) * 1000) AS BIGINT) AS ms FROM entries WHERE start_seconds IS NOT NULL AND NOT isnan(start_seconds))
    SELECT entry_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock,
      lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS stamp FROM t
    """,
)
def clock_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time as the two spellings of the outputs: one truncates, the other rounds."""
    e = table(spark, sf_dir, "entries").where("start_seconds IS NOT NULL AND NOT isnan(start_seconds)")
    return e.select("entry_id", T.clock(F.col("start_seconds")).alias("clock"), T.stamp(F.col("start_seconds")).alias("stamp"))


@add(
    "clamped_regions",
    sql="SELECT entry_id, greatest(0, least(1, CASE WHEN isnan(x) THEN 0 ELSE x END)) AS x, greatest(0, least(1, CASE WHEN isnan(y) THEN 0 ELSE y END)) AS y FROM entries WHERE x IS NOT NULL AND y IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL",
)
def clamped_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, all or nothing, inside the page."""
    e = table(spark, sf_dir, "entries").where("x IS NOT NULL AND y IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL")
    return e.select("entry_id", clamp(F.col("x")).alias("x"), clamp(F.col("y")).alias("y"))


@add(
    "best_importer",
    sql=r"""
    WITH c AS (SELECT doc_id, unnest([{'importer': 'text', 'score': CASE WHEN text IS NULL THEN 0 ELSE 100 END, 'position': 1}, {'importer': 'structured', 'score': CASE WHEN starts_with(ltrim(text, ' ' || chr(10) || chr(13) || chr(9)), '{') THEN 250 ELSE 0 END, 'position': 2},
      {'importer': 'email', 'score': CASE WHEN regexp_matches(text, '^(From|Subject|To|Date): ') THEN 250 ELSE 0 END, 'position': 3}, {'importer': 'chat', 'score': CASE WHEN regexp_matches(text, '^\[[0-9]{2}:[0-9]{2}\] ') THEN 300 ELSE 0 END, 'position': 4}]) AS o FROM documents)
    SELECT doc_id, o.importer AS importer, o.score AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o.score DESC, o.position) AS r FROM c WHERE o.score > 0) WHERE r = 1
    """,
)
def best_importer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The importer with the highest score; of equal ones the first registered."""
    text = F.col("text")
    scored = [("text", F.when(text.isNull(), 0).otherwise(100)), ("structured", F.when(F.startswith(F.trim(text, F.lit(" \n\r\t")), F.lit("{")), 250).otherwise(0))]
    scored += [("email", F.when(text.rlike("^(From|Subject|To|Date): "), 250).otherwise(0)), ("chat", F.when(text.rlike(r"^\[[0-9]{2}:[0-9]{2}\] "), 300).otherwise(0))]
    options = F.array(*(F.struct(score.alias("score"), F.lit(-k).alias("p"), F.lit(name).alias("importer")) for k, (name, score) in enumerate(scored)))
    best = F.array_max(options)
    return table(spark, sf_dir, "documents").select("doc_id", best["importer"].alias("importer"), best["score"].alias("score")).where("score > 0")


@add(
    "job_states",
    sql="""
    WITH l AS (SELECT user_id AS job, arg_max(event_type, event_id) AS state, max(event_id) AS last_event, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1)
    SELECT job, state, last_event, failures, CASE WHEN failures = 0 OR failures > 7 THEN NULL ELSE [5, 300, 1800, 7200, 18000, 36000, 36000][failures] END AS retry_seconds FROM l
    """,
)
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's last state, its failures, and how long its next delivery waits."""
    from paperloom.streaming.intake import RETRY_SECONDS

    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job")).agg(F.max_by("event_type", "event_id").alias("state"), F.max("event_id").alias("last_event"), F.count_if(F.col("event_type") == "error").alias("failures"))
    delays = F.array(*map(F.lit, RETRY_SECONDS))
    return last.withColumn("retry_seconds", F.when(F.col("failures") > 0, F.try_element_at(delays, F.col("failures").cast("int"))))


@add(
    "mail_first_copies",
    sql="""
    SELECT email_id, message_id FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY received_at NULLS LAST, email_id) AS r FROM emails WHERE message_id IS NOT NULL) WHERE r = 1
    UNION ALL SELECT email_id, message_id FROM emails WHERE message_id IS NULL
    """,
)
def mail_first_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message once, as it arrived first; messages without an id all count."""
    e = table(spark, sf_dir, "emails")
    first = e.where("message_id IS NOT NULL").groupBy("message_id").agg(F.min(F.struct(F.col("received_at").isNull().alias("late"), "received_at", "email_id")).alias("f")).select("f.email_id", "message_id")
    return first.unionByName(e.where("message_id IS NULL").select("email_id", "message_id"))


@add("face_boxes")
def face_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of a unit without boxes that overlap a better one by more than half."""
    e = table(spark, sf_dir, "entries").where("kind = 'face' AND x IS NOT NULL AND width IS NOT NULL AND unit_id IS NOT NULL").select("entry_id", "document_id", "unit_id", F.coalesce("confidence", F.lit(0.0)).alias("score"), "x", "y", "width", "height")
    return greedy_boxes(e, ["document_id", "unit_id"], "entry_id", "score", ["x", "y", "width", "height"])


@add("kept_frames")
def kept_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings of a recording whose picture isn't close to one of the twelve kept before; the signs of a face's vector are its fingerprint."""
    s = table(spark, sf_dir, "sightings").where("source_path IS NOT NULL AND vector IS NOT NULL")
    bits = F.aggregate("vector", F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("long")))
    return drop_near_copies(s.select("source_path", "sighting_id", bits.alias("print")), ["source_path"], "sighting_id", "print", 2)


@add(
    "page_flow",
    sql="""
    WITH RECURSIVE c AS (SELECT document_id, chunk_id, len(string_split(text, chr(10))) AS n, row_number() OVER (PARTITION BY document_id ORDER BY chunk_id) AS r FROM chunks WHERE document_id IS NOT NULL AND text IS NOT NULL),
    f AS (
      SELECT document_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS chunk_id, CAST(0 AS BIGINT) AS n_lines, CAST(1 AS BIGINT) AS page_first, CAST(1 AS BIGINT) AS page_last, CAST(0 AS BIGINT) AS used FROM (SELECT DISTINCT document_id FROM c)
      UNION ALL
      SELECT document_id, r, chunk_id, n, page, CASE WHEN n <= 59 - top THEN page ELSE page + CAST(ceil((n - (59 - top)) / 59.0) AS BIGINT) END, CASE WHEN n <= 59 - top THEN top + n ELSE n - (59 - top) - 59 * (CAST(ceil((n - (59 - top)) / 59.0) AS BIGINT) - 1) END
      FROM (SELECT f.document_id, c.r, c.chunk_id, c.n, f.page_last + CASE WHEN f.used > 0 AND (f.used + 2 > 59 OR (c.n <= 59 AND f.used + 1 + c.n > 59)) THEN 1 ELSE 0 END AS page,
        CASE WHEN f.used > 0 AND (f.used + 2 > 59 OR (c.n <= 59 AND f.used + 1 + c.n > 59)) THEN 0 WHEN f.used > 0 THEN f.used + 1 ELSE 0 END AS top FROM f JOIN c ON c.document_id = f.document_id AND c.r = f.r + 1)
    )
    SELECT document_id, chunk_id, n_lines, page_first, page_last FROM f WHERE r > 0
    """,
)
def page_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a document on pages of 59 lines."""
    c = table(spark, sf_dir, "chunks").where("document_id IS NOT NULL AND text IS NOT NULL").select("document_id", "chunk_id", F.size(F.split("text", "\n")).alias("n_lines"))
    return flow_pages(c, "document_id", "chunk_id", "n_lines")


@add(
    "transcript_units",
    sql="""
    WITH c AS (SELECT document_id, source_id, entry_id, text, CAST(round(start_seconds * 1000) AS BIGINT) AS a, CAST(round(end_seconds * 1000) AS BIGINT) AS b FROM entries
      WHERE kind = 'transcript' AND start_seconds IS NOT NULL AND end_seconds IS NOT NULL AND end_seconds >= start_seconds AND trim(text) <> ''),
    l AS (SELECT *, '[' || lpad(CAST(a // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(a // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(a // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(a % 1000 AS VARCHAR), 3, '0')
      || ' --> ' || lpad(CAST(b // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(b // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(b // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(b % 1000 AS VARCHAR), 3, '0') || '] ' || text AS line FROM c)
    SELECT document_id, source_id, string_agg(line, chr(10) ORDER BY a, b, entry_id) AS text, count(*) AS n FROM l GROUP BY document_id, source_id
    """,
)
def transcript_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken lines of a source as one text with their times."""
    c = table(spark, sf_dir, "entries").where("kind = 'transcript' AND start_seconds IS NOT NULL AND end_seconds >= start_seconds").where(F.trim("text") != "")
    line = F.concat(F.lit("["), T.stamp(F.col("start_seconds")), F.lit(" --> "), T.stamp(F.col("end_seconds")), F.lit("] "), F.col("text"))
    key = F.struct(F.round(F.col("start_seconds") * 1000).alias("a"), F.round(F.col("end_seconds") * 1000).alias("b"), "entry_id", line.alias("line"))
    rows = c.groupBy("document_id", "source_id").agg(F.array_sort(F.collect_list(key)).alias("r"), F.count("*").alias("n"))
    return rows.select("document_id", "source_id", F.array_join("r.line", "\n").alias("text"), "n")


@add(
    "document_manifests",
    sql=r"""
    WITH u AS (SELECT document_id, source_id, unit_id, min(page_first) AS a, max(page_last) AS b FROM entries GROUP BY 1, 2, 3)
    SELECT d.document_id, regexp_extract(any_value(d.pdf), '([^/]*)$', 1) AS file, count(DISTINCT coalesce(u.source_id, '')) AS n_sources, count(*) AS n_units, min(u.a) AS page_first, max(u.b) AS page_last FROM u JOIN indexed_pdfs d USING (document_id) GROUP BY d.document_id
    """,
)
def document_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON manifest per document, and what it says when it is read back."""
    from paperloom.operators.publish import manifest, read_manifest

    written = manifest(table(spark, sf_dir, "entries"), table(spark, sf_dir, "indexed_pdfs"))
    m = written.select("document_id", read_manifest(F.col("manifest")).alias("m"))
    units = F.flatten(F.transform("m.sources", lambda s: s["units"]))
    return m.select("document_id", "m.file", F.size("m.sources").alias("n_sources"), F.size(units).alias("n_units"), F.array_min(F.transform(units, lambda u: u["page_first"])).alias("page_first"), F.array_max(F.transform(units, lambda u: u["page_last"])).alias("page_last"))


@add(
    "shared_entries",
    sql="""
    SELECT entry_id, kind, CASE WHEN kind = 'face' AND entry_id % 2 = 0 THEN 'face' ELSE text END AS text FROM entries e JOIN indexed_pdfs d USING (document_id)
    WHERE d.profile = 'share' AND (kind <> 'location' OR entry_id % 3 = 0) AND NOT (kind = 'chunk' AND entry_id % 7 = 0)
    """,
)
def shared_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of shared documents: every other face is taken as recognised, every third place as read from the text, every seventh chunk as a summary of people."""
    from paperloom.operators.publish import shared_entries as shared

    d = table(spark, sf_dir, "indexed_pdfs").where("profile = 'share'").select("document_id")
    nth = lambda kind, n, key, value: F.when((F.col("kind") == kind) & (F.col("entry_id") % n == 0), F.to_json(F.create_map(F.lit(key), F.lit(value))))
    marked = F.coalesce(nth("face", 2, "person", "Ann"), nth("location", 3, "source", "text"), nth("chunk", 7, "summary", "people"), F.col("attributes"))
    return shared(table(spark, sf_dir, "entries").join(d, "document_id", "left_semi").withColumn("attributes", marked)).select("entry_id", "kind", "text")


@add(
    "email_threads",
    sql=r"""
    WITH s AS (SELECT email_id, regexp_replace(lower(subject), '^(?:(?:re|fw|fwd|aw|wg|rv|tr)\s*:\s*)+', '') AS topic, from_addrs[1] AS sender FROM emails WHERE subject IS NOT NULL)
    SELECT topic, count(*) AS n, min(email_id) AS first_id, max(email_id) AS last_id, count(DISTINCT sender) AS n_senders FROM s GROUP BY topic
    """,
)
def email_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a topic, without the marks of replies and forwards."""
    e = table(spark, sf_dir, "emails").where("subject IS NOT NULL")
    s = e.select("email_id", F.regexp_replace(F.lower("subject"), r"^(?:(?:re|fw|fwd|aw|wg|rv|tr)\s*:\s*)+", "").alias("topic"), F.try_element_at("from_addrs", F.lit(1)).alias("sender"))
    per = s.groupBy("topic", "sender").agg(F.count("*").alias("n"), F.min("email_id").alias("a"), F.max("email_id").alias("b"))
    return per.groupBy("topic").agg(F.sum("n").alias("n"), F.min("a").alias("first_id"), F.max("b").alias("last_id"), F.count("sender").alias("n_senders"))
