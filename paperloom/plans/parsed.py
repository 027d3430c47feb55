"""Queries of the parsers: texts are made from the tables by formatting, and what is read back must be the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import dates, entities, signals
from paperloom.functions import text as T
from paperloom.plans.registry import Registry
from paperloom.session import table
from paperloom.sources import files, markup, messages, structured

REGISTRY = Registry()
add = REGISTRY.add


def _line(column: F.Column | str) -> F.Column:
    """A text on one line, without brackets and the marks of formats."""
    return F.trim(F.regexp_replace(F.regexp_replace(column, r"[\s<>&\[\]{}\"\\|]+", " "), " +", " "))


_LINE = r"trim(regexp_replace(regexp_replace({}, '[\s<>&\[\]{{}}\"\\|]+', ' ', 'g'), ' +', ' ', 'g'))"


@add(
    "date_phrases",
    sql="""
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T14:05:00' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
      WHEN 3 THEN strftime(o_orderdate - INTERVAL 14 DAY, '%Y-%m-%d') ELSE strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') || 'T17:30:00' END AS iso, o_orderkey % 5 IN (3, 4) AS relative FROM orders
    """,
)
def date_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of orders in five wordings."""
    o = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    word = lambda pattern: F.date_format("d", pattern)
    k = F.col("o_orderkey") % 5
    said = F.when(k == 0, F.concat(F.lit("It left on "), word("d MMMM yyyy"), F.lit("."))).when(k == 1, F.concat(F.lit("Seen "), word("MMM d, yyyy"), F.lit(" at 2:05 pm")))
    said = said.when(k == 2, F.concat(F.lit("stamped "), word("dd/MM/yyyy"), F.lit(" here"))).when(k == 3, F.lit("Two weeks ago it was sent")).otherwise(F.lit("tomorrow at 17:30"))
    found = o.select("o_orderkey", F.inline(dates.date_mentions(said, F.col("d"))))
    return found.select("o_orderkey", "iso", "relative")


@add("capture_days", sql="SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def capture_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day that metadata tells, of keys of differing rank."""
    stamp = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    k = F.col("o_orderkey") % 3
    meta = F.map_from_arrays(F.array(F.when(k == 0, "EXIF:DateTimeOriginal").when(k == 1, "QuickTime.CreateDate").otherwise("File:FileModifyDate"), F.lit("XMP:creation_time")), F.array(stamp, F.when(k == 2, F.lit("unknown")).otherwise(F.lit("1901-01-01T00:00:00"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.capture_date(meta).alias("day"))


@add(
    "text_links",
    sql="""
    WITH l AS (SELECT c_custkey, unnest([{'p': 1, 'kind': 'url', 'value': 'https://Site' || c_custkey || '.test/a_(b)'}, {'p': 2, 'kind': 'email', 'value': 'c' || c_custkey || '@mail.example'},
      {'p': 3, 'kind': 'url', 'value': 'docs.c' || c_custkey || '.com/guide'}, {'p': 4, 'kind': 'domain', 'value': 'c' || c_custkey || '.org'}]) AS e FROM customer)
    SELECT c_custkey, e.kind AS kind, e.value AS value FROM l
    """,
)
def text_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, mailboxes and hosts among file names, versions and repeats."""
    key = F.col("c_custkey").cast("string")
    said = F.concat(F.lit("See (https://Site"), key, F.lit(".test/a_(b)), or ask c"), key, F.lit("@mail.example. Read build.pl, main.rs, v1.2.3; docs.c"), key, F.lit(".com/guide! Home: c"), key, F.lit(".org/ and C"), key, F.lit(".ORG."))
    return table(spark, sf_dir, "customer").select("c_custkey", F.inline(entities.entities(said))).select("c_custkey", F.col("entity").alias("kind"), "value")


@add("hosts", sql="SELECT c_custkey, 'shop' || c_custkey || '.test' AS host, CASE WHEN c_custkey % 2 = 0 THEN '/a/b?x=1' ELSE '' END AS path FROM customer")
def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    address = F.concat(F.when(F.col("c_custkey") % 3 == 0, "HTTPS://WWW.").otherwise(""), F.lit("Shop"), key, F.lit(".TEST"), F.when(F.col("c_custkey") % 5 == 0, ":8080").otherwise(""), F.when(F.col("c_custkey") % 2 == 0, "/a/b?x=1").otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", entities.host_and_path(address).alias("h")).select("c_custkey", "h.host", "h.path")


_RULES = [("docs.example.com", "/sheets", "Sheets"), ("docs.example.com", "", "Docs"), ("example.com", "", "Example"), ("code.test", "/wiki", "Wiki")]


@add(
    "address_apps",
    sql="""
    SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Sheets' WHEN 1 THEN 'Docs' WHEN 2 THEN 'Example' WHEN 3 THEN 'Wiki' ELSE NULL END AS app FROM customer
    """,
)
def address_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The application of an address by the first rule that fits."""
    options = F.array(*map(F.lit, ("https://docs.example.com/sheets/1", "http://my.docs.example.com/x", "www.example.com", "code.test/wiki/a", "https://notexample.com/")))
    address = F.element_at(options, (F.col("c_custkey") % 5 + 1).cast("int"))
    place = entities.host_and_path(address)
    return table(spark, sf_dir, "customer").select("c_custkey", entities.app_of(place["host"], place["path"], _RULES).alias("app"))


_APPS, _TITLES = {"Visual Mill Code": "Mill", "Mill": "Old Mill", "Threadbird": "Threadbird"}, {"Sheet": "Sheets", "Mail": "Mail"}


@add(
    "screen_apps",
    sql="""
    SELECT p_partkey, unnest(CASE p_partkey % 4 WHEN 0 THEN ['Mill'] WHEN 1 THEN ['Threadbird', 'Sheets'] WHEN 2 THEN ['Old Mill'] ELSE [] END) AS app FROM part
    """,
)
def screen_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications named in lines of a screen, by whole words and by titles of windows."""
    lines = F.array(*map(F.lit, ("open Visual Mill Code now", "Threadbird: plan.ods - Sheet", "the Mill and a Windmill, Mill", "Write a Sheet or a Mail - today")))
    said = F.element_at(lines, (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(entities.apps(said, _APPS, _TITLES)).alias("a")).select("p_partkey", "a.app")


@add(
    "gps_forms",
    sql="""
    SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE round(10 + s_suppkey % 50 + 0.25, 6) END AS latitude, CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE round(-(20 + s_suppkey % 100 + 0.5), 6) END AS longitude,
      CASE WHEN s_suppkey % 4 = 0 THEN -12.0 WHEN s_suppkey % 4 = 2 THEN 30.0 ELSE NULL END AS altitude FROM supplier
    """,
)
def gps_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of metadata: degrees and minutes with hemispheres, a combined value, ISO 6709, and none at 0, 0."""
    lat, lon = (F.col("s_suppkey") % 50 + 10).cast("string"), (F.col("s_suppkey") % 100 + 20).cast("string")
    pair = F.create_map(F.lit("EXIF:GPSLatitude"), F.concat(lat, F.lit(" deg 15' 0.0\" N")), F.lit("EXIF:GPSLongitude"), F.concat(lon, F.lit(" deg 30' 0.0\"")), F.lit("EXIF:GPSLongitudeRef"), F.lit("West"), F.lit("EXIF:GPSAltitude"), F.lit("12 m Below Sea Level"))
    whole = F.create_map(F.lit("Composite:GPSPosition"), F.concat(lat, F.lit(".25, -"), lon, F.lit(".5")))
    iso = F.create_map(F.lit("com.location"), F.concat(F.lit("+"), lat, F.lit(".25-"), F.lpad(lon, 3, "0"), F.lit(".5+030/")))
    none = F.create_map(F.lit("EXIF:GPSLatitude"), F.lit("0"), F.lit("EXIF:GPSLongitude"), F.lit("0"))
    k = F.col("s_suppkey") % 4
    found = table(spark, sf_dir, "supplier").select("s_suppkey", entities.positions(F.when(k == 0, pair).when(k == 1, whole).when(k == 2, iso).otherwise(none)).alias("p"))
    return found.select("s_suppkey", F.round("p.latitude", 6).alias("latitude"), F.round("p.longitude", 6).alias("longitude"), "p.altitude")


@add(
    "subtitle_cues",
    sql=f"""
    SELECT entry_id, CAST(round(start_seconds * 1000) AS BIGINT) AS start_ms, CAST(round(end_seconds * 1000) AS BIGINT) AS end_ms, {_LINE.format('text')} AS text FROM entries
    WHERE kind = 'transcript' AND start_seconds >= 0 AND end_seconds >= start_seconds AND {_LINE.format('text')} <> ''
    """,
)
def subtitle_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken lines written as subtitles, with tags and a broken cue between them, and read back."""
    e = table(spark, sf_dir, "entries").where("kind = 'transcript' AND start_seconds >= 0 AND end_seconds >= start_seconds").withColumn("t", _line("text"))
    source = F.concat(F.lit("WEBVTT\n\n1\n"), T.stamp(F.col("start_seconds")), F.lit(" --> "), T.stamp(F.col("end_seconds")), F.lit("\n<i>"), F.col("t"), F.lit("</i>\n\n2\n00:09 --> later\nlost\n\n3\n00:00:05,000 --> 00:00:02,000\nbackwards\n"))
    read = markup.cue_rows(e.select("entry_id", source.alias("source")), "entry_id", "source")
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return read.select("entry_id", ms("start_seconds").alias("start_ms"), ms("end_seconds").alias("end_ms"), "text")


@add("html_pages", sql=f"SELECT item_id, '# Item ' || item_id || chr(10) || chr(10) || {_LINE.format('text')} || chr(10) || '- one & two' || chr(10) || '- three' || chr(10) AS text, 'Item ' || item_id AS title FROM eval_items")
def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items written as pages with a frame around the main part, and read back."""
    body = _line("text")
    page = F.concat(F.lit("<html><head><title>Item "), F.col("item_id").cast("string"), F.lit("</title><style>p {}</style></head><body><nav>Home</nav><main><p>"), body, F.lit("</p><script>var x;</script><ul><li>one &amp; two</li><li>three</li></ul></main><footer>end</footer></body></html>"))
    return table(spark, sf_dir, "eval_items").select("item_id", markup.readable(page).alias("r")).select("item_id", "r.text", "r.title")


@add(
    "chat_lines",
    sql=f"""
    SELECT email_id, strftime(sent_at, '%Y-%m-%d') AS day, strftime(sent_at, '%H:%M:%S') AS time, 'Sender ' || email_id % 7 AS sender, {_LINE.format("coalesce(subject, 'none')")} || chr(10) || 'more' AS text, ['photo ' || email_id || '.jpg'] AS attachments
    FROM emails WHERE sent_at IS NOT NULL
    """,
)
def chat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages written as an exported chat, with a line that continues and an attachment, and read back."""
    m = table(spark, sf_dir, "emails").where("sent_at IS NOT NULL")
    head = F.concat(F.lit("["), F.date_format("sent_at", "yyyy-MM-dd, HH:mm:ss"), F.lit("] Sender "), (F.col("email_id") % 7).cast("string"), F.lit(": "))
    export = F.concat(head, _line(F.coalesce("subject", F.lit("none"))), F.lit("\nmore\n<attached: photo "), F.col("email_id").cast("string"), F.lit(".jpg>"))
    read = messages.chat_rows(m.select("email_id", export.alias("export")), "email_id", "export", "whatsapp")
    return read.select("email_id", "day", "time", "sender", "text", "attachments")


@add(
    "chat_export_json",
    sql=f"""
    SELECT email_id, 'Chat ' || email_id AS title, strftime(sent_at, '%Y-%m-%d') AS day, strftime(sent_at, '%H:%M:%S') AS time, 'S' || email_id % 7 AS sender,
      CASE WHEN email_id % 2 = 0 THEN 'Forwarded from Ann' || chr(10) ELSE '' END || {_LINE.format("coalesce(subject, 'none')")} || ' (https://a.test)' AS text FROM emails WHERE sent_at IS NOT NULL
    """,
)
def chat_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages written as a JSON export, with links and forwards, and read back."""
    m = table(spark, sf_dir, "emails").where("sent_at IS NOT NULL")
    piece = F.array(F.struct(_line(F.coalesce("subject", F.lit("none"))).alias("text"), F.lit("https://a.test").alias("href")))
    message = F.struct(F.lit("message").alias("type"), F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), F.concat(F.lit("S"), (F.col("email_id") % 7).cast("string")).alias("from"), piece.alias("text"), F.when(F.col("email_id") % 2 == 0, "Ann").alias("forwarded_from"))
    export = F.to_json(F.struct(F.concat(F.lit("Chat "), F.col("email_id").cast("string")).alias("name"), F.array(message).alias("messages")))
    read = messages.chat_rows(m.select("email_id", export.alias("export")), "email_id", "export", "telegram")
    return read.select("email_id", "title", "day", "time", "sender", "text")


@add(
    "message_blocks",
    sql=f"SELECT email_id, strftime(sent_at, '%Y-%m-%d') AS day, strftime(sent_at, '%H:%M:%S') AS time, 'Sender ' || email_id % 7 AS sender, {_LINE.format('coalesce(subject, $$none$$)')} AS text, ['/tmp/pic' || email_id || '.heic'] AS attachments FROM emails WHERE sent_at IS NOT NULL",
)
def message_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages written as blocks of a date line, a sender and a body, and read back."""
    m = table(spark, sf_dir, "emails").where("sent_at IS NOT NULL")
    export = F.concat(F.date_format("sent_at", "MMM dd, yyyy  h:mm:ss a"), F.lit("\nSender "), (F.col("email_id") % 7).cast("string"), F.lit("\n"), _line(F.coalesce("subject", F.lit("none"))), F.lit("\n/tmp/pic"), F.col("email_id").cast("string"), F.lit(".heic\n"))
    read = messages.chat_rows(m.select("email_id", export.alias("export")), "email_id", "export", "imessage")
    return read.select("email_id", "day", "time", "sender", "text", "attachments")


@add(
    "mailboxes",
    sql="""
    SELECT o_custkey, position, 'Order ' || o_orderkey AS subject, 'Clerk <clerk' || o_custkey || '@desk.test>' AS sender, strftime(o_orderdate, '%Y-%m-%d') || 'T08:30:00Z' AS date, 'Priority: ' || o_orderpriority AS body FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders)
    """,
)
def mailboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer written as a mailbox file, and its messages read back."""
    o = table(spark, sf_dir, "orders")
    mail = lambda m: F.concat(
        F.lit("From clerk Mon Jan  1 00:00:00 2024\nFrom: Clerk <clerk"), F.col("o_custkey").cast("string"), F.lit("@desk.test>\nSubject: =?utf-8?q?Order_"), m["o_orderkey"].cast("string"), F.lit("?=\nDate: "),
        F.date_format(m["o_orderdate"], "dd MMM yyyy"), F.lit(" 10:30:00 +0200\nContent-Type: text/plain; charset=utf-8\n\nPriority: "), m["o_orderpriority"], F.lit("\n\n"),
    )
    own = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderdate", "o_orderpriority"))).alias("orders"))  # a customer's own orders; their mails are written where they are gathered
    box = own.select("o_custkey", F.array_join(F.transform("orders", mail), "").alias("box"))
    read = messages.email_rows(box, "o_custkey", F.col("box"), mbox=True)
    return read.select("o_custkey", F.col("position").cast("long").alias("position"), "subject", F.element_at("from_addrs", 1).alias("sender"), "date", F.trim(F.col("body"), F.lit("\n ")).alias("body"))


@add(
    "slack_lines",
    sql="SELECT event_id, strftime(to_timestamp(CAST(floor(epoch(ts)) AS BIGINT)), '%Y-%m-%d') AS day, CASE WHEN user_id % 2 = 0 THEN 'User ' || user_id ELSE 'U' || user_id END AS sender, CASE WHEN event_id % 2 = 0 THEN '(thread reply) ' ELSE '' END || 'hi @' || CASE WHEN user_id % 2 = 0 THEN 'User ' || user_id ELSE 'U' || user_id END || ' see docs (https://a.test) & <b>' AS text FROM events",
)
def slack_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of day files: names of users looked up, markup as plain text, replies marked."""
    e = table(spark, sf_dir, "events")
    users = e.select("user_id").distinct().where("user_id % 2 = 0").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user"), F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("name"))
    whole = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("string")
    key = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    rows = e.select("event_id", key.alias("user"), F.concat(F.lit("hi <@"), key, F.lit("> see <https://a.test|docs> &amp; &lt;b&gt;")).alias("text"), F.concat(whole, F.lit(".000100")).alias("ts"), F.when(F.col("event_id") % 2 == 0, F.lit("1.0")).alias("thread_ts"))
    return messages.slack_messages(rows, users).select("event_id", "day", "sender", "text")


@add(
    "json_record_units",
    sql="""
    SELECT o_custkey, unit_no, 'Record ' || unit_no || ' (orders[' || (unit_no - 1) || '])' || chr(10) || 'key: ' || o_orderkey || chr(10) || 'status.code: ' || o_orderstatus || chr(10) || 'status.tags: [a, b]' AS text, '/orders/' || (unit_no - 1) AS pointer
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS unit_no, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 20
    """,
)
def json_record_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as one JSON document, read as a unit for each record; documents whose outline is short stay whole and are left out."""
    o = table(spark, sf_dir, "orders")
    record = F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_orderstatus").alias("code"), F.array(F.lit("a"), F.lit("b")).alias("tags")).alias("status"))
    docs = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(record)).alias("orders")).where(F.size("orders") > 20)  # a customer's own orders
    own = docs.select("o_custkey", F.to_json(F.struct(F.lit("x").alias("about"), "orders")).alias("doc"))
    read = structured.json_units(own, "o_custkey", "doc", F.lit(False)).where("unit_no > 1")
    return read.select("o_custkey", (F.col("unit_no") - 1).cast("long").alias("unit_no"), "text", "pointer")


@add("json_byte_spans", sql="SELECT event_id, CAST(octet_length(encode('{\"id\": ' || event_id || ', \"é\": ')) AS BIGINT) AS byte_start, CAST(octet_length(encode('{\"id\": ' || event_id || ', \"é\": ' || props)) AS BIGINT) AS byte_end FROM events WHERE props IS NOT NULL")
def json_byte_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of a member of each JSON text."""
    doc = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "é": '), F.col("props"), F.lit(', "end": [1, "]"] }'))
    e = table(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", F.explode(structured.member_spans(doc)).alias("m"))
    return e.where("m.name = 'é'").select("event_id", "m.byte_start", "m.byte_end")


@add("json_sniffed", sql="SELECT event_id, event_id % 4 <> 1 AS json FROM events WHERE props IS NOT NULL")
def json_sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text begins as JSON, also where it is cut off."""
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("note: "), F.col("props"))).when(k == 2, F.concat(F.lit("﻿  "), F.expr("left(props, 5)"))).otherwise(F.concat(F.lit("["), F.col("props"), F.lit(",")))
    return table(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", structured.looks_like_json(text).alias("json"))


@add("flattened_metadata", sql="SELECT p_partkey, unnest([{'key': 'format.size', 'value': CAST(p_size AS VARCHAR)}, {'key': 'streams[0].codec', 'value': p_type}, {'key': 'streams[1].tags.name', 'value': p_name}]) AS e FROM part".replace("SELECT p_partkey, unnest", "SELECT p_partkey, e.key AS key, e.value AS value FROM (SELECT p_partkey, unnest") + ")")
def flattened_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of nested metadata as dotted keys."""
    doc = F.to_json(F.struct(F.struct(F.col("p_size").alias("size")).alias("format"), F.array(F.struct(F.col("p_type").alias("codec"), F.lit(None).cast("struct<name:string>").alias("tags")), F.struct(F.lit(None).cast("string").alias("codec"), F.struct(F.col("p_name").alias("name")).alias("tags"))).alias("streams")))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(structured.flattened(doc)).alias("key", "value"))


@add(
    "page_word_boxes",
    sql="SELECT entry_id, 2 AS page, 'w' || entry_id AS text, round(x, 6) AS x, round(y, 6) AS y, round(width, 6) AS width FROM entries WHERE kind = 'face' AND x IS NOT NULL AND y IS NOT NULL AND width IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(width) AND x >= 0 AND y >= 0 AND width > 0 AND NOT isinf(x) AND NOT isinf(y) AND NOT isinf(width)",
)
def page_word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes written as words of a page of 500 by 800 points, and read back as parts of it."""
    fine = "kind = 'face' AND x >= 0 AND y >= 0 AND width > 0 AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(width) AND abs(x) < 1e9 AND abs(y) < 1e9 AND abs(width) < 1e9"
    number = lambda c: F.format_string("%.9f", c)
    page = F.concat(F.lit('<page width="10" height="10"></page><page width="500.0" height="800.0"><word xMin="'), number(F.col("x") * 500), F.lit('" yMin="'), number(F.col("y") * 800), F.lit('" xMax="'), number((F.col("x") + F.col("width")) * 500), F.lit('" yMax="'), number(F.col("y") * 800 + 9), F.lit('">w'), F.col("entry_id").cast("string"), F.lit("</word></page>"))
    read = table(spark, sf_dir, "entries").where(fine).select("entry_id", F.inline(markup.page_words(page)))
    return read.select("entry_id", "page", "text", *(F.round(c, 6).alias(c) for c in ("x", "y", "width")))


@add("bookmark_links", sql="SELECT n_nationkey, 'https://n' || n_nationkey || '.test/' AS url, n_name || ' & co' AS title, ['Travel', 'Region ' || n_regionkey] AS folders FROM nation")
def bookmark_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a bookmark file with folders, repeats and other schemes."""
    key = F.col("n_nationkey").cast("string")
    link = F.concat(F.lit('<DT><A HREF="https://n'), key, F.lit('.test/">'), F.col("n_name"), F.lit(" &amp; co</A>"))
    source = F.concat(F.lit("<DL><DT><H3>Travel</H3><DL><DT><H3>Region "), F.col("n_regionkey").cast("string"), F.lit("</H3><DL>"), link, F.lit('<DT><A HREF="ftp://x/">x</A></DL></DL>'), link, F.lit("</DL>"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.inline(markup.bookmarks(source)))


@add("link_lines", sql="SELECT n_nationkey, 'https://n' || n_nationkey || '.test/a' AS url FROM nation UNION ALL SELECT n_nationkey, 'http://b.test/' || n_nationkey FROM nation")
def link_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a plain list, each once; comments and other schemes are none."""
    key = F.col("n_nationkey").cast("string")
    source = F.concat(F.lit("# mine\nhttps://n"), key, F.lit(".test/a\n\n  http://b.test/"), key, F.lit("  \nftp://c.test\nhttps://n"), key, F.lit(".test/a\nno link"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(markup.link_list(source)).alias("url"))


@add("sniffed_types", sql="SELECT event_id, [NULL, 'application/pdf', 'image/png', 'application/zip', 'audio/wav'][event_id % 5 + 1] AS mime, event_id % 5 IN (0, 1) AS is_text FROM events")
def sniffed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types told by first bytes, and whether they are text."""
    heads = F.array(*(F.unhex(F.lit(h)) for h in ("68656C6C6F20776F726C64210A", "255044462D312E370A68690A", "89504E470D0A1A0A0000000000000000", "504B03040000000000000000", "524946460000000057415645")))
    head = F.element_at(heads, (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", files.content_type(head).alias("mime"), files.sniffed_as_text(head).alias("is_text"))


@add("decoded_queries", sql="SELECT c_custkey, c_name AS name, 'a b&c' AS note, 'é' AS mark FROM customer")
def decoded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of addresses, decoded; the first of a name counts."""
    query = F.concat(F.lit("name="), F.url_encode("c_name"), F.lit("&note=a+b%26c&mark=%C3%A9&name=other&=x"))
    p = T.query_parameters(query)
    return table(spark, sf_dir, "customer").select("c_custkey", p["name"].alias("name"), p["note"].alias("note"), p["mark"].alias("mark"))


@add("wrapped_lines", sql="SELECT item_id, string_agg(w, ' ' ORDER BY i) AS text, true AS fits FROM (SELECT item_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM eval_items)) GROUP BY item_id")
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts wrapped at forty characters: no line is longer, and no word is lost."""
    lines = table(spark, sf_dir, "eval_items").select("item_id", T.wrapped(F.col("text"), 40).alias("l"))
    return lines.select("item_id", F.array_join(F.filter("l", lambda x: x != ""), " ").alias("text"), F.forall("l", lambda x: F.length(x) <= 40).alias("fits"))


@add("public_addresses", sql="SELECT user_id, [false, false, false, true, false][user_id % 5 + 1] AS public, user_id % 5 IN (0, 3) AS listed FROM (SELECT DISTINCT user_id FROM events)")
def public_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that may be fetched, and those in listed networks."""
    address = F.element_at(F.array(*map(F.lit, ("10.1.2.3", "127.0.0.1", "::1", "8.8.4.4", "169.254.1.1"))), (F.col("user_id") % 5 + 1).cast("int"))
    public = F.pandas_udf(lambda s: s.map(entities.is_public), "boolean")
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", public(address).alias("public"), entities.allowed(address, ["10.0.0.0/8", "8.8.0.0/16"]).alias("listed"))


@add("trusted_senders", sql="SELECT c_custkey, c_custkey % 4 = 0 AS trusted FROM customer")
def trusted_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senders on a list whose first result by our own server passed."""
    k = F.col("c_custkey") % 4
    sender = F.when(k == 3, F.lit("Eve <eve@other.test>")).otherwise(F.concat(F.lit("C <c"), F.col("c_custkey").cast("string"), F.lit("@Desk.test>")))
    results = F.when(k == 1, F.array(F.lit("our.test; dmarc=fail"), F.lit("our.test; dmarc=pass"))).when(k == 2, F.array(F.lit("their.test; dmarc=pass"))).otherwise(F.array(F.lit("their.test; dmarc=fail"), F.lit("our.test; spf=pass; dmarc=pass")))
    return table(spark, sf_dir, "customer").select("c_custkey", entities.sender_allowed(sender, results, [], ["desk.test"], "our.test").alias("trusted"))


@add(
    "sound_spans",
    sql="""
    WITH w AS (SELECT DISTINCT user_id, CASE event_type WHEN 'error' THEN 'silence' ELSE 'speech' END AS label, CAST(floor(epoch(ts) / 60) AS BIGINT) AS i FROM events),
    f AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY user_id, label ORDER BY i) <= 2 THEN 0 ELSE 1 END AS fresh FROM w),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, label ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM f)
    SELECT user_id, label, min(i) AS start_seconds, max(i) + 1 AS end_seconds FROM g GROUP BY user_id, label, island HAVING max(i) + 1 - min(i) >= CASE label WHEN 'silence' THEN 3 ELSE 2 END
    """,
)
def sound_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes with events as sound windows of a second, and their spans."""
    e = table(spark, sf_dir, "events")
    i = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).cast("long")
    w = e.select("user_id", F.when(F.col("event_type") == "error", "silence").otherwise("speech").alias("label"), i.alias("i")).distinct()
    w = w.select("*", F.lit(1.0).alias("confidence"), F.col("i").alias("start"), (F.col("i") + 1).alias("end"))
    return signals.sound_events(w, ["user_id"]).select("user_id", "label", "start_seconds", "end_seconds")


@add("window_labels", sql="SELECT event_id, CASE WHEN value <= 0 OR 20 * log10(value / 1000) < -50 THEN 'silence' WHEN event_id % 10 > 3 AND event_id % 7 > 1 THEN 'speech' WHEN event_id % 7 > 1 THEN 'noise' ELSE 'music' END AS label FROM events WHERE value IS NOT NULL")
def window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound windows by their loudness, quiet parts and crossings."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    loud = signals.decibels(F.col("value") / 1000)
    return e.select("event_id", signals.window_class(loud, F.col("event_id") % 10 / 10.0 - 0.05, F.col("event_id") % 7 / 10.0 - 0.04).alias("label"))


@add(
    "picture_colours",
    sql="SELECT doc, colour, rank FROM (SELECT document_id AS doc, CASE WHEN entry_id % 3 = 0 THEN 'red' WHEN entry_id % 3 = 1 THEN 'blue' ELSE 'white' END AS colour, row_number() OVER (PARTITION BY document_id ORDER BY count(*) DESC, CASE WHEN entry_id % 3 = 0 THEN 'red' WHEN entry_id % 3 = 1 THEN 'blue' ELSE 'white' END) AS rank, count(*) AS n, sum(count(*)) OVER (PARTITION BY document_id) AS total FROM entries WHERE document_id IS NOT NULL GROUP BY 1, 2) WHERE n >= 0.05 * total",
)
def picture_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as pixels of a picture per document: its colours by share."""
    k = F.col("entry_id") % 3
    shade = (F.col("entry_id") % 20).cast("int")
    pixels = table(spark, sf_dir, "entries").where("document_id IS NOT NULL").select(F.col("document_id").alias("doc"), F.when(k == 1, shade).otherwise(255 - shade).alias("r"), F.when(k == 2, 255 - shade).otherwise(shade).alias("g"), F.when(k == 0, shade).otherwise(255 - shade).alias("b"))
    found = signals.dominant_colours(pixels, "doc", {"red": (255, 0, 0), "blue": (0, 0, 255), "white": (255, 255, 255)})
    return found.select("doc", "colour", "rank")


@add("picture_prints", sql="SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 0 END AS print, CASE WHEN p_partkey % 2 = 0 THEN 64 ELSE 0 END AS bits FROM part")
def picture_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of rising and falling grey values."""
    step = F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(-1)
    luma = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda y: F.transform(F.sequence(F.lit(1), F.lit(9)), lambda x: (F.lit(100) + step * x).cast("int")))
    prints = table(spark, sf_dir, "part").select("p_partkey", signals.difference_hash(luma).alias("print"))
    return prints.withColumn("bits", F.bit_count("print").cast("int"))


@add(
    "largest_faces",
    sql="SELECT source_path, sighting_id FROM (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY w * h DESC, sighting_id) AS r FROM sightings WHERE source_path IS NOT NULL AND w * h IS NOT NULL) WHERE r = 1",
)
def largest_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.operators.people import largest_face

    return largest_face(table(spark, sf_dir, "sightings").where("source_path IS NOT NULL AND w * h IS NOT NULL"), "source_path").select("source_path", "sighting_id")


@add(
    "unique_file_names",
    sql=r"""
    SELECT email_id, CASE WHEN n = 1 THEN name ELSE regexp_extract(name, '^(.*?)(\.[^.]*)?$', 1) || '-' || n || regexp_extract(name, '^(.*?)(\.[^.]*)?$', 2) END AS published_name FROM (
      SELECT email_id, attachment_names[1] AS name, row_number() OVER (PARTITION BY lower(attachment_names[1]) ORDER BY email_id) AS n FROM emails WHERE len(attachment_names) > 0 AND attachment_names[1] IS NOT NULL)
    """,
)
def unique_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.operators.publish import unique_names

    named = table(spark, sf_dir, "emails").where(F.size("attachment_names") > 0).select("email_id", F.element_at("attachment_names", 1).alias("name")).where("name IS NOT NULL")
    return unique_names(named, "name", "email_id").select("email_id", "published_name")


@add("event_numbers", sql="SELECT user_id AS run, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events")
def event_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.streaming.intake import event_log

    return event_log(table(spark, sf_dir, "events").withColumnRenamed("user_id", "run"), ["ts", "event_id"]).select("run", "event_id", "seq")


_SCANS = "SELECT CASE WHEN user_id % 9 = 0 THEN '/in/.' ELSE '/in/' END || user_id || CASE WHEN user_id % 7 = 0 THEN '.part' ELSE '.pdf' END AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS scan_no, CAST(floor(value) AS BIGINT) % 3 AS size, event_id // 1000 AS mtime, user_id FROM events"


@add(
    "settled_files",
    sql=f"WITH s AS ({_SCANS}), w AS (SELECT *, lag(size) OVER (PARTITION BY path ORDER BY scan_no) = size AND lag(mtime) OVER (PARTITION BY path ORDER BY scan_no) = mtime AS same FROM s WHERE user_id % 9 <> 0 AND user_id % 7 <> 0) SELECT path, min(scan_no) AS claimed_at FROM w WHERE same GROUP BY path",
)
def settled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scans of an inbox: each file is claimed once two scans agree."""
    from paperloom.streaming.intake import settled

    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    path = F.concat(F.when(F.col("user_id") % 9 == 0, "/in/.").otherwise("/in/"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 7 == 0, ".part").otherwise(".pdf"))
    return settled(e.select(path.alias("path"), n.alias("scan_no"), (F.floor("value").cast("long") % 3).alias("size"), F.floor(F.col("event_id") / 1000).cast("long").alias("mtime")))


@add(
    "leased_jobs",
    sql="""
    WITH l AS (SELECT user_id AS job, min(event_id) AS created, arg_max(event_type, event_id) AS t, max(event_id) AS tm FROM events GROUP BY 1)
    SELECT job, created, CASE WHEN t = 'click' AND tm + 30 + 60 < (SELECT max(event_id) FROM events) THEN 'pending' WHEN t = 'click' THEN 'running' ELSE 'done' END AS state FROM l
    """,
)
def leased_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by their last event; a running one whose lease is over is pending again."""
    from paperloom.streaming.intake import job_table

    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("event_id")).first()[0] or 0
    log = e.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "running").otherwise("done").alias("state"), F.col("event_id").cast("double").alias("at"), F.lit(30.0).alias("lease_seconds"))
    return job_table(log, float(now)).select("job", "created", "state")


@add(
    "delivery_states",
    sql="""
    WITH a AS (SELECT user_id AS msg_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, CASE WHEN event_type = 'purchase' THEN 200 WHEN event_id % 97 = 0 THEN 410 ELSE 503 END AS status, CAST(event_id AS DOUBLE) AS tm, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    l AS (SELECT msg_id, arg_max(status, attempt) AS status, arg_max(tm, attempt) AS tm, count(*) AS tries FROM a WHERE attempt <= 1 + msg_id % 9 GROUP BY 1)
    SELECT msg_id, CASE WHEN status BETWEEN 200 AND 299 THEN 'done' WHEN status = 410 OR tries > 7 THEN 'failed' ELSE 'waiting' END AS state,
      CASE WHEN status NOT BETWEEN 200 AND 299 AND status <> 410 AND tries <= 7 THEN tm + [5, 300, 1800, 7200, 18000, 36000, 36000][tries] END AS next_at FROM l
    """,
)
def delivery_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tries of deliveries and when the next one is due."""
    from paperloom.streaming.intake import deliveries

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    status = F.when(F.col("event_type") == "purchase", 200).when(F.col("event_id") % 97 == 0, 410).otherwise(503)
    tries = table(spark, sf_dir, "events").select(F.col("user_id").alias("msg_id"), n.alias("attempt"), status.alias("status"), F.col("event_id").cast("double").alias("at")).where(F.col("attempt") <= 1 + F.col("msg_id") % 9)
    return deliveries(tries)


_VALENCES = {"good": 1.9, "great": 3.1, "terrible": -2.1, "horrible": -2.5}


@add("tone_labels", sql="SELECT event_id, CAST([0.4404, -0.3818, 0.431, 0.0][event_id % 4 + 1] AS DOUBLE) AS score, ['positive', 'negative', 'positive', 'neutral'][event_id % 4 + 1] AS label FROM events")
def tone_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tone of sentences by a small lexicon, and its label."""
    said = F.element_at(F.array(*map(F.lit, ("The film was good.", "The trip was great but the hotel was terrible", "At least it isn't a horrible film.", "The box is on the shelf."))), (F.col("event_id") % 4 + 1).cast("int"))
    scored = table(spark, sf_dir, "events").select("event_id", signals.tone_scores(said, _VALENCES).alias("s"))
    return scored.select("event_id", F.round("s", 4).alias("score"), signals.tone_label(F.col("s")).alias("label"))
