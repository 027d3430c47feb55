from datetime import date

import pytest
from pyspark.sql import functions as F

from paperloom.functions import checks, dates, entities, signals, text, vectors
from paperloom.functions.identity import derived_uuid
from paperloom.operators import ocr, people, publish, runs
from paperloom.operators.search import parse_query, Term

REF = date(2024, 3, 6)


@pytest.mark.parametrize(
    "said,want",
    [
        ("on 2024-03-05T17:00", [("datetime", "2024-03-05T17:00:00")]),
        ("5 June 2023 at 5 pm", [("datetime", "2023-06-05T17:00:00")]),
        ("June 5", [("date", "2024-06-05")]),
        ("13/02/2024 and 02/13/24", [("date", "2024-02-13"), ("date", "2024-02-13")]),
        ("yesterday, last Friday, next Wednesday, Thursday", [("date", "2024-03-05"), ("date", "2024-03-01"), ("date", "2024-03-13"), ("date", "2024-03-07")]),
        ("in 2 weeks or 3 days ago", [("date", "2024-03-20"), ("date", "2024-03-03")]),
        ("31/02/2024, 99/99/2024, v1.2.3, 300 x 300", []),
    ],
)
def test_dates(said, want):
    assert [(k, iso) for _, _, k, iso, _ in dates.find_dates(said, REF)] == want


def test_dates_without_reference():
    assert [(x[3], x[4]) for x in dates.find_dates("June 5 or today")] == [("--06-05", True), (None, True)]


def test_entities():
    assert entities.text_entities("See (https://A.test/x_(y)), mail me@b.test. or docs.example.com/guide and v1.2.3 file.txt") == [("url", "https://A.test/x_(y)"), ("email", "me@b.test"), ("url", "docs.example.com/guide")]
    assert entities.href("WWW.Example.com/Path") == "https://www.example.com/Path"
    assert [entities.is_public(a) for a in ("8.8.8.8", "10.0.0.1", "127.0.0.1", "::1", "::ffff:10.0.0.1", "x")] == [True, False, False, False, False, False]
    assert entities.place_mentions("From NEW YORK to Port Tavish via York", {"New York": "ny", "Port Tavish": "pt", "York": "yo"}) == [("ny", "NEW YORK"), ("pt", "Port Tavish"), ("yo", "York")]


def test_queries_are_parsed():
    assert parse_query('say "Red Car" now') == [Term(("say",)), Term(("red", "car")), Term(("now",))]
    assert parse_query("invo* a-b ...") == [Term(("invo",), True), Term(("a", "b"))] and parse_query("?!") == []


def test_tone_and_signature():
    lex = {"good": 1.9, "bad": -2.5}
    assert signals.tone_score("good", lex) > 0 > signals.tone_score("not good", lex)
    assert signals.tone_score("very good", lex) > signals.tone_score("good", lex) > signals.tone_score("slightly good", lex)
    assert signals.tone_score("good but bad", lex) < 0 and signals.tone_score("words", lex) == 0
    assert signals.webhook_signature("whsec_MfKQ9r8GKYqrTwjUPD8ILPZIo2LaLaSw", "msg_p5jXN8AQM9LWM0D4loKWxJek", 1614265330, '{"test": 2432232314}') == "v1,g0hM9SsE+OTPJTGt/tmIKtSyZlE3uFJELVlNIOLJ1OE="


#: Compound scores of the public implementation of the method, for the public valences below.
VALENCES = {"smart": 1.7, "handsome": 2.2, "funny": 1.9, "good": 1.9, "horrible": -2.5, "sux": -1.5, "lol": 1.8, ":)": 2.0, ":d": 2.3, "sure": 1.3, "bad": -2.5, "happy": 2.7, "problems": -1.7, "no": -1.2, "worst": -3.1, "great": 3.1, "terrible": -2.1, "best": 3.2, "okay": 0.9}


@pytest.mark.parametrize(
    "said,want",
    [
        ("She is smart, handsome, and funny.", 0.8316),
        ("She is very smart, handsome, and funny.", 0.8545),
        ("She is VERY SMART, handsome, and FUNNY!!!", 0.9342),
        ("She is VERY SMART, uber handsome, and FRIGGIN FUNNY!!!", 0.9469),
        ("She is not smart, handsome, nor funny.", -0.7424),
        ("At least it isn't a horrible film.", 0.431),
        ("The film was only kind of good.", 0.3832),
        ("Monday SUX!", -0.5461),
        ("Monday only kinda sux! But I'll get by, lol", 0.5249),
        ("Make sure you :) or :D tomorrow!", 0.8633),
        ("Not bad at all", 0.431),
        ("There were no problems with the parcel", 0.3089),
        ("This is the worst coffee I have ever had.", -0.6249),
        ("The trip was great but the hotel was terrible", -0.3818),
        ("", 0.0),
    ],
)
def test_tone_scores(said, want):
    assert round(signals.tone_score(said, VALENCES), 4) == want


def test_people():
    gallery = {1: [[1.0, 0.0, 0.0]]}
    faces = [("u1", [2.0, 0.1, 0.0]), ("u1", [0.0, 1.0, 0.0]), ("u2", [0.9, 0.0, 0.1]), ("u2", [0.0, 1.0, 0.1]), ("u2", [0.0, 0.0, 1.0])]
    rows, gallery, last = people.recognise(faces, gallery, {1: "Alice"}, 1)
    assert [(r[1], r[3]) for r in rows] == [(1, False), (2, True), (1, False), (2, False), (3, True)] and last == 3


def test_columns(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.6), F.lit(0.8)))) == pytest.approx(0.6)
    assert value(vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)), -1.0)) == -1.0
    assert value(vectors.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(20015.1, abs=1)
    assert value(vectors.iou([F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0)], [F.lit(1.0), F.lit(0.0), F.lit(2.0), F.lit(2.0)])) == pytest.approx(1 / 3)
    assert value(vectors.hamming(F.lit(5).cast("long"), F.lit(6).cast("long"))) == 2
    assert value(derived_uuid("d", F.lit("a"), F.lit(0)))[14] == "8" and value(derived_uuid("d", F.lit("a"), F.lit(0)))[19] in "89ab"
    assert value(text.safe_file_name(F.lit("../../a b?.txt"))) == "a b_.txt" and value(text.slug(F.lit("  Hello, World! "))) == "hello-world"
    assert value(text.clock(F.lit(3725.9))) == "1:02:05" and value(text.stamp(F.lit(1.0005))) == "00:00:01.001"
    assert value(entities.gps_point(F.lit("Dunmere (61.4740, -6.9088)"))).longitude == -6.9088
    assert value(entities.app_of(F.lit("docs.x.test"), F.lit("/sheet/1"), [("x.test", "/sheet", "Sheets"), ("x.test", "", "X")])) == "Sheets"
    assert value(signals.redacted(F.lit("open /home/a/b.txt"), ["/home", "/home/a"])) == "open <dir>/b.txt"
    assert value(signals.difference_hash(F.array(*[F.array(*[F.lit(i) for i in range(9)])] * 8))) == -1
    assert value(people.good_name(F.lit("person-3"))) is False and value(people.good_name(F.lit("Ann"))) is True
    kept = value(publish.share_metadata(F.create_map(F.lit("exif:GPSLatitude"), F.lit("1"), F.lit("exif:ImageWidth"), F.lit("2"), F.lit("source.path"), F.lit("/a"))))
    assert kept == {"exif:ImageWidth": "2"}


def test_runs(spark):
    w = [(k, "k", i, lab, c, float(i), i + 1.0) for k in ("a",) for i, lab, c in [(0, "speech", 0.5), (1, "speech", 0.6), (3, "speech", 0.4), (7, "speech", 0.9), (4, "laughter", 0.7), (6, "laughter", 0.6)]]
    df = spark.createDataFrame(w, "s string, k string, i int, label string, confidence double, start double, end double")
    got = {(r.label, r.start_seconds, r.end_seconds, r.confidence) for r in signals.sound_events(df, ["s"]).collect()}
    assert got == {("speech", 0.0, 4.0, 0.6), ("laughter", 4.0, 7.0, 0.7)}
    boxes = spark.createDataFrame([("u", 1, 0.9, 0.0, 0.0, 1.0, 1.0), ("u", 2, 0.8, 0.1, 0.0, 1.0, 1.0), ("u", 3, 0.7, 3.0, 0.0, 1.0, 1.0)], "u string, id int, score double, x double, y double, width double, height double")
    assert sorted(r.id for r in runs.greedy_boxes(boxes, ["u"], "id", "score", ["x", "y", "width", "height"]).collect()) == [1, 3]
    prints = spark.createDataFrame([("v", 1, 0), ("v", 2, 1), ("v", 3, 255), ("v", 4, 254)], "v string, n int, p long")
    assert sorted(r.n for r in runs.drop_near_copies(prints, ["v"], "n", "p", 2).collect()) == [1, 3]
    flow = spark.createDataFrame([("d", 1, 30), ("d", 2, 30), ("d", 3, 100), ("d", 4, 5)], "d string, n int, rows int")
    assert [(r.page_first, r.page_last) for r in runs.flow_pages(flow, "d", "n", "rows").orderBy("n").collect()] == [(1, 1), (2, 2), (2, 4), (4, 4)]
    words = spark.createDataFrame([("p", 1, "TOTAL", 0.1, 0.1, 0.1, 0.02, 0.9), ("p", 2, "GBP", 0.22, 0.1, 0.05, 0.02, 0.8), ("p", 3, "Other", 0.8, 0.1, 0.1, 0.02, 0.7), ("p", 4, "Below", 0.1, 0.2, 0.1, 0.02, 0.6)], "p string, n int, text string, x double, y double, width double, height double, confidence double")
    assert sorted(r.text for r in ocr.lines(words, "p").collect()) == ["Below", "Other", "TOTAL GBP"]
    assert ocr.joined_text(words, "p", "n").first().text == "TOTAL GBP Other\nBelow"
    pixels = spark.createDataFrame([("i", 250, 5, 5)] * 9 + [("i", 5, 5, 250)], "i string, r int, g int, b int")
    assert [(r.colour, round(r.share, 1)) for r in signals.dominant_colours(pixels, "i", {"red": (255, 0, 0), "blue": (0, 0, 255), "white": (255, 255, 255)}).orderBy("rank").collect()] == [("red", 0.9), ("blue", 0.1)]
    names = spark.createDataFrame([(1, "a.pdf"), (2, "A.pdf"), (3, "b")], "n int, name string")
    assert [r.published_name for r in publish.unique_names(names, "name", "n").orderBy("n").collect()] == ["a.pdf", "A-2.pdf", "b"]


def test_checks(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 2}, "b": {"type": "array", "items": {"enum": ["x"]}}}, "additionalProperties": False}
    assert checks.problems({"a": 3, "b": ["x"]}, schema) == []
    assert checks.problems({"a": 1, "b": ["y"], "c": 0}, schema) == [("a", "is too small"), ("b[0]", "is none of the values"), ("", "c isn't allowed")]
    assert checks.problems(1, {"oneOf": []}) == [("", "unknown keyword oneOf")]
    df = spark.createDataFrame([("[1]",), ("{",), (None,)], "t string").select(checks.json_problems(F.col("t"), schema).alias("p"))
    assert [None if r.p is None else r.p[0].message for r in df.collect()] == ["is not object", "is not JSON", None]
    merged = spark.range(1).select(checks.layered(("file", F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))), ("flag", F.create_map(F.lit("b"), F.lit("3")))).alias("m")).first().m
    assert {k: (v.value, v.origin) for k, v in merged.items()} == {"a": ("1", "file"), "b": ("3", "flag")}


def test_parsed_documents():
    from paperloom.sources.structured import rmeta_units

    units = rmeta_units('[{"X-TIKA:content":"A \\n\\n\\n\\nB","dc:title":"T"},{"X-TIKA:content":" "},{"X-TIKA:content":"C","n":["1","2"]}]')
    assert units == [(1, "A\n\nB", {"dc:title": "T"}), (3, "C", {"n": "1, 2"})]


def test_full_text(spark, tmp_path):
    from paperloom.operators.index import ask, build_index, full_text, search
    from paperloom.operators.search import question_terms

    df = spark.createDataFrame([(1, "Résumé of the map cabinet"), (2, "map of a cabinet map cabinet"), (3, None), (4, ""), (5, "other words")], "id int, text string")
    index = build_index(df, "id", text.index_tokens(F.col("text")), str(tmp_path / "a"))
    found = lambda q: [r.id for r in full_text(index, q).orderBy("score", "id").collect()]
    assert sorted(found('"map cabinet"')) == [1, 2] and found('"cabinet map"') == [2] and found("RESUME cab*") == [1]
    assert found("?!") == [] and found("absent") == [] and index.table("totals").first()["n"] == 4
    empty = build_index(df.limit(0), "id", text.index_tokens(F.col("text")), str(tmp_path / "b"))
    assert full_text(empty, "map").count() == 0
    asked = build_index(df.where("trim(text) <> ''"), "id", text.question_tokens(F.col("text")), str(tmp_path / "c"))
    assert {r.id for r in ask(asked, df, "id", "text", question_terms("Where is the cabinet?")).collect()} == {1, 2}
    assert ask(asked, df, "id", "text", question_terms("who is it")).count() == 0
    for bad in ({}, {"text": "map", "limit": 0}):
        with pytest.raises(ValueError):
            search(index, df, df, **bad)


def test_matches_in_blocks(spark, monkeypatch):
    from paperloom.operators import blocks

    rows = [(i, "g", [float(i % 7), 1.0], i % 4) for i in range(60)] + [(100, "g", [0.0, 0.0], 1), (101, "g", [1.0], 1), (102, "h", [1.0, 1.0], 1), (103, "g", None, 1)]
    df = spark.createDataFrame(rows, "id long, grp string, vector array<float>, owner long")
    read = lambda k: sorted((r.asked_id, r.place, r.found_id, r.owner) for r in blocks.top_matches(df.where("id % 20 = 0"), df, k).collect())
    whole = read(2)
    assert [x for x in whole if x[0] == 0] == [(0, 1, 7, 3), (0, 2, 14, 2)]
    plain = sorted((r.asked_id, r.place, r.found_id) for r in blocks.top_matches(df.where("id = 0"), df.drop("owner"), 3).collect())
    assert plain == [(0, 1, 7), (0, 2, 14), (0, 3, 21)]
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 2)
    assert read(2) == whole and blocks.all_matches(df.where("id = 0"), df, 0.999999).count() == 8


def test_spans_of_any_length(spark):
    points = spark.createDataFrame([(1, 5.0), (1, 5000.0), (1, 1e9), (1, float("nan")), (2, 5.0)], "k int, at double")
    spans = spark.createDataFrame([(1, 0.0, 1e10, "a"), (1, 5.0, 5.0, "b"), (1, 4999.0, 5000.0, "c"), (1, 0.0, float("inf"), "d"), (1, 0.0, float("nan"), "e"), (1, 9.0, 1.0, "f")], "k int, s double, e double, n string")
    got = sorted((r.at, r.n) for r in runs.near(points, spans, "k", "at", "s", "e", 0.0).collect())
    assert got == [(5.0, "a"), (5.0, "b"), (5000.0, "a"), (5000.0, "c"), (1e9, "a")]
    assert [(r.at, r.n) for r in runs.near(points, spans, "k", "at", "s", "e", 0.0, open_end=True).collect() if r.n != "a"] == []
