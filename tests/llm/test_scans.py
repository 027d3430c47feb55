from paperloom.llm import scans
from paperloom.llm.scans import page_number, read_page, repaired, skeleton


def test_numbers_and_skeletons():
    assert [page_number(x) for x in ("- 12 -", "[l5]", "Seite 7", "p. 10", "Page 3 of 80", "vii", "36 |", "Talbrook", "B0X-10", "")] == [12, 15, 7, 10, 3, 7, 36, None, None, None]
    assert skeleton("28   Unsigned Notebook - Section 9") == skeleton("Unsigned Note6ook - Section 9") == skeleton("Unsigncd Notebook - Section 9")
    assert skeleton("exarnined slieet") == skeleton("examined sheet")


def test_read_page():
    text = "Narrow Transcript - Section 1\n\nThe corrccted ship-\nment of the up-\nto-date kind, H0-3410.\n\n845\n\nMore.\n[12]"
    noise, clean = read_page(text, 12, {skeleton("Narrow Transcript - Section 1")}, None, {"corrccted": "corrected"}, {"up-to-date"})
    assert sorted(noise) == [("header", 1, ""), ("hyphenation", 3, "shipment"), ("hyphenation", 4, "up-to-date"), ("misread", 3, "corrected"), ("page_number", 10, "")]
    assert clean == "The corrected shipment of the up-to-date kind, H0-3410.\n\n845\n\nMore."


def test_table(spark):
    body = "The shipment was measured again by the clerk\nand the shipment was measured once more in it.\n"
    rows = [(i, "s1", i, f"KESTREL MANUAL\nBox {chr(97 + i % 26) * 3 + chr(97 + i // 26) * 3}. {body}{i}", "x") for i in range(1, 41)]
    rows += [(120, "s1", 49, "KESTREL MANUAL\nA shiprnent that was mcasured in the room of the\nclerk.\n49", "x"), (121, None, None, None, "x"), (122, "s2", None, "", "x"), (123, "s1", 49, "KESTREL MANUAL\nA shiprnent that was mcasured in the room of the\nclerk.\n49", "x"), (124, "s3", 1, "word " * 100_000, "x")]
    df = spark.createDataFrame(rows, "entry_id long, source_id string, page_first int, text string, noise string")
    got = {r.entry_id: r for r in repaired(df, "entry_id", "text", "source_id", "page_first").collect()}
    kinds = lambda i: sorted((x.noise_kind, x.line_no, x.token) for x in got[i].noise)
    assert kinds(120) == kinds(123) == [("header", 1, ""), ("misread", 2, "measured"), ("misread", 2, "shipment"), ("page_number", 4, "")]
    assert kinds(3) == [("header", 1, ""), ("page_number", 4, "")] and got[121].clean_text is None and got[122].noise == []
    assert len(got) == 45 and repaired(df.limit(0), "entry_id", "text", "source_id", "page_first").count() == 0


def test_joined_tables_give_the_rows_of_broadcast_tables(spark, monkeypatch):
    body = "The retention of the été-forme and the up-to-date Café was measured by the clerk\nand its retention was measured once more, été-forme or Café, up-to-date.\n"
    rows = [(i, "s1", i, f"Box {chr(97 + i % 26) * 3}. {body}retenti0n rnay.\n", "x") for i in range(1, 41)]
    rows += [(60 + i, "s7", i, f"{h}\nA page of its own with a longer line, {chr(97 + i) * 3}.\nAnd one more line that is longer, {chr(98 + i) * 4}.\nAnd a last one that is longer, {chr(99 + i) * 4}.", "x") for i, h in enumerate(("Harbour Register", "Harbour Registcx", "Harbour Register"))]
    rows += [(50, "s1", 60, "It was the reten-\nti0n.\nAn été-\nforme, rcten-\ntion, and (mcasured) mcasured. The rctention.\nup-\nto-date\u2003mcasured", "x"), (50, "s1", 61, "An other mcasured one", "x"), (None, "s2", 1, "It was mcasured", "x"), (51, None, None, None, "x"), (52, "s2", None, "", "x")]
    df = spark.createDataFrame(rows, "entry_id long, source_id string, page_first int, text string, noise string")
    read = lambda: sorted((str(r) for r in repaired(df, "entry_id", "text", "source_id", "page_first").collect()))
    small = read()
    monkeypatch.setattr(scans, "BROADCAST_ROWS", 0)
    large = read()
    assert large == small and len(small) == 48
    assert any("kind='header'" in r for r in small) and any("token='retention'" in r and "token='été-forme'" in r for r in small)


def test_heads_need_repetition(spark):
    lone = "Dear Madam Harcourt Greenfield\nthe paper was found by the clerk in a box.\nIt was read.\nIt was kept.\nIt was closed."
    long = "Proceedings of the Extraordinary General Assembly of the Friends of the Harbour Archive in Session"
    body = lambda i: f"{long}\nBox {chr(97 + i) * 3} was opened by hand on that day.\nIt holds paper {chr(97 + i) * 4}.\nOf no use {chr(98 + i) * 5}."
    near = ["Harbour Register of Ships", "Harbour Registcr of Shlps", "Harbour Regjster of Ships"]
    rows = [(1, "s0", 1, lone)] + [(10 + i, "s1", i, body(i)) for i in range(3)] + [(20 + i, "s2", i, near[i] + "\n" + body(i + 5).split("\n", 1)[1]) for i in range(3)]
    rows += [(30 + i, None, i, f"Unscanned Heading Line\n{body(i + 10).split(chr(10), 1)[1]}") for i in range(2)]
    df = spark.createDataFrame(rows, "entry_id long, source_id string, page_first int, text string")
    got = {r.entry_id: [x.line_no for x in r.noise if x.noise_kind == "header"] for r in repaired(df, "entry_id", "text", "source_id", "page_first").collect()}
    assert got == {1: [], **{10 + i: [1] for i in range(3)}, **{20 + i: [1] for i in range(3)}, 30: [], 31: []}


def test_vocabulary_decides_on_hyphens(spark):
    rows = [(i, f"s{i}", 1, f"The well-known shipment {chr(97 + i)} is here.\nThe well-known shipment.") for i in range(12)]
    rows.append((50, "x", 1, "It is well-\nknown that (ship-\nrnent), came\nre-\nturned."))
    df = spark.createDataFrame(rows, "entry_id long, source_id string, page_first int, text string")
    got = {r.entry_id: r for r in repaired(df, "entry_id", "text", "source_id", "page_first").collect()}
    assert [x.token for x in got[50].noise if x.noise_kind == "hyphenation"] == ["well-known", "shipment", "returned"]


def test_long_lines_take_no_time():
    for line in ("A" * 200_000, "@" * 100_000, "Ab" + " " * 200_000 + "Cd", "{" * 100_000, "a." * 50_000, "ab-\n" * 20_000):
        assert skeleton(line) is not None and page_number(line) is None
        assert read_page(line, 1, set(), None, {}, set())[1]
    assert page_number("." * 500 + " 12 " + "." * 500) == 12
