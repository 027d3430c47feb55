import io
import json
import time
import zipfile

from pyspark.sql import functions as F

from paperloom.sources import files, markup, messages, structured


def test_json():
    assert structured.units('{"id":7,"user":{"name":"u"}}\n\nbad\n', True) == [(None, "Record 1 (line 1)\nid: 7\nuser.name: u", None), (None, "Record 2 (line 3)\nbad", "a line isn't JSON")]
    tree = structured.load('{"b":1.50,"a":[1,{"x":null}],"e":[],"big":12345678901234567890}')
    assert structured.flat_lines(tree) == ["b: 1.50", "a[0]: 1", "a[1].x: null", "e: []", "big: 12345678901234567890"]
    body = json.dumps({"next": "cursor-1", "data": [{"sku": i, "qty": i} for i in range(300)]})
    found = structured.units(body, False)
    assert len(found) == 301 and found[0][1] == "next: cursor-1\ndata: [300 records below]" and found[1][:2] == ("/data/0", "Record 1 (data[0])\nsku: 0\nqty: 0")
    assert structured.pointer(["a/b", "c~d"]) == "/a~1b/c~0d"


def test_html():
    text, title = markup.html_to_text("<html><head><title>T &amp; U</title><style>x</style></head><body><h1>Head</h1><p>One  two<br>three</p><ul><li>a<ul><li>b</li></ul></li></ul><table><tr><td>1</td><td>2</td></tr></table><img alt='cat'></body></html>")
    assert title == "T & U" and text.startswith("# Head\n\nOne two\nthree\n- a\n  - b\n1\t2\n")
    assert "image: cat" in text
    assert markup.html_to_text("<nav>skip</nav><main><p>Body</p></main>")[0] == "Body\n"


def test_cues():
    srt = "1\r\n00:00:01,000 --> 00:00:02,500\r\n<i>Hi</i> &amp; bye\r\n\r\n2\r\n00:00:05,000 --> 00:00:04,000\r\nbad\r\n\r\n3\r\nx --> y\r\nbad"
    assert markup.cues(srt) == ([(1.0, 2.5, "Hi & bye")], 2)
    assert markup.cues("WEBVTT\n\nid\n01:02.000 --> 01:03.000 align:start\nText")[0] == [(62.0, 63.0, "Text")]


def test_email():
    raw = "From: =?utf-8?q?M=C3=BChle?= <a@x.test>\nTo: b@x.test, C <c@x.test>\nSubject: =?utf-8?q?M=C3=BChle_ledger?=\nDate: Thu, 11 Mar 2021 17:45:00 +0200\nMessage-ID: <1@x>\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\n\nBody\n--B\nContent-Type: text/plain\nContent-Disposition: attachment; filename=\"../../notes.txt\"\n\nx\n--B--\n"
    got = messages.read_email(raw)
    assert got["subject"] == "Mühle ledger" and got["date"] == "2021-03-11T15:45:00Z" and got["to_addrs"] == ["b@x.test", "C <c@x.test>"] and got["attachment_names"] == ["notes.txt"] and got["body"].strip() == "Body"
    assert messages.read_email(b"\xff\xfe no message")["subject"] is None
    assert len(messages.split_mbox("From a\nSubject: 1\n\nx\nFrom b\nSubject: 2\n\ny\n")) == 2


def test_plain_emails():
    usual = "From: Clerk <c1@desk.test>\nTo: b@x.test, C D <c@x.test>\nSubject: {}\nDate: {}\nMessage-ID: <1.a@x>\nX-Other: y\nContent-Type: text/plain; charset=utf-8\n\nBody é\n\n"
    for subject in ("two  [words]", "=?utf-8?q?Order_7?=", "=?UTF-8?Q?M=C3=BChle?=", "=?utf-8?b?YQ==?=", "=?utf-8?q?a?= =?utf-8?q?b?=", "=?utf-8?q?=zz?=", "=?utf-8?q?a=0Ab?=", "=?utf-8?q?=C3?=", "folded\n on", "é", ""):
        for date in ("Thu, 11 Mar 2021 17:45:00 +0200", "1 Jan 2000 00:00:00 -0000", "31 Feb 2000 00:00:00 +0000", "11 Mar 2021 10:00:00 +9999", "11 Mar 21 10:00 GMT", "soon"):
            m = usual.format(subject, date)
            assert messages.read_plain_email(m) in (None, tuple(messages.read_email(m).values())), m
    mail = usual.format("=?utf-8?q?Order_7?=", "02 Jan 1996 10:30:00 +0200")
    assert messages.read_plain_email(mail)[1:3] == ("Order 7", ["Clerk <c1@desk.test>"])
    head, _, body = mail.partition("\n\n")
    for other in (mail.replace("text/plain", "text/html"), mail.replace("utf-8\n", "latin-1\n"), f"{head}\nContent-Transfer-Encoding: base64\n\n{body}", f"{head}\nSubject: b\n\n{body}", mail.replace("\n", "\r\n"), mail.replace("é", "\udcff"), "no message", ""):
        assert messages.read_plain_email(other) is None
    began = time.perf_counter()
    for _ in range(200):
        messages.read_email(mail)
    whole = time.perf_counter() - began
    for _ in range(200):
        messages.read_plain_email(mail)
    assert time.perf_counter() - began - whole < whole / 10


def test_email_rows(spark, monkeypatch):
    plain = "From x\nFrom: A <a@x.test>\nSubject: s{}\n\nbody {}\n"
    html = "From x\nFrom: b@x.test\nSubject: =?utf-8?b?aMOp?=\nContent-Type: text/html\n\n<p>hi</p>\n"
    many = "".join(plain.format(i, i) for i in range(5))
    df = spark.createDataFrame([(1, many + html + many), (2, None), (None, plain.format("z", "z"))], "id long, box string")
    monkeypatch.setattr(messages, "ROWS_AT_ONCE", 3)
    got = [(r.id, r.position, r.subject, list(r.from_addrs), r.body.strip()) for r in messages.email_rows(df, "id", F.col("box"), mbox=True).collect()]
    five = [(f"s{i}", ["A <a@x.test>"], f"body {i}") for i in range(5)]
    assert [g for g in got if g[0] == 1] == [(1, n, *x) for n, x in enumerate([*five, ("hé", ["b@x.test"], "hi"), *five], 1)]
    assert [g for g in got if g[0] != 1] == [(None, 1, "sz", ["A <a@x.test>"], "body z")]
    raw = spark.createDataFrame([("k", bytearray(b"Subject: x\nContent-Type: text/plain; charset=latin-1\n\n\xe9")), ("l", bytearray(b"\xff\xfe no message"))], "id string, mail binary")
    assert sorted((r.id, r.position, r.subject, r.date, r.body) for r in messages.email_rows(raw, "id", F.col("mail")).collect())[0] == ("k", 1, "x", None, "é")
    assert messages.email_rows(raw, "id", F.col("mail")).where("id = 'l'").first().subject is None


def test_chats():
    ios = "﻿[27/02/2021, 9:05:01 PM] Ann: Hello\nmore\n‎[27/02/2021, 9:06:00 PM] Bo: ‎<attached: a.jpg>"
    assert messages.whatsapp(ios) == [("2021-02-27", "21:05:01", "Ann", "Hello\nmore", []), ("2021-02-27", "21:06:00", "Bo", "", ["a.jpg"])]
    assert messages.whatsapp("1/27/21, 9:05 AM - Ann: x.pdf (file attached)") == [("2021-01-27", "09:05", "Ann", "", ["x.pdf"])]
    tg = json.dumps({"name": "Fam", "messages": [{"type": "service", "action": "create_group", "title": "Family", "actor": "A", "date": "2022-02-18T09:00:00"}, {"type": "message", "from": "A", "date": "2022-02-18T09:01:00", "text": ["See ", {"type": "text_link", "text": "this", "href": "https://example.com"}, " now"]}]})
    assert [m[3] for m in messages.telegram(tg)[0][1]] == ["[create group] Family", "See this (https://example.com) now"]
    names = messages.slack_names([{"id": "U1", "name": "n", "real_name": "R", "profile": {"display_name": "D"}}, {"id": "U2", "name": "n2"}])
    day = messages.slack_day([{"type": "message", "user": "U2", "text": "hi <@U1> <https://x.y|site> &amp;", "ts": "1791279850.0", "thread_ts": "1.0"}], names)
    assert names == {"U1": "D", "U2": "n2"} and day[0][2:4] == ("n2", "(thread reply) hi @D site (https://x.y) &")
    im = "Feb 18, 2022  9:44:10 AM\nAnn\nHi there\n/Users/a/p.png\nhttps://x.y/z\n\nFeb 18, 2022  1:00:00 PM\nMe\nYo"
    assert messages.imessage(im) == [("2022-02-18", "09:44:10", "Ann", "Hi there\nhttps://x.y/z", ["/Users/a/p.png"]), ("2022-02-18", "13:00:00", "Me", "Yo", [])]


def test_tables(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a/x.txt", "hello")
        inner = io.BytesIO()
        with zipfile.ZipFile(inner, "w") as y:
            y.writestr("deep.txt", "deep")
        z.writestr("in.zip", inner.getvalue())
    (tmp_path / "b.zip").write_bytes(buffer.getvalue())
    (tmp_path / ".hidden").write_text("h")
    (tmp_path / "n.txt").write_text("plain")
    found = files.discover(spark, str(tmp_path))
    rows = found.select("path", files.content_type(F.col("content")).alias("mime"), files.sniffed_as_text(F.col("content")).alias("text")).collect()
    assert [(r.path.rsplit("/", 1)[1], r.mime, r.text) for r in rows] == [("b.zip", "application/zip", False), ("n.txt", None, True)]
    assert sorted((r.member, r.depth, bytes(r.content)) for r in files.archive_members(found.where("path LIKE '%.zip'")).collect() if r.member != "in.zip") == [("a/x.txt", 1, b"hello"), ("in.zip/deep.txt", 2, b"deep")]
    df = spark.createDataFrame([(1, "[27/02/2021, 9:05:01] Ann: Hello\n[27/02/2021, 9:06:01] Bo: Yes"), (2, None)], "id long, text string")
    chat = messages.chat_rows(df, "id", "text", "whatsapp")
    assert [r.text for r in messages.chat_units(chat, "id").collect()] == ["whatsapp chat: chat\nParticipants: Ann, Bo\nMessages: 2 (2021-02-27 to 2021-02-27)\n\n-- 2021-02-27 --\n09:05:01 Ann: Hello\n09:06:01 Bo: Yes"]
    scores = spark.createDataFrame([("s", "text", 100, 0, 1), ("s", "json", 250, 0, 2), ("s", "mail", 250, 0, 3), ("t", "text", 0, 0, 1)], "source string, importer string, score int, priority int, position int")
    assert [tuple(r) for r in files.best_importer(scores).collect()] == [("s", "json", 250)]
    words = df.limit(1).select(markup.recognised_words(F.lit("5\t1\t1\t1\t1\t1\t10\t20\t30\t40\t95.5\tHello\n5\t1\t1\t1\t1\t1\t1\t1\t1\t1\t-1\tx"), F.lit(100.0), F.lit(200.0)).alias("w")).first().w
    assert [(w.text, w.x, w.y, w.confidence) for w in words] == [("Hello", 0.1, 0.1, 0.955)]
