import pytest

from paperloom.llm.mail import layout, newly_written, parse, split_body

CASES = [
    ("Hi Ann,\n\nNew text here.\n\nCheers Ines\n\nOn 14 Jan 2024 at 09:44, Bo Tam <b@x.test> wrote:\n> Old.\n>> Older.\n>\n> More.", [5, 7, 8, 9, 10, 11]),
    ("On 17 Mar 2024 at 09:58, Ivo Dumarwick\n<ivo@x.test> wrote:\n> Old.\n\nMy answer.", [1, 2, 3]),
    ("Quoting T V <t@x.test>:\n> First half so that the\n\nAn answer in between.\n\n> index could be rebuilt.\n\nTessa", [1, 2, 6, 8]),
    ("See below.\n\n-----Ursprüngliche Nachricht-----\nVon: A B\nGesendet: heute\n\nOld.\n\nGruß\nB", [3, 4, 5, 7, 9, 10]),
    ("Text.\n\nFrom: A B <a@x.test>\nSent: 9 Jan 2024\nTo: desk\nSubject: x\n\nOld.", [3, 4, 5, 6, 8]),
    ("Text.\n\n-- see the list below --\n\nBR\n--\nA B\nLeitung Archiv | X\n8 Harrow Lane, Dunmere", [5, 6, 7, 8, 9]),
    ("Text.\n\nSent from my phone", [3]),
    ("Sent from the annex by courier, the box arrives at noon.", []),
    ("Text.\n\n---\nThe contents of this e-mail may be privileged. Mail is not\nsecure and may be read or changed on its way.", [3, 4, 5]),
    ("This message is meant for everybody on the list.", []),
    ("OR> Old one.\nOR>\nOR> Old two.\n\nNew.", [1, 2, 3]),
    ("Hello Farid\r\n\r\nNew.\r\n\r\n/Jola\r\n", [5]),
    ("Petra wrote on 24 Feb 2024:\n| Old.\n|\n| | Older.", [1, 2, 3, 4]),
    ("From: A B <a@x.test>\nSent: 9 Jan 2024\nSubject: x\n\n> old words\n> of hers\n\nMy answer to them.\n\nKind regards\nBo", [1, 2, 3, 5, 6, 10, 11]),
    ("My answer.\n\nFrom: A B <a@x.test>\nSent: 9 Jan 2024\n\n> mine of before\n\nHer answer to it.", [3, 4, 6, 8]),
    ("Sent from my tablet, please excuse typos", [1]),
    ("Look:\n\n---- Forwarded message ----\nFrom: Uma Ost <u@x.test>\nDate: 3 May 2024\n\nOld text.\n\n---- End of forwarded message ----\n\nWhat do you make of it?", [3, 4, 5, 7, 9]),
    ("Anfang der weitergeleiteten Nachricht:\n\n> Von: Kai\n> Datum: heute\n>\n> Alt.\n\nDas ist neu.", [1, 3, 4, 5, 6]),
    ("Sent from my kitchen tablet", [1]),
    ("Sent from the harbour on Monday, and it should reach you soon.", []),
    ("My reasons are these:\n\nFirst, second and third.", []),
]


@pytest.mark.parametrize("body,lines", CASES)
def test_lines(body, lines):
    assert split_body(body)[0] == lines


def test_text_and_depth():
    assert split_body(CASES[0][0])[1] == "Hi Ann,\n\nNew text here."
    deep = "\n".join(">" * k + " x" for k in range(1, 400)) + "\nNew."
    assert split_body(deep)[0] == list(range(1, 400))
    assert split_body("Text line without end\n" * 20_000)[0] == []


def test_tree_of_enclosed_bodies():
    body = "New.\n\nOn 3 May 2024 Uma wrote:\n> Hers.\n>\n> -- \n> Uma\n>\n> Kai schrieb am 2. Mai 2024:\n>> His.\n\nMore."
    tree = parse(list(enumerate(body.split("\n"), 1)), whole=True)
    assert [n.kind for n in tree] == ["text", "quoted", "text"]
    inner = tree[1].parts
    assert [n.kind for n in inner] == ["text", "signature", "quoted"] and [n.kind for n in inner[2].parts] == ["text"] and inner[2].parts[0].lines == [10]


def test_layout(spark):
    rows = [(1, "A.\n\n> Is it so?\n>> It is so?", 0), (2, None, 0), (3, "", 0)]
    df = spark.createDataFrame(rows, "email_id long, body string, depth int")
    got = sorted((r.email_id, r.depth, r.node_kind, r.first_line, r.n_lines) for r in layout(df, "email_id", "body").collect())
    assert got == [(1, 0, "quoted", 3, 2), (1, 0, "text", 1, 2), (1, 1, "quoted", 4, 1), (1, 1, "text", 3, 1), (1, 2, "text", 4, 1)]


def test_table(spark):
    rows = [(1, "Text.\n\nCheers\nBo", "x"), (2, None, "x"), (3, "", "x"), (1, "Text.\n\nCheers\nBo", "x")]
    df = spark.createDataFrame(rows, "email_id long, body string, new_text string")
    got = newly_written(df, "email_id", "body").collect()
    assert sorted((r.email_id, r.other_lines, r.new_text) for r in got if r.email_id != 2) == [(1, [3, 4], "Text."), (1, [3, 4], "Text."), (3, [], "")]
    assert [r.new_text for r in got if r.email_id == 2] == [None] and newly_written(df.limit(0), "email_id", "body").count() == 0


def test_long_lines_take_no_time():
    for line in ("A" * 200_000, "@" * 100_000, "> " * 30_000 + "x", "a:\n" * 30_000):
        assert split_body(line)[1] is not None
