import random
import re
from re import _parser

import pytest

from paperloom.llm.residue import _RAW, ERROR, FILLER, PLACEHOLDER, SCRIPT, _gate, boilerplate, evidence, judged

CASES = [
    ("Dear {{ name }}, your copy is ready.", ["placeholder"]),
    ("Sehr geehrte Frau <vorname einfügen>,", ["placeholder"]),
    ("sent to %ORDER_NO% today", ["placeholder"]),
    ("404 Not Found\nRequest id: AB-1", ["error"]),
    ("Die angeforderte  Adresse gibt es\nnicht (mehr).", ["error"]),
    ('{"status":503,"error":"gone"}', ["error"]),
    ("Traceback (most recent call last):\n  File \"a.py\", line 3, in run\nKeyError: 'x'", ["error"]),
    ("Texte  d'exemple  à  remplacer", ["filler"]),
    ("Minim culpa sunt dolor amet velit magna porta ipsum tempor nulla.", ["filler"]),
    ("Please turn on Java-\nScript to view this page.", ["script"]),
    ("Ohne Skripte kann diese Seite nicht angezeigt werden.", ["script"]),
    ("Esta aplicación necesita JavaScript.", ["script"]),
    ("> JS is off.\n> Oops! 500 - internal error", ["error", "script"]),
    ('Their log says "access denied" 80 times.', []),
    ("Pages that ask visitors to enable JavaScript are opened in the helper.", []),
    ("Placeholders in square brackets, e.g. [Your Name], must be replaced before a form is handed in.", []),
    ("Example from the manual:\n```\nDear ${name}, your copy is ready\n```", []),
    ("A field such as `{{title}}` is filled in by the importer.", []),
    ('raw: {"tags":["envelope"],"n":{}} and note [1], rates of 12% and the path /a/%20new/B', []),
    ("[signature illegible] and below it <unclear>; transcript 404 of 500", []),
    ("", []),
]


@pytest.mark.parametrize("text,kinds", CASES)
def test_evidence(text, kinds):
    assert evidence(text) == kinds


def test_long_text():
    assert evidence("word and more words. " * 200_000 + "Access denied.") == ["error"]


def test_judged_with_boilerplate_and_edges(spark):
    rows = [(i, f"Session expired?\nHome | {i}\nReal text number {i}.", None, "a") for i in range(40)]
    rows += [(100, "Access denied", "q", "b"), (101, None, None, "b"), (102, "", "z", "b"), (103, "Access denied", None, None), (104, "Access denied", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, evidence string, _host string")
    got = {r.doc_id: r.evidence for r in judged(df, "doc_id", "text", "_host").collect()}
    assert got[100] == got[103] == got[104] == ["error"] and got[101] == got[102] == []
    assert all(got[i] == [] for i in range(40)) and len(got) == 45
    assert boilerplate(df, "text", "_host").count() == 1
    assert judged(df.limit(0), "doc_id", "text", "_host").count() == 0


def test_repeated_pages_are_no_boilerplate(spark):
    page = lambda i: f"Access denied\nYour request {i} was refused at 12:{i % 60:02}.\nHome"
    letters = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    rows = [(i, "404 Not Found\nThe address is unknown.", "a") for i in range(150)]
    rows += [(i, page(i), "a") for i in range(150, 300)]
    rows += [(i, f"Session expired?\nThe {letters(i)} was read.\nIt is {letters(i * 7)}.", "a") for i in range(300, 1000)]
    rows += [(i, "404 Not Found\nThe address is unknown.", "b") for i in range(1000, 1040)]
    rows += [(i, f"Error 503\nRequest id: {i}", "c") for i in range(2000, 2040)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = {r.doc_id: r.evidence for r in judged(df, "doc_id", "text", "source").collect()}
    assert all(got[i] == ["error"] for i in (*range(300), *range(1000, 1040), *range(2000, 2040)))
    assert not any(got[i] for i in range(300, 1000))


def test_record_of_boilerplate_alone(spark):
    hints = ["Ask the owner.", "Call the desk.", "Write to us.", "Wait a little.", "Look at the map.", "Go back."]
    rows = [(i, "Access denied\n" + "\n".join(h for k, h in enumerate(hints) if i >> k & 1), "a") for i in range(1, 64)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert all(r.evidence == ["error"] for r in judged(df, "doc_id", "text", "source").collect())


@pytest.mark.parametrize(
    "text,kind",
    [
        ("Dear (insert name), welcome.", "placeholder"),
        ("Dear (your name), welcome.", "placeholder"),
        ("Liebe (Ihr Name), hallo.", "placeholder"),
        ("410 Gone", "error"),
        ('{"code": 503, "at": 1}', "error"),
        ("Veuillez réessayer", "error"),
        ('File "x.py", line 3, in run', "error"),
        ("Die angeforderte Seite wurde nicht geladen", "error"),
        ("Donec vitae nunc et justo viverra mauris etiam in porta", "filler"),
        ("bla,bla,bla", "filler"),
        ("You must enable (JS).", "script"),
        ("JS: it must be on", "script"),
        ("allow inline/scripts", "script"),
    ],
)
def test_gates_pass(text, kind):
    assert evidence(text) == [kind]


def test_reporting_needs_a_construction():
    assert evidence("Internal Server Error - please inform the readers desk.") == ["error"]
    assert evidence("Training manual for visitors. 503 Service Unavailable") == ["error"]
    assert evidence("The helper asks its visitors to enable JavaScript.") == []
    assert evidence("An unexpected error has occurred. Stack trace: none") == ["error"]
    assert evidence("Hello *|FNAME|*, see <<offer>> or %(date)s") == ["placeholder"]
    assert evidence("Dolor sit amet.") == ["filler"]


def test_bounds_change_nothing(spark, monkeypatch):
    rows = [(i, f"Session expired?\nHome | {i}\nReal text number {i}.", "ab"[i % 2]) for i in range(80)] + [(100, "Access denied", None), (101, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    read = lambda: sorted((r.doc_id, r.evidence) for r in judged(df, "doc_id", "text", "source").collect())
    small = read()
    monkeypatch.setattr("paperloom.llm.residue.BROADCAST_KEYS", 0)
    assert read() == small


def _samples(parsed, pick):
    """A text that a parsed pattern matches; looks around and bounds are left out."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "NOT_LITERAL":
            out += "x"
        elif name == "IN":
            kind, value = pick(arg) if str(arg[0][0]) != "NEGATE" else (None, None)
            out += chr(value) if str(kind) == "LITERAL" else chr(value[0]) if str(kind) == "RANGE" else {"CATEGORY_DIGIT": "4", "CATEGORY_SPACE": " "}.get(str(value), "x")
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            out += "".join(_samples(inner, pick) for _ in range(pick([low, min(high, low + 1)])))
        elif name == "SUBPATTERN":
            out += _samples(arg[3], pick)
        elif name == "BRANCH":
            out += _samples(pick(arg[1]), pick)
        elif name in ("ANY", "CATEGORY"):
            out += "x"
    return out


@pytest.mark.parametrize("kind,pattern", [("error", ERROR), ("error", _RAW), ("placeholder", PLACEHOLDER), ("filler", FILLER), ("script", SCRIPT)])
def test_every_alternative_passes_its_gate(kind, pattern):
    pick = random.Random(5).choice
    tree = list(_parser.parse(pattern.pattern, pattern.flags))
    branches = tree[0][1][1] if str(tree[0][0]) == "BRANCH" else [tree]
    seen = 0
    for branch in branches:
        for _ in range(300):
            text = _samples(branch, pick)
            if not pattern.search(text):
                continue
            seen += 1
            low = re.sub(r"\s", " ", text.lower())
            assert kind in frozenset().union(*(k for _, k in _gate().iter(" " + low + " "))), text
    assert seen > 100
