import random

from paperloom.llm.leakage import leaks, question_classes, renamed

DOCS = "doc_id long, text string, item_id string, tokens int, canon int"
ITEMS = "item_id long, text string, doc_id string"


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, None, 1, 2) for i, t in docs], DOCS)
    e = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    return {(r.doc_id, r.item_id): r.n_exact for r in leaks(d, e, "doc_id", "text", "item_id", "text").collect()}


def linked(spark, docs, items):
    d = spark.createDataFrame([(i, t, None, 1, 2) for i, t in docs], DOCS)
    e = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    classes = question_classes(e, "item_id", "text")
    return {(r.doc_id, r.item_id) for r in renamed(d, e, "doc_id", "text", "item_id", "text").join(classes, "class_id").collect()}


def frames():
    return [(i, f"a train leaves Town{chr(97 + i)}x at {i}0 minutes past nine and reaches Place{chr(97 + i)}y after {i}7 stops") for i in range(1, 6)]


def test_exact_renamed_and_edges(spark):
    items = frames()
    exact = items[0][1].upper().replace(" ", " *") + "."
    other = items[0][1].replace("Townbx", "Zug").replace("Placeby", "Zag")
    eleven = " ".join(items[2][1].split()[:11])
    docs = [(1, exact), (2, other), (3, None), (4, ""), (5, eleven), (6, "other words entirely " * 500), (7, exact), (8, "x " * 5000 + items[3][1])]
    got = found(spark, docs, items)
    assert got[1, 1] > 0 and got[7, 1] == got[1, 1] and got[8, 4] > 0 and (2, 1) not in got
    assert not [k for k in got if k[0] in (3, 4, 5, 6)]
    links = linked(spark, docs, items)
    assert (2, 1) in links and (2, 5) in links and not [k for k in links if k[0] in (1, 3, 4, 5, 6, 7)]


def test_fillers_that_do_not_agree_are_no_renaming(spark):
    item = lambda a, b, c, d=None: f"{a} gives {b} and {c} gives {d or a} then how many are left"
    items = [(k, item(*(f"{x}{chr(97 + k)}q" for x in "abc"))) for k in range(4)]
    docs = [(1, item("Uwe", "Rosa", "Tim")), (2, item("Uwe", "Rosa", "Tim", "Kim")), (3, item("Uwe", "Rosa", "Uwe"))]
    assert {d for d, _ in linked(spark, docs, items)} == {1}


def test_renamings_planted_in_prose(spark):
    """Precision and recall of renamed questions among prose that shares the frame words."""
    rnd = random.Random(9)
    frames = [f"how many {k} does {{0}} need when {{1}} of the {m} are in the {n} and {{0}} takes {{2}} more" for k, m, n in (("boxes", "maps", "hall"), ("cards", "files", "room"), ("keys", "doors", "house"))]
    name = lambda: "".join(rnd.choices("bdfgklmnprst", k=4)) + "a"
    items = [(i, frames[i % 3].format(name(), rnd.randrange(90), rnd.randrange(90))) for i in range(12)]
    frame = "how many does need when of the are in the and takes more boxes cards keys".split()
    prose = lambda: " ".join(rnd.choice(frame) if rnd.random() < 0.6 else name() for _ in range(80))
    planted = {i: i % 3 for i in range(0, 60, 4)}
    docs = [(i, prose() + " " + (frames[planted[i]].format(name(), rnd.randrange(90), rnd.randrange(90)) if i in planted else "") + " " + prose()) for i in range(60)]
    assert linked(spark, docs, items) == {(d, k) for d, f in planted.items() for k in range(12) if k % 3 == f}


def test_bounds_change_nothing(spark, monkeypatch):
    items = frames()
    docs = [(1, items[0][1]), (2, items[1][1].replace("Townbx", "Zug")), (3, "y " * 40)]
    small = found(spark, docs, items), linked(spark, docs, items)
    monkeypatch.setattr("paperloom.llm.leakage.BROADCAST_ROWS", 0)
    monkeypatch.setattr("paperloom.llm.leakage.SCAN_TEMPLATES", 0)
    assert (found(spark, docs, items), linked(spark, docs, items)) == small


def test_passage_without_frame_words(spark):
    item = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece"
    assert found(spark, [(1, "y " + item[4:] + " z")], [(9, item)]) == {(1, 9): 1}


def test_accents_and_empty_tables(spark):
    item = "El niño pidió más té café sofá menú día árbol río canción lápiz"
    assert found(spark, [(1, item.lower().replace("ñ", "n").replace("é", "e"))], [(9, item)])[1, 9] == 2
    assert found(spark, [], [(9, item)]) == {} and found(spark, [(1, item)], []) == {}


def test_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"w{c}" for c in "abcdefgh"] + ["1", "22", "km"]
    items = [(i, " ".join(rnd.choices(vocab, k=30))) for i in range(12)]
    docs = []
    for i in range(40):
        t = rnd.choices(vocab, k=20)
        if i % 3 == 0:
            w = rnd.choice(items)[1].split()
            a = rnd.randrange(0, 15)
            t[5:5] = w[a : a + rnd.choice([11, 12, 13])]
        docs.append((i, " ".join(t)))
    grams = lambda t: {tuple(t.split()[k : k + 12]) for k in range(len(t.split()) - 11)}
    want = {(d, e) for d, t in docs for e, u in items if grams(t) & grams(u)}
    assert set(found(spark, docs, items)) == want
