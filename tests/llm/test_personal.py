import pytest
from pyspark.sql import functions as F

from paperloom.llm import personal
from paperloom.llm.personal import Lexicon, detect, gather_names, masked, mentions

LEX = Lexicon(frozenset("ines peter vera farid will mark rose grace tomas jola chidi".split()), frozenset("lindormann zelmsen corvano dreveau kelbski gostez iverholt".split()))
CASES = [
    ("You can reach Ines Lindormann at a.b+scan@x.test or 494.555.0165.", [("name", "Ines Lindormann"), ("email", "a.b+scan@x.test"), ("phone", "494.555.0165")]),
    ("Lo pidió peter zelmsen, escriba a pk[at]talbrook.test.", [("name", "peter zelmsen"), ("email", "pk[at]talbrook.test")]),
    ("LINDORMANN, Ines hat unterschrieben.", [("name", "LINDORMANN, Ines")]),
    ("S. Dreveau firmó. Mr Vera Kelbski-Zelmsen", [("name", "S. Dreveau"), ("name", "Vera Kelbski-Zelmsen")]),
    ("Grace\nde Gostez signed", [("name", "Grace\nde Gostez")]),
    ("Mark the loose pages. Will the depot open? The rose pattern will fade. Faith in it. Grace\nperiods end.", []),
    ("Dear Rose,\n\nask for Mark.\n/Jola", [("name", "Rose"), ("name", "Mark"), ("name", "Jola")]),
    ("jaskby (at) mail (dot) calder (dot) example and kel at ninefold dot invalid", [("email", "jaskby (at) mail (dot) calder (dot) example"), ("email", "kel at ninefold dot invalid")]),
    ("Call +49 (0)30 23125-826\n150c Tollgate Row, Port Tavish, DM6 6FP now", [("phone", "+49 (0)30 23125-826"), ("address", "150c Tollgate Row, Port Tavish, DM6 6FP")]),
    ("tel (887) 555-0155, 030/23125514, 01 99 00 20 47, 020 7946 0713, 15355550175", [("phone", x) for x in ("(887) 555-0155", "030/23125514", "01 99 00 20 47", "020 7946 0713", "15355550175")]),
    ("Order 21589/78, ticket #2480835, roll 50-436-91, invoice 9100-4163, scale 1:01911, 2024-01-17 11:51, ZB 880 555", []),
    ("The IBAN on the form is ZZ72 6015 9181 1570 14.", [("identity", "ZZ72 6015 9181 1570 14")]),
    ("DNI 81824623-F, passport XX0774532, SSN 962-67-3517, tax ID 698/086/51087, insurance 1 79 32 99 623 403", [("identity", x) for x in ("81824623-F", "XX0774532", "962-67-3517", "698/086/51087", "1 79 32 99 623 403")]),
    ("an Torfweg 92, 53178 Altenquell. PO Box 954, Dunmere. au 62 rue des Tanneuses, 54981 Brévannes-le-Puy. Calle del Batán 16, 46765 Puente Moral.", [("address", "Torfweg 92, 53178 Altenquell"), ("address", "PO Box 954, Dunmere"), ("address", "62 rue des Tanneuses, 54981 Brévannes-le-Puy"), ("address", "Calle del Batán 16, 46765 Puente Moral")]),
    ("The Tollgate Row folder; room 31, second floor; Shelf 32, box 848", []),
    ("", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_detect(text, want):
    assert [(k, text[a:b]) for k, a, b in detect(text, LEX)] == want


def test_masked_and_long():
    text = "Hi Ines Lindormann, mail a@b.test."
    assert masked(text, detect(text, LEX)) == "Hi [NAME], mail [EMAIL]."
    long = "plain words here. " * 100_000 + text
    assert len(detect(long, LEX)) == 2
    assert len(detect("1 " * 50_000, LEX)) == 0 and detect("a." * 50_000, LEX) == []


def test_tables(spark):
    names = spark.createDataFrame([("Ines Lindormann <a@b.test>",), ("Corvano, Vera",), ("x@y.test",), (None,), ("Scan Desk <s@x.test>",)], "_name string")
    lexicon = gather_names(names)
    assert {"ines", "vera"} <= lexicon.given and {"lindormann", "corvano"} <= lexicon.surnames and "scan" not in lexicon.given
    df = spark.createDataFrame([(1, "Vera Corvano called.", "x"), (2, None, "x"), (3, "", "x"), (1, "Vera Corvano called.", "x")], "id long, text string, spans string")
    got = mentions(df, [F.col("id")], F.col("text"), lexicon).collect()
    assert sorted((r.id, r.masked_text or "") for r in got) == [(1, "[NAME] called."), (1, "[NAME] called."), (2, ""), (3, "")]
    assert [r.spans for r in got if r.id == 2] == [[]] and mentions(df.limit(0), [F.col("id")], F.col("text"), Lexicon()).count() == 0


def test_surnames_from_the_texts(spark):
    names = spark.createDataFrame([("Ines Lindormann",), ("Farid",)], "_name string")
    texts = ["Ines Okeke came.", "Okeke, Farid", "Farid Storage is full", "the storage hall, their storage shelf", "Farid Storage again", "storage and storage", "more storage", "in storage", "Ines Once said so", None, ""]
    read = spark.createDataFrame([(t,) for t in texts], "_text string")
    lexicon = gather_names(names, read)
    assert "okeke" in lexicon.surnames and not {"storage", "once", "came"} & lexicon.surnames
    assert [k for k, *_ in detect("Okeke's list", lexicon)] == ["name"] and detect("It was Moskova again.", lexicon) == []


def test_checksums_refuse():
    kinds = lambda text: {k for k, *_ in detect(text, LEX)}
    assert "identity" in kinds("account DE89 3704 0044 0532 0130 00") and "identity" not in kinds("account DE88 3704 0044 0532 0130 00")
    assert detect("12345678Z", LEX) and not detect("his id was 12345678A", LEX)
    assert detect("The DNI on the form is 12345678A", LEX)
    assert "identity" in kinds("card 4111 1111 1111 1111") and "identity" not in kinds("card 4111 1111 1111 1112")


def test_context_changes_the_score():
    assert [k for k, *_ in detect("Kelbski wrote.", LEX)] == ["name"] and not detect("Kelbski GmbH wrote. Corvano & Sons, Zelmsen Street", LEX)
    assert [k for k, *_ in detect("She lives at 12 Mill Lane.", LEX)] == ["address"] and not detect("See page 12 Mill Lane folder", LEX)


def test_names_with_apostrophe_or_hyphen():
    lexicon = Lexicon(frozenset({"sean", "jean-luc"}), frozenset({"o'neill", "d'angelo"}))
    for text, want in (("It was O'Neill again", "O'Neill"), ("O'Neill, Sean came", "O'Neill, Sean"), ("to D'Angelo's desk", "D'Angelo's"), ("It was Jean-Luc again", "Jean-Luc")):
        assert [text[a:b] for _, a, b in detect(text, lexicon)] == [want]


def test_long_columns_of_numbers():
    phones = [f"020 7946 {k:04}" for k in range(713, 733)]
    text = "\n".join(phones)
    assert [text[a:b] for k, a, b in detect(text, Lexicon()) if k == "phone"] == phones
    assert detect("(" * 200_000 + " " * 200_000, Lexicon()) == []


def test_joined_lexicon_gives_the_rows_of_a_broadcast_one(spark, monkeypatch):
    people = [a + b for a in ("Kelb", "Norv", "Trev", "Iver", "Mosk") for b in ("berg", "sen", "well", "ling", "ova")]
    names = spark.createDataFrame([(f"Ines {w}",) for w in people] + [("O'Neill, Jean-Luc",), ("Vera Corvano-Zelm",), ("Corvano Vera",), ("Scan Desk",)], "_name string")
    texts = ["Ines Norvsen called O'Neill.", "It was Moskova's plan.", "Vera Corvano-Zelm and Jean-Luc, Anna.", "The scan desk, Kelb.", None, "", "Ines Norvsen called O'Neill.", "Ines Okeke or Ines Okeke", "Okeke"]
    df = spark.createDataFrame([(i % 6, t) for i, t in enumerate(texts)], "id long, text string")
    read = lambda: sorted(str(r) for r in mentions(df, [F.col("id")], F.col("text"), gather_names(names, df.select(F.col("text").alias("_text")))).collect())
    small = read()
    monkeypatch.setattr(personal, "MAX_NAMES", 2)
    assert read() == small and len(small) == 9 and sum("masked_text='[NAME] called [NAME].'" in r for r in small) == 2 and any("masked_text='[NAME]'" in r for r in small)
