import random
import re

import pytest

from paperloom.llm.splitting import _ENDS, page_ranges, pieces, split


def level_of(text, limit):
    ok = lambda parts: all(len(p.strip().encode()) <= limit for p in parts)
    para = re.split(r"\f|\n(?=[^\S\n\f]*(?:\n|$))", text)
    line = [x for p in para for x in re.split(r"[\n\f]", p)]
    sent = [x for p in line for x in re.split(r"(?<=[.!?])\s+", p)]
    word = text.split()
    for name, parts in (("paragraph", para), ("line", line), ("sentence", sent), ("word", word)):
        if ok(parts):
            return name
    return "char"


def check(text, limit, overlap):
    level, cuts = split(text, limit, overlap)
    assert level == level_of(text, limit), (level, text[:80])
    assert "".join(text[n:e] for _, n, e in cuts) == text
    for (s, n, e), before in zip(cuts, [None, *cuts]):
        assert len(text[s:e].encode()) <= limit and s <= n and (n < e or not text) and n - s <= overlap
        if before:
            assert s >= 0 and n == before[2]
    return cuts


@pytest.mark.parametrize("seed", range(30))
def test_random_texts(seed):
    rnd = random.Random(seed)
    alphabet = ["a", "é", "漢", "😀", " ", ". ", "\n", "\n\n", "\r\n", "\f", "wordy", "x" * 30, "! "]
    text = "".join(rnd.choices(alphabet, k=rnd.choice([0, 1, 50, 400])))
    check(text, rnd.choice([4, 16, 40, 200]), rnd.choice([0, 5, 30]))


def test_ends_at_pauses_and_overlaps():
    text = "\n\n".join(f"Paragraph {i} says something of no use here. And more." for i in range(400))
    cuts = check(text, 4096, 300)
    assert all(text[:e].endswith("\n") for _, _, e in cuts[:-1]) and all(n - s > 200 for s, n, _ in cuts[1:])
    assert len(check("x" * 100_000, 4096, 300)) < 30
    assert len(check("word " * 300_000, 4096, 300)) > 300


def greedy(text, limit, overlap):
    """Cut by cut, without a table: the farthest boundary of the strongest level within the limit."""
    ends = {k: sorted({m.end() for m in p.finditer(text)}) for k, p in _ENDS.items()}
    size = lambda a, b: len(text[a:b].encode())
    words = sorted({0, len(text), *ends["paragraph"], *ends["line"], *ends["sentence"], *ends["word"]})
    cut, out = 0, []
    while cut < len(text):
        begins = [w for w in words if cut - overlap <= w <= cut and size(w, cut) <= limit // 2]
        begin = begins[0] if cut and begins else cut
        after = next(w for w in words if w > cut)
        if size(begin, after) > limit:
            begin = cut
        if size(begin, len(text)) <= limit:
            best = len(text)
        else:
            best = max(w for w in words if w > cut and size(begin, w) <= limit)
            level = []
            for k in ("paragraph", "line", "sentence", "word"):
                level = sorted({*level, *ends[k]})
                fits = [e for e in level if e > cut and size(begin, e) <= limit and size(cut, e) >= limit // 4]
                if fits:
                    best = fits[-1]
                    break
        out.append((begin, cut, best))
        cut = best
    return out


@pytest.mark.parametrize("seed", range(6))
def test_squaring_is_the_same_as_cut_by_cut(seed):
    rnd = random.Random(seed)
    text = "".join("".join(rnd.choices("abcé.", k=rnd.randrange(1, 9))) + rnd.choice([" ", " ", " ", "\n", "\n\n"]) for _ in range(500))
    assert check(text, 200, 20) == greedy(text, 200, 20)


def test_pages():
    text = "a" * 10 + "\f" + "b" * 10 + "\f" + "c" * 9
    cuts = [(0, 0, 11), (8, 11, 22), (20, 22, 31)]
    assert page_ranges(text, cuts, 5, 7) == [(5, 5), (5, 6), (6, 7)]
    assert page_ranges(text, cuts, 5, None) == [(5, 5), (5, 6), (6, 7)]
    assert page_ranges(text, cuts, None, 7) == [(None, None)] * 3
    assert page_ranges(text, cuts, 1, 1) == [(1, 1)] * 3
    assert page_ranges(text, cuts, 1, 10)[-1][1] == 10


def test_table(spark):
    rows = [(1, "tiny", 0), (2, None, 0), (3, "", 0), (4, "long. " * 2000, 0), (4, "long. " * 2000, 0)]
    df = spark.createDataFrame(rows, "item_id long, text string, cut_level int")
    got = pieces(df, "item_id", "text").collect()
    assert {r.item_id for r in got} == {4} and {r.cut_level for r in got} == {"sentence"}
    assert len(got) % 2 == 0 and pieces(df.limit(0), "item_id", "text").count() == 0
