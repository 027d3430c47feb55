import random

from paperloom.llm.mixing import apportion, mix


def slow(seats, weights, caps):
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        free = [k for k in weights if got[k] < caps[k] and weights[k] > 0]
        if not free:
            break
        k = min(free, key=lambda k: (-weights[k] / (2 * got[k] + 1), k))
        got[k] += 1
    return {k: v for k, v in got.items() if v}


def test_apportionment_against_seat_by_seat():
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05, "e": 0.0}
    for seats in (0, 1, 7, 100, 1001):
        for caps in (dict.fromkeys(weights, 10**9), {"a": 20, "b": 500, "c": 3, "d": 1, "e": 5}):
            assert {k: v for k, v in apportion(seats, weights, caps).items() if v} == slow(seats, weights, caps)


def tables(spark, docs, targets):
    return spark.createDataFrame(docs, "doc_id long, text string, source string, n_uses int"), spark.createDataFrame(targets, "doc_source string, target_share double, max_repeats int")


def test_shares_caps_and_edges(spark):
    docs = [(i, f"some words of document {i} " * 20, "big", 1) for i in range(600)] + [(1000 + i, f"few words {i} " * 25, "small", 1) for i in range(150)]
    docs += [(5000, "no source", None, 1), (5001, "no target", "other", 1), (5002, None, "big", 1), (5003, "", "small", 1), (0, docs[0][1], "big", 1)]
    targets = [("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2)]
    rows, report = mix(*tables(spark, docs, targets), "doc_id", "text", "source")
    rows, by = rows.collect(), {r.doc_source: r for r in report.collect()}
    assert set(by) == {"big", "small", "absent"} and by["absent"].n_tokens_used == 0
    assert abs(by["big"].reached_share - 0.5 / 0.9) < 0.03 and abs(sum(r.reached_share for r in by.values()) - 1) < 1e-9
    assert all(r.n_uses <= {"big": 1, "small": 3}[r.doc_source] for r in rows)
    assert not {5000, 5001} & {r.doc_id for r in rows}
    assert sum(r.n_tokens * r.n_uses for r in rows if r.doc_source == "small") == by["small"].n_tokens_used


def test_asked_total_runs_into_caps_and_empty(spark):
    docs = [(i, "words " * 400, "a", 1) for i in range(50)] + [(100 + i, "words " * 400, "b", 1) for i in range(50)]
    rows, report = mix(*tables(spark, docs, [("a", 0.9, 1), ("b", 0.1, 1)]), "doc_id", "text", "source", total_tokens=40_000)
    by = {r.doc_source: r for r in report.collect()}
    assert by["a"].n_tokens_used == by["a"].n_tokens_available and by["a"].reached_share < 0.9
    rows, report = mix(*tables(spark, [], [("a", 0.9, 1)]), "doc_id", "text", "source")
    assert rows.count() == 0 and [r.reached_share for r in report.collect()] == [0.0]


def test_apportionment_is_that_of_seat_by_seat():
    rnd = random.Random(3)
    for _ in range(200):
        keys = [f"k{i}" for i in range(rnd.randrange(1, 7))]
        weights, caps = {k: rnd.choice([0.0, 1.0, 2.0, 3.5, 0.25]) for k in keys}, {k: rnd.choice([0, 1, 5, 40, 1000]) for k in keys}
        seats = rnd.randrange(0, 120)
        quota = {k: 0 for k in sorted(keys) if weights[k] > 0 and caps[k] > 0}
        for _ in range(seats):
            free = [k for k in quota if quota[k] < caps[k]]
            if free:
                best = max(free, key=lambda k: (weights[k] / (2 * quota[k] + 1), [-ord(c) for c in k]))
                quota[best] += 1
        assert apportion(seats, weights, caps) == quota
    assert sum(apportion(10**9, {"a": 0.9, "b": 0.1}, {"a": 10**8, "b": 10**10}).values()) == 10**9
