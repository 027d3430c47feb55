import math
import random

from pyspark.sql import functions as F

from paperloom.operators.intervals import periods_and_gaps, seconds_to_ms


def brute(rows):
    by = {}
    for k, s, e in rows:
        if s is not None and e is not None and e >= s:
            by.setdefault(k, []).append((s, e))
    out = set()
    for k, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(k, "period", s, e) for s, e in merged}
        out |= {(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def run(spark, rows, shard):
    df = spark.createDataFrame(rows, "k string, s long, e long").repartition(3)
    got = periods_and_gaps(df, ["k"], F.col("s"), F.col("e"), shard_slots=shard).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_against_brute_force_over_shards(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), s := rnd.randrange(-300, 300), s + rnd.choice([0, 1, 2, 5, 90])) for _ in range(400)]
    rows += rows[:20] + [("a", 5, 1), ("b", None, 3), ("b", 3, None), ("c", 7, 7), ("d", -900, 900), ("d", 100, 101), ("d", 900, 901), ("d", 903, 904)]
    for shard in (8, 64, 1 << 22):
        assert run(spark, rows, shard) == brute(rows)


def test_touching_joins_and_one_unit_apart_is_a_gap(spark):
    assert run(spark, [("x", 1, 2), ("x", 2, 3), ("x", 4, 4)], 4) == {("x", "period", 1, 3), ("x", "gap", 3, 4), ("x", "period", 4, 4)}


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], "k string, s long, e long, lo long, hi long, shard long, _k0 string")
    assert periods_and_gaps(df, ["k"], F.col("s"), F.col("e")).count() == 0
    df = spark.createDataFrame([("q", 1, 2, 9, 9, 9, "z")], df.schema)
    assert [tuple(r) for r in periods_and_gaps(df, ["k"], F.col("s"), F.col("e")).collect()] == [("q", "period", 1, 2)]


def test_unusable_seconds(spark):
    df = spark.createDataFrame([(1.234,), (math.nan,), (math.inf,), (None,), (0.2805,)], "x double")
    assert [r[0] for r in df.select(seconds_to_ms(F.col("x"))).collect()] == [1234, None, None, None, 281]
