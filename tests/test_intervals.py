import random

import pytest

from parlance.operators.intervals import periods_and_gaps, unit_intervals


def brute(rows):
    out = set()
    by = {}
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    for k, spans in by.items():
        spans.sort()
        merged = [list(spans[0])]
        for s, e in spans[1:]:
            if s > merged[-1][1]:
                merged.append([s, e])
            else:
                merged[-1][1] = max(merged[-1][1], e)
        out |= {(k, "period", s, e) for s, e in merged}
        out |= {(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


SCHEMA = "k string, start_ms long, end_ms long"


@pytest.mark.parametrize("seed", range(4))
def test_against_merging(spark, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(600):
        s = r.randrange(0, 400)
        # one key holds a third of all rows; ties, repeats, empty and reversed intervals occur
        rows.append((r.choice(["hot", "hot", "a", "b", "c", None]), s, s + r.randrange(-3, 9)))
    rows += rows[:50]
    df = spark.createDataFrame(rows, SCHEMA)
    for block in (1, 7, 50, 600_000):
        got = {tuple(x) for x in periods_and_gaps(df, ["k"], block_ms=block).collect()}
        assert got == brute(rows)


def test_nested_touching_and_empty(spark):
    rows = [("a", 0, 10), ("a", 2, 3), ("a", 10, 12), ("a", 20, 30), ("a", None, 5), ("b", 1, 1)]
    got = {tuple(x) for x in periods_and_gaps(spark.createDataFrame(rows, SCHEMA), ["k"]).collect()}
    assert got == {("a", "period", 0, 12), ("a", "gap", 12, 20), ("a", "period", 20, 30)}
    assert periods_and_gaps(spark.createDataFrame([], SCHEMA), ["k"]).count() == 0


def test_clashing_columns(spark):
    rows = [("a", 0, 10, 1, 2, "x"), ("a", 20, 30, 1, 2, "x")]
    df = spark.createDataFrame(rows, "k string, start_ms long, end_ms long, rank int, block int, side string")
    assert periods_and_gaps(df, ["k"]).count() == 3


def test_units(spark):
    rows = [("R", " ald ", 1.0000001, 2.0), ("R", "ALD", 2.0, 3.0), ("R", "", 1.0, 2.0), ("R", None, 1.0, 2.0), ("R", "ALD", 5.0, 4.0)]
    u = spark.createDataFrame(rows, "recording string, speaker string, start double, end double")
    got = [tuple(x) for x in periods_and_gaps(unit_intervals(u), ["recording", "speaker"]).collect()]
    assert got == [("R", "ALD", "period", 1000, 3000)]
