"""Periods and gaps against a brute-force set of pages."""

import random

import pytest

from foliolens.operators.intervals import coalesced, periods_and_gaps

SCHEMA = "query_id long, doc_id string, from_page int, to_page int, kind string, lo int"


def brute(rows):
    pages = {}
    for q, d, a, b, *_ in rows:
        if q is not None and d is not None and a is not None and b is not None and 1 <= a <= b:
            pages.setdefault((q, d), set()).update(range(a, b + 1))
    out = set()
    for (q, d), s in pages.items():
        runs = []
        for p in sorted(s):
            if runs and runs[-1][1] + 1 == p:
                runs[-1][1] = p
            else:
                runs.append([p, p])
        out |= {(q, d, "period", a, b) for a, b in runs}
        out |= {(q, d, "gap", x[1] + 1, y[0] - 1) for x, y in zip(runs, runs[1:])}
    return out


def check(spark, rows, *splits):
    df = spark.createDataFrame(rows, SCHEMA)
    for split in (1_000_000, *splits):
        got = [tuple(r) for r in periods_and_gaps(df, ["query_id", "doc_id"], split_rows=split).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows), split
    assert {(*r,) for r in coalesced(df, ["query_id", "doc_id"]).collect()} == {(q, d, a, b) for q, d, k, a, b in brute(rows) if k == "period"}


@pytest.mark.parametrize(
    "given",
    [
        [(1, 5)],
        [(5, 6), (1, 3)],
        [(1, 4), (3, 6)],
        [(1, 3), (4, 6)],
        [(1, 3), (2, 4), (5, 5), (6, 8), (10, 12)],
        [(5, 3), (None, 2), (0, 4), (-1, -1), (7, None)],
        [(10, 15), (1, 2), (3, 5), (5, 8), (16, 18), (18, 20)],
        [(1, 2147483647), (2147483647, 2147483647)],
    ],
)
def test_stated_cases(spark, given):
    if (1, 2147483647) in given:
        df = spark.createDataFrame([(1, "d", a, b, "x", 0) for a, b in given], SCHEMA)
        assert [tuple(r) for r in periods_and_gaps(df, ["query_id", "doc_id"]).collect()] == [(1, "d", "period", 1, 2147483647)]
        return
    check(spark, [(1, "d", a, b, "x", 0) for a, b in given])


def test_random_hot_key_and_nulls(spark):
    r = random.Random(5)
    rows = []
    for _ in range(30000):
        hot = r.random() < 0.33
        q, d = (1, "hot") if hot else (r.choice([None, 1, 2, 3, 4]), r.choice([None, "a", "b", "hot"]))
        a = r.randrange(-1, 60000)
        rows.append((q, d, r.choice([a, a, a, None]), a + r.randrange(-1, 4), "k", 1))
    check(spark, rows + rows[:100], 2000)


def test_keys_in_ranges(spark):
    """Keys cut at their ranges' ends: short, long and nested intervals, some across many ranges, and ranges without any row."""
    r = random.Random(6)
    rows = []
    for q in range(6):
        for _ in range(80):
            a = r.choice([r.randrange(1, 400), r.randrange(2000, 2200)])
            rows.append((q, "d", a, a + r.choice([0, 1, 2, 5, 1 if q < 3 else 300]), "k", 1))
    check(spark, rows + [(9, "d", 2147483000 + i * 7, min(2147483000 + i * 7 + 3, 2147483647), "k", 1) for i in range(92)], 5, 30)


def test_empty(spark):
    check(spark, [])
