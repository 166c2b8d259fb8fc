from __future__ import annotations

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from creditladder.operators import reshape, windows
from creditladder.operators.aggregates import calibration_table, category_share, duplicate_keys, means, month_total
from creditladder.operators.checks import expect_covered, missing_report
from creditladder.operators.joins import unique_by


@pytest.fixture(scope="module")
def months(spark):
    rnd = random.Random(3)
    data = [(g, d, rnd.choice([None, 1.0, 2.0]), rnd.choice([None, "a", "b"])) for g in range(6) for d in range(30) if rnd.random() < 0.7]
    rnd.shuffle(data)
    return spark.createDataFrame(data, "g int, d int, x double, s string"), sorted(data, key=lambda r: r[:2])


def loop_fill(data, column, backwards=False):
    out, last, group = {}, None, None
    for r in reversed(data) if backwards else data:
        if r[0] != group:
            last, group = None, r[0]
        last = r[column] if r[column] is not None else last
        out[r[:2]] = last
    return out


def test_fills_match_a_loop(months):
    df, data = months
    down, up = loop_fill(data, 3), loop_fill(data, 3, backwards=True)
    got = {(r.g, r.d): r.s for r in windows.fill_down(df, "s", "g", "d").collect()}
    assert got == down
    got = {(r.g, r.d): r.s for r in windows.fill_up(df, "s", "g", "d").collect()}
    assert got == up
    both = df.withColumn("s", windows.filled_down_then_up("s", "g", "d"))
    chained = windows.fill_up(windows.fill_down(df, "s", "g", "d"), "s", "g", "d")
    assert rows(both) == rows(chained)
    assert rows(windows.fill_down(chained, "s", "g", "d")) == rows(chained)


def test_runs_never_exceed_counts(months):
    df, data = months
    out = windows.cumulative_count(windows.run_length(df, "g", "d", "s", "run"), ["g", "s"], "d", "cum")
    assert out.filter("run > cum or run < 1").count() == 0
    expected, prev, n = {}, None, 0
    for r in data:
        same = prev is not None and prev[0] == r[0] and r[3] is not None and prev[3] == r[3]
        n = n + 1 if same else 1
        expected[r[:2]] = n
        prev = r
    assert {(r.g, r.d): r.run for r in out.collect()} == expected


def test_running_total_is_null_before_the_first_value(frame):
    df = frame("g int, d int, x double", [(1, 1, None), (1, 2, 5.0), (1, 3, None), (1, 4, 1.0)])
    assert [r.s for r in windows.running_sum(df, {"s": "x"}, "g", "d").orderBy("d").collect()] == [None, 5.0, 5.0, 6.0]


def test_column_ranges(frame):
    df = frame("a int, b int, c int, d int", [(1, 2, 3, 4)])
    assert reshape.select_range(df, "b", "c").columns == ["b", "c"]
    assert reshape.select_range(df, "c", "b", invert=True).columns == ["a", "d"]
    assert reshape.select_existing(df, ["d", "nope", "a"]).columns == ["a", "d"]
    assert rows(reshape.pick_positions(df, [2, 0], ["x", "y"])) == [(3, 1)]
    long = reshape.unpivot_periods(df, ["a"], {"p": {"v": "b"}, "q": {"v": "c"}})
    assert rows(long) == [(1, "p", 2), (1, "q", 3)]


def test_unique_by_fails_the_job(frame):
    df = frame("k int, v int", [(1, 1), (2, 2)])
    assert rows(unique_by(df, "k")) == [(1, 1), (2, 2)]
    with pytest.raises(Exception, match="loans: repeated key k"):
        unique_by(df.unionAll(df), "k", "loans").collect()


def test_coverage(frame):
    df, other = frame("k int", [(1,), (2,), (None,)]), frame("k int", [(1,), (1,), (2,), (None,)])
    assert rows(expect_covered(df, other, "k")) == [(3, 3, 3, True)]
    assert rows(expect_covered(df.unionAll(df), other, "k")) == [(6, 3, 6, False)]
    assert rows(expect_covered(df, other.filter("k = 1"), "k")) == [(3, 3, 1, False)]
    assert rows(duplicate_keys(other, "k")) == [(1,)]
    assert rows(missing_report(frame("k int, a int, b int", [(1, None, None), (2, 1, None)]), "k", {"no a": "a", "no b": "b"})) == [
        (1, "no a"), (1, "no b"), (2, "no b"),
    ]


def test_shares_and_month_totals(frame):
    df = frame("t int, c string, b double", [(1, "x", 1.0), (1, "y", 3.0), (1, None, 4.0), (2, "x", 1.0), (2, "y", None), (None, "x", 2.0), (3, "x", 0.0)])
    assert rows(category_share(df, "t", "c", "b")) == [
        (None, "x", 2.0, 2.0, 1.0), (1, None, 4.0, 8.0, 0.5), (1, "x", 1.0, 8.0, 0.125), (1, "y", 3.0, 8.0, 0.375),
        (2, "x", 1.0, None, None), (2, "y", None, None, None), (3, "x", 0.0, 0.0, None),
    ]
    totals = {r.t: r.s for r in month_total(df, "t", "b", "s").collect()}
    assert totals == {1: 8.0, 2: None, None: 2.0, 3: 0.0}


def test_table_of_statistics(frame):
    df = frame("x double, y double", [(1.0, None), (3.0, 5.0)])
    out = calibration_table(df, {"a": {"mean": F.avg("x")}, "b": {"mean": F.avg("y"), "n": F.count("y")}})
    assert rows(out) == [("a", "mean", 2.0), ("b", "mean", 5.0), ("b", "n", 1.0)]
    assert rows(means(df, ["x", "y"])) == [("x", 2.0), ("y", 5.0)]
    assert rows(means(df, ["x", "y"], strict=True)) == [("x", 2.0), ("y", None)]
