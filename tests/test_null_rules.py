"""Null, text and ordering rules, each on a tiny frame."""

from __future__ import annotations

from datetime import date

import pytest
from helpers import rows
from pyspark.sql import functions as F

from creditladder.functions import features as feat
from creditladder.functions import nulls, parsing
from creditladder.functions.dates import month_end, month_start
from creditladder.functions.ladder import is_writeoff, pit_flags, reached_flags
from creditladder.operators import aggregates as agg
from creditladder.operators import windows
from creditladder.operators.joins import anti, merge, semi
from creditladder.operators.reshape import gather_long


def one(df):
    return df.first()[0]


def test_merge_matches_null_keys_or_not(frame):
    left = frame("k int, a string", [(1, "a"), (None, "n"), (3, "c")])
    right = frame("k int, b string", [(1, "x"), (None, "y"), (4, "z")])
    assert rows(merge(left, right, "k", "left")) == [(None, "n", "y"), (1, "a", "x"), (3, "c", None)]
    assert rows(merge(left, right, "k", "left", null_keys="drop")) == [(None, "n", None), (1, "a", "x"), (3, "c", None)]
    for hot in (False, True):
        full = merge(left, right, "k", "full", hot_keys=hot)
        assert rows(full) == [(None, "n", "y"), (1, "a", "x"), (3, "c", None), (4, None, "z")]
        full = merge(left, right, "k", "full", null_keys="drop", hot_keys=hot)
        assert rows(full) == [(None, None, "y"), (None, "n", None), (1, "a", "x"), (3, "c", None), (4, None, "z")]
    assert rows(semi(left, right, "k").select("k")) == [(None,), (1,)]
    assert rows(anti(left, right, "k").select("k")) == [(3,)]


def test_merge_repeats_duplicates_and_suffixes_clashes(frame):
    left = frame("k int, v int", [(1, 10), (1, 11)])
    right = frame("k int, v int", [(1, 20), (1, 21)])
    out = merge(left, right, "k")
    assert out.columns == ["k", "v_x", "v_y"]
    assert rows(out) == [(1, 10, 20), (1, 10, 21), (1, 11, 20), (1, 11, 21)]
    assert rows(merge(left, right)) == []  # natural: both columns are keys
    with pytest.raises(ValueError):
        merge(left, right.toDF("x", "y"))


def test_unknown_condition_gives_unknown(frame):
    df = frame("c int", [(1,), (0,), (None,)])
    got = df.select("c", nulls.if_known(F.col("c") > 0, F.lit("y"), F.lit("n")).alias("v"))
    assert rows(got, "c") == [(None, None), (0, "n"), (1, "y")]


def test_replace_skips_unknown_conditions(frame):
    df = frame("c int", [(5,), (1,), (None,)])
    assert rows(df.select(nulls.replace_where("c", F.col("c") > 2, F.lit(9)).alias("v"))) == [(None,), (1,), (9,)]


def test_lower_bound_leaves_null(frame):
    df = frame("x double", [(0.2,), (3.0,), (None,)])
    assert rows(df.select(nulls.raise_to("x", 1).alias("x"))) == [(None,), (1.0,), (3.0,)]


def test_strict_and_skipping_sums(frame):
    df = frame("g int, x double", [(1, 1.0), (1, 2.0), (2, 1.0), (2, None), (3, None)])
    assert rows(agg.sum_by(df, "g", "x", "s")) == [(1, 3.0), (2, None), (3, None)]
    assert rows(agg.total_by(df, "g", "x", "s")) == [(1, 3.0), (2, 1.0), (3, 0.0)]
    assert rows(df.groupBy("g").agg(nulls.avg_strict("x").alias("m"))) == [(1, 1.5), (2, None), (3, None)]
    assert one(df.filter("g > 9").agg(nulls.sum_strict("x"))) == 0.0


def test_division_by_zero_is_unknown(frame):
    df = frame("a double, b double", [(0.0, 0.0), (1.0, 0.0), (1.0, 2.0)])
    assert rows(df.select(nulls.ratio(F.col("a"), F.col("b")).alias("r"))) == [(None,), (None,), (0.5,)]


def test_parsers_turn_junk_into_null(frame):
    df = frame("s string", [("1,234.5",), ("x",), (None,)])
    assert rows(df.select(parsing.parse_number("s").alias("v"))) == [(None,), (None,), (1234.5,)]
    df = frame("s string", [(" 12 ",), ("12.0",), ("12.5",), ("a1",), ("",), ("-7",)])
    assert rows(df.select(parsing.parse_id("s").alias("v"))) == [(None,), (None,), (None,), (-7,), (12,), (12,)]
    df = frame("s string", [("85%",), ("n/a",), ("7.5",)])
    assert rows(df.select(parsing.parse_percent("s").alias("v"))) == [(None,), (0.075,), (0.85,)]
    df = frame("s string", [("1/5/2015",), ("12/31/2015",), ("01/05/2015",), ("2015-01-05",), ("13/1/2015",)])
    got = rows(df.select(parsing.parse_date("s").alias("v")))
    assert got == [(None,), (None,), (date(2015, 1, 5),), (date(2015, 1, 5),), (date(2015, 12, 31),)]
    df = frame("s string", [("Jan-2016",), ("",)])
    assert rows(df.select(parsing.parse_month_label("s").alias("v"))) == [(None,), (date(2016, 1, 1),)]
    df = frame("s string", [("X1.31.2016",), ("Loan",)])
    assert rows(df.select(parsing.parse_date("s", parsing.COLUMN_NAME_DATE).alias("v"))) == [(None,), (date(2016, 1, 31),)]


def test_text_rule(frame):
    df = frame("s string", [("",), (None,), ("NA",), ("a",)])
    assert rows(df.select(parsing.text("s").alias("v"))) == [(None,), ("",), ("",), ("a",)]


def test_writeoff_encodings(frame):
    assert [r[0] for r in frame("w string", [("Writeoff",), ("Performing",), ("1",), (None,)]).select(is_writeoff("w")).collect()] == [True, False, True, None]
    assert [r[0] for r in frame("w int", [(1,), (0,), (None,)]).select(is_writeoff("w")).collect()] == [True, False, None]


def test_null_sorts_last_in_windows(frame):
    df = frame("g int, d int, x double", [(1, None, 1.0), (1, 1, 10.0), (1, 2, 100.0)])
    assert rows(windows.running_sum(df, {"s": "x"}, "g", "d"), "d") == [(1, None, 1.0, 111.0), (1, 1, 10.0, 10.0), (1, 2, 100.0, 110.0)]


def test_spells_break_at_every_null(frame):
    cats = [1, 1, 2, 2, None, None, 1, 1, 1]
    df = frame("g int, d int, c int", [(7, i, c) for i, c in enumerate(cats)])
    run = windows.run_length(df, "g", "d", "c", "n")
    assert [r.n for r in run.orderBy("d").collect()] == [1, 2, 1, 2, 1, 1, 1, 2, 3]
    cum = windows.cumulative_count(df, ["g", "c"], "d", "n")
    assert [r.n for r in cum.orderBy("d").collect()] == [1, 2, 1, 2, 1, 2, 3, 4, 5]


def test_unpivot_keeps_nulls(frame):
    df = frame("id int, a double, b double", [(1, None, 2.0)])
    assert rows(gather_long(df, ["id"], ["a", "b"], "k", "v", {"a": "first"})) == [(1, "b", 2.0), (1, "first", None)]


def test_counts_of_pairs_ignore_nulls(frame):
    df = frame("a int, b int", [(1, 1), (1, 1), (1, None), (None, 1)])
    assert rows(agg.crosstab_long(df, "a", "b")) == [(1, 1, 2)]
    assert rows(agg.value_counts(df, "a")) == [(1, 3)]
    assert rows(agg.null_counts(df)) == [("a", 1), ("b", 1)]


def test_last_row_on_ties_is_last_in_the_file(frame):
    df = frame("g int, d int, o int, v string", [(1, 5, 0, "a"), (1, 5, 1, "b"), (2, 1, 2, "c"), (2, None, 3, "d")])
    assert rows(windows.last_per(df, "g", ["d", "o"]).select("g", "v")) == [(1, "b"), (2, "d")]


def test_negative_base_power_is_nan(frame):
    value = one(frame("p double, t double", [(1.5, 1.5)]).select(feat.cumulative_pd("p", "t")))
    assert value != value


def test_month_edges(frame):
    df = frame("d date", [(date(2016, 2, 1),), (date(2016, 2, 29),)])
    assert rows(df.select(month_end("d"), month_start("d"))) == [(date(2016, 2, 29), date(2016, 2, 1))] * 2


def test_tenor(frame):
    df = frame(
        "m date, o date, d date",
        [(date(2017, 1, 1), None, date(2015, 1, 2)), (None, date(2015, 2, 1), date(2015, 1, 1)), (None, None, date(2015, 1, 1))],
    )
    assert [r[0] for r in df.select(feat.remaining_tenor("m", "o", "d")).collect()] == [2.0, 1.0, None]


def test_flags(frame):
    df = frame("s double, p double", [(60.0, 1000.0), (70.0, 999.0), (None, None)])
    got = df.select(feat.on_watch_list("s").alias("w"), feat.has_paid("p").alias("p"))
    assert [tuple(r) for r in got.collect()] == [(1, 1), (0, 0), (0, 0)]
    df = frame("t string", [("Real Estate - farm",), ("x Equipment and Machinery",), ("Stock",), (None,)])
    assert [r[0] for r in df.select(feat.hard_collateral("t")).collect()] == [True, True, False, False]


def test_reached_flags_and_unknowns(frame):
    df = frame("c int, wo string", [(2, "Performing"), (1, "Writeoff"), (None, "Performing"), (None, "Writeoff"), (4, None)])
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in reached_flags("c", "wo").items()]).collect()]
    assert got == [(1, 1, 0, 0), (1, 1, 1, 1), (None, None, None, None), (None, 1, 1, 1), (1, None, None, None)]


def test_point_in_time_flags(frame):
    df = frame("c int, b double", [(0, 5.0), (0, 0.0), (6, 5.0), (18, None), (None, 5.0), (0, None)])
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in pit_flags("c", "b").items()]).collect()]
    assert got == [
        (1, 1, 0, 0, 0), (0, 0, 0, 0, 0), (1, 0, 1, 0, 0), (None, 0, 0, 0, 1), (1, None, None, None, None),
        (None, None, 0, 0, 0),
    ]


def test_weighted_means(frame):
    df = frame("p double, w double", [(0.5, 10.0), (None, 30.0), (0.1, 10.0)])
    assert one(df.agg(agg.weighted_mean("p", "w", "each"))) == pytest.approx(6 / 50)
    assert one(df.agg(agg.weighted_mean("p", "w", "pair"))) == pytest.approx(6 / 20)
    assert one(df.agg(agg.weighted_mean("p", "w", "strict"))) is None
    hole = frame("p double, w double", [(0.5, None), (0.1, 10.0)])
    assert one(hole.agg(agg.weighted_mean("p", "w", "pair"))) is None
    assert one(hole.agg(agg.weighted_mean("p", "w", "each"))) == pytest.approx(0.1)


def test_weighted_rate_needs_known_states(frame):
    df = frame("w double, s string", [(10.0, "Writeoff"), (30.0, "Performing")])
    assert one(df.agg(agg.weighted_rate("w", is_writeoff("s")))) == 0.25
    hole = frame("w double, s string", [(10.0, "Writeoff"), (30.0, None)])
    assert one(hole.agg(agg.weighted_rate("w", is_writeoff("s")))) is None


def test_writeoff_encodings(frame):
    texts = frame("i int, s string", [(1, "Writeoff"), (2, "1"), (3, "1.0"), (4, "0"), (5, "0.0"), (6, "Performing"), (7, None)])
    assert [r.w for r in texts.select("i", is_writeoff("s").alias("w")).orderBy("i").collect()] == [True, True, True, False, False, False, None]
    numbers = frame("i int, n int, d double", [(1, 1, 1.0), (2, 0, 0.0), (3, None, None)])
    got = numbers.select("i", is_writeoff("n").alias("n"), is_writeoff("d").alias("d")).orderBy("i").collect()
    assert [(r.n, r.d) for r in got] == [(True, True), (False, False), (None, None)]
