"""Sums that do not depend on the order of the rows."""

from __future__ import annotations

import math
import random
import struct

import pytest
from helpers import rows
from pyspark.sql import functions as F

from creditladder.functions.exact import exact_avg, exact_sum, exact_sum_or_zero, exact_sum_strict
from creditladder.operators.aggregates import calibration_bins, sum_by, total_by, weighted_mean
from creditladder.operators.windows import running_sum


def bits(x: float) -> bytes:
    return struct.pack(">d", x)


def wild(rng, n):
    return [rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randint(-30, 60) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_same_bits_under_any_partitioning(spark, frame, seed):
    rng = random.Random(seed)
    values = wild(rng, 3000) + [1e16, 1.0, -1e16, 0.1, -0.1, 0.0, -0.0]
    df = frame("i int, g int, x double, w double", [(i, i % 3, x, rng.random()) for i, x in enumerate(values)])
    seen = set()
    for n in (1, 3, 300):
        part = df.repartition(n, F.rand(n))
        got = part.groupBy("g").agg(exact_sum("x").alias("s"), exact_avg("x").alias("a"), weighted_mean("w", "x", exact=True).alias("m")).orderBy("g").collect()
        seen.add(b"".join(bits(v) for r in got for v in (r.s, r.a, r.m)))
        for r in got:
            want = math.fsum(x for i, x in enumerate(values) if i % 3 == r.g)
            assert r.s == pytest.approx(want, rel=4e-16)
    assert len(seen) == 1


def test_cancelling_sums_are_exact(frame):
    for values in ([1e20, 1.0, -1e20], [-1.0], [-(2.0**-60), 1.0, -1.0], [0.1] * 10, [-3.5, 2.25], [2.0**70, -(2.0**70), 2.0**-70], [-1e-3, 5e-4]):
        got = frame("x double", [(v,) for v in values]).agg(exact_sum("x")).first()[0]
        assert got == math.fsum(values), (values, got)


def test_null_and_odd_values(frame):
    df = frame("g string, x double", [("a", None), ("b", 1.5), ("b", None), ("c", float("inf")), ("c", 1.0), ("d", float("inf")), ("d", float("-inf")), ("e", float("nan"))])
    got = {r.g: r for r in df.groupBy("g").agg(exact_sum("x").alias("s"), exact_sum_strict("x").alias("t"), exact_sum_or_zero("x").alias("z")).collect()}
    assert (got["a"].s, got["a"].t, got["a"].z) == (None, None, 0.0)
    assert (got["b"].s, got["b"].t, got["b"].z) == (1.5, None, 1.5)
    assert got["c"].s == float("inf") and math.isnan(got["d"].s) and math.isnan(got["e"].s)
    empty = df.limit(0).agg(exact_sum("x").alias("s"), exact_sum_strict("x").alias("t")).first()
    assert (empty.s, empty.t) == (None, 0.0)
    with pytest.raises(Exception, match="(?i)overflow"):
        frame("x double", [(1e40,)]).agg(exact_sum("x")).collect()


def test_options_agree_with_plain_sums(frame):
    df = frame("g int, o int, x double", [(g, o, None if o == 2 else g + o / 4) for g in range(3) for o in range(5)])
    assert rows(sum_by(df, "g", "x", "s", exact=True)) == rows(sum_by(df, "g", "x", "s"))
    assert rows(total_by(df, "g", "x", "s", exact=True)) == rows(total_by(df, "g", "x", "s"))
    assert rows(running_sum(df, {"s": "x"}, "g", "o", exact=True)) == rows(running_sum(df, {"s": "x"}, "g", "o"))


def test_calibration_bins(frame):
    rng = random.Random(1)
    data = [(rng.random(), rng.choice([0, 1, None])) for _ in range(500)] + [(0.5, 1)] * 300 + [(None, 1)] * 7 + [(1.0, 0)]
    df = frame("p double, y int", data)
    got = calibration_bins(df, {"all": (F.lit(True), F.col("p")), "high": (F.col("p") > 0.8, F.col("p")), "none": (F.col("p") > 2, F.col("p"))}, F.col("y")).collect()
    for r in got:
        inside = [(p, y) for p, y in data if (p is None) == (r.bin is None) and (r.segment == "all" or (p or 0) > 0.8) and (p is None or r.low <= p <= r.high)]
        assert (r.n, r.n_unknown) == (len(inside), sum(y is None for _, y in inside))
        if r.bin is not None:
            assert r.mean_pd == pytest.approx(sum(p for p, _ in inside) / len(inside))
    of_all = [r for r in got if r.segment == "all"]
    assert sum(r.n for r in of_all) == len(data) and {r.segment for r in got} == {"all", "high"}
    # 300 equal predictions stay in one bin, so there are fewer than ten.
    assert max(r.n for r in of_all) >= 300 and all(r.n <= 120 for r in of_all if not (r.low or 0) <= 0.5 <= (r.high or 0))
