"""Months added one by one against the panel built at once."""

from __future__ import annotations

import dataclasses
import random
import re
from datetime import date, timedelta

import pytest
from helpers import rows
from pyspark.sql import functions as F

from creditladder.plans.panel import PanelSources, build_panel, loan_table, months_table
from creditladder.plans.panel_append import MONTHLY, append_month, loan_state, with_first_ratings
from creditladder.sources.layout import read_by_key, write_by_key
from workload import queries_tables  # noqa: F401  (registers its queries)
from workload.registry import QUERIES

ENDS = [date(2016, m + 1, 1) - timedelta(1) for m in range(1, 9)]


def random_sources(frame, seed):
    """Loans with gaps, months of payments only, late first ratings, unknown categories and spells of all lengths."""
    rng = random.Random(seed)
    loans, day = range(1, 40), lambda e: e - timedelta(rng.randrange(25))
    cells = [(i, e) for i in loans for e in ENDS if i % 7 or e > ENDS[3]]
    late = {i: rng.choice([0, 0, 3, 6, 99]) for i in loans}
    return PanelSources(
        balances=frame("loan_id long, date date, balance double", [(i, e, float(rng.choice([100, 300, 900]))) for i, e in cells if rng.random() < 0.8]),
        ratings=frame(
            "loan_id long, date date, monitor_score double, risk_category_sf string, _ord long",
            [(i, day(e), rng.choice([None, 55.0, 65.0, 75.0]), rng.choice([None, "Current", "Doubtful"]), k)
             for k, (i, e) in enumerate(cells * 2) if ENDS.index(e) >= late[i] and rng.random() < 0.4],
        ),
        payments=frame("loan_id long, date date, paid double, disbursed double", [(i, day(e), rng.choice([None, 400.0]), rng.choice([None, 5.0])) for i, e in cells if rng.random() < 0.5]),
        maturities=frame("loan_id long, date date, maturity_date date, outstanding_principal double", [(i, e, rng.choice([None, date(2020, 1, i % 28 + 1)]), 1.0) for i, e in cells if rng.random() < 0.2]),
        categories=frame("loan_id long, date date, risk_category int", [(i, e, rng.choice([None, 1, 1, 1, 2, 3])) for i, e in cells if rng.random() < 0.9]),
        collateral=frame("loan_id long, collateral_type string", [(i, "Real Estate") for i in loans if i % 2]),
        guarantees=frame("loan_id long, guarantee double", [(1, 0.5)]),
        recoveries=frame("loan_id long, recovery double", [(3, 7.0)]),
        pds=frame(
            "loan_id long, pd_one_year double, close_date date, maturity_at_origination date, active int, wo string",
            [(i, i / 100, None, date(2018, 1, 30), i % 2, rng.choice([None, "Performing", "Writeoff"])) for i in loans if i % 5],
        ),
    )


def until(src, end):
    return dataclasses.replace(src, **{n: getattr(src, n).filter(F.col("date") <= F.lit(end)) for n in MONTHLY})


def written(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.schema(df.schema).parquet(str(path))


@pytest.mark.parametrize("seed", range(2))
def test_months_added_one_by_one(frame, tmp_path, seed):
    src = random_sources(frame, seed)
    old = until(src, ENDS[2])
    state, panel = loan_state(months_table(old)), build_panel(old)
    gained = 0
    for k, end in enumerate(ENDS[3:]):
        month = append_month(src, state, end.isoformat())
        late = written(month.first_ratings, tmp_path / f"late{k}")
        gained += late.count()
        panel = written(with_first_ratings(panel, late).unionByName(month.panel), tmp_path / f"panel{k}")
        state = written(month.state, tmp_path / f"state{k}")
    digits = dict.fromkeys(("paid_cum", "disb_cum", "pd", "remaining_tenor"), 9)
    both = [df.withColumns({c: F.round(c, n) for c, n in digits.items()}) for df in (panel, build_panel(src))]
    assert rows(both[0]) == rows(both[1]) and gained > 3
    plain = lambda df: sorted((r.loan_id, r.last_month, r.paid_cum, r.risk_category_sf, r.last_category, r.spell, tuple(sorted(r.seen.items()))) for r in df.collect())
    assert plain(state) == plain(loan_state(months_table(src)))
    with pytest.raises(Exception, match="not older"):
        append_month(src, state, ENDS[-1].isoformat()).panel.collect()


def test_first_month_and_empty_month(frame):
    src = random_sources(frame, 5)
    nothing = loan_state(months_table(until(src, date(2000, 1, 1))))
    first = append_month(src, nothing, ENDS[0].isoformat())
    assert rows(first.panel) == rows(build_panel(until(src, ENDS[0]))) and first.first_ratings.count() == 0
    later = append_month(src, first.state, "2030-05-05")
    assert later.panel.count() == 0 and rows(later.state.drop("seen")) == rows(first.state.drop("seen"))
    unread = dataclasses.replace(src, balances=src.balances.union(src.balances.limit(1).withColumn("date", F.lit(None).cast("date"))))
    with pytest.raises(Exception, match="without a date"):
        loan_state(months_table(unread)).collect()


def test_append_reads_one_month_and_the_state(spark, frame, tmp_path):
    """Sources stored by month, the state stored by loan: one month's folders are scanned, the state does not travel."""
    src = random_sources(frame, 1)
    by_month = {}
    for n in MONTHLY:
        df = getattr(src, n).withColumn("month", F.last_day("date"))
        df.write.partitionBy("month").parquet(str(tmp_path / n))
        by_month[n] = spark.read.schema(df.schema).parquet(str(tmp_path / n)).filter(F.col("month") == F.lit(ENDS[3])).drop("month")
    state = write_by_key(loan_state(months_table(until(src, ENDS[2]))), str(tmp_path / "state"), "loan_id", "last_month", 4)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(keep, ("false", "-1", "4")):
        spark.conf.set(k, v)
    try:
        month = append_month(dataclasses.replace(src, **by_month), read_by_key(spark, str(tmp_path / "state")), ENDS[3].isoformat())
        text = month.panel._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    scans = re.findall(r"PartitionFilters: \[([^]]*)\]", text)
    assert sum("2016-04-30" in s for s in scans) == len(MONTHLY), scans
    assert text.count("laid_out_") == 1
    state_scan = text[: text.index("laid_out_")]
    assert "Exchange" not in state_scan.rsplit("SortMergeJoin", 1)[1].rsplit("+- *", 2)[-1]
    assert rows(month.panel.select("loan_id", "balance")) == rows(build_panel(src).filter(F.col("date") == F.lit(ENDS[3])).select("loan_id", "balance"))


def test_durable_month_is_computed_once(spark, frame, tmp_path):
    """The month's rows are stored once and the loans' table is taken as given; the results are the same."""
    src = random_sources(frame, 3)
    state = written(loan_state(months_table(until(src, ENDS[2]))), tmp_path / "state")
    loans = written(loan_table(src), tmp_path / "loans")
    plain, durable = (append_month(src, state, ENDS[3].isoformat(), **more) for more in ({}, {"loans": loans, "durable": True}))
    for name in ("panel", "first_ratings"):
        assert rows(getattr(plain, name)) == rows(getattr(durable, name))
    assert rows(plain.state.drop("seen")) == rows(durable.state.drop("seen"))
    for df in (durable.panel, durable.first_ratings, durable.state):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "ExistingRDD" not in text and "LocalTableScan" not in text, text


def test_panel_append_reads_each_given_table_a_fixed_number_of_times(spark, sf):
    """What is stored is read back: the rows that come out do not go back to the given tables, however many months are added."""
    out = QUERIES["panel_append"](spark, sf("0.001"))
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in text and "l_shipdate" not in text and "c_custkey" not in text, text
    files = {re.sub(r"-[0-9a-f]{12}/.*", "", f).rsplit("/", 1)[1] for f in out.inputFiles()}
    assert files == {"months", "loans", "month"}, files
