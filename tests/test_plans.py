"""Shape of the physical plans, and results under skew."""

from __future__ import annotations

import re

import pytest
from helpers import rows
from pyspark.sql import functions as F

from creditladder.operators import aggregates as agg
from creditladder.operators import windows
from creditladder.operators.file_order import fill_down_ordered
from creditladder.operators.joins import merge
from creditladder.plans import migration
from creditladder.plans.panel import PanelSources, active_as_of, active_as_of_stored, build_panel, one_per_month
from creditladder.sources import records
from creditladder.sources.layout import read_by_key, write_by_key
from workload import queries_models  # noqa: F401  (registers its queries)
from workload.queries_tables import panel_sources
from workload.registry import QUERIES, Inputs


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def static_plan(spark, make) -> str:
    """The plan with all exchanges in place and no broadcasts, as it runs on large inputs."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return plan(make())
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


@pytest.fixture
def stored(spark, sf, tmp_path):
    """Panel sources as stored tables, so that only the panel's own steps show in its plan."""
    src = panel_sources(Inputs(spark, sf("0.001")))
    tables = {}
    for name in PanelSources.__dataclass_fields__:
        path = str(tmp_path / name)
        getattr(src, name).write.parquet(path)
        tables[name] = spark.read.parquet(path)
    return PanelSources(**tables)


def test_panel_exchanges_and_sorts(spark, stored):
    text = static_plan(spark, lambda: build_panel(stored))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    keys = sorted(tuple(re.sub(r"#\d+L?", "", c).strip() for c in e.split(",")[:-1]) for e in exchanges)
    # Months: one for the combined sources, one for the ratings. Loans: one for all windows and the join,
    # one for the loan table.
    assert keys == [("loan_id",), ("loan_id",), ("loan_id", "__month"), ("loan_id", "__month")], keys
    assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text
    windows_block = text[: text.index("hashpartitioning")]
    assert len(re.findall(r"\bSort \[", windows_block)) <= 3, windows_block


def test_panel_filters_and_columns_reach_the_scan(stored):
    text = plan(build_panel(stored).select("loan_id", "date", "pmt_1k"))
    assert "maturity_date" not in text and "collateral_type" not in text
    assert "IsNotNull(loan_id)" in text


def test_scalar_means_read_the_book_once(spark, sf):
    from workload.queries_models import _fixed_migrations

    df = _fixed_migrations(Inputs(spark, sf("0.001"))("book"))
    out = df.select("loan_id", migration.active_pd_avg(df).alias("p"))
    out.collect()
    final = plan(out)
    final = final[: final.index("== Initial Plan ==")] if "== Initial Plan ==" in final else final
    assert len(re.findall(r"[-+] Subquery subquery", final)) == 1, final
    assert "Join Cross" not in final and "NestedLoop" not in final


def test_all_queries_are_registered():
    assert len(QUERIES) >= 100


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_multiplies_its_inputs(spark, sf, name):
    text = plan(QUERIES[name](spark, sf("0.001")))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


@pytest.fixture
def skewed(spark):
    """Payments of which one loan holds a third, in one month most of all."""
    n = 60_000
    loan = F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 997 + 2)
    day = F.date_add(F.lit("2015-01-01").cast("date"), (F.col("id") * 37 % 700).cast("int"))
    day = F.when(F.col("id") % 6 == 0, F.lit("2015-05-05").cast("date")).otherwise(day)
    return spark.range(n, numPartitions=12).select(
        loan.alias("loan_id"), day.alias("date"), (F.col("id") % 100 / 4).alias("paid"), F.lit(None).cast("double").alias("disbursed"), F.col("id").alias("_ord")
    )


def test_hot_loan_shrinks_before_it_travels(spark, skewed):
    """What one loan sends to the shuffle is bounded by months per input split, not by its rows."""
    monthly = windows.monthly_sums(skewed.withColumn("date", F.last_day("date")), ["loan_id", "date"], {"paid": "paid"})
    text = plan(monthly)
    assert text.index("partial_sum") > text.index("Exchange hashpartitioning")
    by_loan = monthly.filter("loan_id = 1")
    assert by_loan.count() <= 24
    total = windows.running_sum(monthly, {"cum": "paid"}, "loan_id", "date").filter("loan_id = 1").agg(F.max("cum")).first()[0]
    assert total == pytest.approx(skewed.filter("loan_id = 1").agg(F.sum("paid")).first()[0])
    ratings = skewed.select("loan_id", "date", F.col("paid").alias("monitor_score"), F.lit("x").alias("risk_category_sf"), "_ord")
    last = one_per_month(ratings)
    assert "partial_max_by" in plan(last)
    expected = skewed.filter("loan_id = 1 and date = '2015-05-31'").agg(F.max("_ord")).first()[0]
    best = skewed.filter("loan_id = 1 and month(date) = 5 and year(date) = 2015").orderBy(F.desc("date"), F.desc("_ord")).first()
    got = last.filter("loan_id = 1 and date = '2015-05-31'").first()
    assert got.monitor_score == best.paid and (expected is None or expected >= 0)


def test_hot_null_keys_in_joins(spark, skewed):
    left = skewed.select(F.when(F.col("loan_id") != 1, F.col("loan_id")).alias("k"), F.col("_ord").alias("a"))
    right = spark.createDataFrame([(None, 1), (5, 2), (5000, 3)], "k long, b int")
    plain, spread = (merge(left, right, "k", "full", hot_keys=h) for h in (False, True))
    assert rows(plain.groupBy("k").agg(F.count("*"), F.sum("b"))) == rows(spread.groupBy("k").agg(F.count("*"), F.sum("b")))
    assert spread.filter("k is null and b = 1").count() == 20_000
    assert "FullOuter" in plan(plain) and "FullOuter" not in plan(spread)


def test_skewed_left_join_is_split(spark, skewed, tmp_path):
    """Adaptive execution splits the hot key of a null-safe left join."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    keep = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        left = skewed.select(F.when(F.col("loan_id") != 1, F.col("loan_id")).alias("k"), "_ord")
        right = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("b"))
        df = merge(left, right, "k", "left")
        df.write.parquet(str(tmp_path / "out"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == 60_000
        df.collect()
        assert "isSkew" in plan(df) or "skewed=true" in plan(df) or "skew=true" in plan(df), plan(df)[:3000]
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_month_steps_have_no_month_wide_window(skewed):
    df = skewed.withColumn("t", F.trunc("date", "MM"))
    for out in (agg.month_total(df, "t", "paid", "s"), agg.category_share(df, "t", "loan_id", "paid")):
        assert "Window" not in plan(out)


def test_global_fill_orders_only_the_chunk_table(skewed):
    out = fill_down_ordered(skewed.select("_ord", F.when(F.col("_ord") % 5000 == 7, F.col("paid")).alias("v")), "v", chunk_rows=1000)
    text = static_plan(out.sparkSession, lambda: out)
    below_single = text[text.index("SinglePartition") :]
    assert "HashAggregate" in below_single or "ObjectHashAggregate" in below_single
    assert text.count("SinglePartition") == 1
    assert out.filter("v is null").count() == 7


def test_guarantee_report_is_scanned_in_many_tasks(spark, sf, monkeypatch):
    """The notes hold line breaks, and the file is still cut into splits; the records agree with a read in one piece."""
    names = {"spark.sql.files.maxPartitionBytes": "512", "spark.sql.files.openCostInBytes": "0"}
    whole = rows(QUERIES["guarantee_report"](spark, sf("0.01")))
    before = {k: spark.conf.get(k) for k in names}
    scan, tasks = records._lines, []

    def counted(spark, path):
        lines = scan(spark, path)
        tasks.append(spark.read.text(path, lineSep="\n").rdd.getNumPartitions())
        return lines

    monkeypatch.setattr(records, "_lines", counted)
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        assert rows(QUERIES["guarantee_report"](spark, sf("0.01"))) == whole
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks[0] > 4 and any("\n" in r[2] for r in whole)


def test_stored_panel_does_not_travel(spark, stored, tmp_path):
    """Stored by month and loan: the loans of one month are joined, and windows run, where the rows lie."""
    panel = write_by_key(build_panel(stored), str(tmp_path / "panel"), "loan_id", "date", 4)
    text = static_plan(spark, lambda: active_as_of_stored(panel, "2000-06-30"))
    # Nothing travels, and the loans are read of that one month only.
    assert "Exchange" not in text, text
    assert "date = 2000-06-30" in re.sub(r"#\d+L?", "", text) and "ReadSchema: struct<loan_id:bigint,balance:double>" in text
    along = static_plan(spark, lambda: windows.run_length(panel, "loan_id", "date", "risk_category", "n"))
    assert "Exchange" not in along
    by_loan = static_plan(spark, lambda: merge(panel, stored.guarantees.select("loan_id", F.lit(1).alias("g")), "loan_id", "left", null_keys="drop"))
    assert len(re.findall(r"Exchange ", by_loan)) == 1, by_loan
    again = read_by_key(spark, str(tmp_path / "panel"))
    spark.sql(f"drop table {[t.name for t in spark.catalog.listTables() if t.name.startswith('laid_out_')][-1]}")
    fresh = read_by_key(spark, str(tmp_path / "panel"))
    assert again.schema == fresh.schema and rows(active_as_of_stored(fresh, "2000-06-30").select("loan_id", "date", "active")) == rows(
        active_as_of(panel, "2000-06-30").select("loan_id", "date", "active")
    )
    assert "Exchange" not in static_plan(spark, lambda: windows.run_length(fresh, "loan_id", "date", "risk_category", "n"))


def test_joins_and_windows_by_loan_share_one_exchange(spark, stored):
    """In the join-by-join form the months travel once by loan, for the joins on it and for the windows."""
    text = static_plan(spark, lambda: build_panel(stored, "repeat"))
    exchanges = [re.sub(r"#\d+L?", "", e) for e in re.findall(r"Exchange hashpartitioning\((.*), \d+\), ", text)]
    by_loan = [e for e in exchanges if "loan" in e and "date" not in e and "month" not in e]
    # The months, and the running totals of payments; the tables of loans have renamed keys.
    assert sorted(by_loan) == ["__no_loan, __loan", "loan_id"], exchanges
