"""Whole runs from export files to result tables."""

from __future__ import annotations

import random

import pytest

from creditladder import jobs
from creditladder.plans.panel_checks import COUNT_TABLES
from creditladder.sources.sinks import load_models

MONTHS = ["Jan-2014", "Feb-2014", "Mar-2014", "Apr-2016"]
MONTH_DATES = ["1/15/2014", "2/15/2014", "3/15/2014", "4/15/2016"]
MONTH_ENDS = ["1/31/2014", "2/28/2014", "3/31/2014", "4/30/2016"]
CATEGORIES = ["Current", "Special Mention", "Substandard", "Doubtful"]


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    """400 loans whose write-offs follow their probability and category."""
    rnd = random.Random(2)
    folder = tmp_path_factory.mktemp("exports")
    loans = []
    for i in range(1, 401):
        pd, u = rnd.random() * 0.6, rnd.random()
        rung = sum(u < s for s in (1.4 * pd, 0.9 * pd, 0.55 * pd))
        lost = rnd.random() < (0.02, 0.15, 0.4, 0.6)[rung] + pd / 3
        loans.append((i, round(pd, 4), rung, "Writeoff" if lost else "Performing", int(i % 3 == 0)))

    def write(export, *lines):
        (folder / f"{export}.csv").write_text("\n".join(lines) + "\n")

    write("payments", "Loan ID,Transaction/ Record Type,Date,Principal Disbursed,Principal Paid",
          *[f'{i},Pay,{d},,"1,{100 + i}.00"' for i, *_ in loans for d in MONTH_DATES[1:]])
    write("ratings", "Loan ID,Rating Date,Final Risk Score,Final Risk Category",
          *[f"{i},{d},{55 + i % 30},{CATEGORIES[r]}" for i, _, r, *_ in loans for d in MONTH_DATES])
    write("wide_categories", "Loan," + ",".join(MONTH_ENDS),
          *[f"{i}," + ",".join(str(min(r, k + i % 2) + 1) for k in range(4)) for i, _, r, *_ in loans])
    write("maturities", "Loan ID,Report Date,Maturity Date,Outstanding Principal",
          *[f"{i},{MONTH_ENDS[0]},12/31/{2016 + i % 4},5" for i, *_ in loans])
    write("collateral", "Loan ID,Collateral Type", *[f"{i},{'Real Estate' if i % 2 else 'Stock'}" for i, *_ in loans])
    write("guarantees", "List", "Close Date,Loan ID,Bank,% Guaranteed,Notes", *[f"1/1/2016,{i},b,{i % 90}%," for i, *_ in loans if i % 5 == 0], ",,,,", ",,,9%,footer")
    write("recoveries", "Loan ID,Internal Recoveries Paid", *[f"{i},10" for i, *_ in loans if i % 4 == 0])
    report = ["Title", "Time,LoanID,Balance,Risk", f"{MONTHS[0]},pad,0,", ",pad,0,"]
    for k, m in enumerate(MONTHS):
        report.append(f"{m},LoanID (Rollup),9,")
        report += [f',{i},"{1 + i % 7},{300 + i}",x' for i, *_, active in loans if k < 3 or active]
    write("balances", *report, ",Total,1,")
    write("profile_pds", "LoanID,pd,pd_one_year,Close.Date,Maturity.at.Origination,active,WO,RC.Opp.Number,pdSMWO,pdSubWO,pdDWO",
          *[f"{i},{p},{p / 2},{1 + i % 12}/1/2013,1/1/2017,{a},{w},OPP{i},{p / 2 + 0.3},{p / 2 + 0.4},{p / 2 + 0.5}" for i, p, _, w, a in loans])
    write("monthly_ratings", "RCOppNumber,a,b,RiskDate,RiskCategory", *[f"OPP{i},,,{MONTH_DATES[0]},{CATEGORIES[r]} " for i, _, r, *_ in loans])
    write("underwriting_pds", "LoanID,Max_Risk_Category,WO,active,pd,pd_multiple_years,RC.Opp.Number",
          *[f"{i},{CATEGORIES[r]},{w},{a},{p},{p},OPP{i}" for i, p, r, w, a in loans])
    write("payment_flags", "LoanID,watch_list,pmt_1k", *[f"{i},{i % 2},{int(i % 5 < 3)}" for i, *_ in loans])
    write("migration_pds", "LoanID,Max_Risk_Category,WO,active,pd,Risk_Category,balance_1215,EAD,LGD,Sector.and.Perishability,Loan.Type,Amount",
          *[f"{i},{CATEGORIES[r]},{int(w == 'Writeoff')},{a},{p},{CATEGORIES[r]},{100 * i},1,0.9,s,t,5" for i, p, r, w, a in loans])
    write("september_loans", "LoanID,last_year,pd,September_Risk_Category", *[f"{i},1,{p},{CATEGORIES[r]}" for i, p, r, *_ in loans])
    write("september_categories", "LoanID,risk_cat_9_2014,risk_cat_9_2015", *[f"{i},{6 * r},0" for i, _, r, *_ in loans])
    write("september_balances", "LoanID,balance_0914,balance_0915", *[f"{i},{i},{i % 2}" for i, *_ in loans])
    write("rated_loans", "LoanID,Risk.Rating.Category,WriteoffsDummy,active,balance_0915,last_year,Sector.and.Perishability,Loan.Type,amount,September_Risk_Category",
          *[f"{i},{1 + i % 4},{int(w == 'Writeoff')},{a},{i},1,s,t,5,{CATEGORIES[r]}" for i, _, r, w, a in loans])
    return str(folder)


def test_panel_and_its_models(spark, inputs, tmp_path):
    out = str(tmp_path)
    panel = jobs.run_panel(spark, inputs, out)
    assert panel.count() == 400 * 3 + 133
    assert panel.filter("pmt_1k = 1 and date = '2014-02-28'").count() == 400
    checks = {n: spark.read.csv(f"{out}/checks/panel_{n}", header=True).collect() for n in ("rows", "nulls", "month_totals", "counts")}
    n_rows = {r.stage: int(r.n) for r in checks["rows"]}
    # April has payments of all loans, but balances of the active ones only.
    assert n_rows == {"months": 1600, "above the floor": 1333, "panel": 1333, "repeated keys": 0, "balance without category": 0}
    nulls = {(r.stage, r.variable): int(r.n_null) for r in checks["nulls"]}
    assert nulls["months", "balance"] == 267 and nulls["panel", "balance"] == 0 and nulls["panel", "guarantee"] == panel.filter("guarantee is null").count()
    assert len(checks["month_totals"]) == 4
    pairs = {(r.first, r.second) for r in checks["counts"]}
    assert pairs == set(COUNT_TABLES)
    assert all(sum(int(r.n) for r in checks["counts"] if (r.first, r.second) == p) == 1333 for p in pairs)
    rejected = spark.read.csv(f"{out}/checks/rejected", header=True)
    assert rejected.columns == ["export", "_ord", "field", "text", "reason", "dropped"] and rejected.count() == 0
    for all_dates in (False, True):
        models = jobs.run_panel_models(panel, f"{out}/models{all_dates}", all_dates=all_dates)
        assert len(models) == 6 and models["current"].status == "ok"
    assert spark.read.csv(f"{out}/modelsTrue/coefficients", header=True).count() >= 6


def test_loan_models_and_loss(spark, inputs, tmp_path):
    out = str(tmp_path)
    profile = jobs.run_loan_models(spark, inputs, out)
    assert profile.count() == 400 and profile.filter("pd_d_wo is null").count() == 0
    assert spark.read.csv(f"{out}/report/coverage", header=True).first().ok == "true"
    assert set(load_models(out, spark)) == {"current", "watch_list", "paid_1k", "special_mention", "substandard", "doubtful"}
    losses = jobs.run_loss(spark, inputs, out)
    assert losses.count() == 4 and losses.filter("port_loss <= 0 or portfolio_with_data <> 1").count() == 0


def test_migration_and_point_in_time(spark, inputs, tmp_path):
    out = str(tmp_path)
    chain = jobs.run_migration(spark, inputs, out)
    assert {m.status for m in chain.values()} == {"ok"}
    book = spark.read.parquet(f"{out}/migration_pds")
    assert book.columns == ["loan_id", "pd", "risk_category", "balance_1215", "ead", "lgd", "sector", "loan_type", "amount", "pd_active"]
    assert book.count() == 133 and book.filter("pd_active is null").count() == 0
    pit = jobs.run_point_in_time(spark, inputs, out, load_models(out, spark))
    assert {r.period: r["count"] for r in pit.groupBy("period").count().collect()} == {"0914": 400, "0915": 200}
    assert pit.filter("pd_active is null").count() == 0


def test_rating(spark, inputs, tmp_path):
    book = jobs.run_rating(spark, inputs, str(tmp_path))
    assert book.count() == 133
    counts = spark.read.csv(f"{tmp_path}/risk_rating_category_to_writeoffs", header=True)
    assert counts.selectExpr("sum(n)").first()[0] == 400
