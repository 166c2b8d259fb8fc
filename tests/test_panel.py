"""The loan-month panel on small inputs, and both of its forms against each other."""

from __future__ import annotations

import dataclasses
from datetime import date

import pytest
from helpers import rows
from pyspark.sql import functions as F

from creditladder.plans.panel import OUTPUT, PanelSources, active_as_of, build_panel
from workload.queries_tables import panel_sources
from workload.registry import Inputs

JAN, FEB, MAR, APR = (date(2016, m, d) for m, d in ((1, 31), (2, 29), (3, 31), (4, 30)))


@pytest.fixture
def sources(frame):
    return PanelSources(
        balances=frame("loan_id long, date date, balance double", [(1, JAN, 500.0), (1, FEB, 600.0), (1, APR, 700.0), (2, JAN, 200.0), (3, JAN, 900.0)]),
        ratings=frame(
            "loan_id long, date date, monitor_score double, risk_category_sf string, _ord long",
            [(1, date(2016, 2, 10), 65.0, "Watch List", 0), (1, date(2016, 2, 10), 71.0, "Current", 1), (1, MAR, 10.0, "Doubtful", 2), (None, JAN, 1.0, "x", 3)],
        ),
        payments=frame(
            "loan_id long, date date, paid double, disbursed double",
            [(1, date(2016, 2, 3), 400.0, None), (1, date(2016, 2, 20), 500.0, 5.0), (1, date(2016, 3, 1), 100.0, None), (None, JAN, 1.0, 1.0), (1, None, 9.0, 9.0)],
        ),
        maturities=frame("loan_id long, date date, maturity_date date, outstanding_principal double", [(1, FEB, date(2020, 2, 28), 1.0)]),
        categories=frame("loan_id long, date date, risk_category int", [(1, JAN, 2), (1, FEB, 2), (1, APR, 2), (3, JAN, None), (9, JAN, 4)]),
        collateral=frame("loan_id long, collateral_type string", [(1, "Real Estate"), (3, None)]),
        guarantees=frame("loan_id long, guarantee double", [(1, 0.5)]),
        recoveries=frame("loan_id long, recovery double", [(3, 7.0)]),
        pds=frame(
            "loan_id long, pd_one_year double, close_date date, maturity_at_origination date, active int, wo string",
            [(1, 0.1, None, date(2018, 1, 30), 1, "Performing"), (2, 0.1, None, None, 0, None)],
        ),
    )


@pytest.mark.parametrize("form", ["error", "repeat"])
def test_small_panel(sources, form):
    df = build_panel(sources, form)
    assert df.columns == OUTPUT
    got = {(r.loan_id, r.date): r for r in df.collect()}
    # The balance of exactly 200 falls below the floor; the payment-only March is gone too.
    assert sorted(got) == [(1, JAN), (1, FEB), (1, APR), (3, JAN)]
    jan, feb, apr, three = got[1, JAN], got[1, FEB], got[1, APR], got[3, JAN]
    # Of the two ratings of one day the later row counts; it is carried down, and up before it. The
    # March rating has no balance row to stand on.
    assert [r.risk_category_sf for r in (jan, feb, apr)] == ["Current"] * 3
    assert [r.paid_cum for r in (jan, feb, apr)] == [None, 900.0, 1000.0]
    assert [r.pmt_1k for r in (jan, feb, apr)] == [0, 0, 1]
    assert [r.maturity_date for r in (jan, feb, apr)] == [None, date(2020, 2, 28), date(2020, 2, 28)]
    # March has no category, so April starts a new spell but counts on in total.
    assert [r.months_in_risk_cat for r in (jan, feb, apr)] == [1, 2, 1]
    assert [r.months_in_risk_cat_cum for r in (jan, feb, apr)] == [1, 2, 3]
    assert jan.remaining_tenor == pytest.approx(730 / 365) and jan.pd == pytest.approx(1 - 0.9**2)
    assert (jan.current, jan.special_mention, jan.substandard, jan.doubtful) == (1, 1, 0, 0)
    assert (jan.collateral, jan.guarantee, three.collateral, three.recovery) == (True, 0.5, False, 7.0)
    assert (three.pd, three.wo, three.current, three.special_mention, three.watch_list) == (None, None, None, None, 0)


def test_repeated_keys(sources):
    doubled = dataclasses.replace(sources, guarantees=sources.guarantees.unionAll(sources.guarantees))
    with pytest.raises(Exception, match="guarantees: repeated key loan_id"):
        build_panel(doubled).collect()
    assert build_panel(doubled, "repeat").filter("loan_id = 1").count() == 6
    doubled = dataclasses.replace(sources, balances=sources.balances.unionAll(sources.balances))
    with pytest.raises(Exception, match="balances: repeated key loan_id, date"):
        build_panel(doubled).collect()
    with pytest.raises(ValueError):
        build_panel(sources, "other")


def test_unreadable_months_stand_apart_from_every_month(sources, frame):
    """The last month a date can have is a month like any other; unreadable ones come after it."""
    last = date(9999, 12, 31)
    balances = frame("loan_id long, date date, balance double", [(1, last, 300.0), (1, None, 400.0), (4, None, 500.0)])
    months = dataclasses.replace(sources, balances=balances, maturities=sources.maturities.limit(0), payments=sources.payments.limit(0))
    for form in ("error", "repeat"):
        got = build_panel(months, form).select("loan_id", "date", "balance", "months_in_risk_cat_cum")
        assert set(map(tuple, got.collect())) == {(1, last, 300.0, 1), (1, None, 400.0, 2), (4, None, 500.0, 1)}


def test_forms_agree_on_test_data(spark, sf):
    src = panel_sources(Inputs(spark, sf("0.001")))
    digits = dict.fromkeys(("paid_cum", "disb_cum", "pd", "remaining_tenor", "balance", "recovery"), 6)
    a, b = (build_panel(src, f).withColumns({c: F.round(c, n) for c, n in digits.items()}) for f in ("error", "repeat"))
    assert rows(a) == rows(b)


def test_active_on_a_day(frame):
    df = frame("loan_id long, date date, balance double, active int", [(1, JAN, 5.0, 9), (1, FEB, 0.0, 9), (2, JAN, 0.0, 9), (2, FEB, 5.0, 9), (3, JAN, None, 9)])
    got = {r.loan_id: r.active for r in active_as_of(df, "2016-01-31").collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_panel_properties(spark, sf):
    df = build_panel(panel_sources(Inputs(spark, sf("0.001"))))
    bad = df.filter("pd < 0 or pd > 1 or months_in_risk_cat > months_in_risk_cat_cum or remaining_tenor < 1 or balance <= 200")
    assert bad.count() == 0
    assert df.groupBy("loan_id", "date").count().filter("count > 1").count() == 0


def test_missing_loan_ids_meet_in_the_join_by_join_form(sources):
    """A missing loan id is an id of its own there, apart from the id 0."""
    more = lambda df, *added: df.union(df.sparkSession.createDataFrame(list(added), df.schema))
    src = dataclasses.replace(
        sources,
        balances=more(sources.balances, (None, JAN, 800.0), (None, FEB, 800.0), (0, FEB, 300.0)),
        categories=more(sources.categories, (None, JAN, 3), (None, FEB, 3), (0, FEB, 3)),
        guarantees=more(sources.guarantees, (None, 0.25), (0, 0.75)),
    )
    got = {(r.loan_id, r.date): r for r in build_panel(src, "repeat").filter("loan_id is null or loan_id = 0").collect()}
    assert sorted(got, key=str) == [(0, FEB), (None, JAN), (None, FEB)]
    assert {k: (r.guarantee, r.months_in_risk_cat) for k, r in got.items()} == {(0, FEB): (0.75, 1), (None, JAN): (0.25, 1), (None, FEB): (0.25, 2)}
    assert got[None, JAN].paid_cum == got[None, FEB].paid_cum == 1.0
