from __future__ import annotations

from datetime import date

import pytest
from helpers import rows

from creditladder.plans.exposure import build_exposure, clean_exposure, expected_loss, loan_loss_output, portfolio_loss
from workload.queries_models import loss_rows
from workload.registry import Inputs

JAN, FEB, MAR = date(2016, 1, 1), date(2016, 2, 1), date(2016, 3, 1)


@pytest.fixture
def inputs(frame):
    balances = frame("loan_id long, time date, balance double", [(1, JAN, 1000.0), (1, FEB, 499.0), (2, JAN, 2000.0), (9, JAN, 800.0), (9, MAR, -5.0), (None, JAN, 600.0)])
    profile = frame(
        "loan_id long, rc_opp_number string, pd double, pd_sm_wo double, pd_sub_wo double, pd_d_wo double, wo string",
        [(1, "A", 0.1, 0.2, 0.3, 0.4, "x"), (2, "B", 0.1, None, 0.3, 0.4, "x"), (3, "C", 0.1, 0.2, 0.3, 0.4, "x")],
    )
    guarantees = frame("loan_id long, guarantee double, notes string", [(1, 0.5, "half")])
    ratings = frame("rc_opp_number string, time date, risk_category string", [("A", JAN, "Substandard"), ("B", JAN, "Special Mention"), (None, JAN, "Doubtful")])
    return balances, profile, guarantees, ratings


def test_exposure_rows(inputs):
    pro = clean_exposure(build_exposure(*inputs))
    got = {(r.loan_id, r.time): (r.balance, r.guarantee, r.risk_category) for r in pro.collect()}
    assert got == {
        (1, JAN): (1000.0, 0.5, "Substandard"),
        (1, FEB): (0.0, 0.5, "Current"),
        (2, JAN): (2000.0, 0.0, "Special Mention"),
        (3, None): (None, 0.0, None),
        (9, JAN): (800.0, 0.0, "Doubtful"),  # no profile, so no number: it meets the rating without one
        (9, MAR): (0.0, 0.0, None),  # a negative balance keeps its unknown category
        (None, JAN): (600.0, 0.0, "Doubtful"),
    }
    kept_apart = clean_exposure(build_exposure(*inputs, null_keys="drop"))
    assert {r.risk_category for r in kept_apart.filter("loan_id = 9 and balance > 0").collect()} == {"Current"}


def test_losses(inputs):
    el = expected_loss(clean_exposure(build_exposure(*inputs)))
    got = {(r.loan_id, r.time): r.el for r in el.collect()}
    assert got[1, JAN] == pytest.approx(0.3 * 1000 * 0.5 * 0.9)
    assert got[1, FEB] == 0.0 and got[2, JAN] is None and got[9, JAN] is None
    months = {r.time: r for r in portfolio_loss(el).collect()}
    # January: loan 2 has no probability for its category. March has none at all and drops out; the row
    # without a month has no category, so no probability either.
    assert sorted(months) == [JAN, FEB]
    assert months[JAN].port_balance == 1000.0 and months[JAN].p_balance_all == 4400.0
    assert months[JAN].port_loss == pytest.approx(0.135) and months[JAN].portfolio_with_data == pytest.approx(1000 / 4400)
    assert months[FEB].port_loss is None and months[FEB].el_portfolio == 0.0
    assert loan_loss_output(el).columns == [
        "loan_id", "time", "balance", "pd", "pd_sm_wo", "pd_sub_wo", "pd_d_wo", "wo", "guarantee", "notes", "risk_category", "pd_profile", "el",
    ]


def test_loss_never_exceeds_balance(spark, sf):
    el = loss_rows(Inputs(spark, sf("0.001")))
    assert el.filter("el > balance or el < 0 or pd_profile > 1").count() == 0


def test_ratings_repeat_rows(inputs):
    balances, profile, guarantees, ratings = inputs
    pro = build_exposure(balances, profile, guarantees, ratings.unionAll(ratings.filter("rc_opp_number = 'A'")), duplicates="repeat")
    assert len([r for r in rows(pro.filter("loan_id = 1 and time is not null").select("loan_id", "time"))]) == 3


def test_repeated_ratings_fail_unless_asked_for(inputs, frame):
    balances, profile, guarantees, ratings = inputs
    for number in ("A", "", None):
        twice = ratings.unionByName(frame(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ratings.schema), [(number, MAR, "Current")] * 2))
        with pytest.raises(Exception, match="repeated key"):
            build_exposure(balances, profile, guarantees, twice).collect()
        assert build_exposure(balances, profile, guarantees, twice, duplicates="repeat").count() >= 7
    with pytest.raises(Exception, match="guarantees: repeated key"):
        build_exposure(balances, profile, guarantees.union(guarantees), ratings).collect()
    with pytest.raises(ValueError):
        build_exposure(*inputs, duplicates="x")
