from __future__ import annotations

import math
import random

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from creditladder.functions.probability import active_pd, chain_products, next_downgrade
from creditladder.plans import migration, rating, segments
from creditladder.plans.models import (
    FittedLogit,
    Segment,
    coefficients,
    fit_linear,
    fit_logit,
    fit_logits,
    fit_rating_factor,
    score,
    score_rating_factor,
)
from creditladder.plans.separation import design, firth, separation
from creditladder.sources.sinks import load_models, save_models


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(11)
    out = []
    for i in range(3000):
        x, m = rnd.random(), rnd.randint(1, 30)
        p = 1 / (1 + math.exp(-(-2 + 3 * x + 0.1 * m - 0.003 * m * m)))
        out.append((i, x, float(m), float(m * m), int(rnd.random() < p), rnd.choice([0, 1])))
    return spark.createDataFrame(out, "id int, pd double, m double, m2 double, y int, g int").cache()


def gradient(df, fitted: FittedLogit) -> list[float]:
    r = F.col("y") - fitted.probability()
    return list(df.agg(F.avg(r), *[F.avg(r * F.col(f)) for f in fitted.features]).first())


def newton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p))
    return beta


def test_fits_reach_the_optimum(data):
    models = fit_logits(
        data,
        {
            "one": Segment(F.col("y"), ("pd",)),
            "three": Segment(F.col("y"), ("pd", "m", "m2"), F.col("g") == 1),
        },
    )
    assert [m.status for m in models.values()] == ["ok", "ok"]
    assert max(map(abs, gradient(data, models["one"]))) < 1e-9
    inside = data.filter("g = 1")
    assert max(map(abs, gradient(inside, models["three"]))) < 1e-6
    pdf = inside.toPandas()
    expected = newton(np.column_stack([np.ones(len(pdf)), pdf.pd, pdf.m, pdf.m2]), pdf.y.to_numpy())
    assert [models["three"].intercept, *models["three"].coefficients] == pytest.approx(list(expected), abs=1e-7)
    assert models["three"].n_rows == len(pdf) and models["three"].n_events == pdf.y.sum()


def test_rows_with_unknowns_leave_the_fit_but_not_the_score(data):
    holes = data.withColumns({"pd": F.when(F.col("id") % 5 != 0, F.col("pd")), "y": F.when(F.col("id") % 7 != 0, F.col("y"))})
    a = fit_logit(holes, "y", ["pd"], "a")
    b = fit_logit(data.filter("id % 5 <> 0 and id % 7 <> 0"), "y", ["pd"], "a")
    assert a.n_rows == b.n_rows and a.coefficients == pytest.approx(b.coefficients, abs=1e-10)
    scored = score(holes, a, "p")
    assert scored.count() == 3000 and scored.filter("(pd is null) <> (p is null)").count() == 0


def test_statuses(spark, data):
    models = fit_logits(
        data,
        {
            "empty": Segment(F.col("y"), ("pd",), F.col("g") == 5),
            "unknown": Segment(F.col("y"), ("pd",), F.lit(None).cast("boolean")),
            "single": Segment(F.col("y"), ("pd",), F.col("y") == 0),
            "separated": Segment((F.col("pd") > 0.5).cast("int"), ("pd",)),
        },
    )
    assert {n: m.status for n, m in models.items()} == {"empty": "empty", "unknown": "empty", "single": "single_class", "separated": "separated"}
    assert score(data, models["empty"], "p").filter("p is not null").count() == 0
    table = coefficients(spark, models)
    assert table.filter("model = 'empty'").count() == 1 and table.filter("model = 'separated'").count() == 2


def test_durable_training_frame(data):
    a = fit_logits(data, {"a": Segment(F.col("y"), ("pd",))}, durable=True)["a"]
    assert a.coefficients == pytest.approx(fit_logit(data, "y", ["pd"], "a").coefficients, abs=1e-10)


def test_rating_models(frame):
    df = frame(
        "loan_id int, risk_rating int, writeoff int, active int, last_year int, balance_0915 double",
        [(1, 1, 0, 0, 1, 1.0), (2, 1, 1, 0, 1, 1.0), (3, 2, 1, 0, 1, 1.0), (4, 2, 1, 1, 1, 5.0), (5, 3, 0, 1, 1, 5.0), (6, None, 0, 1, 1, 5.0), (7, 1, 0, 1, 1, 0.0)],
    )
    fitted = fit_rating_factor(df, "risk_rating", "writeoff", rating.closed_last_year())
    assert rows(fitted) == [(1, 0.5), (2, 1.0)]
    scored = {r.loan_id: r.pd_rr for r in score_rating_factor(df, fitted, "risk_rating").collect()}
    assert scored == {1: 0.5, 2: 0.5, 3: 1.0, 4: 1.0, 5: None, 6: None, 7: 0.5}
    book = rating.rated_book(rating.rate_by_factor(df))
    assert book.columns == ["loan_id", "last_year", "balance_0915", "pd_rr"] and book.count() == 3
    line = fit_linear(df, "writeoff", "risk_rating", rating.closed_last_year()).first()
    assert (line.intercept, line.slope) == pytest.approx((0.0, 0.5))
    lm = {r.loan_id: r.pd_rr_lm for r in rating.rate_by_line(df).collect()}
    assert lm[5] == pytest.approx(1.5) and lm[6] is None


@pytest.fixture(scope="module")
def loans(spark):
    rnd = random.Random(5)
    out = []
    for i in range(4000):
        pd, u = rnd.random() * 0.4, rnd.random()
        steps = [1.8 * pd, 1.2 * pd * (0.5 + pd), 0.9 * pd * (0.4 + pd), 0.5 * pd * (0.4 + pd)]
        rung = sum(u < s for s in steps)
        label = ["Current", "Special Mention", "Substandard", "Doubtful", "Doubtful"][rung]
        out.append((i, pd, i % 2, label, "Writeoff" if rung == 4 else "Performing"))
    df = spark.createDataFrame(out, "loan_id int, pd double, active int, max_risk_category string, wo string")
    return segments.loan_flags(df).cache()


def test_chain_feeds_each_prediction_on(loans):
    chain = migration.fit_chain(loans)
    assert list(chain) == ["pm_sm", "pm_substandard", "pm_doubtful", "pm_wo"]
    assert {m.status for m in chain.values()} == {"ok"}
    pdf = loans.filter("active = 0").toPandas()
    x = pdf.pd.to_numpy()
    pdf["lost"] = (pdf.wo == "Writeoff").astype(int)
    inside = np.ones(len(pdf), dtype=bool)
    for (name, label, _, _), column in zip(migration.STAGES, ("special_mention", "substandard", "doubtful", "lost")):
        y = pdf[column].to_numpy()
        beta = newton(np.column_stack([np.ones(inside.sum()), x[inside]]), y[inside])
        assert [chain[name].intercept, *chain[name].coefficients] == pytest.approx(list(beta), rel=1e-6)
        x = 1 / (1 + np.exp(-(beta[0] + beta[1] * x)))
        inside &= y == 1
    scored = migration.add_chain_products(migration.chain_scores(loans, chain))
    assert scored.filter("pdx > pd_sm or pd_sm > pd_substandard or pd_substandard > pd_doubtful or pdx < 0 or pd_doubtful > 1").count() == 0


def test_chain_stops_where_a_stage_is_empty(loans):
    chain = migration.fit_chain(loans.filter("special_mention = 0"))
    assert [m.status for m in chain.values()] == ["single_class", "empty", "empty", "empty"]
    assert migration.chain_scores(loans, chain).filter("pm_wo is not null").count() == 0


def test_products_by_category(frame):
    df = frame(
        "category string, pm_sm double, pm_substandard double, pm_doubtful double, pm_wo double",
        [(c, 0.5, 0.4, 0.3, 0.2) for c in ("Current", "Special Mention", "Substandard", "Doubtful", "Other", None)],
    )
    got = df.select(
        active_pd("category").alias("a"), next_downgrade("category").alias("n"),
        next_downgrade("category", compat=True).alias("c"), *[e.alias(k) for k, e in chain_products().items()],
    ).collect()
    assert [r.a for r in got] == pytest.approx([0.012, 0.024, 0.06, 0.2, None, None])
    assert [r.n for r in got] == [0.5, 0.4, 0.3, 0.2, None, None]
    assert [r.c for r in got] == [0.5, 0.5, 0.4, 0.3, None, None]
    assert (got[0].pd_sm, got[0].pd_substandard, got[0].pd_doubtful, got[0].pdx) == pytest.approx((0.024, 0.06, 0.2, 0.012))


def test_current_rung_probability_is_the_one_in_the_product(loans):
    """The step a loan faces now is the first factor of its active probability."""
    scored = migration.chain_scores(loans, migration.fit_chain(loans))
    out = scored.withColumns({"a": active_pd("max_risk_category"), "n": next_downgrade("max_risk_category")})
    rest = {"Current": "pm_substandard * pm_doubtful * pm_wo", "Special Mention": "pm_doubtful * pm_wo", "Substandard": "pm_wo", "Doubtful": "1"}
    for label, tail in rest.items():
        assert out.filter(F.col("max_risk_category") == label).filter(f"abs(a - n * {tail}) > 1e-12").count() == 0


def test_wrong_way(frame):
    df = frame(
        "loan_id int, pd double, pd_wl double, pd_sm_wo double, pd_sub_wo double, pd_d_wo double",
        [(1, 0.1, 0.1, 0.2, 0.3, 0.4), (2, 0.2, 0.1, 0.2, 0.3, 0.3), (3, None, 0.1, 0.2, None, 0.4)],
    )
    assert rows(segments.wrong_way(df)) == [(2, "current < special mention"), (2, "substandard < doubtful")]
    unknown = {r.rule: r.n for r in segments.wrong_way_unknown(df).collect()}
    assert unknown == {"watch list < special mention": 0, "current < special mention": 1, "special mention < substandard": 1, "substandard < doubtful": 1}


def test_loan_frame_and_output(frame):
    pds = frame(
        "loan_id int, max_risk_category string, wo string, active int, pd double, pd_multiple_years double, rc_opp_number string",
        [(1, "Substandard", "Performing", 0, 0.1, 0.2, "A"), (2, "Odd", None, 0, 0.1, 0.3, "B"), (3, "Current", "Writeoff", 1, 0.1, 0.4, "C")],
    )
    flags = frame("loan_id int, watch_list int, pmt_1k int", [(1, 1, 0), (2, 0, 1), (3, 1, 1)])
    df = segments.loan_frame(pds, flags)
    got = {r.loan_id: (r.max_risk_category, r.pd, r.pd_orig, r.current, r.special_mention, r.substandard, r.doubtful) for r in df.collect()}
    assert got == {
        1: ("Substandard", 0.2, 0.1, 1, 1, 1, 0), 2: (None, 0.3, 0.1, 1, None, None, None), 3: ("Current", 0.4, 0.1, 1, 1, 1, 1),
    }
    scored = df.withColumns({c: F.lit(0.5) for c in segments.LOAN_SCORES})
    assert segments.profile_output(scored).columns == ["loan_id", "max_risk_category", "pd", *segments.LOAN_SCORES, "rc_opp_number"]


def test_point_in_time(frame):
    loans = frame("loan_id int, pd double", [(1, 0.1), (2, 0.2), (3, None)])
    cats = frame("loan_id int, c1 int, c2 int", [(1, 0, 6), (2, 18, None), (3, 0, 0)])
    bals = frame("loan_id int, b1 double, b2 double", [(1, 10.0, 20.0), (2, 30.0, 5.0), (3, 10.0, None)])
    periods = migration.period_table(loans, cats, bals, {"p1": ("c1", "b1"), "p2": ("c2", "b2")})
    assert periods.count() == 6
    half = {n: FittedLogit(n, "y", (f,), "ok", 1, 1, 0.0, (0.0,)) for n, _, f, _ in migration.STAGES}
    got = {(r.loan_id, r.period): r.pd_active for r in migration.point_in_time(periods, half).collect()}
    assert got == {(1, "p1"): 0.0625, (1, "p2"): 0.125, (2, "p1"): 0.5, (2, "p2"): None, (3, "p1"): None}
    means = {r.period: r for r in migration.period_means(migration.point_in_time(periods, half)).collect()}
    assert means["p1"].weighted_pd == pytest.approx((1 + 6) / 50) and means["p1"].mean_pd == pytest.approx(0.15)
    assert means["p1"].weighted_pd_active == pytest.approx((0.625 + 15) / 50)


# Features that split the labels together


def rows_of(frame, points, labels):
    schema = ", ".join(f"x{i} double" for i in range(len(points[0]))) + ", y int"
    return frame(schema, [(*map(float, p), int(y)) for p, y in zip(points, labels)])


GRID = [(a, b) for a in range(5) for b in range(5)]
SPLITS = {
    "complete": (GRID, [int(2 * a + 3 * b > 9.5) for a, b in GRID]),
    # The points on the line take both labels, all others are split by it.
    "partial": (GRID + [(1, 3), (2, 2)], [int(a + b > 4 or (a + b == 4 and a % 2)) for a, b in GRID] + [0, 1]),
    "none": (GRID, [(a * 7 + b * 3) % 2 for a, b in GRID]),
    "one feature": (GRID, [int(a > 2) for a, _ in GRID]),
    "dependent": ([(a, 2 * a) for a in range(8)], [0, 1, 0, 1, 1, 0, 1, 1]),
}


@pytest.mark.parametrize("name", SPLITS)
def test_separation(frame, name):
    df = rows_of(frame, *SPLITS[name])
    want = {"one feature": "complete", "dependent": "none"}.get(name, name)
    assert separation(design(df, ["x0", "x1"], "y")) == want
    scaled = df.withColumns({"x0": F.col("x0") * 1e-4 + 3, "x1": F.col("x1") * 1e5})
    assert separation(design(scaled, ["x0", "x1"], "y")) == want


def firth_by_hand(points, labels, steps=200):
    x, y = np.c_[np.ones(len(points)), np.array(points, float)], np.array(labels)
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        w = p * (1 - p)
        inverse = np.linalg.inv((x * w[:, None]).T @ x)
        h = w * np.einsum("ij,jk,ik->i", x, inverse, x)
        step = inverse @ (x.T @ (y - p + h * (0.5 - p)))
        beta = beta + step * min(1, 3 / np.abs(step).max())
    return beta


@pytest.mark.parametrize("name", ["complete", "partial", "none", "one feature"])
def test_penalised_fit(frame, name):
    points, labels = SPLITS[name]
    fit = firth(design(rows_of(frame, points, labels), ["x0", "x1"], "y"))
    assert fit.converged and fit.steps < 40
    assert [fit.intercept, *fit.coefficients] == pytest.approx(firth_by_hand(points, labels).tolist(), rel=1e-6, abs=1e-7)


def test_separated_segments_get_finite_coefficients(frame, tmp_path, spark):
    segments = {n: Segment(F.col("y"), ("x0", "x1"), F.col("s") == n, "y") for n in ("complete", "partial", "none")}
    df = None
    for n in segments:
        part = rows_of(frame, *SPLITS[n]).withColumn("s", F.lit(n))
        df = part if df is None else df.union(part)
    models = fit_logits(df, segments)
    assert {n: (m.status, m.method) for n, m in models.items()} == {"complete": ("separated", "firth"), "partial": ("separated", "firth"), "none": ("ok", "ml")}
    assert all(abs(b) < 100 for m in models.values() for b in m.coefficients)
    assert save_models(models, str(tmp_path), spark) == 1 and save_models({"none": models["none"]}, str(tmp_path), spark) == 2
    assert load_models(str(tmp_path), spark, 1) == models and set(load_models(str(tmp_path), spark)) == {"none"}
    with pytest.raises(ValueError, match="no models of version 3"):
        load_models(str(tmp_path), spark, 3)


def test_panel_calibration_computes_each_prediction_once(frame):
    """Segments that overlap, are empty, or lack predictions, states and balances; one exponential per segment in the plan."""
    df = frame("k int, x double, wo string, balance double", [(1, 0.0, "Writeoff", 100.0), (1, None, "Performing", 50.0), (2, 0.0, None, 30.0), (2, 1.0, "Writeoff", 10.0), (3, 0.0, "Performing", None)])
    where = {"one": F.col("k") == 1, "two": F.col("k") == 2, "up_to_two": F.col("k") < 3, "three": F.col("k") == 3, "none": F.col("k") > 3}
    parts = {n: segments.Segment(segments.wo_label(), ("x",), c) for n, c in where.items()}
    models = {n: segments.FittedLogit(n, "wo", ("x",), "ok", 1, 1, 0.0, (math.log(3),)) for n in where}
    out = segments.panel_calibration(df, models, parts)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("EXP(") + text.count("exp(") == len(where), text
    got = {(r.segment, r.statistic): r.value for r in out.collect()}
    stats = ("mean_pd", "mean_actual", "weighted_pd", "mean_pd_known", "mean_actual_known", "weighted_pd_known", "n", "n_unknown_pd", "n_unknown_state")
    assert {n: [None if got[n, s] is None else round(got[n, s], 9) for s in stats] for n in where} == {
        "one": [None, round(100 / 150, 9), None, 0.5, round(100 / 150, 9), 0.5, 2, 1, 0],
        "two": [0.625, None, 0.5625, 0.625, 1.0, 0.5625, 2, 0, 1],
        "up_to_two": [None, None, None, round(1.75 / 3, 9), round(110 / 160, 9), round(72.5 / 140, 9), 4, 1, 1],
        "three": [0.5, None, None, 0.5, None, None, 1, 0, 0],
        "none": [None, None, None, None, None, None, 0, 0, 0],
    }
