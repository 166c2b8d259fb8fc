"""Queries for the model families, scoring, portfolio loss and point-in-time probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditladder.functions import probability as prob
from creditladder.operators import aggregates as agg
from creditladder.operators.reshape import select_existing
from creditladder.plans import exposure as exp
from creditladder.plans import migration as mig
from creditladder.plans import rating, segments
from creditladder.plans.models import Segment, coefficients, fit_linear, fit_logits, fit_rating_factor, score
from creditladder.plans.models import score_all as with_scores
from creditladder.plans.panel import active_as_of, build_panel
from creditladder.session import cut_lineage, new_path
from creditladder.sources.sinks import load_models, save_models, write_report

from .fixtures import PERIODS
from .irls import FIRTH_STEPS, last_step, terms
from .oracle_views import LOAN_SEGMENTS, MONTHS, PANEL_SEGMENTS, PANEL_SEGMENTS_ALL, PD, chain_scored
from .queries_tables import panel_sources
from .registry import COEF, MONEY, RATE, Inputs, query, rounded

CLOSED_BEFORE, WATCH_FROM, WATCH_TO = "2001-06-01", "1996-03-27", "2000-01-01"
ACTIVE_ON = "2000-06-30"


def _estimates(t: Inputs, models) -> DataFrame:
    return rounded(coefficients(t.spark, models).select("model", "term", "estimate"), estimate=COEF)


def loan_frame(t: Inputs) -> DataFrame:
    return segments.loan_frame(t("loans"), t("payment_flags"))


# --- fits --------------------------------------------------------------------------------------------


def _register_loan_fit(query_name: str, segment: str) -> None:
    @query(query_name, terms(f"fit_loan_{segment}", segment, PD, COEF))
    def fit(t: Inputs) -> DataFrame:
        one = {segment: segments.loan_segments()[segment]}
        return _estimates(t, fit_logits(loan_frame(t), one))


for _query, _segment in {
    "fit_pd": "current", "fit_watch_list": "watch_list", "fit_paid_1k": "paid_1k",
    "fit_special_mention": "special_mention", "fit_substandard": "substandard", "fit_doubtful": "doubtful",
}.items():
    _register_loan_fit(_query, _segment)


_TERM_NAMES = {"m": "months_in_risk_cat", "m2": "months_in_risk_cat_sq"}


def _family_sql(family: str, segs: dict) -> str:
    parts = []
    for name, (_, features) in segs.items():
        sql = terms(f"fit_{family}_{name}", name, features, COEF)
        for short, full in _TERM_NAMES.items():
            sql = sql.replace(f"'{short}' term", f"'{full}' term")
        parts.append(sql)
    return "\nunion all\n".join(parts)


def active_panel(t: Inputs) -> DataFrame:
    return active_as_of(build_panel(panel_sources(t)), ACTIVE_ON)


@query("fit_panel_family", _family_sql("panel", PANEL_SEGMENTS))
def fit_panel_family(t: Inputs) -> DataFrame:
    family = segments.panel_segments(CLOSED_BEFORE, WATCH_FROM, WATCH_TO)
    return _estimates(t, fit_logits(active_panel(t), family, durable=True))


@query("fit_panel_family_all_dates", _family_sql("all", PANEL_SEGMENTS_ALL))
def fit_panel_family_all_dates(t: Inputs) -> DataFrame:
    return _estimates(t, fit_logits(active_panel(t), segments.panel_segments_all_dates(), durable=True))


def _panel_scored(name: str, features) -> str:
    """The segment's rows with their prediction p."""
    more = " + f.b2 * s.m + f.b3 * s.m2" if features is MONTHS else ""
    return f"(select s.*, 1e0 / (1e0 + exp(-(f.b0 + f.b1 * s.pd{more}))) p from {{seg_panel_{name}}} s, {last_step(f'fit_panel_{name}')} f)"


_CALIBRATION = {
    "mean_pd": "case when count(*) = count(p) then avg(p) end",
    "mean_actual": "case when count(*) = count(y) then sum(y * balance) / nullif(sum(balance), 0) end",
    "weighted_pd": "case when count(*) = count(p) then sum(balance * p) / nullif(sum(balance), 0) end",
    "mean_pd_known": "avg(p)",
    "mean_actual_known": "sum(y * balance) / nullif(sum(balance) filter (y is not null), 0)",
    "weighted_pd_known": "sum(balance * p) / nullif(sum(balance) filter (p is not null), 0)",
    "n": "count(*)", "n_unknown_pd": "count(*) - count(p)", "n_unknown_state": "count(*) - count(y)",
}


@query(
    "panel_calibration",
    "\nunion all\n".join(
        f"select '{name}' segment, unnest({list(_CALIBRATION)}) as statistic, unnest([{', '.join(f'round({v}, 6)' for v in _CALIBRATION.values())}]) as value "
        f"from {_panel_scored(name, features)} q"
        for name, (_, features) in PANEL_SEGMENTS.items()
    ),
)
def panel_calibration(t: Inputs) -> DataFrame:
    """On all rows; unknown predictions and write-off states are counted, and told from the known ones."""
    t.store("pmt")
    panel = cut_lineage(active_panel(t), "panel")
    family = segments.panel_segments(CLOSED_BEFORE, WATCH_FROM, WATCH_TO)
    return rounded(segments.panel_calibration(panel, fit_logits(panel, family), family), value=RATE)


@query(
    "calibration_bins",
    "\nunion all\n".join(
        f"""select '{name}' segment, cast(bin as int) bin, cast(sum(n) as bigint) n, cast(sum(n) - sum(n_known) as bigint) n_unknown,
                   round(min(low), 6) low, round(max(high), 6) high, round(case when bin is not null then sum(p) / sum(n) end, 6) mean_pd,
                   round(sum(y) / nullif(sum(n_known), 0), 6) mean_actual
            from (select *, case when cell is not null then floor((sum(n) over (partition by cell is null order by cell) - n) * 10
                                                                  / sum(n) over (partition by cell is null)) end bin
                  from (select case when p is not null then least(floor(p * 1000), 999) end cell, count(*) n, count(y) n_known, min(p) low, max(p) high, sum(p) p, sum(y) y
                        from {_panel_scored(name, features)} q group by 1) c) d group by bin"""
        for name, (_, features) in PANEL_SEGMENTS.items()
    ),
)
def calibration_bins(t: Inputs) -> DataFrame:
    """Predicted beside actual rates by tenths of the prediction."""
    panel = cut_lineage(active_panel(t), "panel")
    family = segments.panel_segments(CLOSED_BEFORE, WATCH_FROM, WATCH_TO)
    out = segments.panel_calibration_bins(panel, fit_logits(panel, family), family)
    return rounded(out, **dict.fromkeys(("low", "high", "mean_pd", "mean_actual"), RATE))


@query(
    "fit_separated",
    "\nunion all\n".join(
        f"select 'split' model, '{term}' term, round(b{i}, {COEF}) estimate, 'separated' status from {{fit_split}} where step = {FIRTH_STEPS}"
        for i, term in enumerate(("(Intercept)", "pd", "utilised"))
    ),
)
def fit_separated(t: Inputs) -> DataFrame:
    """Two features that split the labels only together: found, and fitted with the penalised likelihood."""
    models = fit_logits(t("split_loans"), {"split": Segment(F.col("y"), ("pd", "utilised"), None, "y")})
    return rounded(coefficients(t.spark, models), estimate=COEF)


_CHAIN_FIT = "\nunion all\n".join(
    terms(f"fit_chain_{i}", stage, ["x"], COEF).replace("'x' term", f"'{feature}' term")
    for i, (stage, _, feature, _) in enumerate(mig.STAGES)
)


def chain(t: Inputs):
    return mig.fit_chain(segments.loan_flags(t("loans")))


@query("fit_chain", _CHAIN_FIT)
def fit_chain(t: Inputs) -> DataFrame:
    return _estimates(t, chain(t))


@query(
    "fit_rating_factor",
    """select risk_rating, round(avg(writeoff), 6) pd_rr from {rated}
       where active = 0 and last_year = 1 and risk_rating is not null group by risk_rating""",
)
def fit_rating_factor_query(t: Inputs) -> DataFrame:
    fitted = fit_rating_factor(t("rated"), "risk_rating", "writeoff", rating.closed_last_year())
    return rounded(fitted, pd_rr=RATE)


@query(
    "fit_rating_linear",
    """select round(regr_intercept(writeoff, risk_rating), 4) intercept, round(regr_slope(writeoff, risk_rating), 4) slope
       from {rated} where active = 0 and last_year = 1""",
)
def fit_rating_linear(t: Inputs) -> DataFrame:
    return rounded(fit_linear(t("rated"), "writeoff", "risk_rating", rating.closed_last_year()), intercept=COEF, slope=COEF)


@query(
    "score_rating_linear",
    """select loan_id, round(f.a + f.b * risk_rating, 6) pd_rr_lm from {rated},
       (select regr_intercept(writeoff, risk_rating) a, regr_slope(writeoff, risk_rating) b from {rated}
        where active = 0 and last_year = 1) f""",
)
def score_rating_linear(t: Inputs) -> DataFrame:
    return rounded(rating.rate_by_line(t("rated")).select("loan_id", "pd_rr_lm"), pd_rr_lm=RATE)


@query(
    "rating_counts",
    """select round(pd_rr, 6) pd_rr, count(*) n from {rated} r join
       (select risk_rating, avg(writeoff) pd_rr from {rated} where active = 0 and last_year = 1 group by risk_rating) f
       on r.risk_rating = f.risk_rating group by round(pd_rr, 6)""",
)
def rating_counts(t: Inputs) -> DataFrame:
    """How many loans got each predicted value."""
    return agg.value_counts(rating.rate_by_factor(t("rated")), "pd_rr", RATE)


@query(
    "coefficients",
    "\nunion all\n".join(terms(f"fit_loan_{s}", s, PD, COEF) for s in LOAN_SEGMENTS) + "\nunion all\n" + _CHAIN_FIT,
)
def coefficients_query(t: Inputs) -> DataFrame:
    return _estimates(t, {**segments.fit_loan_models(loan_frame(t)), **chain(t)})


# --- loan models: scoring and checks -----------------------------------------------------------------

_SCORES = ["pd_wl", "pd_pmt", "pd_sm_wo", "pd_sub_wo", "pd_d_wo"]


def scored_loans(t: Inputs) -> DataFrame:
    df = loan_frame(t)
    return segments.score_loans(df, segments.fit_loan_models(df))


@query(
    "score_all",
    "select loan_id, round(pd, 6) pd, " + ", ".join(f"round({c}, 6) {c}" for c in _SCORES) + " from {scored_loans}",
)
def score_all(t: Inputs) -> DataFrame:
    return rounded(scored_loans(t).select("loan_id", "pd", *_SCORES), **dict.fromkeys(["pd", *_SCORES], RATE))


@query(
    "score_one",
    f"""select l.loan_id, round(1e0 / (1e0 + exp(-(f.b0 + f.b1 * case when l.loan_id % 9 = 0 then null else l.pd end))), 6) p
        from {{loan_frame}} l, {last_step('fit_loan_current')} f""",
)
def score_one(t: Inputs) -> DataFrame:
    """One model on a frame with unknown inputs."""
    df = loan_frame(t)
    fitted = fit_logits(df, {"current": segments.loan_segments()["current"]})["current"]
    holes = df.withColumn("pd", F.when(F.col("loan_id") % 9 != 0, F.col("pd")))
    return rounded(score(holes, fitted, "p").select("loan_id", "p"), p=RATE)


@query(
    "model_round_trip",
    f"""select l.loan_id, round(1e0 / (1e0 + exp(-(f.b0 + f.b1 * l.pd))), 6) current, round(1e0 / (1e0 + exp(-(g.b0 + g.b1 * l.pd))), 6) substandard,
               round(1e0 / (1e0 + exp(-(h.b0 + h.b1 * l.pd + h.b2 * (l.loan_id * 53 % 89) / 89e0))), 4) split, cast(2 as int) as version
        from {{loan_frame}} l, {last_step('fit_loan_current')} f, {last_step('fit_loan_substandard')} g,
             (select * from {{fit_split}} where step = {FIRTH_STEPS}) h""",
)
def model_round_trip(t: Inputs) -> DataFrame:
    """Models stored, stored again as a new version, read back, and every loan scored with them."""
    df = loan_frame(t).withColumn("utilised", (F.col("loan_id") * 53 % 89) / 89)
    wanted = segments.loan_segments()
    models = fit_logits(df, {n: wanted[n] for n in ("current", "substandard")})
    models |= fit_logits(t("split_loans"), {"split": Segment(F.col("y"), ("pd", "utilised"), None, "y")})
    path = new_path(t.spark, "models")
    save_models({"current": models["current"]}, path, t.spark)
    version = save_models(models, path, t.spark)
    back = load_models(path, t.spark)
    scored = with_scores(df, back).select("loan_id", *models, F.lit(version).alias("version"))
    return rounded(scored, current=RATE, substandard=RATE, split=COEF)


@query(
    "report_round_trip",
    """select 'wrong_way' sheet, rule a, '' b, cast(count(*) as double) n from ({WRONG}) w group by rule
       union all select 'counts', max_risk_category, wo, count(*) from {loan_frame} where wo is not null and code >= 0 group by all
       union all ({COEFS})""".replace(
        "{WRONG}",
        " union all ".join(f"select '{name}' as rule from {{scored_loans}} where not ({lo} < {hi})" for name, (lo, hi) in segments.WRONG_WAY_RULES.items()),
    ).replace("{COEFS}", " union all ".join(f"select 'coefficients', model, term, estimate from ({terms(f'fit_loan_{s}', s, PD, COEF)}) c" for s in LOAN_SEGMENTS)),
)
def report_round_trip(t: Inputs) -> DataFrame:
    """The sheets of a report (wrong-way loans, value counts, coefficients) written as CSV tables and read back."""
    df = loan_frame(t)
    models = segments.fit_loan_models(df)
    path = new_path(t.spark, "report")
    write_report(
        {
            "wrong_way": segments.wrong_way(segments.score_loans(df, models)),
            "counts": agg.crosstab_long(df, "max_risk_category", "wo"),
            "coefficients": coefficients(t.spark, models),
        },
        path,
    )

    def sheet(name: str, schema: str) -> DataFrame:
        return t.spark.read.schema(schema).csv(f"{path}/{name}", header=True, nullValue="NA")

    wrong = sheet("wrong_way", "loan_id long, rule string").groupBy("rule").agg(F.count(F.lit(1)).cast("double").alias("n"))
    counts = sheet("counts", "max_risk_category string, wo string, n double")
    terms_ = sheet("coefficients", "model string, term string, estimate double, status string")
    return (
        wrong.select(F.lit("wrong_way").alias("sheet"), F.col("rule").alias("a"), F.lit("").alias("b"), "n")
        .union(counts.select(F.lit("counts"), "max_risk_category", "wo", "n"))
        .union(terms_.select(F.lit("coefficients"), "model", "term", F.round("estimate", COEF)))
    )


@query(
    "wrong_way",
    "\nunion all\n".join(
        f"select loan_id, '{name}' as rule from {{scored_loans}} where not ({lo} < {hi})"
        for name, (lo, hi) in segments.WRONG_WAY_RULES.items()
    ),
)
def wrong_way(t: Inputs) -> DataFrame:
    return segments.wrong_way(scored_loans(t))


_IN = {n: c for n, c in LOAN_SEGMENTS.items()}


def _rate(numerator: str, denominator: str, where: str) -> str:
    return f"(select sum({numerator}) / nullif(cast(sum({denominator}) as double), 0) from {{known_loans}} where {where})"


def _calibration_rows() -> str:
    score_of = {v: k for k, v in segments.LOAN_SCORES.items()}
    rows = [("current", s, _rate("y", "1", w)) for s, w in (
        ("predicted on subset", "active = 0"), ("actual on subset", "active = 0"), ("actual all loans", "true"))]
    for name in ("watch_list", "paid_1k", "special_mention", "substandard", "doubtful"):
        p = score_of[name]
        rows.append((name, "predicted on subset", f"(select avg({p}) from {{known_loans}} where active = 0 and {_IN[name]})"))
        if name in ("watch_list", "paid_1k"):
            rows.append((name, "actual on subset", _rate("y", "1", f"active = 0 and {_IN[name]}")))
        else:
            column = {"special_mention": "sm", "substandard": "sub", "doubtful": "doubt"}[name]
            rows.append((name, "actual on subset", _rate("y", column, "active = 0")))
            rows.append((name, "actual all loans", _rate("y", column, "true")))
    known = [f"select 'known' loans, '{n}' segment, '{s}' as statistic, round({v}, 6) as value" for n, s, v in rows]
    return "\nunion all\n".join(known + _calibration_of_all())


def _strict_rate(where: str, size: str, only: str = "true") -> str:
    """A write-off that counts and is unknown, or an unknown size, makes the rate unknown."""
    return f"""(select case when count(*) filter ({where} and {only} and y is null) = 0
                  and count(*) filter ({where} and {size} is null) = 0
                then coalesce(sum(y) filter ({where} and {only}), 0) / nullif(cast(sum({size}) filter ({where}) as double), 0) end
                from {{scored_loans}})"""


def _calibration_of_all() -> list[str]:
    score_of = {v: k for k, v in segments.LOAN_SCORES.items()}
    rows = [("current", s, _strict_rate(w, "1")) for s, w in (
        ("predicted on subset", "active = 0"), ("actual on subset", "active = 0"), ("actual all loans", "true"))]
    for name in ("watch_list", "paid_1k", "special_mention", "substandard", "doubtful"):
        rows.append((name, "predicted on subset", f"(select avg({score_of[name]}) from {{scored_loans}} where active = 0 and {_IN[name]})"))
        if name in ("watch_list", "paid_1k"):
            column = {"watch_list": "watch_list", "paid_1k": "pmt_1k"}[name]
            rows.append((name, "actual on subset", _strict_rate("active = 0", column, f"{column} = 1")))
        else:
            column = {"special_mention": "sm", "substandard": "sub", "doubtful": "doubt"}[name]
            rows.append((name, "actual on subset", _strict_rate("active = 0", column)))
            rows.append((name, "actual all loans", _strict_rate("true", column)))
    return [f"select 'all', '{n}', '{s}', round({v}, 6)" for n, s, v in rows]


@query("calibration_table", _calibration_rows())
def calibration_table(t: Inputs) -> DataFrame:
    """On all loans, where an unknown write-off state makes the actual rates unknown, and on those whose
    state is known."""
    df = loan_frame(t)
    models = segments.fit_loan_models(df)
    every = segments.loan_calibration(df, models).select(F.lit("all").alias("loans"), "*")
    known = segments.loan_calibration(df.filter("wo is not null"), models).select(F.lit("known").alias("loans"), "*")
    return rounded(every.unionByName(known), value=RATE)


@query(
    "mean_scores",
    "\nunion all\n".join(
        f"select '{c}' as variable, round(avg({c}), 6) as value from {{scored_loans}} where active = 0"
        for c in ("pd", "pd_sm_wo", "pd_sub_wo", "pd_d_wo")
    ),
)
def mean_scores(t: Inputs) -> DataFrame:
    return rounded(segments.mean_scores(scored_loans(t)), value=RATE)


# --- migration chain ---------------------------------------------------------------------------------

_PM = list(prob.MIGRATIONS)


def _fixed_migrations(df: DataFrame) -> DataFrame:
    """Probabilities set by rule instead of fits."""
    pd = F.col("pd")
    values = (F.least(F.lit(1.0), 0.2 + pd), F.least(F.lit(1.0), 0.3 + pd), 0.5 + pd / 2, 0.9 - pd / 3)
    return df.withColumns(dict(zip(_PM, values)))


_FIXED_BOOK = "(select b.*, " + ", ".join(f"{v.strip()} {n}" for n, v in zip(_PM, (
    "least(1e0, 0.2e0 + pd)", "least(1e0, 0.3e0 + pd)", "0.5e0 + pd / 2", "0.9e0 - pd / 3"))) + " from {book} b) x"


def _by_category_sql(values: list[str], name: str) -> str:
    cases = " ".join(f"when '{c}' then {v}" for c, v in zip(prob.CATEGORIES, values))
    return f"round(case risk_category {cases} end, 6) {name}"


_AHEAD = [" * ".join(_PM[i:]) for i in range(4)]


@query(
    "chain_products",
    f"""select loan_id, round({' * '.join(_PM[1:])}, 6) pd_sm, round({' * '.join(_PM[2:])}, 6) pd_substandard,
        round(pm_wo, 6) pd_doubtful, round({' * '.join(_PM)}, 6) pdx from {_FIXED_BOOK}""",
)
def chain_products(t: Inputs) -> DataFrame:
    out = mig.add_chain_products(_fixed_migrations(t("book")))
    names = ["pd_sm", "pd_substandard", "pd_doubtful", "pdx"]
    return rounded(out.select("loan_id", *names), **dict.fromkeys(names, RATE))


@query("active_pd", f"select loan_id, {_by_category_sql(_AHEAD, 'pd_active')} from {_FIXED_BOOK}")
def active_pd(t: Inputs) -> DataFrame:
    df = _fixed_migrations(t("book"))
    return df.select("loan_id", F.round(prob.active_pd("risk_category"), RATE).alias("pd_active"))


@query(
    "active_pd_avg",
    f"""select loan_id, {_by_category_sql(['pm_sm * a.s * a.d * a.w', 'pm_substandard * a.d * a.w', 'pm_doubtful * a.w', 'pm_wo'], 'pd_avg')}
        from {_FIXED_BOOK}, (select avg(case when risk_category = 'Special Mention' then pm_substandard end) s,
            avg(case when risk_category = 'Substandard' then pm_doubtful end) d,
            avg(case when risk_category = 'Doubtful' then pm_wo end) w from {_FIXED_BOOK}) a""",
)
def active_pd_avg(t: Inputs) -> DataFrame:
    df = _fixed_migrations(t("book"))
    return df.select("loan_id", F.round(mig.active_pd_avg(df), RATE).alias("pd_avg"))


@query(
    "next_downgrade",
    f"""select loan_id, {_by_category_sql(_PM, 'next_step')},
        {_by_category_sql([_PM[0], _PM[0], _PM[1], _PM[2]], 'next_step_compat')} from {_FIXED_BOOK}""",
)
def next_downgrade(t: Inputs) -> DataFrame:
    df = _fixed_migrations(t("book"))
    return df.select(
        "loan_id",
        F.round(prob.next_downgrade("risk_category"), RATE).alias("next_step"),
        F.round(prob.next_downgrade("risk_category", compat=True), RATE).alias("next_step_compat"),
    )


@query(
    "score_chain",
    "select loan_id, " + ", ".join(f"round({c}, 6) {c}" for c in _PM)
    + f", round({' * '.join(_PM)}, 6) pdx from {{scored_chain}}",
)
def score_chain(t: Inputs) -> DataFrame:
    scored = mig.add_chain_products(mig.chain_scores(t("loans"), chain(t)))
    return rounded(scored.select("loan_id", *_PM, "pdx"), **dict.fromkeys([*_PM, "pdx"], RATE))


@query(
    "chain_line",
    f"""select round(regr_intercept({' * '.join(_PM)}, pd), 4) intercept, round(regr_slope({' * '.join(_PM)}, pd), 4) slope
        from {{scored_chain}}""",
)
def chain_line(t: Inputs) -> DataFrame:
    """Straight line of the chain's product on the original probability."""
    scored = mig.add_chain_products(mig.chain_scores(t("loans"), chain(t)))
    return rounded(mig.chain_line(scored), intercept=COEF, slope=COEF)


@query(
    "chain_means",
    "\nunion all\n".join(
        f"select '{n}' as variable, round(avg({v}), 6) mean from {{scored_chain}}"
        for n, v in [*((c, c) for c in _PM), ("pd", "pd"), ("pdx", " * ".join(_PM))]
    ),
)
def chain_means(t: Inputs) -> DataFrame:
    scored = mig.add_chain_products(mig.chain_scores(t("loans"), chain(t)))
    return rounded(agg.means(scored, [*_PM, "pd", "pdx"], strict=True), mean=RATE)


@query(
    "rate_active_book",
    f"""select loan_id, risk_category, {_by_category_sql(_AHEAD, 'pd_active')},
        {_by_category_sql(['pm_sm * a.s * a.d * a.w', 'pm_substandard * a.d * a.w', 'pm_doubtful * a.w', 'pm_wo'], 'pd_active_avg_downgrade')},
        {_by_category_sql(_PM, 'migration_to_next_cat_prob')},
        round(case risk_category {' '.join(f"when '{c}' then {v}" for c, v in zip(prob.CATEGORIES, _AHEAD))} end * balance, 2) el
        from {{scored_book}}, (select avg(case when risk_category = 'Special Mention' then pm_substandard end) s,
            avg(case when risk_category = 'Substandard' then pm_doubtful end) d,
            avg(case when risk_category = 'Doubtful' then pm_wo end) w from {{scored_book}}) a
        where active = 1""",
)
def rate_active_book(t: Inputs) -> DataFrame:
    out = mig.rate_active_book(t("book"), chain(t))
    names = ["pd_active", "pd_active_avg_downgrade", "migration_to_next_cat_prob"]
    kept = select_existing(out, ["loan_id", "risk_category", *names, "el", "sector"])
    return rounded(kept, **dict.fromkeys(names, RATE), el=MONEY)


_BOOK_SLICES = {
    "Current": "risk_category = 'Current'", "below": "risk_category is not null and risk_category <> 'Current'", "unrated": "risk_category is null", "all": "true",
}


@query(
    "book_loss",
    "\nunion all\n".join(
        f"""select '{name}' slice, count(*) n_loans, case when count(*) = count(balance) then round(coalesce(sum(balance), 0), 2) end balance,
            round(coalesce(sum(x0 * balance), 0), 2) el, round(coalesce(sum(x0 * balance), 0e0) / nullif(sum(balance), 0), 6) loss_rate,
            case when count(*) filter (x0 is not null and balance is null) = 0
                 then round(coalesce(sum(x0 * balance), 0e0) / nullif(sum(balance) filter (x0 is not null), 0), 6) end loss_rate_known,
            round(avg(x0), 6) mean_pd_active, round(avg(pd), 6) mean_pd
            from {{rated_active_book}} where {cond} having count(*) > 0"""
        for name, cond in _BOOK_SLICES.items()
    ),
)
def book_loss(t: Inputs) -> DataFrame:
    """Category-free expected loss of the active book: sums, rates and means, by slice and for the whole book."""
    out = mig.book_loss(mig.rate_active_book(t("book"), chain(t)))
    rates = dict.fromkeys(("loss_rate", "loss_rate_known", "mean_pd_active", "mean_pd"), RATE)
    return rounded(out, balance=MONEY, el=MONEY, **rates)


@query(
    "migration_long",
    "\nunion all\n".join(
        f"select loan_id, '{n}' migration, round({v}, 6) pds from {{scored_chain}}"
        for n, v in (("pd", "pd"), ("pd_sm", _AHEAD[1]), ("pd_substandard", _AHEAD[2]), ("pd_doubtful", _AHEAD[3]), ("pdx", _AHEAD[0]))
    ),
)
def migration_long(t: Inputs) -> DataFrame:
    scored = mig.add_chain_products(mig.chain_scores(t("loans"), chain(t)))
    return rounded(mig.chain_long(scored), pds=RATE)


# --- point in time -----------------------------------------------------------------------------------

_PERIOD_COLUMNS = {f"09{y % 100:02d}": (f"risk_cat_9_{y}", f"balance_09{y % 100:02d}") for y in PERIODS}
_PERIOD_ROWS = "(" + "\nunion all ".join(
    f"select s.loan_id, s.pd, '{p}' period, c.{cat} code, b.{bal} balance from {{sept}} s "
    f"left join {{sept_categories}} c on s.loan_id = c.loan_id left join {{sept_balances}} b on s.loan_id = b.loan_id "
    "where s.last_year = 1"
    for p, (cat, bal) in _PERIOD_COLUMNS.items()
) + ") x"


def period_rows(t: Inputs) -> DataFrame:
    loans = t("sept").filter("last_year = 1").select("loan_id", "pd")
    return mig.period_table(loans, t("sept_categories"), t("sept_balances"), _PERIOD_COLUMNS)


@query(
    "pit_periods",
    f"""select loan_id, period, round(balance, 2) balance, case when balance > 0 then 1 when balance <= 0 then 0 end active,
        case when code is null then null when code <> 0 then 0 when balance > 0 then 1 when balance <= 0 then 0 end as current,
        case when code = 6 then 1 when code is not null then 0 end special_mention,
        case when code = 12 then 1 when code is not null then 0 end substandard,
        case when code = 18 then 1 when code is not null then 0 end doubtful
        from {_PERIOD_ROWS}""",
)
def pit_periods(t: Inputs) -> DataFrame:
    return rounded(period_rows(t).drop("pd", "category_code"), balance=MONEY)


_PIT = f"""(select s.*, case code when 0 then {_AHEAD[0]} when 6 then {_AHEAD[1]} when 12 then {_AHEAD[2]}
            when 18 then {_AHEAD[3]} end pd_active from ({chain_scored('pit_active')}) s) z"""


@query(
    "point_in_time",
    f"select loan_id, period, round(balance, 2) balance, round(pd_active, 6) pd_active from {_PIT}",
)
def point_in_time(t: Inputs) -> DataFrame:
    out = mig.point_in_time(period_rows(t), chain(t)).select("loan_id", "period", "balance", "pd_active")
    return rounded(out, balance=MONEY, pd_active=RATE)


@query(
    "period_means",
    f"""select period, round(sum(pd * balance) / nullif(sum(balance), 0), 6) weighted_pd,
        round(coalesce(sum(pd_active * balance), 0e0) / nullif(sum(balance), 0), 6) weighted_pd_active, round(avg(pd), 6) mean_pd,
        round(avg(pd_active), 6) mean_pd_active from {_PIT} group by period""",
)
def period_means(t: Inputs) -> DataFrame:
    out = mig.period_means(mig.point_in_time(period_rows(t), chain(t)))
    return rounded(out, **dict.fromkeys(out.columns[1:], RATE))


# --- exposure and loss -------------------------------------------------------------------------------


def exposure(t: Inputs) -> DataFrame:
    ratings = t("ratings").withColumn("risk_category", F.rtrim("risk_category"))
    return exp.build_exposure(t("bal_month"), t("profile"), t("guar"), ratings)


def _rounded_exposure(df: DataFrame, **more: int) -> DataFrame:
    rates = dict.fromkeys(("pd", "pd_sm_wo", "pd_sub_wo", "pd_d_wo"), RATE)
    return rounded(df, balance=MONEY, **rates, **more)


_EXPOSURE_COLUMNS = """rc_opp_number, time, loan_id, round(balance, 2) balance, round(pd, 6) pd,
    round(pd_sm_wo, 6) pd_sm_wo, round(pd_sub_wo, 6) pd_sub_wo, round(pd_d_wo, 6) pd_d_wo, wo, guarantee, notes,
    risk_category"""


@query("exposure_panel", f"select {_EXPOSURE_COLUMNS} from {{exposure_rated}}")
def exposure_panel(t: Inputs) -> DataFrame:
    return _rounded_exposure(exposure(t))


@query("clean_exposure", f"select {_EXPOSURE_COLUMNS} from {{exposure_clean}}")
def clean_exposure(t: Inputs) -> DataFrame:
    return _rounded_exposure(exp.clean_exposure(exposure(t)))


def loss_rows(t: Inputs) -> DataFrame:
    return exp.expected_loss(exp.clean_exposure(exposure(t)))


@query(
    "expected_loss",
    """select loan_id, time, round(balance, 2) balance, round(pd, 6) pd, round(pd_sm_wo, 6) pd_sm_wo,
              round(pd_sub_wo, 6) pd_sub_wo, round(pd_d_wo, 6) pd_d_wo, wo, guarantee, notes, risk_category,
              round(pd_profile, 6) pd_profile, round(el, 2) el from {el}""",
)
def expected_loss(t: Inputs) -> DataFrame:
    return _rounded_exposure(exp.loan_loss_output(loss_rows(t)), pd_profile=RATE, el=MONEY)


@query(
    "portfolio_loss",
    """select l.time, round(el_portfolio, 2) el_portfolio, round(port_balance, 2) port_balance,
              round(el_portfolio / nullif(port_balance, 0), 6) port_loss, round(p_balance_all, 2) p_balance_all,
              round(port_balance / nullif(p_balance_all, 0), 6) portfolio_with_data
       from (select time, coalesce(sum(el), 0e0) el_portfolio, coalesce(sum(balance), 0e0) port_balance from {el}
             where pd_profile is not null group by time) l
       join (select time, coalesce(sum(balance), 0e0) p_balance_all from {el} group by time) a
       on l.time is not distinct from a.time""",
)
def portfolio_loss(t: Inputs) -> DataFrame:
    return rounded(
        exp.portfolio_loss(loss_rows(t)), el_portfolio=MONEY, port_balance=MONEY, port_loss=RATE,
        p_balance_all=MONEY, portfolio_with_data=RATE,
    )


@query(
    "category_share",
    """select c.time, c.risk_category, round(c.cat_total, 2) cat_total, round(m.total, 2) balance,
              round(c.cat_total / nullif(m.total, 0), 6) cat_prop
       from (select time, risk_category, case when count(*) = count(balance) then sum(balance) end cat_total
             from {el} group by time, risk_category) c
       join (select time, case when count(*) = count(balance) then sum(balance) end total from {el} group by time) m
       on c.time is not distinct from m.time""",
)
def category_share(t: Inputs) -> DataFrame:
    out = agg.category_share(exp.clean_exposure(exposure(t)), "time", "risk_category", "balance")
    return rounded(out, cat_total=MONEY, balance=MONEY, cat_prop=RATE)


@query(
    "rated_book",
    """select loan_id, balance_0915, last_year, sector, loan_type, amount, september_risk_category,
              round(pd_rr, 6) pd_rr from {rated} r left join
       (select risk_rating, avg(writeoff) pd_rr from {rated} where active = 0 and last_year = 1 group by risk_rating) f
       on r.risk_rating = f.risk_rating where active = 1 and balance_0915 > 0 and last_year = 1""",
)
def rated_book(t: Inputs) -> DataFrame:
    return rounded(rating.rated_book(rating.rate_by_factor(t("rated"))), pd_rr=RATE)


