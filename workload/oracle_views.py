"""SQL-only views: the reference results that several queries are compared with."""

from __future__ import annotations

from .irls import firth_two, irls, last_step

SO_FAR = "rows between unbounded preceding and current row"

ORACLE_VIEWS: dict[str, str] = {
    "risk_flat": """
        select loan_id, last_day(date) date, monitor_score, risk_category_sf
        from (select *, row_number() over (partition by loan_id, last_day(date) order by date desc, _ord desc) rn
              from {risk}) r where rn = 1""",
    "pmt_flat": f"""
        select loan_id, date, sum(paid) over w paid_cum, sum(disbursed) over w disb_cum
        from (select loan_id, last_day(date) date, sum(coalesce(paid, 0e0)) paid,
                     sum(coalesce(disbursed, 0e0)) disbursed
              from {{pmt}} group by loan_id, last_day(date)) m
        window w as (partition by loan_id order by date {SO_FAR})""",
    "months": """
        select coalesce(bp.loan_id, m.loan_id) loan_id, coalesce(bp.date, m.date) date, bp.balance, bp.monitor_score,
               bp.risk_category_sf, bp.paid_cum, bp.disb_cum, m.maturity_date
        from (select coalesce(b.loan_id, p.loan_id) loan_id, coalesce(b.date, p.date) date, b.balance,
                     b.monitor_score, b.risk_category_sf, p.paid_cum, p.disb_cum
              from (select bal.*, rf.monitor_score, rf.risk_category_sf from {bal} bal
                    left join {risk_flat} rf on bal.loan_id = rf.loan_id and bal.date = rf.date) b
              full join {pmt_flat} p on b.loan_id = p.loan_id and b.date = p.date) bp
        full join {maturity} m on bp.loan_id = m.loan_id and bp.date = m.date""",
    "filled": f"""
        select x.loan_id, x.date, x.balance, c.risk_category,
               last_value(paid_cum ignore nulls) over w paid_cum, last_value(disb_cum ignore nulls) over w disb_cum,
               last_value(maturity_date ignore nulls) over w maturity_date,
               coalesce(last_value(risk_category_sf ignore nulls) over w,
                        first_value(risk_category_sf ignore nulls) over u) risk_category_sf,
               coalesce(last_value(monitor_score ignore nulls) over w,
                        first_value(monitor_score ignore nulls) over u) monitor_score,
               row_number() over (partition by x.loan_id, c.risk_category order by x.date) months_cum,
               case when c.risk_category = lag(c.risk_category) over (partition by x.loan_id order by x.date)
                    then 0 else 1 end spell_start
        from {{months}} x left join {{r_cat}} c on x.loan_id = c.loan_id and x.date = c.date
        window w as (partition by x.loan_id order by x.date {SO_FAR}),
               u as (partition by x.loan_id order by x.date rows between current row and unbounded following)""",
    "spells": f"""
        select *, sum(spell_start) over (partition by loan_id order by date {SO_FAR}) spell from {{filled}}""",
    "counted": """
        select *, row_number() over (partition by loan_id, spell order by date) months_run from {spells}""",
    "panel_raw": """
        select k.loan_id, k.date, k.balance, k.risk_category_sf, k.paid_cum, k.disb_cum, k.maturity_date,
               k.risk_category,
               coalesce(contains(co.collateral_type, 'Real Estate')
                        or contains(co.collateral_type, 'Equipment and Machinery'), false) collateral,
               g.guarantee, rv.recovery, p.pd_one_year, p.close_date, p.maturity_at_origination, p.active, p.wo,
               cast(k.months_cum as int) months_risk_cat_cum, cast(k.months_run as int) months_run,
               case when coalesce(k.maturity_date, p.maturity_at_origination) - k.date < 365 then 1e0
                    else (coalesce(k.maturity_date, p.maturity_at_origination) - k.date) / 365e0 end remaining_tenor,
               case when k.monitor_score >= 60 and k.monitor_score < 70 then 1 else 0 end watch_list,
               case when k.paid_cum >= 1000 then 1 else 0 end pmt_1k
        from {counted} k left join {collateral} co on k.loan_id = co.loan_id
        left join {guar} g on k.loan_id = g.loan_id left join {recov} rv on k.loan_id = rv.loan_id
        left join {pds} p on k.loan_id = p.loan_id
        where k.balance > 200""",
    "panel": """
        select *, 1e0 - power(1e0 - pd_one_year, remaining_tenor) pd,
               case when risk_category > 0 then 1 when risk_category <= 0 then 0 end f_current,
               case when wo is null then null when wo = 'Writeoff' or risk_category > 1 then 1
                    when risk_category <= 1 then 0 end f_sm,
               case when wo is null then null when wo = 'Writeoff' or risk_category > 2 then 1
                    when risk_category <= 2 then 0 end f_sub,
               case when wo is null then null when wo = 'Writeoff' or risk_category > 3 then 1
                    when risk_category <= 3 then 0 end f_doubt
        from {panel_raw}""",
    "book_panel": """
        select p.* exclude (active), case when a.loan_id is null then 0 else 1 end active
        from {panel} p left join (select distinct loan_id from {panel} where balance > 0 and date = date '2000-06-30') a
        on p.loan_id = a.loan_id""",
    # One row per loan with flags; pd is the multi-year one.
    "loan_frame": """
        select l.loan_id, l.max_risk_category, l.wo, l.active, l.pd pd_orig, l.pd_multiple_years pd, f.watch_list,
               f.pmt_1k, c.code,
               case when l.wo is null then null when l.wo = 'Writeoff' or c.code > 0 then 1 else 0 end sm,
               case when l.wo is null then null when l.wo = 'Writeoff' or c.code > 6 then 1 else 0 end sub,
               case when l.wo is null then null when l.wo = 'Writeoff' or c.code > 12 then 1 else 0 end doubt,
               case when l.wo is not null then case when l.wo = 'Writeoff' then 1 else 0 end end y
        from {loans} l join {payment_flags} f on l.loan_id = f.loan_id
        join (select loan_id, case max_risk_category when 'Current' then 0 when 'Special Mention' then 6
              when 'Substandard' then 12 when 'Doubtful' then 18 else -1 end code from {loans}) c
        on l.loan_id = c.loan_id""",
    "exposure": """
        select case when b.loan_id is null then r.loan_id else b.loan_id end loan_id, b.time, b.balance,
               r.rc_opp_number, r.pd, r.pd_sm_wo, r.pd_sub_wo, r.pd_d_wo, r.wo, r.guarantee, r.notes
        from {bal_month} b full join
             (select p.*, g.guarantee, g.notes from {profile} p left join {guar} g on p.loan_id = g.loan_id) r
        on b.loan_id = r.loan_id""",
    "exposure_rated": """
        select e.*, rtrim(q.risk_category) risk_category from {exposure} e left join {ratings} q
        on e.rc_opp_number is not distinct from q.rc_opp_number and e.time is not distinct from q.time""",
    "exposure_clean": """
        select * replace (coalesce(guarantee, 0e0) as guarantee,
                          case when balance >= 0 and risk_category is null then 'Current' else risk_category end
                              as risk_category,
                          case when balance < 500 then 0e0 else balance end as balance)
        from {exposure_rated}""",
    "el": """
        select *, pd_profile * balance * (1e0 - guarantee) * 0.9e0 el from
        (select *, case risk_category when 'Special Mention' then pd_sm_wo when 'Substandard' then pd_sub_wo
                   when 'Doubtful' then pd_d_wo when 'Current' then pd end pd_profile from {exposure_clean}) x""",
}

PD = ["pd"]
MONTHS = ["pd", "m", "m2"]

# Loan-level segments: condition over loan_frame.
LOAN_SEGMENTS = {
    "current": "true",
    "watch_list": "watch_list = 1",
    "paid_1k": "pmt_1k = 1",
    "special_mention": "sm = 1",
    "substandard": "sm = 1 and sub = 1",
    "doubtful": "sm = 1 and sub = 1 and doubt = 1",
}
for _name, _cond in LOAN_SEGMENTS.items():
    ORACLE_VIEWS[f"train_loan_{_name}"] = (
        f"select y, pd from {{loan_frame}} where active = 0 and {_cond} and y is not null and pd is not null"
    )
    ORACLE_VIEWS[f"fit_loan_{_name}"] = irls(f"fit_loan_{_name}", f"train_loan_{_name}", PD)

ORACLE_VIEWS["scored_loans"] = "select l.*, " + ", ".join(
    f"1e0 / (1e0 + exp(-({m}.b0 + {m}.b1 * l.pd))) {out}"
    for out, m in (("pd_wl", "w"), ("pd_pmt", "t"), ("pd_sm_wo", "s"), ("pd_sub_wo", "b"), ("pd_d_wo", "d"))
) + " from {loan_frame} l, " + ", ".join(
    f"{last_step('fit_loan_' + seg)} {m}"
    for seg, m in (("watch_list", "w"), ("paid_1k", "t"), ("special_mention", "s"), ("substandard", "b"), ("doubtful", "d"))
)

# Panel segments: dated and undated conditions over book_panel, with the features of each.
DATED = "close_date < date '2001-06-01'"
PANEL_SEGMENTS = {
    "current": (DATED, PD),
    "watch_list": ("watch_list = 1 and risk_category = 1 and date > date '1996-03-27' and date < date '2000-01-01'", PD),
    "paid_1k": (f"pmt_1k = 1 and risk_category = 1 and watch_list = 0 and {DATED}", PD),
    "special_mention": (f"f_sm = 1 and months_run < 12 and {DATED}", MONTHS),
    "substandard": (f"f_sub = 1 and {DATED}", MONTHS),
    "doubtful": ("f_doubt = 1", MONTHS),
}
PANEL_SEGMENTS_ALL = {
    "current": ("true", PD),
    "watch_list": ("watch_list = 1 and risk_category = 1", MONTHS),
    "paid_1k": ("pmt_1k = 1 and risk_category = 1 and watch_list = 0", MONTHS),
    "special_mention": ("f_sm = 1 and months_run < 12", MONTHS),
    "substandard": ("f_sub = 1", MONTHS),
    "doubtful": ("f_doubt = 1", MONTHS),
}
for _family, _segments in (("panel", PANEL_SEGMENTS), ("all", PANEL_SEGMENTS_ALL)):
    for _name, (_cond, _features) in _segments.items():
        ORACLE_VIEWS[f"seg_{_family}_{_name}"] = (
            "select balance, pd, wo, cast(months_run as double) m, cast(months_run as double) * months_run m2, "
            f"case when wo = 'Writeoff' then 1 when wo is not null then 0 end y "
            f"from {{book_panel}} where active = 0 and {_cond}"
        )
        ORACLE_VIEWS[f"train_{_family}_{_name}"] = (
            f"select y, pd, m, m2 from {{seg_{_family}_{_name}}} where y is not null and pd is not null"
        )
        ORACLE_VIEWS[f"fit_{_family}_{_name}"] = irls(f"fit_{_family}_{_name}", f"train_{_family}_{_name}", _features)

# The migration chain on `loans`: each stage's input is the prediction of the one before.
ORACLE_VIEWS["chain_base"] = """
    select loan_id, pd, case when wo is not null then case when wo = 'Writeoff' then 1 else 0 end end wo,
           case when wo is null then null when wo = 'Writeoff' or code > 0 then 1 else 0 end sm,
           case when wo is null then null when wo = 'Writeoff' or code > 6 then 1 else 0 end sub,
           case when wo is null then null when wo = 'Writeoff' or code > 12 then 1 else 0 end doubt
    from (select *, case max_risk_category when 'Current' then 0 when 'Special Mention' then 6
                    when 'Substandard' then 12 when 'Doubtful' then 18 else -1 end code from {loans}) l
    where active = 0"""
_STAGES = (("sm", "true"), ("sub", "sm = 1"), ("doubt", "sm = 1 and sub = 1"), ("wo", "sm = 1 and sub = 1 and doubt = 1"))
_prev = "pd"
_source = "{chain_base}"
for _i, (_label, _cond) in enumerate(_STAGES):
    ORACLE_VIEWS[f"train_chain_{_i}"] = (
        f"select cast({_label} as double) y, {_prev} x, * from {_source} s where {_cond} and {_label} is not null"
    )
    ORACLE_VIEWS[f"fit_chain_{_i}"] = irls(f"fit_chain_{_i}", f"train_chain_{_i}", ["x"])
    ORACLE_VIEWS[f"chain_{_i}"] = (
        f"select s.*, 1e0 / (1e0 + exp(-(f.b0 + f.b1 * s.{_prev}))) pm_{_i} from {_source} s, {last_step(f'fit_chain_{_i}')} f"
    )
    _prev, _source = f"pm_{_i}", f"{{chain_{_i}}}"


def chain_scored(source: str) -> str:
    """``source`` (a view name with a pd column) with the four migration probabilities."""
    sql = f"select *, pd pm_x from {{{source}}}"
    for i, name in enumerate(("pm_sm", "pm_substandard", "pm_doubtful", "pm_wo")):
        prev = ("pd", "pm_sm", "pm_substandard", "pm_doubtful")[i]
        sql = (
            f"select s.*, 1e0 / (1e0 + exp(-(f.b0 + f.b1 * s.{prev}))) {name} "
            f"from ({sql}) s, {last_step(f'fit_chain_{i}')} f"
        )
    return sql


ORACLE_VIEWS["scored_chain"] = chain_scored("loans")
ORACLE_VIEWS["scored_book"] = chain_scored("book")

# Calibration works on rows whose state is known.
ORACLE_VIEWS["known_loans"] = "select * from {scored_loans} where y is not null"

# Loans active at each past September.
PERIOD_YEARS = (1996, 1997, 1998, 1999, 2000)
ORACLE_VIEWS["pit_active"] = "\nunion all\n".join(
    f"select s.loan_id, s.pd, '09{y % 100:02d}' period, c.risk_cat_9_{y} code, b.balance_09{y % 100:02d} balance "
    f"from {{sept}} s left join {{sept_categories}} c on s.loan_id = c.loan_id "
    f"left join {{sept_balances}} b on s.loan_id = b.loan_id where s.last_year = 1 and b.balance_09{y % 100:02d} > 0"
    for y in PERIOD_YEARS
)

ORACLE_VIEWS["fit_split"] = firth_two("fit_split", "split_loans", "pd", "utilised")

_AHEAD = {"Current": "pm_sm * pm_substandard * pm_doubtful * pm_wo", "Special Mention": "pm_substandard * pm_doubtful * pm_wo",
          "Substandard": "pm_doubtful * pm_wo", "Doubtful": "pm_wo"}
ORACLE_VIEWS["rated_active_book"] = (
    "select *, case risk_category " + " ".join(f"when '{c}' then {v}" for c, v in _AHEAD.items()) + " end x0 from {scored_book} where active = 1"
)
