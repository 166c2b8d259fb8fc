"""The given tables as the library's input tables.

Each view is one SQL text that Spark and DuckDB both accept. Names in braces are given tables or other
views. The given tables hold no nulls, so the views make some on purpose.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "orders", "lineitem")

VIEWS = {
    # Some balances fall below the floors (whole amounts), some are negative.
    "bal": """
        select o_custkey loan_id, cast(last_day(o_orderdate) as date) date,
               sum(case when o_orderkey % 23 = 0 then cast(floor(o_totalprice / 1000e0) as double)
                        when o_orderkey % 29 = 0 then -o_totalprice else o_totalprice end) balance
        from {orders} group by o_custkey, cast(last_day(o_orderdate) as date)""",
    # '' is a known blank, null is unknown.
    "risk": """
        select o_custkey loan_id, cast(o_orderdate as date) date,
               case when o_orderkey % 7 = 0 then null else cast(50 + o_orderkey % 50 as double) end monitor_score,
               case o_orderkey % 8 when 0 then 'Current' when 1 then 'Watch List' when 2 then 'Special Mention'
                    when 3 then 'Substandard' when 4 then 'Doubtful' when 5 then '' end risk_category_sf,
               o_orderkey _ord
        from {orders}""",
    "pmt": """
        select o_custkey loan_id, cast(l_shipdate as date) date,
               case when l_returnflag <> 'R' then l_extendedprice end paid,
               case when l_linestatus = 'O' then l_extendedprice end disbursed
        from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    # Categories for every month with an order or a shipment, changing every 5, 9 or 13 months.
    "r_cat": """
        select loan_id, date, cast(case k when 0 then null when 5 then 1 else k end as int) risk_category
        from (select distinct loan_id, date, (loan_id * 7 + cast(floor((year(date) * 12 + month(date))
                     / (5e0 + 4e0 * (loan_id % 3))) as bigint)) % 6 k
              from (select o_custkey loan_id, cast(last_day(o_orderdate) as date) date from {orders}
                    union all select loan_id, cast(last_day(date) as date) date from {pmt}) m) d""",
    "maturity": """
        select o_custkey loan_id, cast(last_day(o_orderdate) as date) date,
               max(cast(o_orderdate as date) + cast(o_orderkey % 1500 as int)) maturity_date,
               sum(o_totalprice) outstanding_principal
        from {orders} where o_orderstatus = 'F' group by o_custkey, cast(last_day(o_orderdate) as date)""",
    "collateral": """
        select c_custkey loan_id, case c_mktsegment when 'BUILDING' then 'Real Estate'
               when 'MACHINERY' then 'Equipment and Machinery' when 'FURNITURE' then null
               else c_mktsegment end collateral_type
        from {customer}""",
    "guar": """
        select c_custkey loan_id, (c_custkey % 100) / 100e0 guarantee,
               case when c_custkey % 20 = 0 then 'partial' end notes
        from {customer} where c_custkey % 10 = 0""",
    # One unreadable recovery per 500 order lines makes that loan's total unknown.
    "recov_rows": """
        select o_custkey loan_id, case when l_orderkey % 500 = 3 then null else l_extendedprice end recovery
        from {lineitem} join {orders} on l_orderkey = o_orderkey where l_returnflag = 'R'""",
    "recov": """
        select loan_id, case when count(*) = count(recovery) then sum(recovery) end recovery
        from {recov_rows} group by loan_id""",
    "last_order": """
        select o_custkey loan_id, cast(max(o_orderdate) as date) last_date,
               max_by(cast(substr(o_orderpriority, 1, 1) as int), o_orderkey) last_priority,
               max_by(o_totalprice, o_orderkey) last_balance
        from {orders} group by o_custkey""",
    # Loans with key % 20 = 19 have no probability, key % 50 = 0 no write-off state.
    "pds": """
        select c_custkey loan_id, 0.01e0 + 0.3e0 * (c_custkey % 97) / 97e0 pd_one_year,
               case when c_custkey % 13 = 0 then null else last_date + cast(c_custkey % 400 as int) end close_date,
               case when c_custkey % 11 = 0 then null else last_date + cast(c_custkey % 2500 as int) end
                   maturity_at_origination,
               cast(case when c_custkey % 3 = 0 then 1 else 0 end as int) active,
               case when c_custkey % 50 = 0 then null when c_acctbal < 0 then 'Writeoff' else 'Performing' end wo
        from {customer} left join {last_order} on c_custkey = loan_id where c_custkey % 20 <> 19""",
    "u": """
        select c_custkey loan_id, ((c_custkey * 7919 + 13) % 1000) / 1000e0 u,
               0.01e0 + 0.3e0 * (c_custkey % 97) / 97e0 pd,
               cast(case when c_custkey % 3 = 0 then 1 else 0 end as int) active
        from {customer}""",
    # One row per loan; the probability carries signal. Some unknown labels and write-off states.
    "loans": """
        select loan_id, pd, 1e0 - power(1e0 - pd, 1e0 + loan_id % 3) pd_multiple_years, active,
               case when loan_id % 211 = 0 then 'Unrated'
                    when u < 1.2e0 * pd * (0.3e0 + 2e0 * pd) then 'Doubtful' when u < 1.2e0 * pd then 'Substandard'
                    when u < 0.7e0 * sqrt(pd) then 'Special Mention' else 'Current' end max_risk_category,
               case when loan_id % 73 = 0 then null
                    when u < 1.2e0 * pd * (0.3e0 + 2e0 * pd) * (0.2e0 + 2e0 * pd) then 'Writeoff'
                    else 'Performing' end wo
        from {u}""",
    # Write-offs that follow two features together without exception; neither splits them alone.
    "split_loans": """
        select loan_id, pd, utilised, cast(case when 3e0 * pd + utilised > 0.9e0 then 1 else 0 end as int) y
        from (select loan_id, pd, (loan_id * 53 % 89) / 89e0 utilised from {u}) s
        where abs(3e0 * pd + utilised - 0.9e0) > 0.15e0""",
    # What the loan is rated today, with some loans unrated, and its present balance.
    "book": """
        select loans.loan_id, pd, active,
               case (loans.loan_id * 31) % 9 when 0 then 'Special Mention' when 1 then 'Substandard'
                    when 2 then 'Doubtful' when 3 then null else 'Current' end risk_category,
               case when loans.loan_id % 17 = 0 then null else last_balance end balance,
               case when loans.loan_id % 41 = 0 then 'Unknown' end note
        from {loans} loans left join {last_order} lo on loans.loan_id = lo.loan_id""",
    "payment_flags": """
        select c_custkey loan_id, cast(c_custkey % 2 as int) watch_list,
               cast(case when c_custkey % 5 < 3 then 1 else 0 end as int) pmt_1k
        from {customer} where c_custkey % 333 <> 332""",
    "profile": """
        select c_custkey loan_id, case when c_custkey % 40 = 7 then null else concat('OPP-', c_custkey) end rc_opp_number,
               0.01e0 + 0.3e0 * (c_custkey % 97) / 97e0 pd,
               case when c_custkey % 31 = 0 then null else 0.05e0 + 0.4e0 * (c_custkey % 97) / 97e0 end pd_sm_wo,
               0.1e0 + 0.5e0 * (c_custkey % 89) / 89e0 pd_sub_wo, 0.3e0 + 0.6e0 * (c_custkey % 83) / 83e0 pd_d_wo,
               case when c_acctbal < 0 then 'Writeoff' else 'Performing' end wo
        from {customer} where c_custkey % 20 <> 19""",
    "bal_month": """
        select loan_id, cast(date_trunc('month', date) as date) time, balance from {bal}""",
    # Monthly ratings by opportunity number; those of some loans came without a number.
    "ratings": """
        select rc_opp_number, time, case rung when 2 then 'Special Mention' when 3 then 'Substandard '
               when 4 then 'Doubtful' when 1 then 'Current' end risk_category
        from (select case when o_custkey % 40 = 7 then null else concat('OPP-', o_custkey) end rc_opp_number,
                     cast(date_trunc('month', o_orderdate) as date) time,
                     max(nullif(cast(substr(o_orderpriority, 1, 1) as int), 5)) rung
              from {orders}
              group by case when o_custkey % 40 = 7 then null else concat('OPP-', o_custkey) end,
                       cast(date_trunc('month', o_orderdate) as date)) r""",
    "rated": """
        select c_custkey loan_id, case when c_custkey % 37 = 0 then null else last_priority end risk_rating,
               cast(case when c_acctbal < 400 * last_priority then 1 else 0 end as int) writeoff,
               cast(case when c_custkey % 3 = 0 then 1 else 0 end as int) active,
               case when c_custkey % 6 = 0 then 0e0 else last_balance end balance_0915,
               cast(case when c_custkey % 4 = 0 then 0 else 1 end as int) last_year,
               c_mktsegment sector, case when c_custkey % 2 = 0 then 'Term' else 'Line' end loan_type,
               c_acctbal amount,
               case when c_custkey % 9 = 0 then 'Substandard' else 'Current' end september_risk_category
        from {customer} left join {last_order} on c_custkey = loan_id""",
    "sept": """
        select c_custkey loan_id, cast(case when c_custkey % 8 = 0 then 0 else 1 end as int) last_year,
               case when c_custkey % 61 = 0 then null else 0.01e0 + 0.3e0 * (c_custkey % 97) / 97e0 end pd
        from {customer}""",
}

PERIODS = (1996, 1997, 1998, 1999, 2000)


def _wide(stem: str, expr: str, suffix) -> str:
    month = "year(o_orderdate) = {y} and month(o_orderdate) = 9"
    cols = [
        f"{expr.replace('PICK', f'case when {month.format(y=y)} then')} {stem}{suffix(y)}" for y in PERIODS
    ]
    return "select o_custkey loan_id,\n" + ",\n".join(cols) + "\nfrom {orders} group by o_custkey"


VIEWS["sept_balances"] = _wide("balance_09", "sum(PICK o_totalprice end)", lambda y: f"{y % 100:02d}")
VIEWS["sept_categories"] = _wide(
    "risk_cat_9_",
    "max(PICK case substr(o_orderpriority, 1, 1) when '1' then 0 when '2' then 6 when '3' then 12 when '4' then 18 end end)",
    lambda y: str(y),
)

_NAME = re.compile(r"\{(\w+)\}")


def uses(sql: str) -> list[str]:
    """Names in braces, in order of first use."""
    return list(dict.fromkeys(_NAME.findall(sql)))


def view(spark: SparkSession, sf_dir: str, name: str, _seen: dict[str, DataFrame] | None = None) -> DataFrame:
    """A given table, or a view over them, as a DataFrame."""
    seen = {} if _seen is None else _seen
    if name not in seen:
        if name in VIEWS:
            inputs = {n: view(spark, sf_dir, n, seen) for n in uses(VIEWS[name])}
            seen[name] = spark.sql(VIEWS[name], **inputs)
        else:
            seen[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return seen[name]


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` for DuckDB: every view it names in braces, directly or not, becomes a CTE. A view that
    names itself is recursive; all others are computed once."""
    known = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def visit(name: str) -> None:
        if name in known and name not in order:
            for n in uses(known[name]):
                if n != name:
                    visit(n)
            order.append(name)

    for n in uses(sql):
        visit(n)

    def plain(text: str) -> str:
        return _NAME.sub(r"\1", text)

    def cte(name: str) -> str:
        how = "" if name in uses(known[name]) else "materialized "
        return f"{name} as {how}({plain(known[name])})"

    head = "with recursive " + ",\n".join(map(cte, order)) + "\n" if order else ""
    return head + plain(sql)
