"""Queries for parsing, projection, joins, aggregates, windows, reshaping, features and checks."""

from __future__ import annotations

from dataclasses import replace
from datetime import date
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditladder.functions import features as feat
from creditladder.functions.exact import exact_sum_or_zero
from creditladder.functions.ladder import (
    CODE_THRESHOLDS,
    category_code,
    category_label,
    is_writeoff,
    reached_flags,
    rung_label,
)
from creditladder.functions.nulls import if_known, na_zero, replace_where
from creditladder.functions.parsing import (
    COLUMN_NAME_DATE,
    ROLLUP_LABELS,
    canonical_label,
    parse_date,
    parse_id,
    parse_month_label,
    parse_number,
    parse_percent,
    text,
)
from creditladder.operators import aggregates as agg
from creditladder.operators import file_order, reshape, windows
from creditladder.operators.checks import expect_covered, missing_report
from creditladder.operators.joins import anti, merge, semi
from creditladder.plans.panel import OUTPUT as PANEL_COLUMNS
from creditladder.plans.panel import PanelSources, active_as_of, active_as_of_stored, build_panel, loan_table, months_table, one_per_month
from creditladder.plans.panel_append import MONTHLY, append_month, loan_state, with_first_ratings
from creditladder.plans.panel_checks import write_checked_panel
from creditladder.session import cut_lineage, new_path
from creditladder.sources.exports import load, load_balances, load_checked, load_guarantees
from creditladder.sources.layout import replace_months, write_by_key
from creditladder.sources.lines import read_export
from creditladder.sources.sinks import write_table

from .registry import MONEY, RATE, Inputs, query, rounded

LOAN_MONTH = ["loan_id", "date"]


def write_lines(lines: DataFrame, path_of, name: str) -> str:
    """Write (ord, value) as text in file order; returns the path."""
    path = new_path(path_of, name)
    lines.orderBy("ord").select("value").write.text(path)
    return path


# --- sources and parsing ---------------------------------------------------------------------------


@query("scan_project", "select o_custkey loan_id, cast(o_orderdate as date) date, o_totalprice balance from {orders}")
def scan_project(t: Inputs) -> DataFrame:
    picked = reshape.pick_positions(t("orders"), [1, 4, 3], ["loan_id", "date", "balance"])
    return picked.withColumn("date", F.col("date").cast("date"))


@query(
    "csv_export",
    """select o_custkey loan_id, cast(o_orderdate as date) date,
              case when o_orderkey % 7 = 0 then null else o_totalprice end paid,
              case when o_orderkey % 5 = 0 then null else o_orderpriority end txn_type
       from {orders}""",
)
def csv_export(t: Inputs) -> DataFrame:
    """The orders written as a payments export (extra columns, commas, blanks, NA) and read back."""
    o = t("orders")
    path = new_path(t.spark, "payments")
    o.select(
        F.lit("x").alias("Officer"),
        F.col("o_custkey").cast("string").alias("Loan ID"),
        F.when(F.col("o_orderkey") % 5 == 0, "NA").otherwise(F.col("o_orderpriority")).alias("Transaction/ Record Type"),
        F.date_format("o_orderdate", "M/d/yyyy").alias("Date"),
        F.lit("").alias("Principal Disbursed"),
        F.when(F.col("o_orderkey") % 7 != 0, F.format_number("o_totalprice", 2)).alias("Principal Paid"),
    ).write.csv(path, header=True)
    return load(t.spark, "payments", path).select("loan_id", "date", "paid", "txn_type")


_MESSY = """
    select row_number() over (order by o_orderkey) - 1 pos, o_custkey, o_orderdate, o_totalprice, o_orderkey,
           o_orderkey % 17 = 0 bad_id, o_orderkey % 19 = 0 no_id, o_orderkey % 11 = 0 bad_date, o_orderkey % 13 = 0 bad_paid from {orders}"""


def _messy_payments(t: Inputs) -> str:
    """The orders as a payments export in which some ids, dates and amounts cannot be read; returns its path."""
    k = F.col("o_orderkey")
    cells = {
        "Loan ID": F.when(k % 17 == 0, F.concat(F.lit("Loan "), "o_custkey")).when(k % 19 == 0, "").otherwise(F.col("o_custkey").cast("string")),
        "Transaction/ Record Type": F.lit("Pay"),
        "Date": F.when(k % 11 == 0, "soon").otherwise(F.date_format("o_orderdate", "M/d/yyyy")),
        "Principal Disbursed": F.lit("NA"),
        "Principal Paid": F.when(k % 13 == 0, "-").otherwise(F.concat(F.lit('"'), F.format_number("o_totalprice", 2), F.lit('"'))),
    }
    top = t.spark.createDataFrame([(-1, ",".join(cells))], "ord long, value string")
    body = t("orders").select(k.alias("ord"), F.concat_ws(",", *cells.values()).alias("value"))
    return write_lines(top.unionAll(body), t.spark, "messy")


@query(
    "rejected_rows",
    f"""with m as ({_MESSY})
        select pos, 'loan_id' field, case when bad_id then 'Loan ' || o_custkey else '' end "text", case when bad_id then 'no whole number' else 'missing' end reason, true dropped
        from m where bad_id or no_id
        union all select pos, 'date', 'soon', 'no date', bad_id or no_id from m where bad_date
        union all select pos, 'paid', '-', 'no number', bad_id or no_id from m where bad_paid""",
)
def rejected_rows(t: Inputs) -> DataFrame:
    """What could not be read of an export, with its place and reason."""
    rejected = load_checked(t.spark, "payments", _messy_payments(t)).rejected
    return rejected.select(F.col("_ord").alias("pos"), "field", F.coalesce("text", F.lit("")).alias("text"), "reason", "dropped")


@query(
    "kept_rows",
    f"""with m as ({_MESSY})
        select pos, o_custkey loan_id, case when not bad_date then cast(o_orderdate as date) end date, case when not bad_paid then o_totalprice end paid
        from m where not bad_id and not no_id""",
)
def kept_rows(t: Inputs) -> DataFrame:
    """The other side of the same pass: with the dropped ones these are all rows read."""
    return load_checked(t.spark, "payments", _messy_payments(t)).rows.select(F.col("_ord").alias("pos"), "loan_id", "date", "paid")


@query(
    "skip_lines",
    """select row_number() over (order by o_orderkey) - 1 pos, o_custkey loan_id, o_orderpriority label,
              o_totalprice amount
       from {orders}""",
)
def skip_lines(t: Inputs) -> DataFrame:
    """A file with a title line above the header, quoted commas, and its row order kept."""
    rows = t("orders").select(
        F.col("o_orderkey").alias("ord"),
        F.concat_ws(
            ",", "o_custkey", F.concat(F.lit('"'), "o_orderpriority", F.lit(', x"')), F.concat(F.lit('"'), F.format_number("o_totalprice", 2), F.lit('"'))
        ).alias("value"),
    )
    top = t.spark.sql("select * from values (-2L, 'Report of all loans'), (-1L, 'Loan ID,Label,% Amount') v(ord, value)")
    raw = read_export(t.spark, write_lines(top.unionAll(rows), t.spark, "titled"), skip=1)
    return raw.select(
        F.col("_ord").alias("pos"),
        parse_id("`Loan.ID`").alias("loan_id"),
        F.regexp_replace("Label", ", x$", "").alias("label"),
        parse_number("`X..Amount`").alias("amount"),
    )


@query("balance_report", "select loan_id, date, round(balance, 2) balance from {bal}")
def balance_report(t: Inputs) -> DataFrame:
    """The balances written in the report's layout (month label on the first row of its block only, padding,
    roll-ups, thousands commas, subtotal) and read back."""
    bal = t("bal")
    months = bal.select("date").distinct()
    label = F.date_format("date", "MMM-yyyy")

    def lines(df: DataFrame, rank: int, shown, loan, amount) -> DataFrame:
        quoted = F.concat(F.lit('"'), amount, F.lit('"'))
        return df.select(
            F.struct(F.col("date").alias("d"), F.lit(rank).alias("r"), loan.cast("string").alias("l")).alias("ord"),
            F.concat_ws(",", shown, loan, quoted, F.lit("n/a")).alias("value"),
        )

    edge = lambda d, value: t.spark.range(1).select(
        F.struct(F.lit(d).cast("date").alias("d"), F.lit(0).alias("r"), F.lit(value).alias("l")).alias("ord"),
        F.lit(value).alias("value"),
    )
    body = [
        lines(months, 1, label, F.lit(ROLLUP_LABELS[1]), F.lit("0")),
        lines(bal, 2, F.lit(""), F.col("loan_id"), F.format_number("balance", 2)),
        lines(months, 3, F.lit(""), F.lit(ROLLUP_LABELS[2]), F.lit("0")),
        lines(months, 4, F.lit(""), F.lit("no number"), F.lit("0")),
    ]
    first = months.agg(F.min("date").alias("date"))
    out = edge("0001-01-01", "Balance report").unionAll(edge("0001-01-02", "Time,LoanID,Balance,Risk"))
    out = out.unionAll(lines(first, -2, label, F.lit("pad"), F.lit("0"))).unionAll(lines(first, -1, F.lit(""), F.lit("pad"), F.lit("0")))
    for part in body:
        out = out.unionAll(part)
    out = out.unionAll(edge("9999-12-31", ',12,"999",subtotal'))
    return rounded(load_balances(t.spark, write_lines(out, t.spark, "balances")), balance=MONEY)


@query(
    "guarantee_report",
    """select loan_id, round(guarantee, 6) guarantee,
              case when notes is null then '' else notes || chr(10) || 'of the "bank", see ' || loan_id end notes
       from {guar}""",
)
def guarantee_report(t: Inputs) -> DataFrame:
    """Guarantees with a title line, positions to pick, notes over several lines and a footer, written and read back."""
    note = F.concat(F.lit('"'), "notes", F.lit('\nof the ""bank"", see '), "loan_id", F.lit('"'))
    rows = t("guar").select(
        F.col("loan_id").alias("ord"),
        F.concat_ws(
            ",", F.lit("1/31/2016"), "loan_id", F.lit("bank"), F.concat(F.round(F.col("guarantee") * 100).cast("int"), F.lit("%")), F.coalesce(note, F.lit(""))
        ).alias("value"),
    )
    edges = t.spark.sql(
        "select * from values (-2L, 'Guarantees'), (-1L, 'Close Date,Loan ID,Bank,% Guaranteed,Notes'), "
        "(9223372036854775806L, ',,,,'), (9223372036854775807L, ',7,,50%,total') v(ord, value)"
    )
    return rounded(load_guarantees(t.spark, write_lines(edges.unionAll(rows), t.spark, "guarantees")), guarantee=RATE)


@query(
    "parse_dates",
    """select o_orderkey, case when o_orderkey % 11 <> 0 then cast(o_orderdate as date) end us_date,
              case when o_orderkey % 11 <> 0 then cast(o_orderdate as date) end with_time,
              cast(date_trunc('month', o_orderdate) as date) month_label, last_day(o_orderdate) column_date
       from {orders}""",
)
def parse_dates(t: Inputs) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return t("orders").select(
        "o_orderkey",
        parse_date(F.when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise(F.date_format(d, "M/d/yyyy"))).alias("us_date"),
        parse_date(F.when(F.col("o_orderkey") % 11 == 0, " 13 May").otherwise(F.date_format(d, "' 'M/d/yyyy' 0:00'"))).alias("with_time"),
        parse_month_label(F.date_format(d, "MMM-yyyy")).alias("month_label"),
        parse_date(F.date_format(F.last_day(d), "'X'M.d.yyyy"), COLUMN_NAME_DATE).alias("column_date"),
    )


@query(
    "parse_number",
    "select o_orderkey, case when o_orderkey % 13 <> 0 then o_totalprice end amount from {orders}",
)
def parse_number_query(t: Inputs) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 13 == 0, "-").otherwise(F.format_number("o_totalprice", 2))
    return t("orders").select("o_orderkey", parse_number(raw).alias("amount"))


@query("parse_percent", "select loan_id, round(guarantee, 6) guarantee from {guar}")
def parse_percent_query(t: Inputs) -> DataFrame:
    raw = F.concat(F.round(F.col("guarantee") * 100).cast("int").cast("string"), F.lit("%"))
    return t("guar").select("loan_id", F.round(parse_percent(raw), RATE).alias("guarantee"))


@query("parse_id", "select o_custkey loan_id, count(*) n from {orders} where o_orderkey % 3 <> 0 group by o_custkey")
def parse_id_query(t: Inputs) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.lit("LoanID (x)")).otherwise(F.col("o_custkey").cast("string"))
    ids = t("orders").select(parse_id(raw).alias("loan_id")).filter(F.col("loan_id").isNotNull())
    return ids.groupBy("loan_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "canonical_label",
    "select rtrim(risk_category) risk_category, count(*) n from {ratings} group by rtrim(risk_category)",
)
def canonical_label_query(t: Inputs) -> DataFrame:
    labels = t("ratings").select(canonical_label("risk_category").alias("risk_category"))
    return labels.groupBy("risk_category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fill_global",
    """select o_orderkey, last_value(case when o_orderkey % 7 = 3 then cast(o_orderdate as date) end ignore nulls)
              over (order by o_orderkey rows between unbounded preceding and current row) date
       from {orders}""",
)
def fill_global(t: Inputs) -> DataFrame:
    blanked = t("orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 == 3, F.col("o_orderdate").cast("date")).alias("date")
    )
    return file_order.fill_down_ordered(blanked, "date", "o_orderkey")


@query(
    "trim_rows",
    """select o_orderkey, o_custkey from
       (select *, row_number() over (order by o_orderkey) a, row_number() over (order by o_orderkey desc) z
        from {orders}) o where a > 2 and z > 1""",
)
def trim_rows(t: Inputs) -> DataFrame:
    return file_order.trim_rows(t("orders").select("o_orderkey", "o_custkey"), 2, 1, "o_orderkey")


@query("drop_rollups", "select o_orderkey, o_orderpriority from {orders} where o_orderpriority not in ('1-URGENT', '5-LOW')")
def drop_rollups(t: Inputs) -> DataFrame:
    return file_order.drop_rollups(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ("1-URGENT", "5-LOW"))


@query(
    "head_until_null",
    """select o_orderkey, o_custkey id from {orders} where o_orderkey <
       coalesce((select min(o_orderkey) from {orders} where o_orderkey % 4999 = 4998), 9223372036854775807)""",
)
def head_until_null(t: Inputs) -> DataFrame:
    ids = F.when(F.col("o_orderkey") % 4999 != 4998, F.col("o_custkey"))
    return file_order.head_until_null(t("orders").select("o_orderkey", ids.alias("id")), "id", "o_orderkey")


# --- projection, filter, conditional -----------------------------------------------------------------


@query("drop_columns", "select loan_id, date, monitor_score, _ord from {risk}")
def drop_columns(t: Inputs) -> DataFrame:
    return t("risk").drop("risk_category_sf")


@query("select_range", "select loan_id, pd_sm_wo, pd_sub_wo, pd_d_wo from {profile}")
def select_range(t: Inputs) -> DataFrame:
    kept = reshape.select_range(t("profile"), "rc_opp_number", "pd", invert=True)
    return reshape.select_range(kept, "loan_id", "pd_d_wo")


@query("select_existing", "select loan_id, pd, wo from {profile}")
def select_existing(t: Inputs) -> DataFrame:
    return reshape.select_existing(t("profile"), ["wo", "pd", "months_in_risk_cat", "loan_id"])


@query(
    "segment_filters",
    """select loan_id, 'closed' segment from {pds} where active = 0 and close_date < date '2000-01-01'
       union all select loan_id, 'small pd' from {pds} where pd_one_year >= 0.05e0 and pd_one_year < 0.2e0
       union all select loan_id, 'rated book' from {rated} where active = 1 and balance_0915 > 0 and last_year = 1
       union all select loan_id, 'last year' from {sept} where last_year = 1""",
)
def segment_filters(t: Inputs) -> DataFrame:
    pds, pick = t("pds"), lambda df, name: df.select("loan_id", F.lit(name).alias("segment"))
    closed = pds.filter((F.col("active") == 0) & (F.col("close_date") < F.lit("2000-01-01").cast("date")))
    small = pds.filter((F.col("pd_one_year") >= 0.05) & (F.col("pd_one_year") < 0.2))
    book = t("rated").filter((F.col("active") == 1) & (F.col("balance_0915") > 0) & (F.col("last_year") == 1))
    last = t("sept").filter(F.col("last_year") == 1)
    return (
        pick(closed, "closed").unionByName(pick(small, "small pd"))
        .unionByName(pick(book, "rated book")).unionByName(pick(last, "last year"))
    )


@query(
    "replace_where",
    """select loan_id, date, case when risk_category > 2 then 9 else risk_category end risk_category from {r_cat}""",
)
def replace_where_query(t: Inputs) -> DataFrame:
    return t("r_cat").withColumn("risk_category", replace_where("risk_category", F.col("risk_category") > 2, F.lit(9)))


@query(
    "case_null",
    """select loan_id, date, case when risk_category is null then null when risk_category = 1 then 'first'
              when risk_category = 2 then 'second' else 'later' end step from {r_cat}""",
)
def case_null(t: Inputs) -> DataFrame:
    rung = F.col("risk_category")
    step = if_known(rung == 1, F.lit("first"), if_known(rung == 2, F.lit("second"), F.lit("later")))
    return t("r_cat").select(*LOAN_MONTH, step.alias("step"))


@query(
    "na_zero",
    "select loan_id, date, coalesce(paid, 0e0) paid, coalesce(disbursed, 0e0) disbursed from {pmt}",
)
def na_zero_query(t: Inputs) -> DataFrame:
    return t("pmt").withColumns({c: na_zero(c) for c in ("paid", "disbursed")})


# --- joins -------------------------------------------------------------------------------------------


@query(
    "merge_left",
    """select b.loan_id, b.date, round(b.balance, 2) balance, r.risk_category
       from {bal} b left join {r_cat} r on b.loan_id = r.loan_id and b.date = r.date""",
)
def merge_left(t: Inputs) -> DataFrame:
    out = merge(t("bal"), t("r_cat"), LOAN_MONTH, "left")
    return rounded(out, balance=MONEY)


@query(
    "merge_full",
    """select coalesce(b.loan_id, m.loan_id) loan_id, coalesce(b.date, m.date) date, round(b.balance, 2) balance,
              round(m.paid, 2) paid
       from {bal} b full join (select loan_id, last_day(date) date, sum(coalesce(paid, 0e0)) paid from {pmt}
                               group by loan_id, last_day(date)) m on b.loan_id = m.loan_id and b.date = m.date""",
)
def merge_full(t: Inputs) -> DataFrame:
    paid = windows.monthly_sums(t("pmt").withColumn("date", F.last_day("date")), LOAN_MONTH, {"paid": "paid"})
    return rounded(merge(t("bal"), paid, LOAN_MONTH, "full"), balance=MONEY, paid=MONEY)


@query(
    "merge_inner",
    """select l.loan_id, round(l.pd, 6) pd, l.wo, f.watch_list, f.pmt_1k from {loans} l
       join {payment_flags} f on l.loan_id = f.loan_id""",
)
def merge_inner(t: Inputs) -> DataFrame:
    return rounded(merge(t("loans").select("loan_id", "pd", "wo"), t("payment_flags")), pd=RATE)


@query(
    "merge_null_keys",
    """select b.rc_opp_number, r.time, b.loan_id, r.risk_category from {profile} b
       left join {ratings} r on b.rc_opp_number is not distinct from r.rc_opp_number""",
)
def merge_null_keys(t: Inputs) -> DataFrame:
    """A missing key meets a missing key, and repeated keys repeat rows."""
    out = merge(t("profile").select("rc_opp_number", "loan_id"), t("ratings"), "rc_opp_number", "left")
    return out.select("rc_opp_number", "time", "loan_id", "risk_category")


@query(
    "semi_anti",
    """select loan_id, case when loan_id in (select loan_id from {pds}) then 'present' else 'absent' end membership
       from {collateral}""",
)
def semi_anti(t: Inputs) -> DataFrame:
    loans, pds = t("collateral").select("loan_id"), t("pds")
    tag = lambda df, name: df.withColumn("membership", F.lit(name))
    return tag(semi(loans, pds, "loan_id"), "present").unionByName(tag(anti(loans, pds, "loan_id"), "absent"))


# --- aggregates --------------------------------------------------------------------------------------


@query("recoveries_by_loan", "select loan_id, round(recovery, 2) recovery from {recov}")
def recoveries_by_loan(t: Inputs) -> DataFrame:
    return rounded(agg.sum_by(t("recov_rows"), "loan_id", "recovery", "recovery"), recovery=MONEY)


@query("balance_by_month", "select date, round(coalesce(sum(balance), 0e0), 2) total_balance from {bal} group by date")
def balance_by_month(t: Inputs) -> DataFrame:
    return rounded(agg.total_by(t("bal"), "date", "balance", "total_balance"), total_balance=MONEY)


@query(
    "wo_rate_weighted",
    """select 'all' loans, active, round(case when count(*) = count(wo)
              then sum(case when wo = 'Writeoff' then balance else 0e0 end) end / nullif(sum(balance), 0), 6) wo_rate
       from (select p.active, p.wo, b.balance from {bal} b join {pds} p on b.loan_id = p.loan_id where b.balance > 200) r
       group by active
       union all select 'known', active, round(sum(case when wo = 'Writeoff' then balance else 0e0 end) / nullif(sum(balance), 0), 6)
       from (select p.active, p.wo, b.balance from {bal} b join {pds} p on b.loan_id = p.loan_id
             where b.balance > 200 and p.wo is not null) k group by active""",
)
def wo_rate_weighted(t: Inputs) -> DataFrame:
    """Over all loans, where unknown states make the rate unknown, and over those whose state is known."""
    df = merge(t("bal").filter("balance > 200"), t("pds"), "loan_id", null_keys="drop")
    rate = agg.weighted_rate("balance", is_writeoff("wo")).alias("wo_rate")
    every = df.groupBy(F.lit("all").alias("loans"), "active").agg(rate)
    known = df.filter("wo is not null").groupBy(F.lit("known").alias("loans"), "active").agg(rate)
    return rounded(every.unionByName(known), wo_rate=RATE)


@query(
    "pd_weighted_each",
    """select active, round(sum(pd * balance) / nullif(sum(balance), 0), 6) weighted_pd from
       (select active, balance, case when loan_id % 7 = 0 then null else pd end pd from {book}) b group by active""",
)
def pd_weighted_each(t: Inputs) -> DataFrame:
    book = t("book").withColumn("pd", F.when(F.col("loan_id") % 7 != 0, F.col("pd")))
    return rounded(book.groupBy("active").agg(agg.weighted_mean("pd", "balance", "each").alias("weighted_pd")), weighted_pd=RATE)


@query(
    "pd_weighted_pair",
    """select risk_category, round(case when count(*) filter (pd is not null and balance is null) = 0
                then sum(pd * balance) / nullif(sum(case when pd is not null then balance end), 0) end, 6) weighted_pd
       from (select risk_category, balance, case when loan_id % 7 = 0 then null else pd end pd from {book}) b
       group by risk_category""",
)
def pd_weighted_pair(t: Inputs) -> DataFrame:
    book = t("book").withColumn("pd", F.when(F.col("loan_id") % 7 != 0, F.col("pd")))
    out = book.groupBy("risk_category").agg(agg.weighted_mean("pd", "balance", "pair").alias("weighted_pd"))
    return rounded(out, weighted_pd=RATE)


@query(
    "column_means",
    """select 'pd_one_year' as variable, round(avg(pd_one_year), 6) mean, 'skipped' nulls from {pds}
       union all select 'active', round(avg(active), 6), 'skipped' from {pds}
       union all select 'pd', round(avg(pd), 6), 'strict' from {profile}
       union all select 'pd_sm_wo', null, 'strict' from {profile} group by 1
       union all select 'pd_d_wo', round(avg(pd_d_wo), 6), 'strict' from {profile}""",
)
def column_means(t: Inputs) -> DataFrame:
    skipped = agg.means(t("pds"), ["pd_one_year", "active"]).withColumn("nulls", F.lit("skipped"))
    strict = agg.means(t("profile"), ["pd", "pd_sm_wo", "pd_d_wo"], strict=True).withColumn("nulls", F.lit("strict"))
    return rounded(skipped.unionByName(strict), mean=RATE)


@query(
    "crosstab",
    """select r.risk_category, p.wo, count(*) n from {r_cat} r join {pds} p on r.loan_id = p.loan_id
       where r.risk_category is not null and p.wo is not null group by r.risk_category, p.wo""",
)
def crosstab(t: Inputs) -> DataFrame:
    return agg.crosstab_long(merge(t("r_cat"), t("pds"), "loan_id", null_keys="drop"), "risk_category", "wo")


@query(
    "value_counts",
    """select cast(risk_rating as varchar) as value, count(*) n, 'rating' kind from {rated}
       where risk_rating is not null group by 1
       union all select cast(pd_group as varchar), count(*), 'pd' from
       (select cast(round(pd_sub_wo, 2) * 100 as int) pd_group from {profile}) p group by 1""",
)
def value_counts(t: Inputs) -> DataFrame:
    ratings = agg.value_counts(t("rated"), "risk_rating").select(F.col("risk_rating").cast("string").alias("value"), "n", F.lit("rating").alias("kind"))
    pds = agg.value_counts(t("profile"), "pd_sub_wo", 2)
    pds = pds.select(F.round(F.col("pd_sub_wo") * 100).cast("int").cast("string").alias("value"), "n", F.lit("pd").alias("kind"))
    return ratings.unionByName(pds)


@query(
    "null_counts",
    """select 'loan_id' as variable, count(*) - count(loan_id) n_null from {pds}
       union all select 'pd_one_year', count(*) - count(pd_one_year) from {pds}
       union all select 'close_date', count(*) - count(close_date) from {pds}
       union all select 'maturity_at_origination', count(*) - count(maturity_at_origination) from {pds}
       union all select 'active', count(*) - count(active) from {pds}
       union all select 'wo', count(*) - count(wo) from {pds}""",
)
def null_counts(t: Inputs) -> DataFrame:
    return agg.null_counts(t("pds"))


@query(
    "duplicate_keys",
    "select cast(sum(n - 1) as bigint) n_duplicates from (select count(*) n from {risk} group by loan_id, last_day(date)) r",
)
def duplicate_keys(t: Inputs) -> DataFrame:
    return agg.duplicate_keys(t("risk").withColumn("date", F.last_day("date")), LOAN_MONTH)


@query(
    "month_total",
    """select loan_id, time, round(balance, 2) balance, round(sum(balance) over (partition by time), 2) portfolio_total
       from {bal_month}""",
)
def month_total(t: Inputs) -> DataFrame:
    out = agg.month_total(t("bal_month"), "time", "balance", "portfolio_total")
    return rounded(out, balance=MONEY, portfolio_total=MONEY).select("loan_id", "time", "balance", "portfolio_total")


# --- windows -----------------------------------------------------------------------------------------


@query(
    "exact_totals",
    """select cast(last_day(date) as date) date, round(cast(sum(cast(paid * 1152921504606846976e0 as hugeint)) as double) / 1152921504606846976e0, 5) paid,
              count(*) n
       from {pmt} group by last_day(date)""",
)
def exact_totals(t: Inputs) -> DataFrame:
    """Month totals that have the same bits however the rows lie; the SQL adds whole 2**-60."""
    paid = t("pmt").withColumn("date", F.last_day("date"))
    out = paid.groupBy("date").agg(exact_sum_or_zero("paid").alias("paid"), F.count(F.lit(1)).alias("n"))
    return rounded(out, paid=5)


@query("running_totals", "select loan_id, date, round(paid_cum, 2) paid_cum, round(disb_cum, 2) disb_cum from {pmt_flat}")
def running_totals(t: Inputs) -> DataFrame:
    monthly = windows.monthly_sums(
        t("pmt").withColumn("date", F.last_day("date")), LOAN_MONTH, {"paid_cum": "paid", "disb_cum": "disbursed"}
    )
    out = windows.running_sum(monthly, {"paid_cum": "paid_cum", "disb_cum": "disb_cum"}, "loan_id", "date")
    return rounded(out, paid_cum=MONEY, disb_cum=MONEY)


@query("last_per_month", "select loan_id, date, monitor_score, risk_category_sf from {risk_flat}")
def last_per_month(t: Inputs) -> DataFrame:
    return one_per_month(t("risk"))


_RATED_MONTHS = """(select b.loan_id, b.date, r.monitor_score, r.risk_category_sf from {bal} b
                    left join {risk_flat} r on b.loan_id = r.loan_id and b.date = r.date) x"""


@query(
    "fill_down",
    f"""select loan_id, date, last_value(monitor_score ignore nulls) over w monitor_score,
              last_value(risk_category_sf ignore nulls) over w risk_category_sf
       from {_RATED_MONTHS}
       window w as (partition by loan_id order by date rows between unbounded preceding and current row)""",
)
def fill_down(t: Inputs) -> DataFrame:
    rated = merge(t("bal"), one_per_month(t("risk")), LOAN_MONTH, "left").drop("balance")
    return windows.fill_down(rated, ["monitor_score", "risk_category_sf"], "loan_id", "date")


@query(
    "fill_up",
    f"""select loan_id, date, coalesce(last_value(monitor_score ignore nulls) over w,
              first_value(monitor_score ignore nulls) over u) monitor_score,
              coalesce(last_value(risk_category_sf ignore nulls) over w,
              first_value(risk_category_sf ignore nulls) over u) risk_category_sf
       from {_RATED_MONTHS}
       window w as (partition by loan_id order by date rows between unbounded preceding and current row),
              u as (partition by loan_id order by date rows between current row and unbounded following)""",
)
def fill_up(t: Inputs) -> DataFrame:
    return windows.fill_up(fill_down(t), ["monitor_score", "risk_category_sf"], "loan_id", "date")


@query(
    "months_in_cat_cum",
    """select loan_id, date, risk_category, cast(n as int) months_cum, cast(n * n as double) months_cum_sq from
       (select *, row_number() over (partition by loan_id, risk_category order by date) n from {r_cat}) c""",
)
def months_in_cat_cum(t: Inputs) -> DataFrame:
    out = windows.cumulative_count(t("r_cat"), ["loan_id", "risk_category"], "date", "months_cum")
    return out.withColumn("months_cum_sq", F.pow("months_cum", F.lit(2)))


@query(
    "months_in_cat",
    """select loan_id, date, risk_category, cast(n as int) months_run, cast(n * n as double) months_run_sq,
              cast(n * n * n as double) months_run_cube
       from (select *, row_number() over (partition by loan_id, spell order by date) n from
             (select *, sum(fresh) over (partition by loan_id order by date) spell from
              (select *, case when risk_category = lag(risk_category) over (partition by loan_id order by date)
                         then 0 else 1 end fresh from {r_cat}) a) b) c""",
)
def months_in_cat(t: Inputs) -> DataFrame:
    out = windows.run_length(t("r_cat"), "loan_id", "date", "risk_category", "months_run")
    run = F.col("months_run")
    return out.withColumns({"months_run_sq": F.pow(run, F.lit(2)), "months_run_cube": F.pow(run, F.lit(3))})


# --- sort, reshape -----------------------------------------------------------------------------------


@query("head_rows", "select loan_id, round(pd, 6) pd, wo from {loans} order by loan_id limit 6")
def head_rows(t: Inputs) -> DataFrame:
    return rounded(t("loans").select("loan_id", "pd", "wo").orderBy("loan_id").limit(6), pd=RATE)


LONG_LABELS = {"pd": "Current", "pd_sm_wo": "Special Mention", "pd_sub_wo": "Substandard", "pd_d_wo": "Doubtful"}
_LONG = "\nunion all ".join(
    f"select loan_id, '{label}' migration, round({c}, 6) pds from {{profile}} WHERE" for c, label in LONG_LABELS.items()
)


@query("gather_long", _LONG.replace("WHERE", ""))
def gather_long(t: Inputs) -> DataFrame:
    cols = reshape.columns_between(t("profile"), "pd", "pd_d_wo")
    return rounded(reshape.gather_long(t("profile"), ["loan_id"], cols, "migration", "pds", LONG_LABELS), pds=RATE)


@query(
    "gather_low_pd",
    "\nunion all ".join(
        f"select loan_id, '{c}' migration, round({c}, 6) pds from {{profile}} where pd < 0.25e0"
        for c in ("pd", "pd_sub_wo", "pd_d_wo")
    ),
)
def gather_low_pd(t: Inputs) -> DataFrame:
    low = t("profile").filter("pd < 0.25")
    cols = ["pd", *reshape.columns_between(low, "pd_sub_wo", "pd_d_wo")]
    return rounded(reshape.gather_long(low, ["loan_id"], cols, "migration", "pds"), pds=RATE)


# --- features ----------------------------------------------------------------------------------------


@query(
    "remaining_tenor",
    """select b.loan_id, b.date, round(case when coalesce(m.maturity_date, p.maturity_at_origination) - b.date < 365
              then 1e0 else (coalesce(m.maturity_date, p.maturity_at_origination) - b.date) / 365e0 end, 6) remaining_tenor
       from {bal} b left join {maturity} m on b.loan_id = m.loan_id and b.date = m.date
       left join {pds} p on b.loan_id = p.loan_id""",
)
def remaining_tenor(t: Inputs) -> DataFrame:
    df = merge(merge(t("bal"), t("maturity"), LOAN_MONTH, "left"), t("pds"), "loan_id", "left", null_keys="drop")
    tenor = feat.remaining_tenor("maturity_date", "maturity_at_origination", "date")
    return df.select(*LOAN_MONTH, F.round(tenor, RATE).alias("remaining_tenor"))


@query(
    "flags",
    """select r._ord, case when monitor_score >= 60 and monitor_score < 70 then 1 else 0 end watch_list,
              case when case when _ord % 3 = 0 then null else o_totalprice end >= 1000 then 1 else 0 end pmt_1k
       from {risk} r join {orders} on _ord = o_orderkey""",
)
def flags(t: Inputs) -> DataFrame:
    df = t("risk").join(t("orders"), F.col("_ord") == F.col("o_orderkey"))
    paid = F.when(F.col("_ord") % 3 != 0, F.col("o_totalprice"))
    return df.withColumn("paid", paid).select(
        "_ord", feat.on_watch_list("monitor_score").alias("watch_list"), feat.has_paid("paid").alias("pmt_1k")
    )


@query(
    "cumulative_pd",
    """select loan_id, round(1e0 - power(1e0 - pd_one_year, loan_id % 7 + 0.5e0), 6) pd from {pds}""",
)
def cumulative_pd(t: Inputs) -> DataFrame:
    df = t("pds").withColumn("tenor", F.col("loan_id") % 7 + F.lit(0.5))
    return df.select("loan_id", F.round(feat.cumulative_pd("pd_one_year", "tenor"), RATE).alias("pd"))


@query(
    "category_codes",
    """select _ord, case risk_category_sf when 'Current' then 0 when 'Watch List' then 3 when 'Special Mention' then 6
              when 'Substandard' then 12 when 'Doubtful' then 18 else -1 end code,
              nullif(risk_category_sf, '') label,
              case risk_category_sf when 'Current' then 0 when 'Special Mention' then 6
              when 'Substandard' then 12 when 'Doubtful' then 18 else -1 end loan_code,
              case _ord % 5 when 1 then 'Current' when 2 then 'Special Mention' when 3 then 'Substandard'
              when 4 then 'Doubtful' end rung
       from {risk}""",
)
def category_codes(t: Inputs) -> DataFrame:
    df = t("risk").withColumn("code", category_code("risk_category_sf"))
    return df.select(
        "_ord", "code", category_label("code").alias("label"),
        category_code("risk_category_sf", watch_list=False).alias("loan_code"),
        rung_label(F.col("_ord") % 5).alias("rung"),
    )


def _flag_sql(name: str, code: str, threshold: int) -> str:
    return (
        f"case when wo is null then null when wo = 'Writeoff' or {code} > {threshold} then 1 "
        f"when {code} <= {threshold} then 0 end {name}"
    )


@query(
    "reached_flags_panel",
    "select loan_id, date, case when risk_category > 0 then 1 when risk_category <= 0 then 0 end as current, "
    + ", ".join(_flag_sql(n, "risk_category", i) for i, n in ((1, "special_mention"), (2, "substandard"), (3, "doubtful")))
    + " from (select r.*, p.wo from {r_cat} r left join {pds} p on r.loan_id = p.loan_id) x",
)
def reached_flags_panel(t: Inputs) -> DataFrame:
    df = merge(t("r_cat"), t("pds"), "loan_id", "left", null_keys="drop")
    return df.select(*LOAN_MONTH, *[c.alias(n) for n, c in reached_flags("risk_category", "wo").items()])


@query(
    "reached_flags_loan",
    "select loan_id, 1 as current, "
    + ", ".join(_flag_sql(n, "code", i) for i, n in ((0, "special_mention"), (6, "substandard"), (12, "doubtful")))
    + """ from (select loan_id, wo, case max_risk_category when 'Current' then 0 when 'Special Mention' then 6
          when 'Substandard' then 12 when 'Doubtful' then 18 else -1 end code from {loans}) x""",
)
def reached_flags_loan(t: Inputs) -> DataFrame:
    df = t("loans").withColumn("code", category_code("max_risk_category", watch_list=False))
    return df.select("loan_id", *[c.alias(n) for n, c in reached_flags("code", "wo", CODE_THRESHOLDS).items()])


@query(
    "hard_collateral",
    """select loan_id, coalesce(collateral_type in ('Real Estate', 'Equipment and Machinery'), false) collateral
       from {collateral}""",
)
def hard_collateral(t: Inputs) -> DataFrame:
    return t("collateral").select("loan_id", feat.hard_collateral("collateral_type").alias("collateral"))


@query("balance_floor", "select loan_id, date, round(balance, 2) balance from {bal} where balance > 200")
def balance_floor(t: Inputs) -> DataFrame:
    return rounded(t("bal").filter(F.col("balance") > feat.PANEL_BALANCE_FLOOR), balance=MONEY)


@query(
    "text_rule",
    "select _ord, coalesce(nullif(risk_category_sf, 'Doubtful'), case when risk_category_sf is null then '' end) label from {risk}",
)
def text_rule(t: Inputs) -> DataFrame:
    """A blank field is an empty text, the letters NA are unknown."""
    raw = F.when(F.col("risk_category_sf") == "Doubtful", "NA").otherwise(F.col("risk_category_sf"))
    return t("risk").select("_ord", text(raw).alias("label"))


# --- panel -------------------------------------------------------------------------------------------


def panel_sources(t: Inputs) -> PanelSources:
    return PanelSources(
        balances=t("bal"), ratings=t("risk"), payments=t("pmt"), maturities=t("maturity"), categories=t("r_cat"),
        collateral=t("collateral"), guarantees=t("guar"), recoveries=t("recov"), pds=t("pds"),
    )


_PANEL_SQL = """
    select loan_id, date, round(balance, 2) balance, risk_category_sf, round(paid_cum, 2) paid_cum,
           round(disb_cum, 2) disb_cum, maturity_date, risk_category, collateral, guarantee,
           round(recovery, 2) recovery, round(pd_one_year, 6) pd_one_year, close_date, maturity_at_origination, active,
           wo, months_risk_cat_cum months_in_risk_cat_cum,
           cast(months_risk_cat_cum * months_risk_cat_cum as double) months_in_risk_cat_cum_sq,
           months_run months_in_risk_cat, cast(months_run * months_run as double) months_in_risk_cat_sq,
           cast(months_run * months_run * months_run as double) months_in_risk_cat_cube,
           round(remaining_tenor, 6) remaining_tenor, watch_list, pmt_1k, round(pd, 6) pd, f_current as current,
           f_sm special_mention, f_sub substandard, f_doubt doubtful
    from {panel}"""


def _rounded_panel(df: DataFrame) -> DataFrame:
    money = dict.fromkeys(("balance", "paid_cum", "disb_cum", "recovery"), MONEY)
    return rounded(df, **money, **dict.fromkeys(("pd_one_year", "remaining_tenor", "pd"), RATE))


@query("panel", _PANEL_SQL)
def panel(t: Inputs) -> DataFrame:
    return _rounded_panel(build_panel(panel_sources(t)))


@query("panel_by_joins", _PANEL_SQL)
def panel_by_joins(t: Inputs) -> DataFrame:
    """The join-by-join form, in which repeated keys repeat rows."""
    return _rounded_panel(build_panel(panel_sources(t), duplicates="repeat"))


@query("panel_append", _PANEL_SQL)
def panel_append(t: Inputs) -> DataFrame:
    """The panel without its last three months, to which those are added one by one."""
    t.store("pmt")
    src = panel_sources(t)
    last = t("bal").agg(F.max("date")).first()[0]
    ends = [r[0] for r in t.spark.range(4).select(F.last_day(F.add_months(F.lit(last), -F.col("id").cast("int")))).collect()][::-1]
    old = replace(src, **{n: getattr(src, n).filter(F.col("date") <= F.lit(ends[0])) for n in MONTHLY})
    new = replace(src, **{n: cut_lineage(getattr(src, n).filter(F.col("date").between(F.date_add(F.lit(ends[0]), 1), F.lit(ends[-1]))), n) for n in MONTHLY})
    loans, months = cut_lineage(loan_table(src), "loans"), cut_lineage(months_table(old), "months")
    state = cut_lineage(loan_state(months), "state")
    parts, first_ratings = [build_panel(old, months=months, loans=loans)], []
    for end in ends[1:]:
        month = append_month(new, state, end.isoformat(), loans, durable=True)
        state = cut_lineage(month.state, "state")
        parts.append(month.panel)
        first_ratings.append(month.first_ratings)
    # What became known in a month fills the months before it; each month is read and joined once.
    later = [reduce(DataFrame.unionByName, first_ratings[i:]) for i in range(len(first_ratings))]
    parts = [with_first_ratings(part, found) for part, found in zip(parts, later)] + parts[-1:]
    return _rounded_panel(reduce(DataFrame.unionByName, parts))


_MONTH_NULLS = {"balance": "balance", "monitor_score": "monitor_score", "risk_category_sf": "risk_category_sf", "paid_cum": "paid_cum",
                "disb_cum": "disb_cum", "maturity_date": "maturity_date", "risk_category": "risk_category"}
_PANEL_NULLS = {c: c for c in PANEL_COLUMNS} | {
    "months_in_risk_cat_cum": "months_risk_cat_cum", "months_in_risk_cat_cum_sq": "months_risk_cat_cum", "months_in_risk_cat": "months_run",
    "months_in_risk_cat_sq": "months_run", "months_in_risk_cat_cube": "months_run",
    "current": "f_current", "special_mention": "f_sm", "substandard": "f_sub", "doubtful": "f_doubt",
}
_CHECKED_PAIRS = {("risk_category", "risk_category_sf"): "risk_category_sf", ("risk_category", "wo"): "wo", ("special_mention", "wo"): "wo", ("risk_category_sf", "wo"): "wo"}


@query(
    "panel_checks",
    "\nunion all\n".join(
        [
            "select 'rows' part, 'months' a, '' b, cast(count(*) as double) n from {counted}",
            "select 'rows', 'above the floor', '', count(*) from {counted} where balance > 200",
            "select 'rows', 'panel', '', count(*) from {panel}",
            "select 'rows', 'repeated keys', '', count(*) - count(distinct (loan_id, date)) from {panel}",
            "select 'rows', 'balance without category', '', count(*) from {panel} where risk_category is null and balance > 0",
        ]
        + [f"select 'nulls months', '{n}', '', count(*) - count({c}) from {{counted}}" for n, c in _MONTH_NULLS.items()]
        + [f"select 'nulls panel', '{n}', '', count(*) - count({c}) from {{panel}}" for n, c in _PANEL_NULLS.items()]
        + ["select 'total', cast(date as varchar), '', round(sum(balance), 2) from {panel} group by date"]
        + [
            f"select 'counts {a} {b}', cast({dict(special_mention='f_sm').get(a, a)} as varchar), {c}, count(*) from {{panel}} "
            f"where {dict(special_mention='f_sm').get(a, a)} is not null and {c} is not null group by {dict(special_mention='f_sm').get(a, a)}, {c}"
            for (a, b), c in _CHECKED_PAIRS.items()
        ]
    ),
)
def panel_checks(t: Inputs) -> DataFrame:
    """All reports of the panel run, as one table."""
    _, checks = write_checked_panel(panel_sources(t), new_path(t.spark, "panel"))
    blank = F.lit("").alias("b")
    parts = [
        checks.rows.select(F.lit("rows").alias("part"), F.col("stage").alias("a"), blank, F.col("n").cast("double").alias("n")),
        checks.nulls.select(F.concat(F.lit("nulls "), "stage"), "variable", blank, F.col("n_null").cast("double")),
        checks.month_totals.select(F.lit("total"), F.col("date").cast("string"), blank, F.round("total_balance", MONEY)),
        checks.counts.select(F.concat_ws(" ", F.lit("counts"), "first", "second"), "value_first", "value_second", F.col("n").cast("double")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(
    "active_as_of",
    """select b.loan_id, b.date, case when a.loan_id is null then 0 else 1 end active from {bal} b
       left join (select distinct loan_id from {bal} where balance > 0 and date = date '2000-06-30') a
       on a.loan_id = b.loan_id""",
)
def active_as_of_query(t: Inputs) -> DataFrame:
    return active_as_of(t("bal"), "2000-06-30").select(*LOAN_MONTH, "active")


@query(
    "active_as_of_stored",
    """select p.loan_id, p.date, round(p.balance, 2) balance, p.active from {book_panel} p""",
)
def active_as_of_stored_query(t: Inputs) -> DataFrame:
    """On the panel stored by month and loan: one month is scanned for the loans, and they are joined where the rows lie."""
    stored = write_by_key(build_panel(panel_sources(t)), new_path(t.spark, "laid_out"), "loan_id", "date", 8)
    return rounded(active_as_of_stored(stored, "2000-06-30").select(*LOAN_MONTH, "balance", "active"), balance=MONEY)


@query(
    "write_round_trip",
    """select loan_id, date, round(case when date = date '1997-06-30' then 2 * balance else balance end, 2) balance from {bal}
       where date <> date '1997-07-31' or loan_id % 2 = 0""",
)
def write_round_trip(t: Inputs) -> DataFrame:
    """A table stored by month; two months run again; a run that fails changes nothing; read back."""
    path, june, july = new_path(t.spark, "months"), date(1997, 6, 30), date(1997, 7, 31)
    bal = t("bal")
    write_table(bal, path, partition_by=["date"])
    again = bal.filter((F.col("date") == F.lit(june)) | (F.col("date") == F.lit(july)) & (F.col("loan_id") % 2 == 0))
    doubled = F.when(F.col("date") == F.lit(june), 2 * F.col("balance")).otherwise(F.col("balance"))
    replace_months(again.withColumn("balance", doubled), path, "date", [june, july])
    broken = again.withColumn("balance", F.when(F.rand(1) < 2, F.raise_error(F.lit("a run that fails"))).cast("double"))
    for failing, months in ((broken, [june, july]), (again, [june]), (again.limit(0), [june])):
        try:
            replace_months(failing, path, "date", months)
        except (PySparkException, ValueError):
            continue
        raise AssertionError("a broken run was stored")
    return rounded(t.spark.read.schema("balance double, loan_id long, date date").parquet(path).select("loan_id", "date", "balance"), balance=MONEY)


@query(
    "suffix_columns",
    """select b.loan_id, b.date, round(b.balance, 2) balance_x, round(m.outstanding_principal, 2) balance_y, m.maturity_date
       from {bal} b left join {maturity} m on b.loan_id = m.loan_id and b.date = m.date""",
)
def suffix_columns(t: Inputs) -> DataFrame:
    """Columns of one name on both sides of a join come out with a suffix each."""
    both = merge(t("bal"), t("maturity").withColumnRenamed("outstanding_principal", "balance"), LOAN_MONTH, "left")
    return rounded(both, balance_x=MONEY, balance_y=MONEY)


# --- checks ------------------------------------------------------------------------------------------


@query(
    "expect_covered",
    """select count(*) n_rows, count(distinct loan_id) n_keys,
              count(*) filter (loan_id in (select loan_id from {payment_flags})) n_covered,
              count(*) = count(distinct loan_id)
              and count(*) = count(*) filter (loan_id in (select loan_id from {payment_flags})) ok
       from {loans}""",
)
def expect_covered_query(t: Inputs) -> DataFrame:
    return expect_covered(t("loans"), t("payment_flags"), "loan_id")


@query(
    "missing_report",
    """select loan_id, 'no month' missing from {exposure} where time is null
       union all select loan_id, 'no pd' from {exposure} where pd is null""",
)
def missing_report_query(t: Inputs) -> DataFrame:
    df = merge(t("bal_month"), t("profile"), "loan_id", "full")
    return missing_report(df, "loan_id", {"no month": "time", "no pd": "pd"})


@query(
    "writeoff_encodings",
    """select o_orderkey, case o_orderkey % 8 when 0 then null when 1 then true when 2 then true when 3 then true when 7 then true
              else false end from_text,
              case when o_orderkey % 3 = 2 then null else o_orderkey % 3 = 1 end from_double from {orders}""",
)
def writeoff_encodings(t: Inputs) -> DataFrame:
    """The write-off state as text, number text and number."""
    k = F.col("o_orderkey")
    texts = F.array(*map(F.lit, (None, "Writeoff", "1", "1.0", "0", "0.0", "Performing", " 1")))
    return t("orders").select(
        "o_orderkey",
        is_writeoff(F.get(texts, (k % 8).cast("int"))).alias("from_text"),
        is_writeoff(F.when(k % 3 == 2, None).otherwise((k % 3).cast("double"))).alias("from_double"),
    )
