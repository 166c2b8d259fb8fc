"""The input exports as typed tables.

``FIELDS`` states, per export, the column read and the type rule it goes through. Unknown extra columns
are ignored and never parsed. Text keeps the blank/unknown distinction, dates, numbers and ids turn
junk into null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import month_end, month_start
from ..functions.parsing import (
    COLUMN_NAME_DATE,
    ROLLUP_LABELS,
    canonical_label,
    parse_date,
    parse_id,
    parse_int,
    parse_month_label,
    parse_number,
    parse_percent,
    text,
)
from ..operators.aggregates import sum_by
from ..operators.file_order import drop_rollups, fill_down_ordered, head_until_null, trim_rows
from ..operators.reshape import gather_long, pick_positions
from ..session import cut_lineage
from .lines import read_export

Rule = Callable[[Column], Column]

# Export -> output column -> (header name made safe, type rule).
FIELDS: dict[str, dict[str, tuple[str, Rule]]] = {
    "payments": {
        "loan_id": ("Loan.ID", parse_id),
        "txn_type": ("Transaction..Record.Type", text),
        "date": ("Date", parse_date),
        "disbursed": ("Principal.Disbursed", parse_number),
        "paid": ("Principal.Paid", parse_number),
    },
    "ratings": {
        "loan_id": ("Loan.ID", parse_id),
        "date": ("Rating.Date", parse_date),
        "monitor_score": ("Final.Risk.Score", parse_number),
        "risk_category_sf": ("Final.Risk.Category", text),
    },
    "maturities": {
        "loan_id": ("Loan.ID", parse_id),
        "date": ("Report.Date", parse_date),
        "maturity_date": ("Maturity.Date", parse_date),
        "outstanding_principal": ("Outstanding.Principal", parse_number),
    },
    "collateral": {
        "loan_id": ("Loan.ID", parse_id),
        "collateral_type": ("Collateral.Type", text),
    },
    "recoveries": {
        "loan_id": ("Loan.ID", parse_id),
        "recovery": ("Internal.Recoveries.Paid", parse_number),
    },
    "profile_pds": {
        "loan_id": ("LoanID", parse_id),
        "pd": ("pd", parse_number),
        "pd_one_year": ("pd_one_year", parse_number),
        "close_date": ("Close.Date", parse_date),
        "maturity_at_origination": ("Maturity.at.Origination", parse_date),
        "active": ("active", parse_int),
        "wo": ("WO", text),
        "rc_opp_number": ("RC.Opp.Number", text),
        "pd_sm_wo": ("pdSMWO", parse_number),
        "pd_sub_wo": ("pdSubWO", parse_number),
        "pd_d_wo": ("pdDWO", parse_number),
    },
    "underwriting_pds": {
        "loan_id": ("LoanID", parse_id),
        "max_risk_category": ("Max_Risk_Category", text),
        "wo": ("WO", text),
        "active": ("active", parse_int),
        "pd": ("pd", parse_number),
        "pd_multiple_years": ("pd_multiple_years", parse_number),
        "rc_opp_number": ("RC.Opp.Number", text),
    },
    "payment_flags": {
        "loan_id": ("LoanID", parse_id),
        "watch_list": ("watch_list", parse_int),
        "pmt_1k": ("pmt_1k", parse_int),
    },
    "migration_pds": {
        "loan_id": ("LoanID", parse_id),
        "max_risk_category": ("Max_Risk_Category", text),
        "wo": ("WO", text),
        "active": ("active", parse_int),
        "pd": ("pd", parse_number),
        "risk_category": ("Risk_Category", text),
        "balance_1215": ("balance_1215", parse_number),
        "ead": ("EAD", parse_number),
        "lgd": ("LGD", parse_number),
        "sector": ("Sector.and.Perishability", text),
        "loan_type": ("Loan.Type", text),
        "amount": ("Amount", parse_number),
    },
    "september_loans": {
        "loan_id": ("LoanID", parse_id),
        "last_year": ("last_year", parse_int),
        "pd": ("pd", parse_number),
        "september_risk_category": ("September_Risk_Category", text),
    },
    "rated_loans": {
        "loan_id": ("LoanID", parse_id),
        "risk_rating": ("Risk.Rating.Category", parse_int),
        "writeoff": ("WriteoffsDummy", parse_int),
        "active": ("active", parse_int),
        "balance_0915": ("balance_0915", parse_number),
        "last_year": ("last_year", parse_int),
        "sector": ("Sector.and.Perishability", text),
        "loan_type": ("Loan.Type", text),
        "amount": ("amount", parse_number),
        "september_risk_category": ("September_Risk_Category", text),
    },
}


def typed(df: DataFrame, fields: dict[str, tuple[str, Rule]]) -> DataFrame:
    """Project an all-text export to its typed columns (``_ord`` is kept when present)."""
    keep = ["_ord"] if "_ord" in df.columns else []
    return df.select(*keep, *[rule(F.col(f"`{src}`")).alias(name) for name, (src, rule) in fields.items()])


def load(spark: SparkSession, export: str, path: str) -> DataFrame:
    """Any export without special layout."""
    return typed(read_export(spark, path, ordered=export in ("ratings",)), FIELDS[export])


#: Why a field's text did not parse, by type rule; text always does.
REASONS: dict[Rule, str] = {
    parse_id: "no whole number",
    parse_int: "no whole number",
    parse_number: "no number",
    parse_date: "no date",
    parse_percent: "no percentage",
}

REJECTED = "array<struct<field:string,text:string,reason:string>>"


@dataclass(frozen=True)
class Checked:
    """An export with its rejected texts. ``rows``: the typed rows whose required fields are known; ``rejected``: (_ord, field,
    text, reason, dropped), one row per field whose text did not parse or that is required and blank. ``dropped``
    tells whether the row is absent from ``rows``."""

    rows: DataFrame
    rejected: DataFrame


def typed_checked(df: DataFrame, fields: dict[str, tuple[str, Rule]], required: Sequence[str] = ("loan_id",), keep: Sequence[str] = ()) -> Checked:
    """:func:`typed`, with what it turned into null beside it. ``df`` has ``_ord``; columns of ``keep`` stay as they are.

    The text is parsed once: the typed rows are stored with the list of their rejected fields, and both results read them.
    A blank field or NA is unknown, not rejected, unless the field is required.
    """
    named = {f"_raw_{name}": F.col(f"`{src}`") for name, (src, _) in fields.items()}
    parsed = df.select("_ord", *keep, *[c.alias(n) for n, c in named.items()], *[rule(F.col(f"`{src}`")).alias(name) for name, (src, rule) in fields.items()])
    checks = []
    for name, (_, rule) in fields.items():
        raw = F.col(f"_raw_{name}")
        blank = raw.isNull() | F.trim(raw).isin("", "NA")
        reason = F.when(F.col(name).isNotNull(), F.lit(None)).when(~blank, F.lit(REASONS.get(rule, "unreadable")))
        if name in required:
            reason = reason.when(blank, F.lit("missing"))
        checks.append(F.when(reason.isNotNull(), F.struct(F.lit(name).alias("field"), raw.alias("text"), reason.alias("reason"))))
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(name).isNull()
    stored = cut_lineage(
        parsed.select("_ord", *keep, *fields, F.array_compact(F.array(*checks)).cast(REJECTED).alias("_rejected"), missing.alias("_dropped")), "typed"
    )
    told = stored.filter((F.size("_rejected") > 0)).select("_ord", F.inline("_rejected"), F.col("_dropped").alias("dropped"))
    return Checked(stored.filter("not _dropped").drop("_rejected", "_dropped"), told)


def load_checked(spark: SparkSession, export: str, path: str, required: Sequence[str] = ("loan_id",)) -> Checked:
    """Any export without special layout, with its rejected rows. The rows keep their place in the file (``_ord``)."""
    return typed_checked(read_export(spark, path, ordered=True), FIELDS[export], required)


def load_balances_checked(spark: SparkSession, path: str, month: str = "end") -> Checked:
    """The balance report with its rejected rows; padding, subtotal and roll-up rows are no rows of it."""
    raw = read_export(spark, path, skip=1)
    dated = _dated_balances(pick_positions(raw, range(4), ["_ord", "date", "loan_id", "balance"]), month)
    return typed_checked(dated, {"loan_id": ("loan_id", parse_id), "balance": ("balance", parse_number)}, keep=["date"])


def load_recoveries(spark: SparkSession, path: str) -> DataFrame:
    """One row per loan; a loan with an unreadable amount has an unknown total."""
    return sum_by(load(spark, "recoveries", path), "loan_id", "recovery", "recovery")


def load_wide_categories(spark: SparkSession, path: str) -> DataFrame:
    """One column per date -> (loan_id, date, risk_category)."""
    raw = read_export(spark, path)
    first, *dates = raw.columns
    flat = raw.toDF("loan_id", *[d.replace(".", "_") for d in dates])
    long = gather_long(flat, ["loan_id"], [d.replace(".", "_") for d in dates], "date", "risk_category")
    return long.select(
        parse_id("loan_id").alias("loan_id"),
        parse_date(F.regexp_replace("date", "_", "."), COLUMN_NAME_DATE).alias("date"),
        parse_int("risk_category").alias("risk_category"),
    )


def load_balances(spark: SparkSession, path: str, drop_null_ids: bool = True, month: str = "end") -> DataFrame:
    """The balance report: a title line, a date written only on the first row of its block, two padding
    rows on top, a subtotal at the bottom, roll-up rows in between.

    ``drop_null_ids=False`` keeps rows whose id is no number; ``month`` sets the day of the month.
    """
    raw = read_export(spark, path, skip=1)
    named = pick_positions(raw, range(4), ["_ord", "date", "loan_id", "balance"])
    return clean_balances(named, drop_null_ids, month)


def clean_balances(named: DataFrame, drop_null_ids: bool = True, month: str = "end") -> DataFrame:
    rows = _dated_balances(named, month)
    out = rows.select(parse_id("loan_id").alias("loan_id"), "date", parse_number("balance").alias("balance"))
    return out.filter(F.col("loan_id").isNotNull()) if drop_null_ids else out


def _dated_balances(named: DataFrame, month: str) -> DataFrame:
    """The report's own rows, still as text, each with its block's date."""
    dated = fill_down_ordered(named.withColumn("date", parse_month_label("date")), "date")
    rows = drop_rollups(trim_rows(dated, head=2, tail=1, ordinals=named), "loan_id", ROLLUP_LABELS)
    return rows.withColumn("date", month_end("date") if month == "end" else month_start("date"))


def load_guarantees(spark: SparkSession, path: str, cut_footer: bool = True) -> DataFrame:
    """(loan_id, guarantee as a fraction, notes). The footer starts at the first empty id; without
    ``cut_footer`` rows with a readable id below it are kept as well. Notes may hold line breaks."""
    raw = read_export(spark, path, skip=1, line_breaks=True)
    named = pick_positions(raw, [0, 1, 2, 4, 5], ["_ord", "close_date", "loan_id", "guarantee", "notes"])
    named = named.withColumn("loan_id", parse_id("loan_id"))
    rows = head_until_null(named, "loan_id") if cut_footer else named.filter(F.col("loan_id").isNotNull())
    return rows.select("loan_id", parse_percent("guarantee").alias("guarantee"), text("notes").alias("notes"))


def load_monthly_ratings(spark: SparkSession, path: str) -> DataFrame:
    """(rc_opp_number, time = month start, risk_category) ; columns are found by name among positions 1, 3, 4 and 5."""
    raw = pick_positions(read_export(spark, path), [0, 2, 3, 4])
    return raw.select(
        text("RCOppNumber").alias("rc_opp_number"),
        month_start(parse_date("RiskDate")).alias("time"),
        canonical_label(text("RiskCategory")).alias("risk_category"),
    )


def load_september_categories(spark: SparkSession, path: str) -> DataFrame:
    return _load_periods(spark, path, "risk_cat_", parse_int)


def load_september_balances(spark: SparkSession, path: str) -> DataFrame:
    return _load_periods(spark, path, "balance_", parse_number)


def _load_periods(spark: SparkSession, path: str, stem: str, rule: Rule) -> DataFrame:
    raw = read_export(spark, path)
    periods = [c for c in raw.columns if c.startswith(stem)]
    return raw.select(parse_id("LoanID").alias("loan_id"), *[rule(F.col(c)).alias(c) for c in periods])
