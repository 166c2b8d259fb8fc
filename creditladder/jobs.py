"""End-to-end runs: a folder of exports in, result tables out.

Each run reads the exports it needs from ``inputs`` and writes Parquet tables, CSV reports and models under
``out``. An export is expected as ``<export>.csv``; ``files`` maps an export to another file name. What one run
hands to the next is a DataFrame or one of those tables.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.aggregates import value_counts
from .operators.checks import expect_covered, missing_report
from .operators.reshape import select_existing
from .plans import exposure, migration, rating, segments
from .plans.models import FittedLogit, coefficients, fit_logits
from .plans.panel import PanelSources, active_as_of_stored
from .plans.panel_checks import write_checked_panel
from .session import cut_lineage
from .sources import exports
from .sources.sinks import save_models, write_report, write_table

MIGRATION_OUTPUT = ("loan_id", "sector", "loan_type", "risk_category", "balance_1215", "pd", "pd_active", "ead", "amount", "lgd")


def _path(inputs: str, export: str, files: Mapping[str, str] | None) -> str:
    return f"{inputs}/{(files or {}).get(export, export + '.csv')}"


#: Exports of the panel in the plain layout, by the name of the source they become.
PLAIN = {"ratings": "ratings", "payments": "payments", "maturities": "maturities", "collateral": "collateral", "pds": "profile_pds"}


def read_panel_sources(spark: SparkSession, inputs: str, files: Mapping[str, str] | None = None) -> tuple[PanelSources, DataFrame]:
    """The panel's sources, and the texts in them that did not parse: (export, _ord, field, text, reason, dropped)."""
    at = lambda export: _path(inputs, export, files)
    checked = {source: exports.load_checked(spark, export, at(export)) for source, export in PLAIN.items()}
    checked["balances"] = exports.load_balances_checked(spark, at("balances"))
    sources = PanelSources(
        **{name: c.rows if name == "ratings" else c.rows.drop("_ord") for name, c in checked.items()},
        categories=exports.load_wide_categories(spark, at("wide_categories")),
        guarantees=exports.load_guarantees(spark, at("guarantees"), cut_footer=False),
        recoveries=exports.load_recoveries(spark, at("recoveries")),
    )
    parts = [c.rejected.select(F.lit(PLAIN.get(name, name)).alias("export"), "*") for name, c in checked.items()]
    return sources, reduce(DataFrame.union, parts)


def run_panel(
    spark: SparkSession, inputs: str, out: str, files: Mapping[str, str] | None = None, duplicates: str = "error", buckets: int | None = None
) -> DataFrame:
    """Exports -> the loan-month panel, stored by month (and, in so many ``buckets``, by loan), and the reports on its
    data (rejected texts, row and null counts, month totals, count tables)."""
    sources, rejected = read_panel_sources(spark, inputs, files)
    panel, checks = write_checked_panel(sources, f"{out}/panel", duplicates, buckets)
    write_report({**checks.tables(), "rejected": rejected}, f"{out}/checks")
    return panel


def run_panel_models(
    panel: DataFrame, out: str, active_on: str = "2016-04-30", all_dates: bool = False
) -> dict[str, FittedLogit]:
    """Stored panel -> write-off models per segment, with their calibration."""
    spark = panel.sparkSession
    family = segments.panel_segments_all_dates() if all_dates else segments.panel_segments()
    df = active_as_of_stored(panel, active_on)
    models = fit_logits(df, family, durable=True)
    write_report(
        {
            "mean_pds_check": segments.panel_calibration(df, models, family),
            "pds_by_bin": segments.panel_calibration_bins(df, models, family),
            "coefficients": coefficients(spark, models),
        },
        out,
    )
    save_models(models, out, spark)
    return models


def run_loan_models(spark: SparkSession, inputs: str, out: str, files: Mapping[str, str] | None = None) -> DataFrame:
    """One row per loan -> category models, every loan scored with every model, and the report tables."""
    pds = exports.load(spark, "underwriting_pds", _path(inputs, "underwriting_pds", files))
    flags = exports.load(spark, "payment_flags", _path(inputs, "payment_flags", files))
    df = segments.loan_frame(pds, flags)
    models = segments.fit_loan_models(df)
    scored = cut_lineage(segments.score_loans(df, models), "scored")
    write_report(
        {
            "coverage": expect_covered(pds, flags, "loan_id"),
            "wrong_direction": segments.wrong_way(scored),
            "wrong_direction_unknown": segments.wrong_way_unknown(scored),
            "mean_pds_check": segments.loan_calibration(df, models),
            "mean_scores": segments.mean_scores(scored),
            "coefficients": coefficients(spark, models),
        },
        f"{out}/report",
    )
    save_models(models, out, spark)
    write_table(segments.profile_output(scored), f"{out}/risk_profile_pds", mode="overwrite")
    return spark.read.parquet(f"{out}/risk_profile_pds")


def run_loss(
    spark: SparkSession, inputs: str, out: str, files: Mapping[str, str] | None = None, duplicates: str = "error"
) -> DataFrame:
    """Balances, profile PDs, guarantees and monthly ratings -> expected loss per loan-month and month."""
    at = lambda export: _path(inputs, export, files)
    balances = exports.load_balances(spark, at("balances"), drop_null_ids=False, month="start")
    pro = exposure.build_exposure(
        balances.withColumnRenamed("date", "time"),
        exports.load(spark, "profile_pds", at("profile_pds")),
        exports.load_guarantees(spark, at("guarantees")),
        exports.load_monthly_ratings(spark, at("monthly_ratings")),
        duplicates=duplicates,
    )
    el = exposure.loan_loss_output(exposure.expected_loss(exposure.clean_exposure(pro)))
    write_table(el, f"{out}/expected_loan_loss_by_month", partition_by=["time"], mode="overwrite")
    el = spark.read.parquet(f"{out}/expected_loan_loss_by_month")
    by_month = cut_lineage(exposure.portfolio_loss(el), "losses")
    write_report(
        {
            "expected_portfolio_loss_by_month": by_month,
            "category_share": exposure.category_share_by_month(el),
            "missing": missing_report(el, "loan_id", {"no month": "time", "no pd": "pd"}),
        },
        out,
    )
    return by_month


def run_migration(spark: SparkSession, inputs: str, out: str, files: Mapping[str, str] | None = None) -> dict[str, FittedLogit]:
    """One row per loan -> the migration chain and the rated active book."""
    loans = segments.loan_flags(exports.load(spark, "migration_pds", _path(inputs, "migration_pds", files)))
    chain = migration.fit_chain(loans)
    book = cut_lineage(migration.rate_active_book(loans.withColumn("balance", F.col("balance_1215")), chain), "book")
    write_table(select_existing(book, MIGRATION_OUTPUT), f"{out}/migration_pds", mode="overwrite")
    scored = migration.add_chain_products(migration.chain_scores(loans, chain))
    write_table(migration.chain_long(scored), f"{out}/migration_long", mode="overwrite")
    write_report(
        {
            "migration_coefficients": coefficients(spark, chain),
            "migration_means": migration.chain_report(migration.chain_scores(loans, chain)),
            "migration_line": migration.chain_line(scored),
            "book_loss": migration.book_loss(book),
        },
        out,
    )
    save_models(chain, out, spark)
    return chain


def run_point_in_time(
    spark: SparkSession, inputs: str, out: str, chain: Mapping[str, FittedLogit], files: Mapping[str, str] | None = None
) -> DataFrame:
    """Past Septembers -> active PDs of every period, in one pass. A period that only one of the two period tables has is
    an error."""
    loans = exports.load(spark, "september_loans", _path(inputs, "september_loans", files)).filter("last_year = 1")
    categories = exports.load_september_categories(spark, _path(inputs, "september_categories", files))
    balances = exports.load_september_balances(spark, _path(inputs, "september_balances", files))
    periods = {"09" + c[-2:]: (c, f"balance_09{c[-2:]}") for c in categories.columns[1:]}
    unmatched = {b for _, b in periods.values()} ^ set(balances.columns[1:])
    if unmatched:
        raise ValueError(f"periods in only one of the two tables: {sorted(unmatched)}")
    pit = migration.point_in_time(migration.period_table(loans, categories, balances, periods), chain)
    write_table(pit, f"{out}/september_active_pds", partition_by=["period"], mode="overwrite")
    pit = spark.read.schema(pit.schema).parquet(f"{out}/september_active_pds")
    write_report({"september_means": migration.period_means(pit)}, out)
    return pit


def run_rating(spark: SparkSession, inputs: str, out: str, files: Mapping[str, str] | None = None) -> DataFrame:
    """Rated loans -> write-off probability per rating, value counts and the active book."""
    loans = exports.load(spark, "rated_loans", _path(inputs, "rated_loans", files))
    by_factor, by_line = rating.rate_by_factor(loans), rating.rate_by_line(loans)
    write_report(
        {
            "risk_ratings": value_counts(loans, "risk_rating"),
            "risk_rating_category_to_writeoffs": rating.predicted_counts(by_factor, "pd_rr"),
            "risk_rating_category_to_writeoffs_line": rating.predicted_counts(by_line, "pd_rr_lm"),
        },
        out,
    )
    write_table(by_factor.filter(rating.active_last_year()), f"{out}/rr_predicted_default_all", mode="overwrite")
    book = rating.rated_book(by_factor)
    write_table(book, f"{out}/rr_predicted_default", mode="overwrite")
    return book
