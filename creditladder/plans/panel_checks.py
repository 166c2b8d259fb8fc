"""What the panel run reports about its data, as by-products of the one write of the panel.

Row and null counts are metrics on the rows that pass by, so nothing is scanned again for them. Counts per value
and month totals come from one aggregate of the stored panel over its category columns, which is small and stored itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.exact import exact_sum_or_zero
from ..operators.aggregates import duplicate_keys
from ..session import cut_lineage
from ..sources.layout import write_by_key
from ..sources.sinks import write_table
from .panel import KEY, LOAN, MONTH, OUTPUT, PanelSources, above_floor, build_panel, months_table

MONTH_COLUMNS = ("balance", "monitor_score", "risk_category_sf", "paid_cum", "disb_cum", "maturity_date", "risk_category")
COUNTED = ("risk_category", "risk_category_sf", "special_mention", "wo")
#: The count tables: two columns each.
COUNT_TABLES = (
    ("risk_category", "risk_category_sf"),
    ("risk_category", "wo"),
    ("special_mention", "wo"),
    ("risk_category_sf", "wo"),
)


@dataclass(frozen=True)
class PanelChecks:
    """rows (stage, n): all months, those above the floor, the panel's, repeated keys, known balances without a category;
    nulls (stage, variable, n_null): before the floor and in the panel; month_totals (date, total_balance);
    counts (first, second, value_first, value_second, n), rows with a null on either side left out."""

    rows: DataFrame
    nulls: DataFrame
    month_totals: DataFrame
    counts: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f"panel_{name}": getattr(self, name) for name in self.__dataclass_fields__}


def _null_metrics(columns) -> list[Column]:
    return [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns]


def _month_metrics() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.count_if(above_floor()).alias("n_above"), *_null_metrics(MONTH_COLUMNS)]


def write_checked_panel(src: PanelSources, path: str, duplicates: str = "error", buckets: int | None = None) -> tuple[DataFrame, PanelChecks]:
    """Builds the panel, stores it by month and returns it, read back, with its checks. ``buckets``: store it by loan
    as well, in that many files a month.

    A metric in the last stage counts each written row once, also when executors are lost. The metrics before the floor lie in
    an earlier stage, whose tasks may run again and count again; their rows above the floor must equal the written
    rows, otherwise they are counted anew from the sources. In the form with repeated keys a joined table may
    repeat months above the floor, so there they are always counted anew.
    """
    spark = src.balances.sparkSession
    before, written = Observation(), Observation()
    panel = build_panel(src, duplicates, lambda months: months.observe(before, *_month_metrics()))
    metrics = (written, [F.count(F.lit(1)).alias("n"), *_null_metrics(OUTPUT)])
    if buckets:
        stored = write_by_key(panel, path, LOAN, MONTH, buckets, metrics).select(*OUTPUT)
    else:
        write_table(panel, path, partition_by=[MONTH], mode="overwrite", observe=metrics)
        stored = spark.read.schema(panel.schema).parquet(path).select(*OUTPUT)

    months, rows = before.get, written.get
    if duplicates != "error" or months["n_above"] != rows["n"]:
        months = months_table(src, duplicates).agg(*_month_metrics()).first().asDict()
    # One row per month and combination of categories: bounded by the calendar and the ladder.
    grouped = stored.groupBy(MONTH, *COUNTED).agg(
        F.count(F.lit(1)).alias("n"), exact_sum_or_zero("balance").alias("balance"), F.count_if(F.col("balance") > 0).alias("n_positive")
    )
    grouped = cut_lineage(grouped, "panel_groups")
    # With unique source keys, which the build has guarded, no key can repeat.
    repeated = 0 if duplicates == "error" else duplicate_keys(stored.select(*KEY), KEY).first().n_duplicates
    no_category = grouped.filter("risk_category is null").agg(F.coalesce(F.sum("n_positive"), F.lit(0))).first()[0]
    counts = {"months": months["n"], "above the floor": months["n_above"], "panel": rows["n"], "repeated keys": repeated, "balance without category": no_category}
    nulls = [("months", c, months[f"null_{c}"]) for c in MONTH_COLUMNS] + [("panel", c, rows[f"null_{c}"]) for c in OUTPUT]
    return stored, PanelChecks(
        rows=spark.createDataFrame(list(counts.items()), "stage string, n long"),
        nulls=spark.createDataFrame(nulls, "stage string, variable string, n_null long"),
        month_totals=grouped.groupBy(MONTH).agg(exact_sum_or_zero("balance").alias("total_balance")),
        counts=_count_tables(grouped),
    )


def _count_tables(grouped: DataFrame) -> DataFrame:
    """All two-way tables in one pass over the grouped rows."""
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(a).cast("string").alias("value_first"), F.col(b).cast("string").alias("value_second"))
            for a, b in COUNT_TABLES
        ]
    )
    long = grouped.select(F.inline(pairs), "n").filter("value_first is not null and value_second is not null")
    return long.groupBy("first", "second", "value_first", "value_second").agg(F.sum("n").alias("n"))
