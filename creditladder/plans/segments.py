"""Write-off models per rung of the ladder: on the loan-month panel and on one row per loan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ladder import CODE_THRESHOLDS, category_code, category_label, is_writeoff, reached_flags
from ..functions.nulls import all_true, avg_strict, ratio, sum_strict
from ..operators.aggregates import calibration_bins, calibration_table
from ..operators.checks import tagged_rows
from ..operators.joins import merge
from ..operators.reshape import columns_between, select_range
from .models import FittedLogit, Segment, fit_logits

# The study's dates. Loans count as closed when closed before CLOSED_BEFORE; the watch
# list was kept in its present meaning from WATCH_FROM on.
CLOSED_BEFORE = "2014-01-01"
WATCH_FROM = "2013-03-27"
WATCH_TO = "2015-01-01"

PD_ONLY = ("pd",)
PD_AND_MONTHS = ("pd", "months_in_risk_cat", "months_in_risk_cat_sq")
LABEL = "wo"


def wo_label(wo: str = LABEL) -> Column:
    """1 write-off, 0 none, null unknown."""
    return is_writeoff(wo).cast("int")


def _is(name: str, value: int) -> Column:
    return F.col(name) == value


def panel_segments(
    closed_before: str = CLOSED_BEFORE, watch_from: str = WATCH_FROM, watch_to: str = WATCH_TO
) -> dict[str, Segment]:
    """Segments of closed loans by close date; months count within the first year after a downgrade."""
    inactive, closed = _is("active", 0), F.col("close_date") < F.lit(closed_before).cast("date")
    in_watch = (F.col("date") > F.lit(watch_from).cast("date")) & (F.col("date") < F.lit(watch_to).cast("date"))
    rung = _is("risk_category", 1)
    where = {
        "current": ([inactive, closed], PD_ONLY),
        "watch_list": ([inactive, _is("watch_list", 1), rung, in_watch], PD_ONLY),
        "paid_1k": ([inactive, _is("pmt_1k", 1), rung, _is("watch_list", 0), closed], PD_ONLY),
        "special_mention": ([inactive, _is("special_mention", 1), F.col("months_in_risk_cat") < 12, closed], PD_AND_MONTHS),
        "substandard": ([inactive, _is("substandard", 1), closed], PD_AND_MONTHS),
        "doubtful": ([inactive, _is("doubtful", 1)], PD_AND_MONTHS),
    }
    return {n: Segment(wo_label(), f, all_true(c)) for n, (c, f) in where.items()}


def panel_segments_all_dates() -> dict[str, Segment]:
    """The variant without date limits and with the months terms below the first rung as well."""
    inactive, rung = _is("active", 0), _is("risk_category", 1)
    where = {
        "current": ([inactive], PD_ONLY),
        "watch_list": ([inactive, _is("watch_list", 1), rung], PD_AND_MONTHS),
        "paid_1k": ([inactive, _is("pmt_1k", 1), rung, _is("watch_list", 0)], PD_AND_MONTHS),
        "special_mention": ([inactive, _is("special_mention", 1), F.col("months_in_risk_cat") < 12], PD_AND_MONTHS),
        "substandard": ([inactive, _is("substandard", 1)], PD_AND_MONTHS),
        "doubtful": ([inactive, _is("doubtful", 1)], PD_AND_MONTHS),
    }
    return {n: Segment(wo_label(), f, all_true(c)) for n, (c, f) in where.items()}


def loan_segments() -> dict[str, Segment]:
    """One row per loan: each rung's segment lies within the one above it."""
    inactive = _is("active", 0)
    rungs = [_is(n, 1) for n in ("special_mention", "substandard", "doubtful")]
    where = {
        "current": [inactive],
        "watch_list": [inactive, _is("watch_list", 1)],
        "paid_1k": [inactive, _is("pmt_1k", 1)],
        "special_mention": [inactive, *rungs[:1]],
        "substandard": [inactive, *rungs[:2]],
        "doubtful": [inactive, *rungs],
    }
    return {n: Segment(wo_label(), PD_ONLY, all_true(c)) for n, c in where.items()}


def loan_flags(df: DataFrame, category: str = "max_risk_category", wo: str = LABEL) -> DataFrame:
    """Adds the category code, the cleaned label and the reached flags to a one-row-per-loan table."""
    coded = df.withColumn("category_code", category_code(category, watch_list=False))
    return coded.withColumns(
        {
            category: category_label("category_code", watch_list=False),
            **reached_flags("category_code", wo, CODE_THRESHOLDS),
        }
    )


def loan_frame(pds: DataFrame, payment_flags: DataFrame) -> DataFrame:
    """Loan table for the category models: natural join with the payment flags, reached flags, and the
    multi-year probability in the place of ``pd`` (which is kept as ``pd_orig``)."""
    df = loan_flags(merge(pds, payment_flags))
    return df.withColumnRenamed("pd", "pd_orig").withColumnRenamed("pd_multiple_years", "pd")


# Score columns of the loan models, in ladder order.
LOAN_SCORES = {
    "pd_wl": "watch_list",
    "pd_pmt": "paid_1k",
    "pd_sm_wo": "special_mention",
    "pd_sub_wo": "substandard",
    "pd_d_wo": "doubtful",
}


def fit_loan_models(df: DataFrame) -> dict[str, FittedLogit]:
    return fit_logits(df, loan_segments())


def score_loans(df: DataFrame, models: Mapping[str, FittedLogit]) -> DataFrame:
    """Every loan with every model, whatever its category."""
    return df.withColumns({out: models[name].probability() for out, name in LOAN_SCORES.items()})


def loan_calibration(df: DataFrame, models: Mapping[str, FittedLogit]) -> DataFrame:
    """Predicted and actual write-off rates: predicted on the segment's closed loans, all write-offs
    among closed loans over the segment's size, and the same over all loans.

    The first column's prediction is the closed loans' own rate."""
    label = wo_label()
    inactive = _is("active", 0)
    segments = loan_segments()

    def over(cond: Column | None, size: Column | None = None, only: Column | None = None) -> Column:
        hits = label if only is None else F.when(only, label).otherwise(F.lit(0))
        size = F.lit(1) if size is None else size
        if cond is not None:
            hits = F.when(cond, hits).otherwise(F.lit(0))
            size = F.when(cond, size).otherwise(F.lit(0))
        return ratio(sum_strict(hits.cast("double")), sum_strict(size.cast("double")))

    def predicted(name: str) -> Column:
        inside = segments[name].where
        p = models[name].probability()
        complete = F.count_if(inside & p.isNull()) == 0
        return F.when(complete, F.avg(F.when(inside, p)))

    table = {
        "current": {
            "predicted on subset": over(inactive),
            "actual on subset": over(inactive),
            "actual all loans": over(None),
        }
    }
    for name, column in (("watch_list", "watch_list"), ("paid_1k", "pmt_1k")):
        table[name] = {
            "predicted on subset": predicted(name),
            "actual on subset": over(inactive, F.col(column), _is(column, 1)),
        }
    for name in ("special_mention", "substandard", "doubtful"):
        table[name] = {
            "predicted on subset": predicted(name),
            "actual on subset": over(inactive, F.col(name)),
            "actual all loans": over(None, F.col(name)),
        }
    return calibration_table(df, table)


def panel_calibration(
    df: DataFrame, models: Mapping[str, FittedLogit], segments: Mapping[str, Segment]
) -> DataFrame:
    """Mean prediction beside the balance-weighted write-off rate and the balance-weighted prediction of
    each segment, unknown as soon as one row's is; the same over the rows whose prediction or state is known; and how
    many rows there are and lack one. All segments from one aggregation over the segments' rows, each with its prediction."""
    member = F.array_compact(
        F.array(*[F.when(F.coalesce(s.where, F.lit(False)), F.struct(F.lit(n).alias("segment"), models[n].probability().alias("p"))) for n, s in segments.items()])
    )
    rows = df.select(F.explode(member).alias("m"), "balance", is_writeoff(LABEL).alias("lost")).select("m.segment", "m.p", "balance", "lost")
    p, balance, lost = F.col("p"), F.col("balance"), F.col("lost")
    hit = F.when(lost, balance).when(~lost, F.lit(0.0))
    statistics = {
        "mean_pd": avg_strict("p"),
        "mean_actual": ratio(sum_strict(hit), sum_strict("balance")),
        "weighted_pd": ratio(sum_strict(balance * p), sum_strict("balance")),
        "mean_pd_known": F.avg(p),
        "mean_actual_known": ratio(F.sum(hit), F.sum(F.when(lost.isNotNull(), balance))),
        "weighted_pd_known": ratio(F.sum(balance * p), F.sum(F.when(p.isNotNull(), balance))),
        "n": F.count(F.lit(1)),
        "n_unknown_pd": F.count_if(p.isNull()),
        "n_unknown_state": F.count_if(lost.isNull()),
    }
    counted = rows.groupBy("segment").agg(*[expr.cast("double").alias(stat) for stat, expr in statistics.items()])

    # A segment without rows has no row here, but its counts are 0.
    def of(name: str, stat: str) -> Column:
        value = F.max(F.when(F.col("segment") == name, F.col(stat)))
        return F.coalesce(value, F.lit(0.0)) if stat.startswith("n") else value

    return calibration_table(counted, {name: {stat: of(name, stat) for stat in statistics} for name in segments})


def panel_calibration_bins(df: DataFrame, models: Mapping[str, FittedLogit], segments: Mapping[str, Segment], bins: int = 10) -> DataFrame:
    """Predicted beside actual write-off rates of each segment by bins of the prediction."""
    return calibration_bins(df, {n: (s.where, models[n].probability()) for n, s in segments.items()}, wo_label(), bins)


WRONG_WAY_RULES = {
    "watch list < special mention": ("pd_wl", "pd_sm_wo"),
    "current < special mention": ("pd", "pd_sm_wo"),
    "special mention < substandard": ("pd_sm_wo", "pd_sub_wo"),
    "substandard < doubtful": ("pd_sub_wo", "pd_d_wo"),
}


def wrong_way(scored: DataFrame) -> DataFrame:
    """(loan_id, rule): loans whose probability does not rise where it should; equality counts. A loan
    may break several rules. Unknown comparisons are not violations, see :func:`wrong_way_unknown`."""
    rules = {name: ~(F.col(lo) < F.col(hi)) for name, (lo, hi) in WRONG_WAY_RULES.items()}
    return tagged_rows(scored, rules, ["loan_id"], "rule")


def wrong_way_unknown(scored: DataFrame) -> DataFrame:
    """(rule, n): comparisons that could not be made."""
    cells = {n: {"unknown": F.count_if((F.col(lo) < F.col(hi)).isNull())} for n, (lo, hi) in WRONG_WAY_RULES.items()}
    out = calibration_table(scored, cells)
    return out.select(F.col("segment").alias("rule"), F.col("value").cast("bigint").alias("n"))


def mean_scores(scored: DataFrame) -> DataFrame:
    """Strict mean of every probability over closed loans."""
    cols = ["pd", *[c for c in ("pd_sm_wo", "pd_sub_wo", "pd_d_wo")]]
    cells = {c: {"mean": avg_strict(c)} for c in cols}
    return calibration_table(scored.filter(_is("active", 0)), cells).select(F.col("segment").alias("variable"), "value")


def profile_output(scored: DataFrame) -> DataFrame:
    """The loan result: ids and category, the probabilities, the opportunity number; no 0/1 flags."""
    flat = select_range(scored, "current", "doubtful", invert=True)
    scores = [c for c in ("pd", *LOAN_SCORES) if c in flat.columns]
    front = columns_between(flat, "loan_id", "max_risk_category")
    return flat.select(*[c for c in front if c not in scores], *scores, "rc_opp_number")
