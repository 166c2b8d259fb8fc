"""The risk-category ladder: labels, codes and the flags derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col, flag, if_known, replace_where

# One ladder, three encodings in the inputs
# (rung of the monthly table, code with the watch list, code of the per-loan tables).
LADDER = (
    # label, rung, code with watch list, per-loan code
    ("Current", 1, 0, 0),
    ("Watch List", None, 3, None),
    ("Special Mention", 2, 6, 6),
    ("Substandard", 3, 12, 12),
    ("Doubtful", 4, 18, 18),
)
RUNG_THRESHOLDS = (0, 1, 2, 3)
CODE_THRESHOLDS = (None, 0, 6, 12)
FLAGS = ("current", "special_mention", "substandard", "doubtful")
WRITEOFF_TEXT = "Writeoff"


def category_code(label: str | Column, watch_list: bool = True) -> Column:
    """Label -> code; -1 for anything else, null included."""
    label = col(label)
    out = F.lit(-1)
    for name, _, with_watch, per_loan in LADDER:
        code = with_watch if watch_list else per_loan
        if code is not None:
            out = replace_where(out, label == name, F.lit(code))
    return out


def category_label(code: str | Column, watch_list: bool = True) -> Column:
    """Code -> label; null when the code is none of the ladder's."""
    code = col(code)
    out = F.lit(None).cast("string")
    for name, _, with_watch, per_loan in LADDER:
        known = with_watch if watch_list else per_loan
        if known is not None:
            out = replace_where(out, code == known, F.lit(name))
    return out


def rung_label(rung: str | Column) -> Column:
    """1..4 of the monthly table -> label."""
    rung = col(rung)
    out = F.lit(None).cast("string")
    for name, number, _, _ in LADDER:
        if number is not None:
            out = replace_where(out, rung == number, F.lit(name))
    return out


def is_writeoff(wo: str | Column) -> Column:
    """Both encodings (text, and 0/1 as any number or number text) -> boolean, null kept."""
    value = col(wo).cast("string")
    return (value == WRITEOFF_TEXT) | F.coalesce(value.try_cast("double") == 1, F.lit(False))


def reached_flags(code: str | Column, wo: str | Column, thresholds=RUNG_THRESHOLDS) -> dict[str, Column]:
    """0/1 per rung: the loan got at least this far. A write-off went through every rung above the
    first; with an unknown write-off state those rungs are unknown too. Threshold None: always 1."""
    code, lost = col(code), is_writeoff(wo)
    out = {}
    for name, threshold in zip(FLAGS, thresholds):
        reached = F.lit(1) if threshold is None else flag(code > threshold)
        out[name] = reached if name == FLAGS[0] else if_known(lost, F.lit(1), reached)
    return out


def pit_flags(code: str | Column, balance: str | Column) -> dict[str, Column]:
    """State at one date (not cumulative): active, and exactly one rung. The current rung also needs a
    positive balance."""
    code, active = col(code), col(balance) > 0
    out = {
        "active": flag(active),
        "current": if_known(code == 0, flag(active), F.lit(0)),
    }
    for name, (_, _, _, loan_code) in zip(FLAGS[1:], LADDER[2:]):
        out[name] = flag(code == loan_code)
    return out
