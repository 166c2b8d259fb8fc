"""Equi-joins with explicit null-key and duplicate-key rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import all_true

_KEY = "__key_{}"


def _keyed(right: DataFrame, by: Sequence[str]) -> DataFrame:
    return right.withColumnsRenamed({k: _KEY.format(i) for i, k in enumerate(by)})


def _match(by: Sequence[str], null_keys: str) -> Column:
    if null_keys not in ("match", "drop"):
        raise ValueError("null_keys must be 'match' or 'drop'")
    pairs = [(F.col(k), F.col(_KEY.format(i))) for i, k in enumerate(by)]
    return all_true([l.eqNullSafe(r) if null_keys == "match" else l == r for l, r in pairs])


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in set(right.columns)]


def merge(
    left: DataFrame,
    right: DataFrame,
    by: str | Sequence[str] | None = None,
    how: str = "inner",
    null_keys: str = "match",
    suffixes: tuple[str, str] = ("_x", "_y"),
    hot_keys: bool = False,
) -> DataFrame:
    """Join on equally named keys (all shared columns by default); keys come out once and first.

    Duplicate keys repeat rows. Other columns of the same name get ``suffixes``. With
    ``null_keys='match'`` a null key meets a null key; with ``'drop'`` it meets nothing (an outer join
    still keeps its row).

    A left or inner join whose left side has a hot key is split by adaptive execution. A full join cannot
    be split, so with ``hot_keys`` it runs as a left join plus the right rows whose key is absent from the
    distinct keys of ``left`` (which combine on the map side); ``left`` is then read twice, the second time
    for its keys only.
    """
    by = [by] if isinstance(by, str) else list(by or shared_columns(left, right))
    if not by:
        raise ValueError("no columns to join on")
    if how not in ("inner", "left", "full"):
        raise ValueError("how must be 'inner', 'left' or 'full'")
    clash = [c for c in shared_columns(left, right) if c not in by]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    rest = [c for df in (left, right) for c in df.columns if c not in by]
    split = how == "full" and hot_keys
    joined = left.join(_keyed(right, by), _match(by, null_keys), "left" if split else how)
    if how != "full":
        return joined.select(*by, *rest)
    if split:
        only_right = anti(right, left, by, null_keys=null_keys)
        return joined.select(*by, *rest).unionByName(only_right, allowMissingColumns=True)
    keys = [F.coalesce(F.col(k), F.col(_KEY.format(i))).alias(k) for i, k in enumerate(by)]
    return joined.select(*keys, *rest)


def semi(left: DataFrame, right: DataFrame, by: str | Sequence[str], null_keys: str = "match") -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``."""
    return _membership(left, right, by, "left_semi", null_keys)


def anti(left: DataFrame, right: DataFrame, by: str | Sequence[str], null_keys: str = "match") -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``."""
    return _membership(left, right, by, "left_anti", null_keys)


def _membership(left, right, by, how, null_keys) -> DataFrame:
    by = [by] if isinstance(by, str) else list(by)
    keys = _keyed(right.select(*by).distinct(), by)
    return left.join(keys, _match(by, null_keys), how)


def unique_by(df: DataFrame, by: str | Sequence[str], what: str = "table") -> DataFrame:
    """The same rows, with a guard in the plan that fails the job on a repeated key.

    The guard's exchange is on the join key, so a join that follows on the same key does not shuffle
    this side again.
    """
    by = [by] if isinstance(by, str) else list(by)
    rest = [c for c in df.columns if c not in by]
    counted = df.groupBy(*by).agg(*[F.first(c).alias(c) for c in rest], F.count(F.lit(1)).alias("__n"))
    return counted.filter(guard_single("__n", f"{what}: repeated key {', '.join(by)}")).drop("__n")


def guard_single(count_col: str, message: str) -> Column:
    """Filter condition that is true, or fails the job where the count is above one."""
    return F.assert_true(F.col(count_col) <= 1, message).isNull()
