"""What several test files share."""

from __future__ import annotations


def rows(df, *order) -> list[tuple]:
    """Rows as tuples, sorted by the text of the given columns (all of them by default)."""
    picked = [tuple(r) for r in df.collect()]
    keys = [df.columns.index(c) for c in order] or range(len(df.columns))
    return sorted(picked, key=lambda r: [(r[k] is not None, str(r[k]) if not isinstance(r[k], (int, float)) else r[k]) for k in keys])
