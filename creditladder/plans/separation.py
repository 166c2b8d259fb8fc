"""Do several features together split the labels, and a fit that stays finite if they do.

A logistic fit has no finite answer when some direction b has z . b >= 0 for all rows, and > 0 for one, where z is the row
(1, features) with its sign turned for label 0. The test looks for the point of least norm in the convex hull of
all z: if it is not 0, it is such a direction (all rows split). If it is 0, it is a mix of a few rows, which any such
direction must be orthogonal to; the search goes on in the space orthogonal to those, until a direction is found there
(the rest of the rows split, the mixed ones lie on the border) or no dimension is left. The point is built up from one
row at a time, and finding that row, the one furthest against the present point, is one aggregation. The driver
holds at most one row per dimension, and one more.

The fallback is the fit with Jeffreys' prior (Firth's correction), whose coefficients are always finite. Each step
needs sums of products of up to three features only, so it is one aggregation as well.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows shorter than this part of their length, seen from a subspace, lie outside it.
FLAT = 1e-9
#: A point nearer to 0 than this is 0.
ZERO = 1e-10
SEARCH_STEPS = 200
FIRTH_STEPS = 100
FIRTH_TOLERANCE = 1e-9
#: A step is at most this long, or as long as the coefficients so far.
LONGEST_STEP = 5.0


@dataclass(frozen=True)
class Design:
    """Rows with ``features``, all known, and a 0/1 ``label``; ``scales`` brings the features to similar size."""

    rows: DataFrame
    features: tuple[str, ...]
    label: str
    scales: tuple[float, ...]

    def terms(self) -> list[Column]:
        return [F.lit(1.0), *[F.col(f) / F.lit(float(s)) for f, s in zip(self.features, self.scales)]]


def design(rows: DataFrame, features: Sequence[str], label: str) -> Design:
    """With each feature's largest size as its scale: one aggregation."""
    found = rows.agg(*[F.max(F.abs(f)).alias(f) for f in features]).first()
    return Design(rows, tuple(features), label, tuple(float(found[f] or 1.0) for f in features))


def _dot(terms: Sequence[Column], weights: np.ndarray) -> Column:
    return sum((t * F.lit(float(w)) for t, w in zip(terms, weights)), F.lit(0.0))


def least_norm(furthest: Callable[[np.ndarray], np.ndarray | None], first: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The point of least norm in the hull of unit rows, and the rows it is a mix of; or a point that no row is against,
    as soon as one is found. ``furthest`` gives the row with the least product with a point. None if the search
    does not end within its steps."""
    points, shares = [first], np.ones(1)
    for _ in range(SEARCH_STEPS):
        x = shares @ np.array(points)
        if np.linalg.norm(x) <= ZERO:
            return x, np.array(points)
        new = furthest(x)
        if new @ x > 0 or any(np.allclose(new, p, rtol=0, atol=1e-14) for p in points):
            return x, np.array(points)
        points, shares = [*points, new], np.append(shares, 0.0)
        while True:
            # The point of least norm in the affine hull of the rows; rows leave until it is a mix of them.
            n = len(points)
            gram = np.block([[np.array(points) @ np.array(points).T, np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
            wanted = np.linalg.lstsq(gram, np.append(np.zeros(n), 1.0), rcond=None)[0][:n]
            if (wanted > 1e-12).all():
                shares = wanted
                break
            low = wanted <= 1e-12
            step = min((shares[i] / (shares[i] - wanted[i]) for i in np.flatnonzero(low) if shares[i] > wanted[i]), default=0.0)
            shares = shares + step * (wanted - shares)
            keep = ~(low & (shares <= 1e-12))
            if keep.all():
                keep[int(np.argmin(shares))] = False
            points, shares = [p for p, k in zip(points, keep) if k], shares[keep]
            shares = shares / shares.sum()
    return None


def separation(d: Design) -> str:
    """``complete`` (a direction splits all rows), ``partial`` (it splits some, the others lie on its border), ``none``, or
    ``unknown`` if the search did not end."""
    sign = 2 * F.col(d.label) - 1
    terms = [t * sign for t in d.terms()]
    space = np.eye(len(terms))
    name = "complete"
    while space.shape[1]:
        inside = [_dot(terms, space[:, j]) for j in range(space.shape[1])]
        length = F.sqrt(sum((c * c for c in inside), F.lit(0.0)))
        whole = F.sqrt(sum((t * t for t in terms), F.lit(0.0)))
        unit = [F.when(length > FLAT * whole, c / length) for c in inside]

        def furthest(x: np.ndarray, unit=unit) -> np.ndarray | None:
            row = d.rows.agg(F.min_by(F.array(*unit), _dot(unit, x)).alias("row")).first().row
            return None if row is None else np.array(row, float)

        first = furthest(np.ones(space.shape[1]))
        if first is None:
            return "none"  # all rows lie in what was left behind: features that depend on each other
        found = least_norm(furthest, first)
        if found is None:
            return "unknown"
        x, points = found
        if np.linalg.norm(x) > ZERO:
            return name
        _, sizes, directions = np.linalg.svd(points)
        rank = int((sizes > 1e-9).sum())
        space = space @ directions[rank:].T
        name = "partial"
    return "none"


@dataclass(frozen=True)
class FirthFit:
    intercept: float
    coefficients: tuple[float, ...]
    converged: bool
    steps: int


def _moments(d: Design, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood, its gradient, the information matrix and the third moments of the prior's gradient."""
    x = d.terms()
    k = len(x)
    eta = _dot(x, beta)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
    held = d.rows.select(F.col(d.label).alias("y"), eta.alias("eta"), p.alias("p"), *[t.alias(f"x{i}") for i, t in enumerate(x)])
    held = held.withColumn("w", F.col("p") * (1 - F.col("p"))).withColumn("v", F.col("w") * (0.5 - F.col("p")))
    c = [F.col(f"x{i}") for i in range(k)]
    # log(1 + exp(eta)) without overflow.
    loss = F.greatest(F.col("eta"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("eta"))) - F.col("y") * F.col("eta")
    pairs, triples = (list(combinations_with_replacement(range(k), n)) for n in (2, 3))
    sums = [F.sum(-loss)] + [F.sum((F.col("y") - F.col("p")) * c[i]) for i in range(k)]
    sums += [F.sum(F.col("w") * c[i] * c[j]) for i, j in pairs] + [F.sum(F.col("v") * c[i] * c[j] * c[m]) for i, j, m in triples]
    got = [float(s) for s in held.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    gradient, info, third = np.array(got[1 : k + 1]), np.zeros((k, k)), np.zeros((k, k, k))
    for (i, j), s in zip(pairs, got[k + 1 :]):
        info[i, j] = info[j, i] = s
    for (i, j, m), s in zip(triples, got[k + 1 + len(pairs) :]):
        for at in {(i, j, m), (i, m, j), (j, i, m), (j, m, i), (m, i, j), (m, j, i)}:
            third[at] = s
    return got[0], gradient, info, third


def firth(d: Design) -> FirthFit:
    """The fit of highest likelihood times the root of the information's determinant."""
    k = len(d.features) + 1
    beta, step = np.zeros(k), np.zeros(k)
    best = -np.inf
    converged, steps = False, 0
    for steps in range(1, FIRTH_STEPS + 1):
        likelihood, gradient, info, third = _moments(d, beta + step)
        sign, logdet = np.linalg.slogdet(info)
        value = likelihood + 0.5 * logdet if sign > 0 else -np.inf
        if value < best - 1e-12 * abs(best) and np.abs(step).max() > FIRTH_TOLERANCE:
            step = step / 2
            continue
        beta, best = beta + step, max(value, best)
        inverse = np.linalg.pinv(info)
        step = inverse @ (gradient + np.einsum("ab,abc->c", inverse, third))
        longest = np.abs(step).max()
        if longest <= FIRTH_TOLERANCE * max(1.0, np.abs(beta).max()):
            converged = True
            break
        step = step * min(1.0, max(LONGEST_STEP, np.abs(beta).max()) / longest)
    plain = beta / np.array([1.0, *d.scales])
    return FirthFit(float(plain[0]), tuple(float(b) for b in plain[1:]), converged, steps)
