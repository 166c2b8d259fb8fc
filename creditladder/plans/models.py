"""Default-probability models: logistic fits with Spark ML, group-mean and least-squares rating models.

A family of models on one frame shares one narrow projection (label, features, segment flags). It is
persisted, or with ``durable=True`` written to the shared folder when the plan below it is long. One
aggregation counts every segment's rows and events first, so a segment that cannot be fitted is reported
by its ``status`` instead of failing the job; where features split the labels, a penalised fit stands in. Scoring is a column expression: unknown input, unknown score.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import col, flag_or_zero
from ..functions.probability import inverse_logit
from ..operators.joins import merge
from ..session import cut_lineage
from .separation import Design, design, firth, separation

MAX_ITERATIONS = 25
TOLERANCE = 1e-8
PARALLEL_FITS = 6


@dataclass(frozen=True)
class Segment:
    """What to fit: rows where ``where`` holds (unknown counts as no), 0/1 ``label``, ``features``."""

    label: Column
    features: Sequence[str]
    where: Column | None = None
    label_name: str = "wo"


@dataclass(frozen=True)
class FittedLogit:
    """A fitted model. ``status`` is ok, empty, single_class, separated (one feature or several together split the
    labels, so the plain fit has no finite answer) or not_converged (no fit within the allowed iterations).
    An empty or single-class segment has no coefficients; those of a separated one are the penalised fit's
    (``method`` firth)."""

    name: str
    label: str
    features: tuple[str, ...]
    status: str
    n_rows: int
    n_events: int
    intercept: float | None = None
    coefficients: tuple[float, ...] = ()
    method: str = "ml"
    model: object = field(default=None, compare=False, repr=False)

    def probability(self, inputs: Mapping[str, Column] | None = None) -> Column:
        """Score as an expression; ``inputs`` replaces features by expressions."""
        if self.intercept is None:
            return F.lit(None).cast("double")
        eta = F.lit(float(self.intercept))
        for name, beta in zip(self.features, self.coefficients):
            x = inputs[name] if inputs and name in inputs else F.col(name)
            eta = eta + F.lit(float(beta)) * x.cast("double")
        return inverse_logit(eta)


def score(df: DataFrame, fitted: FittedLogit, out_col: str) -> DataFrame:
    return df.withColumn(out_col, fitted.probability())


def score_all(df: DataFrame, models: Mapping[str, FittedLogit]) -> DataFrame:
    """``models`` maps output column -> model."""
    return df.withColumns({out: m.probability() for out, m in models.items()})


def fit_logits(
    df: DataFrame, segments: Mapping[str, Segment], durable: bool = False, persist: bool = True
) -> dict[str, FittedLogit]:
    """Fit every segment of a family from one shared training frame. ``persist=False`` when ``df`` is
    kept already. The fits are independent and small beside a cluster, so a few run side by side."""
    names = list(segments)
    features = list(dict.fromkeys(f for s in segments.values() for f in s.features))
    cols = [F.col(f).cast("double").alias(f) for f in features]
    for i, n in enumerate(names):
        s = segments[n]
        inside = F.lit(True) if s.where is None else s.where
        complete = s.label.isNotNull()
        for f in s.features:
            complete = complete & F.col(f).isNotNull()
        cols += [s.label.cast("double").alias(f"__y{i}"), (flag_or_zero(inside & complete) == 1).alias(f"__in{i}")]
    train = df.select(*cols)
    if len(names) > 1 or not all(s.where is None for s in segments.values()):
        anywhere = F.lit(False)
        for i in range(len(names)):
            anywhere = anywhere | F.col(f"__in{i}")
        train = train.filter(anywhere)
    train = cut_lineage(train, "train") if durable else train
    persist = persist and not durable
    if persist:
        train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = _segment_counts(train, [segments[n] for n in names])
        fit = inheritable_thread_target(df.sparkSession)(lambda i: _fit_one(train, names[i], i, segments[names[i]], counts))
        with ThreadPool(min(len(names), PARALLEL_FITS)) as pool:
            return dict(zip(names, pool.map(fit, range(len(names)))))
    finally:
        if persist:
            train.unpersist()


def fit_logit(
    df: DataFrame, label: str, features: Sequence[str], name: str, where: Column | None = None, durable: bool = False
) -> FittedLogit:
    segment = Segment(F.col(label), tuple(features), where, label)
    return fit_logits(df, {name: segment}, durable)[name]


def _segment_counts(train: DataFrame, segments: Sequence[Segment]) -> Mapping[str, object]:
    """Rows, events and, per label, each feature's range: one aggregation, one row."""
    aggs = []
    for i, s in enumerate(segments):
        inside = F.col(f"__in{i}")
        aggs += [F.count_if(inside).alias(f"n{i}"), F.count_if(inside & (F.col(f"__y{i}") == 1)).alias(f"e{i}")]
        for j, f in enumerate(s.features):
            for y in (0, 1):
                x = F.when(inside & (F.col(f"__y{i}") == y), F.col(f))
                aggs += [F.min(x).alias(f"lo{i}_{j}_{y}"), F.max(x).alias(f"hi{i}_{j}_{y}")]
    return train.agg(*aggs).first().asDict()


def _separated(i: int, s: Segment, counts: Mapping[str, object]) -> bool:
    """Does a threshold on one feature split the labels?"""
    for j in range(len(s.features)):
        lo, hi = ([counts[f"{side}{i}_{j}_{y}"] for y in (0, 1)] for side in ("lo", "hi"))
        if hi[0] <= lo[1] or hi[1] <= lo[0]:
            return True
    return False


def _fit_one(train: DataFrame, name: str, i: int, s: Segment, counts: Mapping[str, object]) -> FittedLogit:
    n, events = counts[f"n{i}"], counts[f"e{i}"]
    features = tuple(s.features)
    if events in (0, n):
        return FittedLogit(name, s.label_name, features, "single_class" if n else "empty", n, events)
    rows = train.filter(F.col(f"__in{i}")).select(*features, F.col(f"__y{i}").alias("label"))
    if _separated(i, s, counts):
        return _penalised(design(rows, features, "label"), name, s, n, events)
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    glm = GeneralizedLinearRegression(
        family="binomial", link="logit", tol=TOLERANCE, maxIter=MAX_ITERATIONS, labelCol="label", featuresCol="features"
    )
    model = glm.fit(data.select("label", "features"))
    slow = model.summary.numIterations >= MAX_ITERATIONS
    if slow and len(features) > 1:
        # Coefficients that settle are a finite answer, so only a fit that did not settle is looked at.
        d = design(rows, features, "label")
        if separation(d) in ("complete", "partial"):
            return _penalised(d, name, s, n, events)
    beta = tuple(float(b) for b in model.coefficients)
    return FittedLogit(name, s.label_name, features, "not_converged" if slow else "ok", n, events, float(model.intercept), beta, model=model)


def _penalised(d: Design, name: str, s: Segment, n: int, events: int) -> FittedLogit:
    fit = firth(d)
    return FittedLogit(name, s.label_name, d.features, "separated", n, events, fit.intercept, fit.coefficients, "firth")


def coefficients(spark: SparkSession, models: Mapping[str, FittedLogit]) -> DataFrame:
    """(model, term, estimate, status); a model without coefficients has one row with nulls."""
    rows = []
    for m in models.values():
        if m.intercept is None:
            rows.append((m.name, None, None, m.status))
        else:
            rows.append((m.name, "(Intercept)", m.intercept, m.status))
            rows += [(m.name, f, b, m.status) for f, b in zip(m.features, m.coefficients)]
    return spark.createDataFrame(rows, "model string, term string, estimate double, status string")


def fit_rating_factor(df: DataFrame, rating: str, label: str, where: Column) -> DataFrame:
    """Write-off probability per rating: the fitted value of a logit on a factor is the group mean, so
    one aggregation is the fit. Rows: (rating, pd_rr)."""
    used = df.filter(where & F.col(rating).isNotNull() & F.col(label).isNotNull())
    return used.groupBy(rating).agg(F.avg(col(label).cast("double")).alias("pd_rr"))


def score_rating_factor(df: DataFrame, fitted: DataFrame, rating: str) -> DataFrame:
    """Adds ``pd_rr``; a rating never seen in the fit has no probability."""
    return merge(df, fitted, rating, "left", null_keys="drop")


def fit_linear(df: DataFrame, label: str, feature: str, where: Column | None = None) -> DataFrame:
    """Least squares with one feature as a one-row frame (intercept, slope): one aggregation."""
    used = df if where is None else df.filter(where)
    y, x = col(label).cast("double"), col(feature).cast("double")
    return used.agg(F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"))


def score_linear(df: DataFrame, fitted: DataFrame, feature: str, out_col: str) -> DataFrame:
    line = fitted.select(F.struct("intercept", "slope")).scalar()
    return df.withColumn(out_col, line["intercept"] + line["slope"] * F.col(feature))
