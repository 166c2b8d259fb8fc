"""Result tables and fitted models on disk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.models import FittedLogit


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
    observe: tuple[Observation, Sequence[Column]] | None = None,
) -> None:
    """Parquet (default) or CSV with a header. The old row-number column is not kept.

    With ``partition_by`` the rows are rebalanced on those columns first: adaptive execution splits a
    value that holds most of the rows over several tasks and packs small values together. ``observe``: metrics on the
    written rows, taken in the stage that writes.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if observe:
        df = df.observe(observe[0], *observe[1])
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.csv(path, header=True, nullValue="NA")
    else:
        writer.format(fmt).save(path)


def write_report(tables: Mapping[str, DataFrame], path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Several result tables, each in its own folder under ``path``."""
    for name, df in tables.items():
        write_table(df, f"{path}/{name}", fmt, mode=mode)


def save_models(models: Mapping[str, FittedLogit], path: str, spark: SparkSession) -> int:
    """Stores the models as a new version and returns its number: their coefficients, plus each ML model under its own
    name. Earlier versions stay. The coefficients come last, so a version is complete as soon as it can be read."""
    version = max(model_versions(path, spark), default=0) + 1
    rows = [
        (m.name, m.label, m.status, m.n_rows, m.n_events, m.intercept, list(m.features), list(m.coefficients), m.method)
        for m in models.values()
    ]
    for m in models.values():
        if m.model is not None:
            m.model.write().overwrite().save(f"{path}/models/version={version}/{m.name}")
    table = spark.createDataFrame(rows, _MODEL_COLUMNS).coalesce(1)
    table.write.mode("errorifexists").parquet(f"{path}/model_coefficients/version={version}")
    return version


_MODEL_COLUMNS = (
    "name string, label string, status string, n_rows bigint, n_events bigint, intercept double, "
    "features array<string>, coefficients array<double>, method string"
)


def saved_coefficients(path: str, spark: SparkSession) -> DataFrame:
    """The stored coefficient tables of all versions, one row per model and version."""
    return spark.read.schema(f"{_MODEL_COLUMNS}, version int").parquet(f"{path}/model_coefficients")


def model_versions(path: str, spark: SparkSession) -> list[int]:
    """Stored versions, ascending; none where nothing is stored yet."""
    try:
        versions = saved_coefficients(path, spark).select("version").distinct().collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(r.version for r in versions)


def load_models(path: str, spark: SparkSession, version: int | None = None) -> dict[str, FittedLogit]:
    """The saved models by name, of the given or the latest version; the table has one row per model, so reading
    it here is small."""
    from pyspark.ml.regression import GeneralizedLinearRegressionModel

    known = model_versions(path, spark)
    version = version if version is not None else max(known, default=None)
    if version not in known:
        raise ValueError(f"{path}: no models of version {version}; stored are {known}")
    out = {}
    for r in saved_coefficients(path, spark).filter(F.col("version") == version).collect():
        model = None
        if r.intercept is not None and r.method == "ml":
            model = GeneralizedLinearRegressionModel.load(f"{path}/models/version={version}/{r.name}")
        out[r.name] = FittedLogit(
            r.name, r.label, tuple(r.features), r.status, r.n_rows, r.n_events, r.intercept, tuple(r.coefficients), r.method, model
        )
    return out
