"""The three layouts of a feature table: wide columns, long rows, one vector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import clean


def to_long(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """ids, feature, value: a row for each cell; missing cells stay as NULL values."""
    doubles = df.select(*ids, *[clean(F.col(f), float("inf")).alias(f) for f in features])
    return doubles.unpivot(list(ids), list(features), "feature", "value")


def to_vector(df: DataFrame, features: Sequence[str], out: str = "vector", fill: float | None = None) -> DataFrame:
    """Adds one array<double> column in the order of ``features``."""
    values = [F.col(f).cast("double") if fill is None else F.coalesce(F.col(f).cast("double"), F.lit(fill)) for f in features]
    return df.withColumn(out, F.array(*values))


def to_wide(long: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """From long rows back to a column for each feature."""
    return long.groupBy(*ids).pivot("feature", list(features)).agg(F.first("value", ignorenulls=True))
