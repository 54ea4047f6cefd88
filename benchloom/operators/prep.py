"""Dataset preparation: splits, outliers, encoding, scaling, feature selection."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from .ranks import group_percentiles, join_null_safe, with_rank


def per_feature_split(
    df: DataFrame,
    feature: str | Callable[[list[str]], list[str]],
    unique: Sequence[str],
    test_size: float = 0.5,
    seed: str = "0",
) -> DataFrame:
    """Split each feature value's rows into train and test (column ``part``).

    ``ceil(n * test_size)`` random rows of a value are its test rows.  Values with
    ``n * test_size < 1`` put all their rows into both parts.
    """
    if callable(feature):
        feature = feature(df.columns)[0]
    keyed = df.withColumn("_order", scalars.order_key(seed, *[F.col(c) for c in unique]))
    ranked = with_rank(keyed, [feature], ["_order", *unique], "_rank", "_n")
    wanted = F.col("_n") * F.lit(float(test_size))
    part = (
        F.when(wanted < 1, F.array(F.lit("train"), F.lit("test")))
        .when(F.col("_rank") <= F.ceil(wanted), F.array(F.lit("test")))
        .otherwise(F.array(F.lit("train")))
    )
    return ranked.withColumn("part", F.explode(part)).drop("_order", "_rank", "_n")


def outlier_filter(df: DataFrame, feature: str, quantile: float = 0.99) -> DataFrame:
    """Rows strictly below the exact quantile of a column; text columns are read as numbers."""
    number = F.col(feature).try_cast("double")
    threshold = group_percentiles(
        df.select(number.alias("_v")), [], "_v", {"q": quantile}
    ).scalar()
    return df.withColumn(feature, number).filter(F.col(feature) < threshold)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Encoder of a column: its distinct values in sorted order, numbered from 0."""
    values = df.select(column).distinct()
    return with_rank(values, [], [column], "_code").withColumn("_code", F.col("_code") - 1)


def label_encode(
    df: DataFrame, columns: Sequence[str] | None = None, encoders: Mapping[str, DataFrame] = {}
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Replace text columns by their codes; given encoders are reused.

    Encoders stay distributed: a column may have any number of distinct values.
    """
    if columns is None:
        columns = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    used = {}
    for c in columns:
        used[c] = encoders[c] if c in encoders else label_codes(df, c)
        order = df.columns
        df = join_null_safe(df, used[c], [c], "left").withColumn(c, F.col("_code")).select(*order)
    return df, used


@dataclass(frozen=True)
class StandardScaler:
    """Fitted means and population deviations; constant columns keep deviation 1."""

    stats: Mapping[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> StandardScaler:
        row = df.agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
        ).first()
        return cls({c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(columns)})

    def forward(self, column: Column, name: str) -> Column:
        mean, deviation = self.stats[name]
        return (column - F.lit(mean)) / F.lit(deviation)

    def backward(self, column: Column, name: str) -> Column:
        mean, deviation = self.stats[name]
        return column * F.lit(deviation) + F.lit(mean)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.forward(F.col(c), c) for c in self.stats})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.backward(F.col(c), c) for c in self.stats})


class IdentityScaler:
    """Scaler that changes nothing."""

    def forward(self, column: Column, name: str) -> Column:
        return column

    backward = forward

    def transform(self, df: DataFrame) -> DataFrame:
        return df

    inverse_transform = transform


def variance_select(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns that are not constant (one aggregate over all of them)."""
    row = df.agg(*[F.var_pop(c).alias(str(i)) for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[i] is not None and row[i] > 0]


def dataset_xy(
    df: DataFrame,
    target: str,
    feature_mod: Callable[[list[str]], list[str]] | None = None,
    unique: Sequence[str] = (),
    num_rows: int | None = None,
    scaler: type[StandardScaler] | None = None,
    feature_select: bool = False,
    feature_map: Sequence[bool] | None = None,
) -> tuple[DataFrame, list[str], StandardScaler | IdentityScaler]:
    """Features vector and label, the selected names, and the fitted scaler.

    ``unique`` columns pass through as the row key.  ``feature_map`` selects
    features by position when ``feature_select`` is on, else constant ones go.
    """
    names = [c for c in df.columns if c not in unique]
    names = feature_mod(names) if feature_mod else [n for n in names if n != target]
    if num_rows:
        df = df.orderBy(*unique).limit(num_rows)
    cast = df.select(
        *unique,
        *[F.col(n).cast("double").alias(n) for n in names if n not in unique],
        F.col(target).cast("double").alias("label"),
    )
    if feature_select:
        if feature_map is not None:
            names = [n for n, keep in zip(names, feature_map) if keep]
        else:
            names = variance_select(cast, names)
    fitted = scaler.fit(cast, [*names, "label"]) if scaler else IdentityScaler()
    scaled = fitted.transform(cast)
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(scaled)
    return assembled.select(*unique, "features", "label"), names, fitted
