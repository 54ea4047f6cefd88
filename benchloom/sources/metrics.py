"""Metric series as range-query JSON: flattening, catalogue and selection."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SERIES_SCHEMA = "metric map<string,string>, values array<array<string>>"


def parse_series(results: DataFrame, json: str = "json") -> DataFrame:
    """One row per sample: ``metric`` labels, ``ts`` and ``value``."""
    series = F.from_json(json, SERIES_SCHEMA)
    return (
        results.withColumn("_series", series)
        .select(
            *[c for c in results.columns if c != json],
            F.col("_series.metric").alias("metric"),
            F.explode("_series.values").alias("_sample"),
        )
        .withColumns(
            {
                "ts": F.get("_sample", 0).try_cast("double"),
                "value": F.get("_sample", 1).try_cast("double"),
            }
        )
        .drop("_sample")
    )


def label_names(samples: DataFrame) -> list[str]:
    """Sorted label names in use, without the metric name (bounded: names, not values)."""
    keys = samples.select(F.explode(F.map_keys("metric")).alias("k")).distinct()
    return sorted(r.k for r in keys.filter(F.col("k") != "__name__").collect())


def metric_flatten(samples: DataFrame, labels: Collection[str] | None = None) -> DataFrame:
    """Columns name, timestamp, value and one per label; a missing label is empty text."""
    labels = label_names(samples) if labels is None else list(labels)
    cell = lambda k: F.coalesce(F.col("metric")[k], F.lit(""))
    return samples.select(
        cell("__name__").alias("name"),
        F.col("ts").alias("timestamp"),
        "value",
        *[cell(k).alias(k) for k in labels],
    )


def metric_catalog(samples: DataFrame, prefix: str = "container", name: str = "name") -> DataFrame:
    """Distinct metric names with a prefix."""
    return samples.filter(F.startswith(name, F.lit(prefix))).select(name).distinct()


def metric_select(
    samples: DataFrame,
    metrics: Collection[str] | str,
    pod: str = ".*",
    look_back: str = "1 day",
    ts: str = "ts",
) -> DataFrame:
    """Samples of the named metrics and pods within the look-back from the newest sample.

    Names and pods are regular expressions that match the whole text.
    """
    names = metrics if isinstance(metrics, str) else "|".join(sorted(metrics))
    newest = samples.agg(F.max(ts).alias("newest")).scalar()
    return samples.filter(
        F.rlike("name", F.lit(f"^(?:{names})$"))
        & F.rlike("pod", F.lit(f"^(?:{pod})$"))
        & (F.col(ts) > newest - F.expr(f"interval {look_back}"))
    )
