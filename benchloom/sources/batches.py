"""Feature store of named batches: a write that is repeated changes nothing.

``<path>/rows/attempt=…/app_id_bucket=…`` holds the rows, ``<path>/state/attempt=…`` what the minimum
set needs of them, and ``<path>/batches`` the attempt that counts for each batch.  A batch is
visible once its line in ``batches`` is written, as the last step; what a failed attempt left
behind is never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import join_null_safe
from .store import FEATURE_SCHEMA, encode_features, of_app, write_encoded

_STATE = "app_id string, feature string, whole boolean, runs bigint, attempt string"


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(batch, attempt) of every committed batch.

    Of two writers that commit one batch at the same time, one attempt counts.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batches")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    schema = "batch string, attempt string"
    lines = (
        spark.read.schema(schema).parquet(f"{path}/batches") if files.exists(folder)
        else spark.createDataFrame([], schema)
    )
    return lines.groupBy("batch").agg(F.min("attempt").alias("attempt"))


def _visible(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    # The schema makes the folder names text, whatever they look like.
    rows = spark.read.schema(schema).parquet(f"{path}/{part}")
    return rows.join(committed(spark, path), "attempt", "left_semi").drop("attempt")


def _run_counts(rows: DataFrame) -> DataFrame:
    """Runs per app (``whole``) and per app and feature."""
    held = rows.select("app_id", "run_id", "feature").distinct()
    runs = rows.select("app_id", "run_id", F.lit(None).cast("string").alias("feature")).distinct()
    return (
        held.withColumn("whole", F.lit(False)).unionByName(runs.withColumn("whole", F.lit(True)))
        .groupBy("app_id", "feature", "whole").agg(F.count(F.lit(1)).alias("runs"))
    )


def stage_batch(features: DataFrame, path: str, transform=None) -> str:
    """Write a batch without committing it; returns its attempt."""
    spark, attempt = features.sparkSession, uuid.uuid4().hex
    rows = f"{path}/rows/attempt={attempt}"
    write_encoded(encode_features(features, transform), rows)
    # Counted from what was written, so that both agree also where the input does not repeat.
    stored = spark.read.schema(FEATURE_SCHEMA).parquet(rows)
    _run_counts(stored).write.parquet(f"{path}/state/attempt={attempt}")
    return attempt


def write_batch(features: DataFrame, path: str, batch: str, transform=None) -> bool:
    """Add a batch of tall feature rows; false, and nothing written, if it is committed already.

    All rows of a run belong into one batch.
    """
    spark = features.sparkSession
    if not committed(spark, path).filter(F.col("batch") == batch).isEmpty():
        return False
    attempt = stage_batch(features, path, transform)
    line = spark.createDataFrame([(batch, attempt)], "batch string, attempt string")
    line.coalesce(1).write.mode("append").parquet(f"{path}/batches")
    return True


def read_batches(spark: SparkSession, path: str, app_id: str | None = None) -> DataFrame:
    """Rows of all committed batches, of one app (its bucket folders) or all."""
    rows = _visible(spark, path, "rows", f"{FEATURE_SCHEMA}, attempt string, app_id_bucket int")
    return (rows if app_id is None else of_app(rows, app_id)).drop("app_id_bucket")


def min_feature_set(spark: SparkSession, path: str) -> DataFrame:
    """Features that every run of an app has, from the counts of the batches alone.

    Counts of batches add up, so batches may come in any order and no stored row is read again.
    """
    state = _visible(spark, path, "state", _STATE)
    total = state.filter("whole").groupBy("app_id").agg(F.sum("runs").alias("_total"))
    have = state.filter("NOT whole").groupBy("app_id", "feature").agg(F.sum("runs").alias("_have"))
    return (
        join_null_safe(have, total, ["app_id"], "inner")
        .filter(F.col("_have") == F.col("_total"))
        .select("app_id", "feature")
    )
