"""Feature store and trial results: Parquet in buckets of apps, and by app and trial."""

from __future__ import annotations

import uuid
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import gates

FEATURE_SCHEMA = "run_id string, feature string, value double, app_id string"
BUCKETS = 64  # folders of a store, however many apps it holds


def bucket_of(app: Column) -> Column:
    """The folder number of an app."""
    return F.pmod(F.xxhash64(app.cast("string")), F.lit(BUCKETS)).cast("int")


def encode_features(features: DataFrame, transform=None) -> DataFrame:
    """Tall feature rows as they are stored: run and feature names are normalised."""
    rows = transform(features) if transform else features
    return rows.select(
        scalars.normalize_name(F.col("run_id")).alias("run_id"),
        scalars.normalize_name(F.col("feature")).alias("feature"),
        F.col("value").cast("double").alias("value"),
        F.col("app_id").cast("string").alias("app_id"),
    )


def write_encoded(encoded: DataFrame, path: str) -> None:
    """Append rows of :data:`FEATURE_SCHEMA` below ``app_id_bucket=…``.

    Rebalancing groups a bucket's rows into few files but splits a large one.  Files are sorted
    by app, so that a read of one app skips most of its bucket.
    """
    rows = encoded.withColumn("app_id_bucket", bucket_of(F.col("app_id"))).hint("rebalance", "app_id_bucket")
    rows = rows.sortWithinPartitions("app_id_bucket", "app_id")
    rows.write.mode("append").partitionBy("app_id_bucket").parquet(path)


def write_features(features: DataFrame, path: str, transform=None) -> None:
    """Append tall feature rows.  A repeated call appends them again: see :mod:`batches`."""
    write_encoded(encode_features(features, transform), path)


def of_app(rows: DataFrame, app_id: str) -> DataFrame:
    """The rows of one app, from its bucket folder."""
    return rows.filter((F.col("app_id_bucket") == bucket_of(F.lit(app_id))) & (F.col("app_id") == app_id))


def read_features(
    spark: SparkSession,
    path: str,
    app_id: str | None = None,
    gate: Collection[str] | None = None,
    transform=None,
) -> DataFrame:
    """Rows of one app (only its bucket folder is read) or all, optionally gated."""
    rows = spark.read.schema(f"{FEATURE_SCHEMA}, app_id_bucket int").parquet(path)
    rows = (rows if app_id is None else of_app(rows, app_id)).drop("app_id_bucket")
    if gate is not None:
        rows = rows.filter(F.col("feature").isin(*gate))
    return transform(rows) if transform else rows


def list_apps(spark: SparkSession, path: str) -> DataFrame:
    return read_features(spark, path).select("app_id").distinct()


def write_minimum(minimum: DataFrame, path: str) -> None:
    """Store the minimum set (``app_id``, ``feature``) that later loads are held against."""
    minimum.select("app_id", "feature").write.mode("overwrite").parquet(path)


def load_wide(
    rows: DataFrame, names: Collection[str], minimum: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Wide rows of the runs that have their app's whole minimum set, and skip counts per app.

    ``minimum`` is the stored set; without it the set every present run has, so none is skipped.
    """
    minimum = gates.min_feature_set(rows) if minimum is None else minimum
    complete, skipped = gates.complete_runs(rows, minimum)
    return gates.to_wide(complete, ["app_id", "run_id"], sorted(names)), skipped


def drop_app(spark: SparkSession, path: str, app_id: str) -> bool:
    """Remove the rows of one app; false if there are none.

    Each file that holds some is replaced by one without them in a single rename, so that a
    failed call loses no other row and may be repeated.
    """
    rows = spark.read.schema(f"{FEATURE_SCHEMA}, app_id_bucket int").parquet(path)
    name = F.col("_metadata.file_name").alias("file")
    held = [(r.app_id_bucket, r.file) for r in of_app(rows, app_id).select("app_id_bucket", name).distinct().collect()]
    if not held:  # one bucket's files otherwise, not rows
        return False
    places = {file: f"{path}/app_id_bucket={number}/{file}" for number, file in held}
    kept = spark.read.schema(FEATURE_SCHEMA).parquet(*places.values()).select("*", name)
    kept = kept.filter(~F.col("app_id").eqNullSafe(F.lit(app_id)))
    staged = f"{path}/_kept-{uuid.uuid4().hex}"  # readers pass over such names
    kept.repartition("file").sortWithinPartitions("file", "app_id").write.partitionBy("file").parquet(staged)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = hadoop.Path(path).getFileSystem(conf)
    context = hadoop.FileContext.getFileContext(files.getUri(), conf)
    option = getattr(hadoop, "Options$Rename")
    replace = spark.sparkContext._gateway.new_array(option, 1)
    replace[0] = option.OVERWRITE
    for file, place in places.items():
        parts = files.globStatus(hadoop.Path(f"{staged}/file={file}/part-*"))
        if parts:
            context.rename(parts[0].getPath(), files.makeQualified(hadoop.Path(place)), replace)
        else:
            files.delete(hadoop.Path(place), False)
    files.delete(hadoop.Path(staged), True)
    return True


def string_view(df: DataFrame) -> DataFrame:
    """Every column as text, as document stores keep them."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def write_trial(results: DataFrame, path: str) -> None:
    """Append result rows below ``app=…/trial=…``."""
    (
        results.hint("rebalance", "app", "trial")
        .write.mode("append")
        .partitionBy("app", "trial")
        .parquet(path)
    )


def load_trial(spark: SparkSession, path: str, app: str, trial: str) -> DataFrame:
    """Result rows of one trial; only its partition folder is read."""
    rows = spark.read.option("recursiveFileLookup", "false").parquet(path)
    return rows.filter((F.col("app") == app) & (F.col("trial") == trial))
