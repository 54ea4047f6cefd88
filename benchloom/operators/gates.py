"""Which logs, rows and features take part: gates, modes and minimum sets."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from .ranks import join_null_safe

# The static resource features.
STATIC_FEATURES = (
    "API_Name",
    "Arch",
    "Clock_Speed(GHz)",
    "Compute_Units_(ECU)",
    "EBS_Exposed_as_NVMe",
    "EBS_Optimized__Max_16K_IOPS",
    "EBS_Optimized__Max_Bandwidth",
    "EBS_Optimized__Throughput",
    "EBS_Optimized_surcharge",
    "ECU_per_vCPU",
    "EMR_cost",
    "Enhanced_Networking",
    "FPGAs",
    "GPUs",
    "IPv6_Support",
    "Instance_Storage",
    "Instance_Storage__SSD_TRIM_Support",
    "Instance_Storage__already_warmed-up",
    "Intel_AVX",
    "Intel_AVX2",
    "Intel_Turbo",
    "num_executor",
    "dataset_size",
)


def _starts(*prefixes: str):
    def rule(name: Column) -> Column:
        tests = [F.startswith(name, F.lit(p)) for p in prefixes]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    return rule


def _has(name: Column, *words: str) -> Column:
    out = F.contains(name, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(name, F.lit(w))
    return out


MODES = {
    "all": lambda n: F.lit(True),
    "static": lambda n: n.isin(*STATIC_FEATURES),
    "ins": lambda n: n == "API_Name",
    "none": lambda n: F.lit(False),
    "cf": _starts("cf"),
    "gcf": _starts("gcf_driver_full_gc_count"),
    "gcf_ne": _starts("gcf_driver_full_gc_count", "num_executor"),
    "gcf-all": _starts("gcf"),
    "non_cf": lambda n: ~_starts("cf")(n),
    "cf_total": lambda n: _starts("cf")(n) & _has(n, "total"),
    "fw": _starts("internal"),
    "cf_fw": _starts("internal", "cf"),
    "cf_total_fw": lambda n: _starts("internal")(n) | (_starts("cf")(n) & _has(n, "total")),
    "cpu_only": lambda n: _has(n, "container_cpu_usage_seconds_total"),
    "node_all": _starts("nf"),
    "node_all_ne": _starts("nf", "num_executor"),
    "node_free": lambda n: _starts("nf")(n) & _has(n, "avail", "free", "Free", "Avail"),
    "node_not_total": lambda n: _starts("nf")(n) & ~_has(n, "total"),
}


def feature_mode(
    mode: str | Collection[str],
    name: Column,
    gate: Collection[str] = (),
    select: Collection[str] = (),
) -> Column:
    """Whether a feature takes part.  ``mode`` is a mode name or a set of feature names.

    Completion times never do; gated and selected names always do.
    """
    if isinstance(mode, str):
        if mode not in MODES:
            raise ValueError(f"unsupported feature mode: {mode}")
        chosen = MODES[mode](name)
    else:
        chosen = name.isin(*mode) if mode else F.lit(False)
    passed = [*gate, *select]
    if passed:
        chosen = name.isin(*passed) | chosen
    return ~F.contains(name, F.lit("jct")) & chosen


def mode_columns(
    df: DataFrame, mode: str | Collection[str], gate: Collection[str] = (), select=()
) -> list[str]:
    """Column names of a wide frame that a mode keeps (driver work on the schema only)."""
    spark = df.sparkSession
    names = spark.createDataFrame([(i, c) for i, c in enumerate(df.columns)], "pos int, name string")
    kept = names.filter(feature_mode(mode, F.col("name"), gate, select)).orderBy("pos")
    return [r.name for r in kept.collect()]


def complete_logs(entries: DataFrame, keys: Sequence[str], outputs: int = 4) -> DataFrame:
    """Logs that have an info entry, inputs, and exactly ``outputs`` distinct outputs."""
    # Distinct names first: later duplicates of an entry replace it, they do not add one.
    distinct = entries.groupBy(*keys, "entry_type", "name").agg(F.count(F.lit(1)).alias("_n"))
    counts = distinct.groupBy(*keys).agg(
        F.count_if(F.col("entry_type") == "info").alias("n_info"),
        F.count_if(F.col("entry_type") == "input").alias("n_input"),
        F.count_if(F.col("entry_type") == "output").alias("n_output"),
    )
    return counts.filter(
        (F.col("n_info") > 0) & (F.col("n_input") > 0) & (F.col("n_output") == outputs)
    )


def split_by_jct(rows: DataFrame, jct: str = "jct") -> tuple[DataFrame, DataFrame]:
    """Rows with a valid completion time, and the rejected ones (negative or missing)."""
    valid = F.coalesce(F.col(jct) >= 0, F.lit(False))
    return rows.filter(valid), rows.filter(~valid)


def min_feature_set(features: DataFrame, app: str = "app_id", run: str = "run_id") -> DataFrame:
    """Features that every run of an app has."""
    # The (app, run, feature) groups spread a hot app over all tasks before it is counted.
    held = features.groupBy(app, run, "feature").agg(F.count(F.lit(1)).alias("_n"))
    have = held.groupBy(app, "feature").agg(F.count(F.lit(1)).alias("_have"))
    runs = held.groupBy(app, run).agg(F.count(F.lit(1)).alias("_n"))
    total = runs.groupBy(app).agg(F.count(F.lit(1)).alias("_runs"))
    return (
        join_null_safe(have, total, [app], "inner")
        .filter(F.col("_have") == F.col("_runs"))
        .select(app, "feature")
    )


def gate_features(features: DataFrame, gate: DataFrame, keys: Sequence[str], keep: bool = True):
    """Keep (or drop) the features listed in ``gate``."""
    return join_null_safe(features, gate, keys, "left_semi" if keep else "left_anti")


def complete_runs(features: DataFrame, minimum: DataFrame, app="app_id", run="run_id"):
    """Rows of the minimum set, for runs having all of it; and the per-app count of skipped runs."""
    gated = gate_features(features, minimum, [app, "feature"])
    size = minimum.groupBy(app).agg(F.count(F.lit(1)).alias("_size"))
    held = gated.groupBy(app, run, "feature").agg(F.count(F.lit(1)).alias("_n"))
    per_run = held.groupBy(app, run).agg(F.count(F.lit(1)).alias("_have"))
    all_runs = features.groupBy(app, run).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    known = join_null_safe(join_null_safe(all_runs, per_run, [app, run], "left"), size, [app], "inner")
    full = F.coalesce(F.col("_have"), F.lit(0)) == F.col("_size")
    complete = known.filter(full).select(app, run)
    skipped = known.groupBy(app).agg(F.count_if(~full).alias("skipped"))
    return join_null_safe(gated, complete, [app, run], "left_semi"), skipped


def to_wide(features: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Pivot tall features to one row per run, with the given columns."""
    return features.groupBy(*keys).pivot("feature", list(names)).agg(F.max("value"))


def drop_nested(df: DataFrame) -> DataFrame:
    """Drop array, map and struct columns."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, nested)])


def drop_features(df: DataFrame, names: Sequence[str] = ("jct",)) -> DataFrame:
    """Drop the named columns; a missing one is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such features: {missing}")
    return df.drop(*names)


def unparsed_logs(logs: DataFrame, parsed: DataFrame, blacklist: DataFrame, app="app_id", log="log_id"):
    """Logs that are neither stored yet nor of a blacklisted app.

    ``parsed`` has ids as the store keeps them, so names are normalised before they meet.
    """
    allowed = join_null_safe(logs, blacklist, [app], "left_anti")
    known = parsed.select(app, F.col(log).alias("_stored")).distinct()
    named = allowed.withColumn("_stored", scalars.normalize_name(F.col(log)))
    return join_null_safe(named, known, [app, "_stored"], "left_anti").drop("_stored")
