"""Per-run features from metric series, executors and stage events.

Features stay tall: ``(run keys, feature, value)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..session import materialize
from .ranks import group_percentiles, join_null_safe, with_rank

# Container metrics without information, and the summary statistics.
USELESS_METRICS = (
    "container_tasks_state",
    "container_start_time_seconds",
    "container_scrape_error",
    "container_last_seen",
)
SUMMARY_PERCENTILES = {
    "5_pc": 0.05,
    "25_pc": 0.25,
    "50_pc": 0.50,
    "75_pc": 0.75,
    "95_pc": 0.95,
}
SUMMARY_STATS = ("max", "mean", "min", *SUMMARY_PERCENTILES)
RUN_STATS_PERCENTILES = {"50pc": 0.50, "75pc": 0.75, "95pc": 0.95, "99pc": 0.99}
PICK_FEATURE = "executor_container_cpu_usage_seconds_total"


def _spread(value: str) -> dict[str, tuple[str, str]]:
    return {name: (name, value) for name in ("max", "mean", "min")}


def series_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Max, mean, min and five linear percentiles of each series."""
    return group_percentiles(df, keys, value, SUMMARY_PERCENTILES, merged=_spread(value))


def run_stats(runs: DataFrame, samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Max, mean, min and nearest percentiles per run; -1 everywhere for a run without samples."""
    stats = group_percentiles(
        samples, keys, value, RUN_STATS_PERCENTILES, "nearest", merged=_spread(value)
    )
    names = [c for c in stats.columns if c not in keys]
    joined = join_null_safe(runs.select(*keys), stats, keys, "left")
    return joined.select(*keys, *[F.coalesce(F.col(n), F.lit(-1.0)).alias(n) for n in names])


def _tall(df: DataFrame, keys: Sequence[str], name: Column, stats: Sequence[str]) -> DataFrame:
    """Unpivot summary columns into ``<name>_<stat>`` rows."""
    cells = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in stats])
    return df.select(*keys, name.alias("_name"), F.explode(cells).alias("_cell")).select(
        *keys,
        F.concat_ws("_", "_name", "_cell.stat").alias("feature"),
        F.col("_cell.value").alias("value"),
    )


def drop_unusable_metrics(samples: DataFrame, name: str = "name", owner: str = "id") -> DataFrame:
    """Drop metrics without information and samples whose container id is empty."""
    return samples.filter(~F.col(name).isin(*USELESS_METRICS) & (F.col(owner) != ""))


def _labels(samples: DataFrame, series: str) -> list[str]:
    return [series] if series in samples.columns else []


def container_features(
    samples: DataFrame, keys: Sequence[str], order: str = "seq", id_fetch=None, post_proc=None,
    series: str = "series",
) -> DataFrame:
    """Features ``cf_<id>_<metric>[_<stat>]`` of each container series.

    ``samples`` has the keys, ``pod``, ``container``, ``name``, ``value`` and
    ``order``.  Series of one container and metric that differ in other labels are told
    apart by the column ``series`` (their labels as sorted text), if there is one.
    Counters (``total`` in the name) keep their last value, other metrics their summary;
    of several series the one that starts last counts, with equal starts the greatest labels.
    """
    labels = _labels(samples, series)
    make_id = id_fetch or (lambda df: scalars.container_id(df["pod"], df["container"]))
    usable = drop_unusable_metrics(samples.withColumn("id", make_id(samples)))
    counter = F.contains("name", F.lit("total"))
    fed = usable.select(
        *keys,
        *labels,
        F.col(order).alias("_order"),
        F.concat_ws("_", F.lit("cf"), "id", "name").alias("_name"),
        counter.alias("_counter"),
        F.when(~counter, F.col("value")).alias("_gauge"),
        F.struct(order, "value").alias("_last"),
    )
    # One pass and one shuffle for both kinds of metric.
    stats = group_percentiles(
        fed,
        [*keys, "_name", "_counter", *labels],
        "_gauge",
        SUMMARY_PERCENTILES,
        merged={**_spread("_gauge"), "_last": ("max", "_last"), "_start": ("min", "_order")},
    )
    if labels:
        kept = F.struct(*[F.col(c) for c in (*SUMMARY_STATS, "_last")])
        stats = stats.groupBy(*keys, "_name", "_counter").agg(
            F.max_by(kept, F.struct("_start", *labels)).alias("_kept")
        ).select(*keys, "_name", "_counter", "_kept.*")
    cells = [
        F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in SUMMARY_STATS
    ]
    last = F.array(F.struct(F.lit(None).cast("string").alias("stat"), F.col("_last.value")))
    out = stats.select(
        *keys,
        "_name",
        F.explode(F.when(F.col("_counter"), last).otherwise(F.array(*cells))).alias("_cell"),
    ).select(
        *keys,
        F.concat_ws("_", "_name", "_cell.stat").alias("feature"),
        F.col("_cell.value").alias("value"),
    )
    return post_proc(out) if post_proc else out


def pod_node_map(samples: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """Node of each pod; the last entry wins."""
    return samples.groupBy(*keys, "pod").agg(F.max_by("node", order).alias("node"))


def node_roles(samples: DataFrame, node_info: DataFrame, pods: DataFrame, keys) -> DataFrame:
    """Attach node name, role and use (driver or exec) to node samples by ``instance`` address."""
    ip = F.substring_index("instance", ":", 1)
    used = pods.groupBy(*keys, F.col("node").alias("node_name")).agg(
        F.max(F.contains("pod", F.lit("driver"))).alias("_driver")
    )
    info = node_info.select(*keys, "ip", F.col("name").alias("node_name"), "role")
    named = join_null_safe(samples.withColumn("ip", ip), info, [*keys, "ip"], "inner")
    return join_null_safe(named, used, [*keys, "node_name"], "left").withColumn(
        "use", F.when(F.col("_driver"), "driver").when(~F.col("_driver"), "exec")
    ).drop("_driver")


def node_features(
    samples: DataFrame, node_info: DataFrame, pods: DataFrame, keys: Sequence[str],
    order: str = "seq", post_proc=None, series: str = "series",
) -> DataFrame:
    """Features ``nf_driver_<metric>`` and ``nf_exec_<metric>_<stat>``.

    The first sample of each series counts (a node and, if there is a column ``series``,
    its other labels); those of executor nodes are summarised, of those of the driver's
    node the series that starts last counts.  Master nodes and nodes without pods are
    left out.
    """
    named = node_roles(samples, node_info, pods, keys).filter(
        (F.col("role") != "master") & F.col("use").isNotNull()
    )
    labels = _labels(samples, series)
    firsts = named.groupBy(*keys, "use", "node_name", "name", *labels).agg(
        F.min_by("value", order).alias("value"), F.min(order).alias("_start")
    )
    driver = (
        firsts.filter(F.col("use") == "driver")
        .groupBy(*keys, "name")
        .agg(F.max_by("value", F.struct("_start", "node_name", *labels)).alias("value"))
        .select(*keys, F.concat(F.lit("nf_driver_"), "name").alias("feature"), "value")
    )
    summary = series_summary(firsts.filter(F.col("use") == "exec"), [*keys, "name"], "value")
    execs = _tall(summary, keys, F.concat(F.lit("nf_exec_"), "name"), SUMMARY_STATS)
    out = driver.unionByName(execs)
    return post_proc(out) if post_proc else out


def _split_executors(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    # Features are far smaller than the samples behind them: compute them once.
    features = materialize(features, "features")
    is_driver = F.contains("feature", F.lit("driver"))
    executors = features.filter(~is_driver).withColumns(
        {
            "executor": scalars.executor_of(F.col("feature")),
            "feature": scalars.executor_feature(F.col("feature")),
        }
    )
    return features.filter(is_driver), executors


def executor_pick(
    features: DataFrame, keys: Sequence[str], select: str = PICK_FEATURE, percentile: float = 0.95
) -> DataFrame:
    """Keep one executor per run: the one at ``percentile`` of the ``select`` feature.

    Ties go by executor id.  A feature the chosen executor lacks is null.  A run with
    executors but without the ``select`` feature has the single row
    ``rejected_without_<select>`` in place of executor features.
    """
    driver, executors = _split_executors(features)
    candidates = executors.filter(F.col("feature") == select).select(*keys, "executor", "value")
    ranked = with_rank(candidates, keys, ["value", "executor"], "_rank", "_n")
    chosen = ranked.filter(
        F.col("_rank") == F.least(F.floor(F.col("_n") * F.lit(percentile)), F.col("_n") - 1) + 1
    ).select(*keys, F.col("executor").alias("_chosen"))
    picked = (
        join_null_safe(executors, chosen, keys, "inner")
        .groupBy(*keys, "feature")
        .agg(F.max(F.when(F.col("executor") == F.col("_chosen"), F.col("value"))).alias("value"))
    )
    rejected = join_null_safe(executors.select(*keys).distinct(), chosen, keys, "left_anti").select(
        *keys, F.lit(f"rejected_without_{select}").alias("feature"),
        F.lit(None).cast("double").alias("value"),
    )
    return (
        driver.select(*keys, "feature", "value")
        .unionByName(picked.withColumn("feature", F.concat(F.lit("cf_exec_"), "feature")))
        .unionByName(rejected)
    )


def executor_summary(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summary of each feature over the executors of a run; driver features pass through."""
    driver, executors = _split_executors(features)
    summary = series_summary(executors, [*keys, "feature"], "value")
    execs = _tall(summary, keys, F.concat(F.lit("cf_exec_"), "feature"), SUMMARY_STATS)
    return driver.select(*keys, "feature", "value").unionByName(execs)


def stage_metric_sums(stages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of accumulable values by name; text that is not a number counts as missing."""
    return (
        stages.select(*keys, F.inline("accumulables"))
        .groupBy(*keys, F.col("Name").alias("feature"))
        .agg(F.sum(F.col("Value").try_cast("double")).alias("value"))
    )


def job_completion_time(stages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Completion times per run from ``stage_id``, ``submitted`` and ``completed``.

    ``jct`` is the second-last completion minus the first one (null with fewer
    than two stages), ``full_jct`` the last completion minus the first submission.
    """
    # Equal completions are counted first: a run has one row per distinct time.
    times = stages.groupBy(*keys, "completed").agg(
        F.count("completed").alias("_n"), F.min("submitted").alias("_submitted")
    )
    runs = times.groupBy(*keys).agg(
        F.max("completed").alias("_last"),
        F.max_by("_n", "completed").alias("_n_last"),
        F.min("completed").alias("_first"),
        F.min("_submitted").alias("_submitted"),
    )
    below = join_null_safe(times, runs.select(*keys, "_last"), keys, "inner")
    below = below.filter(F.col("completed") < F.col("_last")).groupBy(*keys).agg(
        F.max("completed").alias("_below")
    )
    second = F.when(F.col("_n_last") > 1, F.col("_last")).otherwise(F.col("_below"))
    return join_null_safe(runs, below, keys, "left").select(
        *keys,
        (second - F.col("_first")).alias("jct"),
        (F.col("_last") - F.col("_submitted")).alias("full_jct"),
    )
