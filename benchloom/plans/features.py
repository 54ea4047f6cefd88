"""Queries: metric series, executors, stages, gates and modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ops
from ..operators import gates
from . import inputs
from .registry import query, r6

RUN = ["run_id"]
_S = inputs.SUMMARY_SQL
_ROUNDED = """round(max, 6) AS max, round(mean, 6) AS mean, round(min, 6) AS min,
       round("5_pc", 6) AS "5_pc", round("25_pc", 6) AS "25_pc", round("50_pc", 6) AS "50_pc",
       round("75_pc", 6) AS "75_pc", round("95_pc", 6) AS "95_pc\""""


def _rounded(df, *keys):
    return df.select(*keys, *[r6(c).alias(c) for c in df.columns if c not in keys])


@query(
    "series_summary",
    f"""
    SELECT user_id, event_type, {_ROUNDED}
    FROM (SELECT user_id, event_type, {_S} FROM events GROUP BY user_id, event_type)
    """,
)
def series_summary(t):
    keys = ["user_id", "event_type"]
    return _rounded(ops.series_summary(t.events.select(*keys, "value"), keys, "value"), *keys)


@query(
    "run_stats",
    """
    WITH s AS (SELECT user_id, value,
                      row_number() OVER (PARTITION BY user_id ORDER BY value) AS r,
                      count(*) OVER (PARTITION BY user_id) AS n
               FROM events),
         a AS (SELECT user_id, max(value) AS mx, avg(value) AS me, min(value) AS mi,
                      max(CASE WHEN r = round_even((n - 1) * 0.50, 0) + 1 THEN value END) AS p50,
                      max(CASE WHEN r = round_even((n - 1) * 0.75, 0) + 1 THEN value END) AS p75,
                      max(CASE WHEN r = round_even((n - 1) * 0.95, 0) + 1 THEN value END) AS p95,
                      max(CASE WHEN r = round_even((n - 1) * 0.99, 0) + 1 THEN value END) AS p99
               FROM s GROUP BY user_id)
    SELECT c_custkey AS user_id, round(coalesce(mx, -1), 6) AS max, round(coalesce(me, -1), 10) AS mean,
           round(coalesce(mi, -1), 6) AS min, coalesce(p50, -1) AS "50pc", coalesce(p75, -1) AS "75pc",
           coalesce(p95, -1) AS "95pc", coalesce(p99, -1) AS "99pc"
    FROM customer LEFT JOIN a ON user_id = c_custkey
    """,
)
def run_stats(t):
    runs = t.customer.select(F.col("c_custkey").alias("user_id"))
    samples = t.events.select("user_id", "value")
    out = ops.run_stats(runs, samples, ["user_id"], "value")
    # a mean of values with two decimals can end in 5 at the seventh
    mean = r6("mean", 10).alias("mean")
    return out.select("user_id", *[mean if c == "mean" else r6(c).alias(c) for c in out.columns[1:]])


@query(
    "container_features",
    f"WITH {inputs.CONTAINER_FEATURES} SELECT run_id, feature, round(value, 6) AS value FROM container_features",
)
def container_features(t):
    return _rounded(ops.container_features(inputs.container_series(t), RUN), "run_id", "feature")


@query(
    "null_metric_gate",
    f"""
    WITH {inputs.CONTAINER_IDS}
    SELECT id, name, count(*) AS samples, round(sum(value), 4) AS total FROM usable GROUP BY id, name
    """,
)
def null_metric_gate(t):
    samples = inputs.container_samples(t).withColumn(
        "id", ops.scalars.container_id(F.col("pod"), F.col("container"))
    )
    return (
        ops.drop_unusable_metrics(samples)
        .groupBy("id", "name")
        .agg(F.count(F.lit(1)).alias("samples"), r6(F.sum("value"), 4).alias("total"))
    )


@query(
    "pod_node_map",
    f"WITH {inputs.CONTAINER_SAMPLES}, {inputs.POD_NODES} SELECT run_id, pod, node FROM pod_nodes",
)
def pod_node_map(t):
    return ops.pod_node_map(inputs.container_samples(t), RUN)


@query(
    "node_role_join",
    f"""
    WITH {inputs.NODE_ROLES}
    SELECT run_id, instance, name, seq, value, node_name, role, use FROM node_roles
    """,
)
def node_role_join(t):
    pods = ops.pod_node_map(inputs.container_samples(t), RUN)
    return ops.node_roles(inputs.node_samples(t), inputs.node_info(t), pods, RUN).drop("ip")


@query(
    "node_features",
    f"""
    WITH {inputs.NODE_ROLES},
    firsts AS (SELECT run_id, use, node_name, name, series, arg_min(value, seq) AS value, min(seq) AS started
               FROM node_roles WHERE role <> 'master' AND use IS NOT NULL
               GROUP BY run_id, use, node_name, name, series)
    SELECT run_id, 'nf_driver_' || name AS feature, round(arg_max(value, started), 6) AS value
    FROM firsts WHERE use = 'driver' GROUP BY run_id, name
    UNION ALL
    SELECT run_id, 'nf_exec_' || name || '_' || stat, round(value, 6) FROM (
      SELECT run_id, name, {inputs.SUMMARY_CELLS} FROM (
        SELECT run_id, name, {_S} FROM firsts WHERE use = 'exec' GROUP BY run_id, name))
    """,
)
def node_features(t):
    pods = ops.pod_node_map(inputs.container_samples(t), RUN)
    out = ops.node_features(inputs.node_series(t), inputs.node_info(t), pods, RUN)
    return _rounded(out, "run_id", "feature")


_EXECUTORS = f"""{inputs.CONTAINER_FEATURES},
    executors AS (
      SELECT run_id, split_part(feature, '_', 3) AS executor,
             array_to_string(string_split(feature, '_')[4:], '_') AS feature, value
      FROM container_features WHERE feature NOT LIKE '%driver%')"""


@query(
    "executor_pick_percentile",
    f"""
    WITH {_EXECUTORS},
    ranked AS (SELECT run_id, executor, row_number() OVER (PARTITION BY run_id ORDER BY value, executor) AS r,
                      count(*) OVER (PARTITION BY run_id) AS n
               FROM executors WHERE feature = '{ops.PICK_FEATURE}'),
    chosen AS (SELECT run_id, executor FROM ranked
               WHERE r = least(floor(n * 0.95::DOUBLE), n - 1) + 1)
    SELECT run_id, feature, round(value, 6) AS value FROM container_features WHERE feature LIKE '%driver%'
    UNION ALL
    SELECT e.run_id, 'cf_exec_' || e.feature,
           round(max(CASE WHEN e.executor = c.executor THEN e.value END), 6)
    FROM executors e JOIN chosen c ON e.run_id = c.run_id GROUP BY e.run_id, e.feature
    UNION ALL
    SELECT DISTINCT run_id, 'rejected_without_{ops.PICK_FEATURE}', NULL::DOUBLE
    FROM executors WHERE run_id NOT IN (SELECT run_id FROM chosen)
    """,
)
def executor_pick_percentile(t):
    feats = ops.container_features(inputs.container_series(t), RUN)
    return _rounded(ops.executor_pick(feats, RUN), "run_id", "feature")


@query(
    "executor_summary",
    f"""
    WITH {_EXECUTORS}
    SELECT run_id, feature, round(value, 6) AS value FROM container_features WHERE feature LIKE '%driver%'
    UNION ALL
    SELECT run_id, 'cf_exec_' || feature || '_' || stat, round(value, 6) FROM (
      SELECT run_id, feature, {inputs.SUMMARY_CELLS} FROM (
        SELECT run_id, feature, {_S} FROM executors GROUP BY run_id, feature))
    """,
)
def executor_summary(t):
    feats = ops.container_features(inputs.container_series(t), RUN)
    return _rounded(ops.executor_summary(feats, RUN), "run_id", "feature")


@query(
    "stage_metric_sums",
    """
    SELECT l_orderkey AS run_id, name AS feature, round(sum(v), 4) AS value FROM (
      SELECT l_orderkey, 'internal.metrics.runTime' AS name, l_extendedprice AS v FROM lineitem
      UNION ALL SELECT l_orderkey, 'internal.metrics.' || l_returnflag, l_quantity FROM lineitem
      UNION ALL SELECT l_orderkey, 'internal.metrics.status', TRY_CAST(l_linestatus AS DOUBLE) FROM lineitem)
    GROUP BY l_orderkey, name
    """,
)
def stage_metric_sums(t):
    sums = ops.stage_metric_sums(inputs.stages(t), RUN)
    return sums.select("run_id", "feature", r6("value", 4).alias("value"))


@query(
    "job_completion_time",
    """
    WITH s AS (SELECT l_orderkey AS run_id,
                      date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS completed,
                      date_diff('day', DATE '1970-01-01', l_shipdate::DATE)
                        - floor(l_quantity)::BIGINT AS submitted
               FROM lineitem),
         g AS (SELECT run_id, list_sort(list(completed), 'DESC') AS c, min(completed) AS first_done,
                      min(submitted) AS first_sub FROM s GROUP BY run_id)
    SELECT run_id, c[2] - first_done AS jct, c[1] - first_sub AS full_jct FROM g
    """,
)
def job_completion_time(t):
    return ops.job_completion_time(inputs.stages(t), RUN)


# ---- gates and modes ------------------------------------------------------------------

_MINIMUM = f"""{inputs.APP_FEATURES},
    runs AS (SELECT app_id, count(DISTINCT run_id) AS n FROM app_features GROUP BY app_id),
    minimum AS (SELECT f.app_id, f.feature FROM app_features f JOIN runs USING (app_id)
                GROUP BY f.app_id, f.feature, n HAVING count(DISTINCT f.run_id) = n)"""


@query("min_feature_set", f"WITH {_MINIMUM} SELECT app_id, feature FROM minimum")
def min_feature_set(t):
    return gates.min_feature_set(inputs.app_features(t))


@query(
    "feature_gate",
    f"""
    WITH {_MINIMUM}
    SELECT 'kept' AS part, app_id, run_id, feature, value FROM app_features
    SEMI JOIN minimum USING (app_id, feature)
    UNION ALL
    SELECT 'gated', app_id, run_id, feature, value FROM app_features
    ANTI JOIN minimum USING (app_id, feature)
    """,
)
def feature_gate(t):
    feats = inputs.app_features(t)
    gate, keys = gates.min_feature_set(feats), ["app_id", "feature"]
    kept = gates.gate_features(feats, gate, keys).withColumn("part", F.lit("kept"))
    gated = gates.gate_features(feats, gate, keys, keep=False).withColumn("part", F.lit("gated"))
    return kept.unionByName(gated)


def _sql_mode(mode: str) -> str:
    starts = lambda p: f"starts_with(feature, '{p}')"
    has = lambda w: f"contains(feature, '{w}')"
    static = ", ".join(f"'{f}'" for f in gates.STATIC_FEATURES)
    cf_total = f"({starts('cf')} AND {has('total')})"
    free = " OR ".join(has(w) for w in ("avail", "free", "Free", "Avail"))
    return {
        "all": "true",
        "static": f"feature IN ({static})",
        "ins": "feature = 'API_Name'",
        "none": "false",
        "cf": starts("cf"),
        "gcf": starts("gcf_driver_full_gc_count"),
        "gcf_ne": f"{starts('gcf_driver_full_gc_count')} OR {starts('num_executor')}",
        "gcf-all": starts("gcf"),
        "non_cf": f"NOT {starts('cf')}",
        "cf_total": cf_total,
        "fw": starts("internal"),
        "cf_fw": f"{starts('internal')} OR {starts('cf')}",
        "cf_total_fw": f"{starts('internal')} OR {cf_total}",
        "cpu_only": has("container_cpu_usage_seconds_total"),
        "node_all": starts("nf"),
        "node_all_ne": f"{starts('nf')} OR {starts('num_executor')}",
        "node_free": f"{starts('nf')} AND ({free})",
        "node_not_total": f"{starts('nf')} AND NOT {has('total')}",
    }[mode]


def _register_mode(label, mode, sql_rule, gate=()):
    passed = " OR ".join(["false", *[f"feature = '{g}'" for g in gate]])

    @query(
        f"feature_mode_{label}",
        f"""
        WITH {inputs.NAMED_FEATURES}
        SELECT feature, count(*) AS n, round(sum(value), 4) AS total FROM named_features
        WHERE NOT contains(feature, 'jct') AND (({passed}) OR ({sql_rule})) GROUP BY feature
        """,
    )
    def mode_query(t):
        feats = inputs.named_features(t)
        return (
            feats.filter(gates.feature_mode(mode, F.col("feature"), gate))
            .groupBy("feature")
            .agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), 4).alias("total"))
        )


for _mode in gates.MODES:
    # The empty mode still lets its gate pass.
    _register_mode(
        _mode.replace("-", "_"), _mode, _sql_mode(_mode), ("rate", "jct") if _mode == "none" else ()
    )
_register_mode(
    "explicit", {"Arch", "rate", "jct"}, "feature IN ('Arch', 'rate', 'jct')", gate=("GPUs",)
)
