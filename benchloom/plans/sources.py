"""Queries: logs, metrics, catalogue, registry, stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import gates
from ..session import scratch_path
from ..sources import batches, catalog, eventlog, logs, metrics, registry, store
from . import inputs
from .registry import query, r6


@query(
    "log_scan",
    r"""
    SELECT lang, source, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines,
           sum(length(replace(text, chr(10), '')))::BIGINT AS chars
    FROM documents GROUP BY lang, source
    """,
)
def log_scan(t):
    path = scratch_path(t.spark, "logs")
    docs = t.documents.select("lang", "source", "text").hint("rebalance", "lang", "source")
    docs.write.partitionBy("lang", "source").text(path)
    lines = logs.log_lines(t.spark, path)
    return lines.groupBy(
        F.regexp_extract("path", "lang=([^/]*)", 1).alias("lang"),
        F.regexp_extract("path", "source=([^/]*)", 1).alias("source"),
    ).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@query(
    "log_index",
    f"WITH {inputs.LOG_INDEX} SELECT app_id, log_id, name, entry_type, path FROM log_index",
)
def log_index(t):
    return logs.log_index(inputs.log_paths(t))


@query(
    "complete_logs",
    f"""
    WITH {inputs.LOG_INDEX}
    SELECT app_id, log_id, count(DISTINCT name) FILTER (entry_type = 'info') AS n_info,
           count(DISTINCT name) FILTER (entry_type = 'input') AS n_input,
           count(DISTINCT name) FILTER (entry_type = 'output') AS n_output
    FROM log_index GROUP BY app_id, log_id HAVING n_info > 0 AND n_input > 0 AND n_output = 4
    """,
)
def complete_logs(t):
    return gates.complete_logs(logs.log_index(inputs.log_paths(t)), ["app_id", "log_id"])


@query(
    "metric_flatten",
    """
    SELECT event_type AS name, (1700000000.5 + event_id + i)::DOUBLE AS timestamp, value + i AS value,
           CASE WHEN event_type = 'signup' THEN '' ELSE regexp_extract(props, '([0-9]+)', 1) END AS k,
           user_id::VARCHAR AS "user"
    FROM events, (VALUES (0), (1)) offsets(i)
    """,
)
def metric_flatten(t):
    flat = metrics.metric_flatten(metrics.parse_series(inputs.series_json(t)))
    return flat.select("name", "timestamp", "value", "k", "user")


@query(
    "metric_catalog",
    f"WITH {inputs.CONTAINER_SAMPLES} SELECT DISTINCT name FROM container_samples WHERE name LIKE 'container%'",
)
def metric_catalog(t):
    return metrics.metric_catalog(inputs.container_samples(t))


@query(
    "metric_select",
    f"""
    WITH {inputs.CONTAINER_SAMPLES}
    SELECT run_id, pod, name, seq, value FROM container_samples
    WHERE regexp_full_match(name, 'container_cpu.*|container_memory_usage_bytes')
      AND regexp_full_match(pod, 'app-exec-.*')
      AND ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY
    """,
)
def metric_select(t):
    chosen = metrics.metric_select(
        inputs.container_samples(t),
        ["container_cpu.*", "container_memory_usage_bytes"],
        "app-exec-.*",
        "7 days",
    )
    return chosen.select("run_id", "pod", "name", "seq", "value")


@query(
    "stage_events_source",
    """
    SELECT l_orderkey AS run_id, (l_partkey * 1000 + l_suppkey * 10 + l_linenumber)::BIGINT AS stage_id,
           floor(l_quantity)::BIGINT AS submitted, floor(l_quantity)::BIGINT + l_linenumber AS completed,
           'rows' AS acc_name, l_extendedprice::VARCHAR AS acc_value
    FROM lineitem WHERE l_returnflag <> 'N'
    """,
)
def stage_events_source(t):
    path = scratch_path(t.spark, "eventlog")
    inputs.event_log_json(t).write.text(path)
    stages = eventlog.read_stages(t.spark, path, run="run_id")
    acc = F.col("accumulables")[0]
    return stages.select(
        "run_id", "stage_id", "submitted", "completed",
        acc["Name"].alias("acc_name"), acc["Value"].alias("acc_value"),
    )


@query(
    "instance_catalog",
    r"""
    SELECT split_part(p_type, ' ', 1) || '.' || p_partkey::VARCHAR AS "API_Name",
           p_size::VARCHAR || '.0' AS "Memory",
           p_retailprice::VARCHAR AS "Linux_On_Demand_cost",
           CASE p_partkey % 4 WHEN 0 THEN '1' ELSE '0' END AS "Intel_AVX", 'Up' AS "Network_Performance"
    FROM part WHERE p_size > 10
    """,
)
def instance_catalog(t):
    path = scratch_path(t.spark, "catalog")
    inputs.catalog_rows(t).write.option("header", "true").csv(path)
    # The predicate is on the row as read, before normalisation.
    wanted = F.split("Memory", r"\.")[0].try_cast("int") > 10
    return catalog.read_catalog(t.spark, path, wanted)


@query(
    "supported_types_extract",
    f"WITH {inputs.INSTANCE_NAMES} SELECT DISTINCT api_name FROM instance_names WHERE supported",
)
def supported_types_extract(t):
    return catalog.supported_types(inputs.machine_type_lines(t))


def _register_selection(label):
    families, scales, not_families, not_names = catalog.SELECTIONS[label]
    listed = lambda names: ", ".join(f"'{n}'" for n in names)
    banned = (
        f"AND split_part(api_name, '.', 1) NOT IN ({listed(not_families)}) AND api_name NOT IN ({listed(not_names)})"
        if not_families
        else ""
    )

    @query(
        f"instance_select_{label}",
        f"""
        WITH {inputs.INSTANCE_NAMES}
        SELECT part_id, api_name FROM instance_names
        WHERE split_part(api_name, '.', 1) IN ({listed(families)})
          AND split_part(api_name, '.', 2) IN ({listed(scales)}) {banned}
          AND api_name IN (SELECT api_name FROM instance_names WHERE supported)
        """,
    )
    def select_query(t):
        names = inputs.instance_names(t).select("part_id", "api_name")
        supported = catalog.supported_types(inputs.machine_type_lines(t))
        out = catalog.select_instances(names, supported, families, scales, not_families, not_names)
        return out.select("part_id", "api_name")


for _label in catalog.SELECTIONS:
    _register_selection(_label)


_LISTED = {
    n: ", ".join(f"'{f}'" for f in v)
    for n, v in {
        "general": catalog.GENERAL,
        "compute": catalog.COMPUTE,
        "memory": catalog.MEMORY,
        "banned": catalog.FAMILY_BLACKLIST,
    }.items()
}


@query(
    "family_union",
    f"""
    WITH {inputs.INSTANCE_NAMES},
    families AS (SELECT split_part(api_name, '.', 1) AS family FROM instance_names)
    (SELECT family FROM families WHERE family IN ({_LISTED['general']})
     UNION SELECT family FROM families WHERE family IN ({_LISTED['compute']})
     UNION SELECT family FROM families WHERE family IN ({_LISTED['memory']}))
    EXCEPT SELECT family FROM families WHERE family IN ({_LISTED['banned']})
    """,
)
def family_union(t):
    family, _ = catalog.family_scale(F.col("api_name"))
    names = inputs.instance_names(t).select(family.alias("family"))
    among = lambda values: F.col("family").isin(*values)
    return catalog.family_union(
        names,
        among(catalog.GENERAL),
        among(catalog.COMPUTE),
        among(catalog.MEMORY),
        excluded=names.filter(among(catalog.FAMILY_BLACKLIST)),
    )


@query(
    "registry_flatten",
    """
    WITH leaves AS (
      SELECT p.*, phase, dimension FROM part p, (VALUES ('before'), ('after')) a(phase),
             (VALUES ('input_scale'), ('scale_up')) d(dimension))
    SELECT 'app-' || p_partkey::VARCHAR AS app, p_name AS name, p_type AS app_type, phase, dimension,
           CASE dimension WHEN 'input_scale' THEN 'size-' ELSE 'type-' END || phase || '-' || p_partkey::VARCHAR AS bucket,
           CASE dimension WHEN 'input_scale' THEN '["dataset_size"]' ELSE 'static' END AS feature,
           CASE dimension WHEN 'scale_up' THEN 'jct' END AS target_feature,
           CASE dimension WHEN 'scale_up' THEN 'API_Name' END AS groupby_index,
           '1' AS min_value, p_size::VARCHAR AS max_value,
           CASE dimension WHEN 'input_scale' THEN '[' || p_size::VARCHAR || ']' ELSE '[]' END AS "values"
    FROM leaves
    """,
)
def registry_flatten(t):
    return registry.registry_flatten(inputs.registry_json(t))


# ---- stores ---------------------------------------------------------------------------


def _stored(t):
    path = scratch_path(t.spark, "features")
    store.write_features(inputs.app_features(t), path)
    return path


_STORED = f"""{inputs.APP_FEATURES},
    stored AS (SELECT app_id, replace(run_id, '.', '_') AS run_id, feature, value FROM app_features)"""


@query("feature_store_write", f"WITH {_STORED} SELECT app_id, run_id, feature, value FROM stored")
def feature_store_write(t):
    return store.read_features(t.spark, _stored(t)).select("app_id", "run_id", "feature", "value")


@query(
    "feature_store_read",
    f"""
    WITH {_STORED}
    SELECT app_id, run_id, feature, value FROM stored
    WHERE app_id = 'app-8' AND feature IN ('view', 'click', 'error')
    """,
)
def feature_store_read(t):
    rows = store.read_features(t.spark, _stored(t), "app-8", {"view", "click", "error"})
    return rows.select("app_id", "run_id", "feature", "value")


_TYPES = ("click", "error", "purchase", "signup", "view")
_WIDE = ", ".join(f'max(value) FILTER (feature = \'{f}\') AS "{f}"' for f in _TYPES)


@query(
    "feature_store_load_wide",
    f"""
    WITH {_STORED},
    minimum AS (SELECT DISTINCT app_id, feature FROM stored WHERE feature <> 'signup'),
    gated AS (SELECT * FROM stored SEMI JOIN minimum USING (app_id, feature)),
    wide AS (
      SELECT app_id, run_id, {_WIDE} FROM gated GROUP BY app_id, run_id
      HAVING count(DISTINCT feature) = (SELECT count(*) FROM minimum m WHERE m.app_id = gated.app_id)),
    runs AS (SELECT DISTINCT app_id, run_id FROM stored SEMI JOIN minimum USING (app_id)),
    skips AS (SELECT app_id, count_if((app_id, run_id) NOT IN (SELECT app_id, run_id FROM wide)) AS skipped
              FROM runs GROUP BY app_id)
    SELECT app_id, run_id, click, error, purchase, signup, view, skipped::BIGINT AS skipped
    FROM skips LEFT JOIN wide USING (app_id)
    """,
)
def feature_store_load_wide(t):
    """Held against a set that some runs lack; an app without complete runs shows its skips."""
    rows = store.read_features(t.spark, _stored(t))
    path = scratch_path(t.spark, "minimum")
    store.write_minimum(rows.filter("feature <> 'signup'").select("app_id", "feature").distinct(), path)
    wide, skipped = store.load_wide(rows, _TYPES, t.spark.read.parquet(path))
    return skipped.join(wide, "app_id", "left")


@query(
    "feature_store_drop_app",
    f"WITH {_STORED} SELECT app_id, count(*) AS n FROM stored WHERE app_id <> 'app-8' GROUP BY app_id",
)
def feature_store_drop_app(t):
    path = _stored(t)
    store.drop_app(t.spark, path, "app-8")
    return store.read_features(t.spark, path).groupBy("app_id").agg(F.count(F.lit(1)).alias("n"))


@query("feature_store_apps", f"WITH {_STORED} SELECT DISTINCT app_id FROM stored")
def feature_store_apps(t):
    return store.list_apps(t.spark, _stored(t))


def _batched(t):
    """Two batches: one fails before its commit and is written again, one is written twice."""
    path = scratch_path(t.spark, "batches")
    rows = inputs.app_features(t)
    odd = F.substring("run_id", 5, 1).cast("int") % 2 == 1
    batches.stage_batch(rows.filter(odd), path)
    batches.write_batch(rows.filter(odd), path, "odd")
    batches.write_batch(rows.filter(~odd), path, "even")
    batches.write_batch(rows.filter(odd), path, "odd")
    return path


@query("feature_store_batches", f"WITH {_STORED} SELECT app_id, run_id, feature, value FROM stored")
def feature_store_batches(t):
    return batches.read_batches(t.spark, _batched(t)).select("app_id", "run_id", "feature", "value")


@query(
    "min_feature_set_batches",
    f"""
    WITH {_STORED}, runs AS (SELECT app_id, count(DISTINCT run_id) AS n FROM stored GROUP BY app_id)
    SELECT app_id, feature FROM stored JOIN runs USING (app_id)
    GROUP BY app_id, feature, n HAVING count(DISTINCT run_id) = n
    """,
)
def min_feature_set_batches(t):
    return batches.min_feature_set(t.spark, _batched(t))


def _trials(t):
    path = scratch_path(t.spark, "trials")
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("app"),
        F.concat(F.lit("trial-"), "l_linestatus").alias("trial"),
        "l_orderkey", "l_quantity", "l_extendedprice",
    )
    store.write_trial(rows, path)
    return path


@query(
    "trial_result_write",
    """
    SELECT l_returnflag AS app, 'trial-' || l_linestatus AS trial, count(*) AS n,
           round(sum(l_extendedprice), 2) AS total
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """,
)
def trial_result_write(t):
    rows = t.spark.read.parquet(_trials(t))
    return rows.groupBy("app", "trial").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("l_extendedprice"), 2).alias("total")
    )


@query(
    "trial_result_load",
    """
    SELECT l_returnflag AS app, 'trial-' || l_linestatus AS trial, l_orderkey, l_quantity, l_extendedprice
    FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F'
    """,
)
def trial_result_load(t):
    return store.load_trial(t.spark, _trials(t), "A", "trial-F")


@query(
    "string_cast_row",
    """
    SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, o_orderpriority, o_custkey::VARCHAR AS o_custkey
    FROM orders
    """,
)
def string_cast_row(t):
    return store.string_view(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey"))


@query(
    "unparsed_logs",
    f"""
    WITH {inputs.LOG_INDEX},
    all_logs AS (SELECT DISTINCT app_id, log_id FROM log_index),
    parsed AS (SELECT DISTINCT app_id, log_id FROM log_index WHERE entry_type = 'success')
    SELECT app_id, log_id FROM all_logs
    WHERE (app_id, log_id) NOT IN (SELECT app_id, log_id FROM parsed)
      AND app_id NOT IN (SELECT 'sweep-app' || n_nationkey::VARCHAR FROM nation WHERE n_regionkey = 1)
    """,
)
def unparsed_logs(t):
    index = logs.log_index(inputs.log_paths(t))
    all_logs = index.select("app_id", "log_id").distinct()
    parsed = index.filter(F.col("entry_type") == "success").select(
        "app_id", scalars.normalize_name(F.col("log_id")).alias("log_id")
    ).distinct()
    banned = t.nation.filter(F.col("n_regionkey") == 1).select(
        F.concat(F.lit("sweep-app"), "n_nationkey").alias("app_id")
    )
    return gates.unparsed_logs(all_logs, parsed, banned)
