"""Queries: trial configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import configs as ops
from ..operators import results
from . import inputs
from .registry import query, r6

CONFIG = ["trial", "row"]


def _cells(t):
    expanded, _ = ops.config_expand(inputs.knobs(t))
    return ops.config_explode(expanded)


@query(
    "config_expand",
    f"""
    WITH {inputs.KNOBS}
    SELECT trial, section, key, string_agg(value, ',' ORDER BY "row") AS vals FROM cells GROUP BY ALL
    UNION ALL
    SELECT trial, 'rejected', NULL, bad_knobs::VARCHAR FROM rejected
    """,
)
def config_expand(t):
    expanded, rejected = ops.config_expand(inputs.knobs(t))
    bad = rejected.select(
        "trial", F.lit("rejected").alias("section"), F.lit(None).cast("string").alias("key"),
        F.col("bad_knobs").cast("string").alias("vals"),
    )
    shown = expanded.select("trial", "section", "key", F.array_join("values", ",").alias("vals"))
    return shown.unionByName(bad)


@query("config_explode", f'WITH {inputs.KNOBS} SELECT trial, section, key, "row", value FROM cells')
def config_explode(t):
    return _cells(t).select("trial", "section", "key", "row", "value")


_ROLES = """
    roles AS (
      SELECT trial, "row",
             CASE WHEN starts_with(key, 'num') THEN lower(replace(key, 'num', '')) ELSE lower(replace(key, 'Type', '')) END AS role,
             max(CASE WHEN starts_with(key, 'num') THEN value::BIGINT END) AS n,
             max(CASE WHEN NOT starts_with(key, 'num') THEN value END) AS instance_type
      FROM cells WHERE section = 'resource' AND (starts_with(key, 'num') OR ends_with(key, 'Type'))
      GROUP BY ALL),
    available AS (SELECT DISTINCT 'type-' || n_regionkey::VARCHAR AS instance_type FROM nation WHERE n_regionkey < 3),
    errors AS (SELECT trial, "row", role, 'unknown type' AS error FROM roles
               WHERE instance_type NOT IN (SELECT instance_type FROM available))"""


def _available(t):
    return (
        t.nation.filter(F.col("n_regionkey") < 3)
        .select(F.concat(F.lit("type-"), "n_regionkey").alias("instance_type"))
        .distinct()
    )


@query(
    "config_runs",
    f"""
    WITH {inputs.KNOBS}, {_ROLES},
    demand AS (
      SELECT trial, "row", string_agg(instance_type || '=' || n::VARCHAR, ';' ORDER BY instance_type) AS demand
      FROM (SELECT trial, "row", instance_type, sum(n)::BIGINT AS n FROM roles
            WHERE (trial, "row") NOT IN (SELECT trial, "row" FROM errors) GROUP BY ALL)
      GROUP BY ALL),
    settings AS (
      SELECT trial, "row", max(CASE WHEN key = 'numRun' THEN try_cast(value AS INT) END) AS n,
             max(CASE WHEN key = 'logBucket' THEN value END) AS log_bucket,
             coalesce(max(CASE WHEN key = 'debug' THEN try_cast(value AS BOOLEAN) END), false) AS debug
      FROM cells GROUP BY ALL),
    judged AS (
      SELECT trial, "row", feature_digest, log_bucket, debug, demand, n,
             CASE WHEN coalesce(n, 0) <= 0 THEN 'numRun'
                  WHEN (trial, "row") IN (SELECT trial, "row" FROM errors) THEN 'resource' END AS problem
      FROM settings JOIN digests USING (trial, "row") LEFT JOIN demand USING (trial, "row"))
    SELECT * EXCLUDE (n, run), run, trial || '/' || "row"::VARCHAR || '/' || run::VARCHAR AS run_id
    FROM (SELECT *, unnest(CASE WHEN problem IS NULL THEN range(0, n)::INT[] ELSE [NULL::INT] END) AS run FROM judged)
    """,
)
def config_runs(t):
    runs = ops.config_runs(_cells(t), available=_available(t))
    pairs = F.transform(
        F.array_sort(F.map_entries("demand")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    )
    return runs.withColumn("demand", F.array_join(pairs, ";"))


@query(
    "instance_demand",
    f"""
    WITH {inputs.KNOBS}, {_ROLES}
    SELECT trial, "row", instance_type, sum(n)::BIGINT AS num_instance FROM roles
    WHERE (trial, "row") NOT IN (SELECT trial, "row" FROM errors)
    GROUP BY ALL
    """,
)
def instance_demand(t):
    demand, _ = ops.instance_demand(_cells(t), _available(t))
    return demand


@query(
    "config_validate",
    f"""
    WITH {inputs.KNOBS}, {_ROLES}
    SELECT trial, NULL::INT AS "row", 'missing ' || key AS problem
    FROM (SELECT DISTINCT trial FROM knobs), (VALUES ('tenancy'), ('logBucket'), ('resultBucket'), ('numRun')) r(key)
    WHERE (trial, key) NOT IN (SELECT trial, key FROM knobs)
    UNION ALL SELECT trial, "row", role || ': ' || error FROM errors
    """,
)
def config_validate(t):
    missing = ops.config_missing(inputs.knobs(t)).select(
        "trial", F.lit(None).cast("int").alias("row"), F.concat(F.lit("missing "), "key").alias("problem")
    )
    _, errors = ops.instance_demand(_cells(t), _available(t))
    wrong = errors.select("trial", "row", F.concat_ws(": ", "role", "error").alias("problem"))
    return missing.unionByName(wrong)


@query(
    "instance_groups",
    """
    SELECT o_custkey AS trial, o_orderkey AS position,
           last_value(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END IGNORE NULLS) OVER w AS image,
           last_value(CASE WHEN o_totalprice > 200000 THEN o_orderpriority END IGNORE NULLS) OVER w AS tenancy
    FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    """,
)
def instance_groups(t):
    groups = t.orders.select(
        F.col("o_custkey").alias("trial"),
        F.col("o_orderkey").alias("position"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("image"),
        F.when(F.col("o_totalprice") > 200000, F.col("o_orderpriority")).alias("tenancy"),
    )
    return ops.instance_groups(groups)


@query(
    "config_cross_sample",
    f"""
    WITH {inputs.KNOBS},
    pool AS (SELECT trial, key, vals, len(vals) AS size,
                    product(len(vals)) OVER (PARTITION BY trial ORDER BY key)::BIGINT AS upto FROM knobs),
    totals AS (SELECT trial, max(upto) AS total, list(size) AS sizes, md5('7|' || trial) AS h
               FROM pool GROUP BY trial),
    seeds AS (SELECT *, ('0x' || substr(h, 1, 15))::BIGINT % total AS a0,
                     ('0x' || substr(h, 16, 15))::BIGINT % total AS b FROM totals),
    steps AS (SELECT *, [a0 + k FOR k IN range(0, 1001)
                IF len([s FOR s IN sizes IF len([d FOR d IN range(2, s + 1)
                        IF s % d = 0 AND (a0 + k) % d = 0]) > 0]) = 0][1] AS a FROM seeds),
    chosen AS (SELECT trial, i AS sample, ((a::HUGEINT * i + b) % total)::BIGINT AS combo
               FROM (SELECT *, unnest(range(0, least(20, total))) AS i FROM steps))
    SELECT trial, combo, sample, key, vals[(combo // (upto // size)) % size + 1] AS value
    FROM chosen JOIN pool USING (trial)
    """,
)
def config_cross_sample(t):
    return ops.cross_sample(inputs.knobs(t), 20, "7")


@query(
    "config_digest",
    """
    SELECT o_orderkey, md5('o_custkey=' || coalesce(o_custkey::VARCHAR, 'None') || ';o_orderpriority='
      || coalesce(o_orderpriority, 'None') || ';o_orderstatus=' || coalesce(o_orderstatus, 'None')) AS feature_digest
    FROM orders
    """,
)
def config_digest(t):
    names = ["o_orderstatus", "o_custkey", "o_orderpriority"]
    return t.orders.select("o_orderkey", results.scalars.config_digest(names).alias("feature_digest"))


@query(
    "app_config_project",
    """
    SELECT l_orderkey AS run_id, l_linenumber AS part_no, l_linenumber AS num_executor,
           floor(l_quantity)::INT AS batch_size,
           CASE WHEN l_returnflag <> 'N' THEN (l_linenumber * 1024)::INT END AS driver_memory,
           CASE WHEN l_linestatus = 'F' THEN l_tax END AS rate,
           CASE WHEN l_linestatus = 'F' THEN l_discount END AS delay,
           CASE WHEN l_linestatus = 'F' THEN 0.5::DOUBLE END AS loss,
           'type-' || (l_suppkey % 7)::VARCHAR AS instance_type, l_linenumber + 1 AS num_instance
    FROM lineitem
    """,
)
def app_config_project(t):
    json = F.expr(
        """concat('{"app":{"num_executor":', l_linenumber, ',"batch_size":', cast(l_quantity as int),
             if(l_returnflag <> 'N', concat(',"driver_memory":"', l_linenumber * 1024, 'm"'), ''),
             if(l_linestatus = 'F', concat(',"exp_configs":{"rate":', l_tax, ',"delay":', l_discount,
                ',"loss":0.5}'), ''),
             '},"resource":{"type-', l_suppkey % 7, '":', l_linenumber + 1, ',"other":9}}')"""
    )
    docs = t.lineitem.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("part_no"), json.alias("json")
    )
    return results.app_config(docs)


@query(
    "row_merge_flatten",
    """
    SELECT o_orderkey AS run_id, o_custkey AS num_executor, o_totalprice AS dataset_size,
           o_orderpriority AS API_Name, round(sum(l_quantity), 4) AS qty, count(*) AS n,
           max(l_linenumber)::BIGINT AS jct
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL
    """,
)
def row_merge_flatten(t):
    run_inputs = t.orders.select(
        F.col("o_orderkey").alias("run_id"),
        F.struct(F.col("o_custkey").alias("num_executor")).alias("app"),
        F.struct(F.col("o_totalprice").alias("dataset_size")).alias("bench"),
        F.struct(F.col("o_orderpriority").alias("API_Name")).alias("resource"),
    )
    outputs = t.lineitem.groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.struct(r6(F.sum("l_quantity"), 4).alias("qty"), F.count(F.lit(1)).alias("n")).alias("output"),
        F.max("l_linenumber").cast("bigint").alias("jct"),
    )
    return results.merge_run(run_inputs, outputs, ["run_id"])
