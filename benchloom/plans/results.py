"""Queries: benchmark parsers, result frames, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import errors, scalars
from ..operators import gates, prep
from ..operators import results as ops
from ..operators.ranks import with_rank
from . import inputs
from .registry import query, r6

RUN = ["run_id"]


# ---- parsers --------------------------------------------------------------------------

_WORDS = "string_split_regex(trim(line), '\\s+')"


def _last(test, value):
    return f"arg_max({value}, line_no) FILTER ({test})"


@query(
    "parse_kv_bench",
    f"""
    WITH {inputs.bench_lines_sql('kv')}, w AS (SELECT *, {_WORDS} AS w FROM bench_lines)
    SELECT run_id, {_last("w[1] = 'read'", 'w[2]')} AS avg_lat_read, {_last("w[1] = 'read'", 'w[3]')} AS std_lat_read,
           {_last("w[1] = 'read'", 'w[4]')} AS min_lat_read, {_last("w[1] = 'read'", 'w[9]')} AS "99th_lat_read",
           {_last("starts_with(w[1], 'Total')", 'w[4]')} AS qps,
           {_last("starts_with(w[1], 'RX')", 'w[-2]')} AS rx_goodput,
           {_last("starts_with(w[1], 'TX')", 'w[-2]')} AS tx_goodput
    FROM w GROUP BY run_id
    """,
)
def parse_kv_bench(t):
    return ops.parse_kv_bench(inputs.bench_lines(t, "kv"), RUN)


def _ms(text):
    return f"""CASE WHEN contains({text}, 'us') THEN TRY_CAST(replace({text}, 'us', '') AS DOUBLE) / 1000
        WHEN contains({text}, 'ms') THEN TRY_CAST(replace({text}, 'ms', '') AS DOUBLE)
        WHEN contains({text}, 's') THEN TRY_CAST(replace({text}, 's', '') AS DOUBLE) * 1000 ELSE TRY_CAST({text} AS DOUBLE) END"""


def _mb(text):
    return f"""CASE WHEN contains({text}, 'MB') THEN TRY_CAST(replace({text}, 'MB', '') AS DOUBLE)
        WHEN contains({text}, 'KB') THEN TRY_CAST(replace({text}, 'KB', '') AS DOUBLE) / 1024
        WHEN contains({text}, 'GB') THEN TRY_CAST(replace({text}, 'GB', '') AS DOUBLE) * 1024 END"""


def _round(expression, name):
    return f"round({expression}, 6) AS {name}"


@query(
    "parse_http_bench",
    f"""
    WITH {inputs.bench_lines_sql('http')},
    w AS (SELECT *, {_WORDS} AS w, last_value(CASE WHEN contains(line, '#[Mean') THEN 'stat'
                   WHEN contains(line, 'HdrHistogram') THEN 'cdf' END IGNORE NULLS)
                 OVER (PARTITION BY run_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
          FROM bench_lines)
    SELECT run_id,
           {_round(_last("section = 'cdf' AND contains(line, '50.000%')", _ms('w[-1]')), 'lat_50pc')},
           {_round(_last("section = 'cdf' AND contains(line, '75.000%')", _ms('w[-1]')), 'lat_75pc')},
           {_round(_last("section = 'cdf' AND contains(line, '99.000%')", _ms('w[-1]')), 'lat_99pc')},
           {_round(_last("section = 'stat' AND contains(line, 'Requests/sec')", 'TRY_CAST(w[-1] AS DOUBLE)'), 'rps')},
           {_round(_last("section = 'stat' AND contains(line, 'Transfer/sec')", _mb('w[-1]')), 'throughput')},
           {_round(_last("contains(line, '#[Mean')", _ms("rtrim(w[3], ',')")), 'lat_mean')},
           {_round(_last("contains(line, '#[Mean')", _ms("rtrim(w[6], ']')")), 'lat_std')}
    FROM w GROUP BY run_id
    """,
)
def parse_http_bench(t):
    out = ops.parse_http_bench(inputs.bench_lines(t, "http"), RUN)
    return out.select("run_id", *[r6(c).alias(c) for c in out.columns if c != "run_id"])


@query(
    "parse_ingest_bench",
    f"""
    WITH {inputs.bench_lines_sql('ingest')},
    s AS (SELECT run_id, split_part(line, ' ', 3)::DOUBLE AS v FROM bench_lines WHERE contains(line, 'Total time:')),
    r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY v) AS r, count(*) OVER (PARTITION BY run_id) AS n FROM s),
    a AS (SELECT run_id, max(v) AS mx, avg(v) AS me, min(v) AS mi,
                 max(CASE WHEN r = round_even((n - 1) * 0.50, 0) + 1 THEN v END) AS p50,
                 max(CASE WHEN r = round_even((n - 1) * 0.75, 0) + 1 THEN v END) AS p75,
                 max(CASE WHEN r = round_even((n - 1) * 0.95, 0) + 1 THEN v END) AS p95,
                 max(CASE WHEN r = round_even((n - 1) * 0.99, 0) + 1 THEN v END) AS p99 FROM r GROUP BY run_id)
    SELECT run_id, coalesce(mx, -1) AS query_latency_max, round(coalesce(me, -1), 6) AS query_latency_mean,
           coalesce(mi, -1) AS query_latency_min, coalesce(p50, -1) AS query_latency_50pc,
           coalesce(p75, -1) AS query_latency_75pc, coalesce(p95, -1) AS query_latency_95pc,
           coalesce(p99, -1) AS query_latency_99pc
    FROM (SELECT DISTINCT run_id FROM bench_lines) LEFT JOIN a USING (run_id)
    """,
)
def parse_ingest_bench(t):
    out = ops.parse_ingest_bench(inputs.bench_lines(t, "ingest"), RUN)
    return out.withColumn("query_latency_mean", r6("query_latency_mean"))


@query(
    "parse_ping",
    """
    SELECT l_suppkey AS src, l_partkey AS dst,
           round(coalesce(arg_min(l_tax * 1000, l_orderkey * 10 + l_linenumber) FILTER (l_linenumber > 4), -1), 6) AS lat_min_us
    FROM lineitem GROUP BY ALL
    """,
)
def parse_ping(t):
    text = F.expr(
        """if(l_linenumber > 4, concat('rtt min/avg/max/mdev = ', l_tax, '/', l_tax + 1, '/9.0/0.1 ms'),
              concat('64 bytes from host: icmp_seq=1 time=', l_tax, ' ms'))"""
    )
    lines = t.lineitem.select(
        F.col("l_suppkey").alias("src"),
        F.col("l_partkey").alias("dst"),
        F.expr("l_orderkey * 10 + l_linenumber").alias("line_no"),
        F.explode(F.array(text)).alias("line"),
    )
    out = ops.parse_ping(lines, ["src", "dst"])
    return out.withColumn("lat_min_us", r6("lat_min_us"))


@query("parse_bench_json", "SELECT o_orderkey AS run_id, o_totalprice AS real_jct FROM orders")
def parse_bench_json(t):
    json = F.expr("""concat('{"results":[{"executionTime":', o_totalprice, '},{"executionTime":1}]}')""")
    return ops.parse_bench_json(t.orders.select(F.col("o_orderkey").alias("run_id"), json.alias("json")))


@query(
    "mesh_rows",
    f"""
    WITH {inputs.LINKS}
    SELECT l.run_id, src, dst, round(lat, 6) AS lat, n_name AS app_name
    FROM links l JOIN nation ON n_nationkey = l.run_id
    """,
)
def mesh_rows(t):
    configs = t.nation.select(F.col("n_nationkey").alias("run_id"), F.col("n_name").alias("app_name"))
    return ops.mesh_rows(inputs.links(t).withColumn("lat", r6("lat")), configs, RUN)


# ---- joins, sets and frames -----------------------------------------------------------


@query(
    "join_instance_features",
    """
    SELECT l_orderkey AS run_id, l_partkey AS API_Name, p_size AS vCPUs, p_retailprice AS cost,
           CASE WHEN l_linenumber - 3 < 0 THEN p_size ELSE l_linenumber - 3 END AS serverThread
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
    """,
)
def join_instance_features(t):
    runs = t.lineitem.select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_partkey").alias("API_Name"),
        F.expr("l_linenumber - 3").alias("serverThread"),
    )
    catalogue = t.part.select(
        F.col("p_partkey").alias("API_Name"), F.col("p_size").alias("vCPUs"),
        F.col("p_retailprice").alias("cost"),
    )
    return ops.join_instances(runs, catalogue, "API_Name", "serverThread")


@query(
    "ip_map_join",
    f"""
    WITH {inputs.LINKS}
    SELECT run_id, src, 's-' || s_name AS dst, s_suppkey IS NOT NULL AS known, round(lat, 6) AS lat
    FROM links LEFT JOIN supplier ON s_suppkey = dst
    """,
)
def ip_map_join(t):
    addresses = t.supplier.select(
        F.col("s_suppkey").alias("external"), F.concat(F.lit("s-"), "s_name").alias("internal")
    )
    out = ops.remap_destinations(inputs.links(t), addresses)
    return out.select("run_id", "src", "dst", "known", r6("lat").alias("lat"))


@query(
    "pairwise_pairs",
    f"""
    WITH {inputs.LINKS}
    SELECT run_id, least(src, dst) AS node_a, greatest(src, dst) AS node_b, count(*) AS samples
    FROM links WHERE src <> dst GROUP BY ALL
    """,
)
def pairwise_pairs(t):
    return ops.measured_pairs(inputs.links(t), RUN)


@query(
    "bipartite_zip",
    """
    WITH s AS (SELECT s_nationkey AS run_id, s_suppkey AS server,
                      row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS position FROM supplier),
         c AS (SELECT c_nationkey AS run_id, c_custkey AS client,
                      row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS position FROM customer)
    SELECT run_id, position, server, client FROM s JOIN c USING (run_id, position)
    """,
)
def bipartite_zip(t):
    servers = t.supplier.select(F.col("s_nationkey").alias("run_id"), F.col("s_suppkey").alias("server"))
    clients = t.customer.select(F.col("c_nationkey").alias("run_id"), F.col("c_custkey").alias("client"))
    out = ops.bipartite_zip(servers, clients, RUN, ["server"], ["client"])
    return out.select("run_id", "position", "server", "client")


@query(
    "client_rollup",
    """
    SELECT l_orderkey AS run_id, round(sum(l_quantity), 6) AS rps, round(sum(l_extendedprice), 4) AS throughput,
           round(avg(l_discount), 6) AS lat_mean, round(avg(l_tax), 6) AS lat_99pc
    FROM lineitem GROUP BY l_orderkey
    """,
)
def client_rollup(t):
    clients = t.lineitem.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_quantity").alias("rps"),
        F.col("l_extendedprice").alias("throughput"), F.col("l_discount").alias("lat_mean"),
        F.col("l_tax").alias("lat_99pc"),
    )
    out = ops.client_rollup(clients, RUN)
    return out.select("run_id", r6("rps").alias("rps"), r6("throughput", 4).alias("throughput"),
                      r6("lat_mean").alias("lat_mean"), r6("lat_99pc").alias("lat_99pc"))


@query(
    "version_regression",
    """
    SELECT o_orderpriority AS tag, round(avg(o_totalprice), 4) AS avg_lat_read,
           round(avg(o_totalprice * 2) / 1000, 6) AS qps, round(avg(o_custkey), 6) AS avg_client_server_lat
    FROM orders GROUP BY o_orderpriority
    """,
)
def version_regression(t):
    runs = t.orders.select(
        F.col("o_orderpriority").alias("tag"), F.col("o_totalprice").alias("avg_lat_read"),
        (F.col("o_totalprice") * 2).alias("qps"), F.col("o_custkey").alias("avg_client_server_lat"),
    )
    out = ops.version_regression(runs, "tag", ["avg_lat_read", "qps", "avg_client_server_lat"])
    return out.select("tag", r6("avg_lat_read", 4).alias("avg_lat_read"), r6("qps").alias("qps"),
                      r6("avg_client_server_lat").alias("avg_client_server_lat"))


@query(
    "link_latency_mean",
    """
    SELECT o_orderkey AS run_id, o_orderpriority AS tag, round(avg(l_tax), 6) AS avg_client_server_lat
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
    """,
)
def link_latency_mean(t):
    runs = t.orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("tag"))
    links = t.lineitem.select(F.col("l_orderkey").alias("run_id"), "l_tax")
    out = ops.attach_link_latency(runs, links, RUN, "l_tax")
    return out.withColumn("avg_client_server_lat", r6("avg_client_server_lat"))


@query(
    "best_by_component",
    """
    SELECT l_linenumber AS num_component, round(max(-l_tax * l_discount) * -100, 6) AS error_percent
    FROM lineitem GROUP BY l_linenumber
    """,
)
def best_by_component(t):
    trials = t.lineitem.select(
        F.col("l_linenumber").alias("num_component"),
        (-F.col("l_tax") * F.col("l_discount")).alias("mean_accuracy"),
    )
    return ops.best_by_component(trials).withColumn("error_percent", r6("error_percent") + F.lit(0.0))


@query(
    "labels_by_x",
    """
    SELECT l_quantity, l_discount, l_extendedprice, count(*) AS copies FROM lineitem GROUP BY ALL
    """,
)
def labels_by_x(t):
    return ops.labels_by_x(t.lineitem, ["l_quantity", "l_discount"], "l_extendedprice")


@query("parsed_by_type", "SELECT p_brand AS app_id, p_type AS API_Name, count(*) AS n FROM part GROUP BY ALL")
def parsed_by_type(t):
    rows = t.part.select(F.col("p_brand").alias("app_id"), F.col("p_type").alias("API_Name"))
    return ops.parsed_by_type(rows)


@query(
    "trial_postproc",
    "SELECT o_orderkey, o_totalprice, 'dedicated' AS tenancy FROM orders",
)
def trial_postproc(t):
    frame = t.orders.select(
        "o_orderkey", "o_totalprice", F.col("o_custkey").alias("run_id"),
        F.lit("b").alias("logBucket"), F.col("o_orderstatus").alias("debug_status"), F.lit(3).alias("numRun"),
    )
    return ops.trial_postproc(frame, "dedicated")


@query(
    "to_numeric",
    """
    SELECT o_orderkey, o_totalprice AS price, substr(o_orderpriority, 1, 1)::DOUBLE AS level, o_orderstatus AS status
    FROM orders
    """,
)
def to_numeric(t):
    text = t.orders.select(
        "o_orderkey", F.col("o_totalprice").cast("string").alias("price"),
        F.substring("o_orderpriority", 1, 1).alias("level"), F.col("o_orderstatus").alias("status"),
    )
    return ops.to_numeric(text, ["price", "level", "status"])


@query(
    "valid_latency_filter",
    """
    SELECT l_suppkey AS src, l_partkey AS dst, l_quantity AS lat FROM lineitem WHERE l_returnflag <> 'N'
    """,
)
def valid_latency_filter(t):
    # One frame per line item with a good and a failed measurement, columns as arrays.
    nested = t.lineitem.select(
        F.array("l_suppkey", "l_suppkey").alias("src"),
        F.array("l_partkey", "l_partkey").alias("dst"),
        F.array(
            F.when(F.col("l_returnflag") != "N", F.col("l_quantity").cast("string")).otherwise("timeout"),
            F.lit("unreachable"),
        ).alias("lat"),
    )
    return ops.valid_latencies(ops.unnest_columns(nested))


@query(
    "good_nodes",
    f"""
    WITH {inputs.LINKS}
    SELECT 'both_low' AS reading, node FROM (
      SELECT src AS node FROM links WHERE lat <= 100 INTERSECT SELECT dst FROM links WHERE lat <= 100)
    UNION ALL
    SELECT 'never_in_tail', node FROM (
      SELECT node FROM (SELECT src AS node, lat FROM links UNION ALL SELECT dst, lat FROM links)
      GROUP BY node HAVING max(lat) <= 100)
    """,
)
def good_nodes(t):
    links = inputs.links(t)
    both = ops.good_nodes(links).withColumn("reading", F.lit("both_low"))
    never = ops.never_in_tail(links).withColumn("reading", F.lit("never_in_tail"))
    return both.unionByName(never)


@query(
    "sorted_view",
    "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_totalprice, o_orderkey",
)
def sorted_view(t):
    return t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority").orderBy(
        "o_totalprice", "o_orderkey"
    )


@query(
    "top_candidates",
    """
    WITH c AS (SELECT p_brand, p_type, avg(p_retailprice) AS mean_test_score, stddev_pop(p_retailprice) AS std_test_score
               FROM part GROUP BY ALL)
    SELECT p_brand, p_type, round(mean_test_score, 6) AS mean_test_score, round(std_test_score, 6) AS std_test_score,
           row_number() OVER (ORDER BY mean_test_score DESC, p_brand, p_type) AS rank
    FROM c QUALIFY rank <= 5
    """,
)
def top_candidates(t):
    scores = t.part.groupBy("p_brand", "p_type").agg(
        F.avg("p_retailprice").alias("mean_test_score"), F.stddev_pop("p_retailprice").alias("std_test_score")
    )
    out = ops.top_candidates(scores, ["p_brand", "p_type"], 5)
    return out.withColumns({c: r6(c) for c in ("mean_test_score", "std_test_score")})


@query(
    "row_limit",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem
    ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 200
    """,
)
def row_limit(t):
    unique = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return ops.row_limit(t.lineitem.select(*unique, "l_extendedprice"), unique, 200)


@query(
    "sample_logs",
    """
    SELECT event_id, user_id, event_type FROM events ORDER BY md5('3|' || event_id::VARCHAR), event_id LIMIT 100
    """,
)
def sample_logs(t):
    return ops.sample_rows(t.events.select("event_id", "user_id", "event_type"), ["event_id"], 100, "3")


@query(
    "random_partition",
    """
    SELECT user_id AS app_id, event_id AS log_id,
           (ntile(4) OVER (PARTITION BY user_id ORDER BY md5('5|' || user_id::VARCHAR || '|' || event_id::VARCHAR), event_id) - 1)::INT AS part
    FROM events
    """,
)
def random_partition(t):
    logs = t.events.select(F.col("user_id").alias("app_id"), F.col("event_id").alias("log_id"))
    return ops.random_partition(logs, ["app_id"], ["log_id"], 4, "5")


@query(
    "union_frames",
    """
    SELECT c_custkey AS key, c_acctbal AS value FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier
    """,
)
def union_frames(t):
    customers = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    suppliers = t.supplier.select(F.col("s_acctbal").alias("value"), F.col("s_suppkey").alias("key"))
    return customers.unionByName(suppliers)


@query(
    "invalid_jct_filter",
    """
    SELECT c_custkey AS run_id, c_acctbal - 1000 AS jct, c_acctbal - 1000 >= 0 AS valid FROM customer
    """,
)
def invalid_jct_filter(t):
    rows = t.customer.select(F.col("c_custkey").alias("run_id"), (F.col("c_acctbal") - 1000).alias("jct"))
    valid, rejected = gates.split_by_jct(rows)
    return valid.withColumn("valid", F.lit(True)).unionByName(rejected.withColumn("valid", F.lit(False)))


@query("drop_nested", "SELECT vec_id, label FROM embeddings")
def drop_nested(t):
    return gates.drop_nested(t.embeddings)


@query("drop_features", "SELECT l_orderkey, l_quantity FROM lineitem")
def drop_features(t):
    frame = t.lineitem.select("l_orderkey", "l_quantity", F.col("l_extendedprice").alias("jct"))
    return gates.drop_features(frame)


# ---- scalar functions -----------------------------------------------------------------


@query(
    "normalize_name",
    "SELECT doc_id, regexp_replace(source || '.' || lang || ':' || left(text, 40), '[.: ]', '_', 'g') AS name FROM documents",
)
def normalize_name(t):
    raw = F.expr("concat(source, '.', lang, ':', left(text, 40))")
    return t.documents.select("doc_id", scalars.normalize_name(raw).alias("name"))


@query("normalize_key", "SELECT p_partkey, replace(p_name, ' ', '_') AS key FROM part")
def normalize_key(t):
    return t.part.select("p_partkey", scalars.normalize_key(F.col("p_name")).alias("key"))


@query(
    "normalize_value",
    """
    SELECT p_partkey,
           CASE p_partkey % 6 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN p_size::VARCHAR || '.0'
                WHEN 3 THEN p_retailprice::VARCHAR WHEN 4 THEN p_size::VARCHAR ELSE p_type END AS value,
           CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN p_size WHEN 3 THEN p_retailprice
                WHEN 4 THEN p_size END::DOUBLE AS number
    FROM part
    """,
)
def normalize_value(t):
    raw = F.expr(
        """case p_partkey % 6 when 0 then 'Yes' when 1 then if(p_size > 20, 'N/A', 'unknown')
             when 2 then concat(p_size, '.0 GiB') when 3 then concat('$', p_retailprice, ' hourly')
             when 4 then concat(p_size, ' vCPUs') else concat(p_type, ' rest') end"""
    )
    return t.part.select(
        "p_partkey", scalars.normalize_value(raw).alias("value"), scalars.normalize_number(raw).alias("number")
    )


@query(
    "container_id",
    f"""
    WITH {inputs.CONTAINER_SAMPLES}
    SELECT seq, CASE WHEN container = '' THEN '' WHEN pod LIKE '%driver%' THEN 'driver_' || container
                     ELSE replace(substr(pod, 5), '-', '_') || '_' || container END AS id
    FROM container_samples
    """,
)
def container_id(t):
    samples = inputs.container_samples(t)
    return samples.select("seq", scalars.container_id(F.col("pod"), F.col("container")).alias("id"))


@query(
    "feature_parts",
    f"""
    WITH {inputs.NAMED_FEATURES}
    SELECT feature, nullif(split_part(feature, '_', 3), '') AS executor,
           array_to_string(string_split(feature, '_')[4:], '_') AS rest, count(*) AS n
    FROM named_features GROUP BY ALL
    """,
)
def feature_parts(t):
    name = F.col("feature")
    return (
        inputs.named_features(t)
        .select("feature", scalars.executor_of(name).alias("executor"), scalars.executor_feature(name).alias("rest"))
        .groupBy("feature", "executor", "rest")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "parse_duration_ms",
    """
    SELECT event_id, round(value * CASE event_type WHEN 'view' THEN 0.001 WHEN 'error' THEN 1000 ELSE 1 END, 6) AS ms
    FROM events
    """,
)
def parse_duration_ms(t):
    text = F.expr(
        "concat(value, case event_type when 'view' then 'us' when 'click' then 'ms' when 'error' then 's' else '' end)"
    )
    return t.events.select("event_id", r6(scalars.parse_duration_ms(text)).alias("ms"))


@query(
    "parse_rate_mb",
    """
    SELECT event_id, CASE event_type WHEN 'view' THEN value / 1024 WHEN 'click' THEN value
                       WHEN 'error' THEN value * 1024 END AS mb
    FROM events
    """,
)
def parse_rate_mb(t):
    text = F.expr(
        "concat(value, case event_type when 'view' then 'KB' when 'click' then 'MB' when 'error' then 'GB' else 'B' end)"
    )
    return t.events.select("event_id", scalars.parse_rate_mb(text).alias("mb"))


@query("run_path", "SELECT o_orderkey, o_orderstatus || '/' || o_orderpriority || '/' || o_orderkey::VARCHAR AS path FROM orders")
def run_path(t):
    path = scalars.run_path(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string"))
    return t.orders.select("o_orderkey", path.alias("path"))


@query("bits_to_mbit", "SELECT event_id, round(value * 1000 / (1024 * 1024), 9) AS mbit FROM events")
def bits_to_mbit(t):
    report = F.expr("""concat('{"end":{"sum_received":{"bits_per_second":', value * 1000, '}}}')""")
    return t.events.select("event_id", r6(scalars.bits_to_mbit(report), 9).alias("mbit"))


# ---- errors ---------------------------------------------------------------------------

# Predicted price: a flat rate per unit, so that labels and predictions differ.
_PREDICTED = "l_quantity * 1500.0"
_PER = "l_returnflag"


def _predicted(t):
    return t.lineitem.select(
        _PER, F.col("l_extendedprice").alias("y"), F.expr("l_quantity * 1500.0D").alias("pred")
    )


def _by_flag(t, name, measure):
    return _predicted(t).groupBy(_PER).agg(r6(measure(F.col("y"), F.col("pred"))).alias(name))


_PRED_SQL = f"WITH p AS (SELECT {_PER}, l_extendedprice AS y, {_PREDICTED}::DOUBLE AS pred FROM lineitem)"


@query(
    "metric_rrse",
    f"{_PRED_SQL} SELECT {_PER}, round(sqrt(avg((y - pred) ** 2) / var_pop(y)), 6) AS rrse FROM p GROUP BY {_PER}",
)
def metric_rrse(t):
    return _by_flag(t, "rrse", errors.rrse)


@query(
    "metric_rrmse",
    f"{_PRED_SQL} SELECT {_PER}, round(sqrt(avg((y - pred) ** 2)) / avg(y), 6) AS rrmse FROM p GROUP BY {_PER}",
)
def metric_rrmse(t):
    return _by_flag(t, "rrmse", errors.rrmse)


@query(
    "metric_rmsre",
    f"""{_PRED_SQL} SELECT {_PER}, round(sqrt(avg(((y - pred) / y) ** 2)), 6) AS rmsre,
    round(CASE WHEN avg(((y - 100000 * pred) / y) ** 2) > 100000 THEN 'inf'::DOUBLE
               ELSE sqrt(avg(((y - 100000 * pred) / y) ** 2)) END, 6) AS capped,
    round(sqrt(avg(((zy * d + m - (zp * d + m)) / (zy * d + m)) ** 2)), 6) AS scaled
    FROM (SELECT *, (y - m) / d AS zy, (pred - m) / d AS zp
          FROM p, (SELECT avg(y) AS m, stddev_pop(y) AS d FROM p)) GROUP BY {_PER}""",
)
def metric_rmsre(t):
    y, pred = F.col("y"), F.col("pred")
    rows = _predicted(t)
    # A model of scaled labels predicts scaled values: its error counts after inversion.
    scaler = prep.StandardScaler.fit(rows, ["y"])
    scaled = rows.withColumns({"zy": scaler.forward(y, "y"), "zp": scaler.forward(pred, "y")})
    return scaled.groupBy(_PER).agg(
        r6(errors.rmsre(y, pred)).alias("rmsre"),
        errors.rmsre_capped(y, pred * 100000).alias("capped"),
        r6(errors.rmsre_scaled(F.col("zy"), F.col("zp"), scaler, "y")).alias("scaled"),
    )


@query(
    "metric_relative_errors",
    f"""{_PRED_SQL} SELECT {_PER}, y, pred, round(CASE WHEN abs((y - pred) / y) > 100000 THEN 'inf'::DOUBLE
    ELSE abs((y - pred) / y) END, 6) AS error FROM p""",
)
def metric_relative_errors(t):
    return _predicted(t).withColumn("error", r6(errors.relative_error(F.col("y"), F.col("pred"))))


@query(
    "error_cdf",
    f"""{_PRED_SQL} SELECT round(e, 6) AS error, round((row_number() OVER (ORDER BY e) - 1) / count(*) OVER (), 9) AS share
    FROM (SELECT abs((y - pred) / y) AS e FROM p)""",
)
def error_cdf(t):
    error = F.abs(errors.signed_relative_error(F.col("y"), F.col("pred")))
    ranked = with_rank(_predicted(t).select(error.alias("error")), [], ["error"], "_rank", "_n")
    return ranked.select(
        r6("error").alias("error"), r6((F.col("_rank") - 1) / F.col("_n"), 9).alias("share")
    )
