"""Run-shaped views of the benchmark tables, each with the SQL that derives the same rows.

``events`` stands for metric samples: ten users form one run, ``event_id`` is
the arrival order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables

# ---- container and node samples -------------------------------------------------------


def container_samples(t: Tables) -> DataFrame:
    return t.events.select(
        F.expr("user_id div 10").alias("run_id"),
        F.expr("if(user_id % 10 = 0, 'app-driver', concat('app-exec-', user_id % 10))").alias("pod"),
        F.expr("if(event_type = 'signup', '', 'executor')").alias("container"),
        F.expr(
            """case event_type
                 when 'purchase' then 'container_cpu_usage_seconds_total'
                 when 'view' then 'container_memory_usage_bytes'
                 when 'click' then 'container_network_receive_bytes'
                 when 'error' then 'container_last_seen'
                 else 'container_fs_reads_total' end"""
        ).alias("name"),
        F.expr("concat('node-', (user_id + event_id % 2) % 10)").alias("node"),
        F.col("event_id").alias("seq"),
        "ts",
        "value",
    )


def container_series(t: Tables) -> DataFrame:
    """The same samples with the labels that tell the series of a metric apart."""
    return container_samples(t).withColumn("series", F.expr("concat('cpu=', seq % 3)"))


CONTAINER_SAMPLES = """
container_samples AS (
  SELECT user_id // 10 AS run_id,
         CASE WHEN user_id % 10 = 0 THEN 'app-driver'
              ELSE 'app-exec-' || (user_id % 10)::VARCHAR END AS pod,
         CASE WHEN event_type = 'signup' THEN '' ELSE 'executor' END AS container,
         CASE event_type
           WHEN 'purchase' THEN 'container_cpu_usage_seconds_total'
           WHEN 'view' THEN 'container_memory_usage_bytes'
           WHEN 'click' THEN 'container_network_receive_bytes'
           WHEN 'error' THEN 'container_last_seen'
           ELSE 'container_fs_reads_total' END AS name,
         'node-' || ((user_id + event_id % 2) % 10)::VARCHAR AS node,
         event_id AS seq, 'cpu=' || (event_id % 3)::VARCHAR AS series, ts, value
  FROM events)"""

CONTAINER_IDS = (
    CONTAINER_SAMPLES
    + """,
usable AS (
  SELECT *, CASE WHEN pod LIKE '%driver%' THEN 'driver'
                 ELSE array_to_string(list_slice(string_split(pod, '-'), -2, -1), '_') END
            || '_' || container AS id
  FROM container_samples
  WHERE container <> '' AND name NOT IN ('container_tasks_state', 'container_start_time_seconds',
                                         'container_scrape_error', 'container_last_seen'))"""
)

# Summary of ``value`` grouped by whatever precedes it.
SUMMARY_SQL = """max(value) AS max, avg(value) AS mean, min(value) AS min,
         quantile_cont(value, 0.05) AS "5_pc", quantile_cont(value, 0.25) AS "25_pc",
         quantile_cont(value, 0.50) AS "50_pc", quantile_cont(value, 0.75) AS "75_pc",
         quantile_cont(value, 0.95) AS "95_pc\""""
SUMMARY_CELLS = """unnest(['max', 'mean', 'min', '5_pc', '25_pc', '50_pc', '75_pc', '95_pc']) AS stat,
         unnest([max, mean, min, "5_pc", "25_pc", "50_pc", "75_pc", "95_pc"]) AS value"""

CONTAINER_FEATURES = (
    CONTAINER_IDS
    + f""",
series_stats AS (
  SELECT run_id, id, name, series, min(seq) AS started, arg_max(value, seq) AS last_value, {SUMMARY_SQL}
  FROM usable GROUP BY run_id, id, name, series),
last_series AS (
  SELECT * FROM series_stats
  QUALIFY row_number() OVER (PARTITION BY run_id, id, name ORDER BY started DESC) = 1),
container_features AS (
  SELECT run_id, 'cf_' || id || '_' || name AS feature, last_value AS value
  FROM last_series WHERE name LIKE '%total%'
  UNION ALL
  SELECT run_id, 'cf_' || id || '_' || name || '_' || stat, value FROM (
    SELECT run_id, id, name, {SUMMARY_CELLS} FROM last_series WHERE name NOT LIKE '%total%'))"""
)


def node_samples(t: Tables) -> DataFrame:
    return t.events.select(
        F.expr("user_id div 10").alias("run_id"),
        F.expr("concat('10.0.', user_id % 10, '.1:9100')").alias("instance"),
        F.concat(F.lit("node_"), "event_type").alias("name"),
        F.col("event_id").alias("seq"),
        "value",
    )


def node_series(t: Tables) -> DataFrame:
    """The same samples with the labels that tell the series of a metric apart."""
    return node_samples(t).withColumn("series", F.expr("concat('cpu=', seq % 3)"))


def node_info(t: Tables) -> DataFrame:
    return (
        t.events.select("user_id")
        .distinct()
        .select(
            F.expr("user_id div 10").alias("run_id"),
            F.expr("concat('10.0.', user_id % 10, '.1')").alias("ip"),
            F.expr("concat('node-', user_id % 10)").alias("name"),
            F.expr("if(user_id % 10 = 9, 'master', 'node')").alias("role"),
        )
    )


NODE_SAMPLES = """
node_samples AS (
  SELECT user_id // 10 AS run_id, '10.0.' || (user_id % 10)::VARCHAR || '.1:9100' AS instance,
         'node_' || event_type AS name, event_id AS seq,
         'cpu=' || (event_id % 3)::VARCHAR AS series, value
  FROM events),
node_info AS (
  SELECT DISTINCT user_id // 10 AS run_id, '10.0.' || (user_id % 10)::VARCHAR || '.1' AS ip,
         'node-' || (user_id % 10)::VARCHAR AS name,
         CASE WHEN user_id % 10 = 9 THEN 'master' ELSE 'node' END AS role
  FROM events)"""

POD_NODES = """
pod_nodes AS (
  SELECT run_id, pod, arg_max(node, seq) AS node FROM container_samples GROUP BY run_id, pod)"""

NODE_ROLES = (
    CONTAINER_SAMPLES
    + ","
    + POD_NODES
    + ","
    + NODE_SAMPLES
    + """,
node_use AS (
  SELECT run_id, node, CASE WHEN bool_or(pod LIKE '%driver%') THEN 'driver' ELSE 'exec' END AS use
  FROM pod_nodes GROUP BY run_id, node),
node_roles AS (
  SELECT s.run_id, s.instance, s.name, s.seq, s.series, s.value, i.name AS node_name, i.role, u.use
  FROM node_samples s
  JOIN node_info i ON i.run_id = s.run_id AND i.ip = split_part(s.instance, ':', 1)
  LEFT JOIN node_use u ON u.run_id = s.run_id AND u.node = i.name)"""
)

# ---- stages ---------------------------------------------------------------------------


def stages(t: Tables) -> DataFrame:
    """One stage per line item; the order is the run."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("run_id"),
        F.expr("l_partkey * 1000 + l_suppkey * 10 + l_linenumber").alias("stage_id"),
        F.expr("cast(datediff(l_shipdate, date'1970-01-01') as bigint)").alias("completed"),
        F.expr("cast(datediff(l_shipdate, date'1970-01-01') - l_quantity as bigint)").alias(
            "submitted"
        ),
        F.expr(
            """array(
                 named_struct('ID', 1L, 'Name', 'internal.metrics.runTime',
                              'Value', cast(l_extendedprice as string)),
                 named_struct('ID', 2L, 'Name', concat('internal.metrics.', l_returnflag),
                              'Value', cast(l_quantity as string)),
                 named_struct('ID', 3L, 'Name', 'internal.metrics.status',
                              'Value', l_linestatus))"""
        ).alias("accumulables"),
    )


# ---- tall feature rows ----------------------------------------------------------------


def app_features(t: Tables) -> DataFrame:
    """(app_id, run_id, feature, value): user, five-day bucket, event type."""
    return t.events.groupBy(
        F.concat(F.lit("app-"), F.col("user_id")).alias("app_id"),
        F.expr("concat('run-', (day(ts) - 1) div 5)").alias("run_id"),
        F.col("event_type").alias("feature"),
    ).agg(F.max("value").alias("value"))


APP_FEATURES = """
app_features AS (
  SELECT 'app-' || user_id::VARCHAR AS app_id, 'run-' || ((day(ts) - 1) // 5)::VARCHAR AS run_id,
         event_type AS feature, max(value) AS value
  FROM events GROUP BY ALL)"""

# Names that exercise every feature mode.
FEATURE_NAMES = (
    "jct",
    "full_jct",
    "API_Name",
    "Arch",
    "num_executor",
    "dataset_size",
    "GPUs",
    "batch_size",
    "cf_driver_mem_usage_max",
    "cf_exec_executor_container_cpu_usage_seconds_total",
    "cf_exec_net_rx_total",
    "gcf_driver_full_gc_count",
    "gcf_driver_minor_gc_count",
    "internal_metrics_jvmGCTime",
    "internal_metrics_resultSize",
    "nf_exec_node_memory_MemAvailable_max",
    "nf_exec_node_memory_MemFree_mean",
    "nf_exec_node_filesystem_avail_bytes_min",
    "nf_driver_node_disk_reads_total",
    "nf_driver_node_load1",
    "rate",
)
_NAME_LIST = ", ".join(f"'{n}'" for n in FEATURE_NAMES)


def named_features(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("run_id"),
        F.expr(f"element_at(array({_NAME_LIST}), cast(event_id % {len(FEATURE_NAMES)} as int) + 1)").alias(
            "feature"
        ),
        "value",
    )


NAMED_FEATURES = f"""
named_features AS (
  SELECT user_id AS run_id, ([{_NAME_LIST}])[event_id % {len(FEATURE_NAMES)} + 1] AS feature, value
  FROM events)"""

# ---- driver and collection log lines --------------------------------------------------
#
# One line per event, the user is the run.  The event type picks the kind of line, the
# event's value and property fill in the numbers.

_CLOCK = {"spark": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
          "duck": "strftime(ts, '%Y-%m-%d %H:%M:%S')"}


def _line_sql(engine: str) -> str:
    text = (lambda x: f"cast({x} as string)") if engine == "spark" else (lambda x: f"({x})::VARCHAR")
    cents = "cast(floor(value * 100) as bigint)"
    k = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"
    clock = _CLOCK[engine]
    seconds = "((day(ts) - 1) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts))"
    stamp = (
        f"concat(replace({clock}, ' ', 'T'), '.000+0000: ', {text(seconds)}, '.', "
        f"lpad({text('event_id % 1000')}, 3, '0'), ': ')"
    )
    start = f"concat('AdaptiveSizeStart: 1.1 collection: ', {text('event_id')})"
    k3 = f"lpad({text(k)}, 3, '0')"
    return f"""
      CASE event_type
        WHEN 'view' THEN concat({stamp},
          CASE WHEN {k} % 2 = 0 THEN '[GC (Allocation Failure) ' ELSE '[GC (Metadata GC Threshold) ' END,
          {start})
        WHEN 'error' THEN concat({stamp}, '[Full GC (Ergonomics) ', {start})
        WHEN 'click' THEN concat('[PSYoungGen: ', {text(f'{cents} + 2000')}, 'K->', {text(k)}, 'K(',
          {text(f'{cents} + 9000')}, 'K)] ', {text(f'{cents} + 5000')}, 'K->', {text(f'{k} + 2500')}, 'K(',
          {text(f'{cents} + 20000')}, 'K), 0.', {k3}, '0000 secs] [Times: user=0.', {k3},
          ' sys=0.01, real=0.02 secs]')
        WHEN 'signup' THEN CASE {k} % 7
          WHEN 0 THEN concat('PSAdaptiveSizePolicy::compute_eden_space_size limits avg_young_live: ', {text(cents)})
          WHEN 1 THEN concat('PSAdaptiveSizePolicy::compute_eden_space_size: live_space: ', {text(cents)},
            ' free_space: ', {text(k)}, ' minor_time: 0.', {k3}, ' major_cost: 0.5 mutator_cost: 0.25')
          WHEN 2 THEN concat('PSAdaptiveSizePolicy::compute_old_gen_free_space limits avg_old_live: ', {text(cents)})
          WHEN 3 THEN concat('PSAdaptiveSizePolicy::compute_old_gen_free_space: live_space: ', {text(cents)},
            ' free_space: ', {text(k)}, ' ')
          WHEN 4 THEN concat('new policy tenuring_thresh: ', {text(k)}, ' avg_survived_padded_avg: 1.5',
            ' avg_promoted_padded_avg: 2.5 avg_pretenured_padded_avg: 0.', {k3})
          WHEN 5 THEN concat('AdaptiveSizeStart: 2.2 collection: ', {text(k)}, ' ')
          ELSE concat('AdaptiveSizePolicy::update_averages: survived: ', {text(cents)}, ' promoted: ', {text(k)},
            ' overflow: false') END
        ELSE concat({clock}, CASE {k} % 7
          WHEN 0 THEN ' INFO SparkContext: Running Spark version 3'
          WHEN 1 THEN ' INFO DAGScheduler: Got job 0 with 8 output partitions'
          WHEN 2 THEN ' INFO SparkContext: Successfully stopped SparkContext'
          WHEN 3 THEN ' INFO TaskSetManager: Starting task 0.0 in stage 0.0'
          WHEN 4 THEN ' INFO TaskSetManager: Starting task 1.0 in stage 1.0'
          WHEN 5 THEN ' INFO TaskSetManager: Finished task 0.0 in stage 0.0'
          ELSE ' INFO BlockManagerInfo: Added rdd_0_1 in memory' END)
      END"""


def driver_lines(t: Tables) -> DataFrame:
    """One log line per event; the user is the run."""
    return t.events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("line_no"),
        F.expr(_line_sql("spark")).alias("line"),
    )


GC_STATE = f"""
lines AS (SELECT user_id AS run_id, event_id AS line_no, {_line_sql("duck")} AS line FROM events),
marked AS (
  SELECT *, CASE WHEN opens IS NOT NULL THEN 'enter' WHEN contains(line, '[PSYoungGen') THEN 'exit' END AS marker
  FROM (SELECT *, CASE WHEN contains(line, '[GC (Allocation') OR contains(line, '[GC (Metadata') THEN 'minor'
                       WHEN contains(line, '[Full GC') THEN 'full' END AS opens FROM lines)),
state AS (
  SELECT *,
         sum(CASE WHEN opens IS NULL THEN 0 ELSE 1 END) OVER w AS collection,
         last_value(marker IGNORE NULLS) OVER w AS state,
         last_value(opens IGNORE NULLS) OVER w AS gc_type,
         coalesce(last_value(CASE WHEN opens IS NOT NULL
           THEN rtrim(split_part(line, ' ', 2), ':')::DOUBLE END IGNORE NULLS) OVER w, 0) AS gc_time,
         last_value(CASE WHEN opens IS NOT NULL
           THEN strptime(split_part(line, '.', 1), '%Y-%m-%dT%H:%M:%S') END IGNORE NULLS) OVER w AS gc_clock
  FROM marked
  WINDOW w AS (PARTITION BY run_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

_YOUNG = "regexp_extract(line, 'PSYoungGen: ([0-9]+)K->([0-9]+)K.([0-9]+)K', {})::DOUBLE / 1000"
_WHOLE = "regexp_extract(line, '] ([0-9]+)K->([0-9]+)K.([0-9]+)K.,', {})::DOUBLE / 1000"


def gc_events_sql(where: str = "true", t: str = "gc_time") -> str:
    return (
        GC_STATE
        + f""",
sized AS (
  SELECT run_id, line_no, collection, gc_type, gc_time, {t} AS t,
         regexp_extract(line, '([0-9.]+) secs. .Times:', 1)::DOUBLE AS pause,
         regexp_extract(line, 'user=([0-9.]+)', 1)::DOUBLE AS user_s,
         regexp_extract(line, 'sys=([0-9.]+),', 1)::DOUBLE AS sys_s,
         regexp_extract(line, 'real=([0-9.]+)', 1)::DOUBLE AS real_s,
         {_YOUNG.format(1)} AS young_before, {_YOUNG.format(2)} AS young_after, {_YOUNG.format(3)} AS young_size,
         {_WHOLE.format(1)} AS whole_before, {_WHOLE.format(2)} AS whole_after, {_WHOLE.format(3)} AS total_size
  FROM state WHERE marker = 'exit' AND {where}),
linked AS (
  SELECT *, whole_before - young_before AS old_before, whole_after - young_after AS old_after,
         total_size - young_size AS old_size,
         young_before - coalesce(lag(young_after) OVER w, 0) AS allocation,
         CASE WHEN gc_type = 'minor'
              THEN (young_before - young_after) - (whole_before - whole_after) END AS promotion,
         gc_time - coalesce(lag(gc_time) OVER w, 0) AS elapsed
  FROM sized WINDOW w AS (PARTITION BY run_id ORDER BY line_no)),
gc_events AS (
  SELECT *, old_size - old_before AS old_free_before, old_size - old_after AS old_free_after,
         allocation / nullif(elapsed, 0) AS allocation_rate, promotion / nullif(elapsed, 0) AS promotion_rate
  FROM linked)"""
    )

# ---- log paths, series JSON, event logs, catalogue, registry --------------------------

_TAILS = (
    "output/eventlogs/part",
    "output/container/part",
    "output/node/part",
    "output/bench/part",
    "output/driver/part",
    "output/other/x",
    "input/app_configs.json",
    "input/bench_configs.yaml",
    "input/readme",
    "info/nodes.json",
    "_SUCCESS",
    "misc/file",
)
_TAIL_LIST = ", ".join(f"'{x}'" for x in _TAILS)


def log_paths(t: Tables) -> DataFrame:
    return t.documents.select(
        F.expr(
            f"""concat('sweep-app', (doc_id div 24) % 25, '-', doc_id div 24, '/',
                       element_at(array({_TAIL_LIST}), cast(n_chars % 12 as int) + 1))"""
        ).alias("path")
    )


LOG_INDEX = f"""
log_paths AS (
  SELECT 'sweep-app' || ((doc_id // 24) % 25)::VARCHAR || '-' || (doc_id // 24)::VARCHAR || '/'
         || ([{_TAIL_LIST}])[n_chars % 12 + 1] AS path FROM documents),
split_paths AS (
  SELECT path, string_split(path, '/') AS s, string_split(path, '/')[1] AS log_id,
         string_split(path, '/')[-1] AS tail FROM log_paths),
typed AS (
  SELECT *, CASE WHEN list_contains(s, 'output') THEN 'output' WHEN list_contains(s, 'input') THEN 'input'
                 WHEN list_contains(s, 'info') THEN 'info' WHEN s[2] = '_SUCCESS' THEN 'success' END AS entry_type
  FROM split_paths),
log_index AS (
  SELECT * FROM (
    SELECT array_to_string(string_split(log_id, '-')[1:2], '-') AS app_id, log_id, entry_type, path,
           CASE WHEN entry_type = 'output' THEN
                  CASE WHEN list_contains(s, 'eventlogs') THEN 'eventlogs'
                       WHEN list_contains(s, 'container') THEN 'container'
                       WHEN list_contains(s, 'node') THEN 'node'
                       WHEN list_contains(s, 'bench') THEN 'bench'
                       WHEN list_contains(s, 'driver') THEN 'driver' END
                WHEN entry_type = 'input' THEN
                  CASE WHEN contains(tail, 'bench_configs') THEN 'bench_configs'
                       WHEN contains(tail, 'configs') THEN 'app_configs' ELSE tail END
                ELSE tail END AS name
    FROM typed) WHERE entry_type IS NOT NULL AND name IS NOT NULL)"""


def series_json(t: Tables) -> DataFrame:
    """One two-sample series per event, as range-query JSON; sign-ups lack a label."""
    label = "if(event_type = 'signup', '', concat('\"k\":\"', regexp_extract(props, '([0-9]+)', 1), '\",'))"
    return t.events.select(
        F.expr(
            f"""concat('{{"metric":{{"__name__":"', event_type, '",', {label}, '"user":"', user_id,
                       '"}},"values":[[', cast(1700000000.5D + event_id as decimal(20,1)), ',"', value,
                       '"],[', cast(1700000001.5D + event_id as decimal(20,1)), ',"', value + 1, '"]]}}')"""
        ).alias("json")
    )


def event_log_json(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.expr(
            """concat('{"Event":"', if(l_returnflag = 'N', 'SparkListenerTaskEnd', 'SparkListenerStageCompleted'),
                 '","run_id":', l_orderkey, ',"Stage Info":{"Stage ID":',
                 l_partkey * 1000 + l_suppkey * 10 + l_linenumber,
                 ',"Submission Time":', cast(l_quantity as bigint),
                 ',"Completion Time":', cast(l_quantity as bigint) + l_linenumber,
                 ',"Accumulables":[{"ID":1,"Name":"rows","Value":"', l_extendedprice, '"}]}}')"""
        ).alias("value")
    )


_FAMILIES = ("m1", "m3", "m4", "m5", "m5a", "m5d", "t2", "c1", "c5", "c5d", "c5n", "z1d", "r3", "r5",
             "r5a", "r5d", "i3", "x1", "p3", "h1")
_SCALES = ("nano", "micro", "small", "medium", "large", "xlarge", "2xlarge", "4xlarge", "8xlarge",
           "metal")
_FAMILY_LIST = ", ".join(f"'{x}'" for x in _FAMILIES)
_SCALE_LIST = ", ".join(f"'{x}'" for x in _SCALES)


def instance_names(t: Tables) -> DataFrame:
    """Instance types offered by the parts; some are supported by the cluster manager."""
    return t.part.select(
        F.col("p_partkey").alias("part_id"),
        F.expr(
            f"""concat(element_at(array({_FAMILY_LIST}), cast(p_partkey % {len(_FAMILIES)} as int) + 1), '.',
                       element_at(array({_SCALE_LIST}), p_size % {len(_SCALES)} + 1))"""
        ).alias("api_name"),
        F.expr("p_size < 40 and p_type <> 'SMALL'").alias("supported"),
    )


INSTANCE_NAMES = f"""
instance_names AS (
  SELECT p_partkey AS part_id,
         ([{_FAMILY_LIST}])[p_partkey % {len(_FAMILIES)} + 1] || '.' || ([{_SCALE_LIST}])[p_size % {len(_SCALES)} + 1]
           AS api_name,
         p_size < 40 AND p_type <> 'SMALL' AS supported
  FROM part)"""


def machine_type_lines(t: Tables) -> DataFrame:
    named = F.concat(F.lit('\t\tName: "'), "api_name", F.lit('",'))
    other = F.concat(F.lit('\t\tFamily: "'), "api_name", F.lit('",'))
    return instance_names(t).select(F.when(F.col("supported"), named).otherwise(other).alias("line"))


def catalog_rows(t: Tables) -> DataFrame:
    return t.part.select(
        F.expr("concat(split_part(p_type, ' ', 1), '.', p_partkey)").alias("API Name"),
        F.expr("concat(p_size, '.0 GiB')").alias("Memory"),
        F.expr("concat('$', p_retailprice, ' hourly')").alias("Linux On Demand cost"),
        F.expr("element_at(array('Yes', 'No', 'unknown', 'N/A'), cast(p_partkey % 4 as int) + 1)").alias(
            "Intel AVX"
        ),
        F.lit("Up to 10 Gigabit").alias("Network Performance"),
    )


def registry_json(t: Tables) -> DataFrame:
    """One registry document per part: two phases with two dimensions each."""
    def phase(name):
        return f"""'"{name}":{{"input_scale":{{"bucket":"size-{name}-', p_partkey,
          '","feature":["dataset_size"],"min_value":1,"max_value":', p_size, ',"values":[',
          p_size, ']}},',
          '"scale_up":{{"bucket":"type-{name}-', p_partkey, '","feature":"static","target_feature":"jct",',
          '"groupby_index":"API_Name","min_value":1,"max_value":', p_size, ',"values":[]}}}}'"""

    return t.part.select(
        F.expr(
            f"""concat('{{"app-', p_partkey, '":{{"meta":{{"name":"', p_name, '","app_type":"', p_type,
              '"}},"spec":{{', {phase("before")}, ',', {phase("after")}, '}}}}}}')"""
        ).alias("json")
    )

# ---- trial knobs ----------------------------------------------------------------------
#
# Eight parts form one trial; each part is one knob.

_KNOB_KEYS = ("numServer", "serverType", "numClient", "clientType", "numRun", "keySize", "tenancy",
              "logBucket")
_KNOB_LIST = ", ".join(f"'{x}'" for x in _KNOB_KEYS)
_KNOB_LEN = """CASE WHEN p_partkey % 8 = 4 OR p_size % 3 = 0 THEN 1 WHEN p_size % 23 = 0 THEN {base} + 1
                    ELSE {base} END"""


def knobs(t: Tables) -> DataFrame:
    length = _KNOB_LEN.format(base="((p_partkey div 8) % 4 + 1)")
    return t.part.select(
        F.expr("concat('trial-', p_partkey div 8)").alias("trial"),
        F.expr("if(p_partkey % 8 < 4, 'resource', if(p_partkey % 8 = 4, 'meta', 'app'))").alias("section"),
        F.expr(f"element_at(array({_KNOB_LIST}), cast(p_partkey % 8 as int) + 1)").alias("key"),
        F.expr(
            f"""transform(sequence(0, cast({length} as int) - 1), i -> case
                  when p_partkey % 8 in (1, 3) then concat('type-', (p_size + i) % 4)
                  when p_partkey % 8 = 4 then cast(p_size % 3 + 1 as string)
                  when p_partkey % 8 < 4 then cast((p_size + i) % 5 + 1 as string)
                  else cast(p_size * (i + 1) as string) end)"""
        ).alias("values"),
    )


KNOBS = f"""
knobs AS (
  SELECT 'trial-' || (p_partkey // 8)::VARCHAR AS trial,
         CASE WHEN p_partkey % 8 < 4 THEN 'resource' WHEN p_partkey % 8 = 4 THEN 'meta' ELSE 'app' END AS section,
         ([{_KNOB_LIST}])[p_partkey % 8 + 1] AS key,
         list_transform(range(0, ({_KNOB_LEN.format(base="((p_partkey // 8) % 4 + 1)")})::BIGINT), lambda i: CASE
           WHEN p_partkey % 8 IN (1, 3) THEN 'type-' || ((p_size + i) % 4)::VARCHAR
           WHEN p_partkey % 8 = 4 THEN (p_size % 3 + 1)::VARCHAR
           WHEN p_partkey % 8 < 4 THEN ((p_size + i) % 5 + 1)::VARCHAR
           ELSE (p_size * (i + 1))::VARCHAR END) AS vals
  FROM part),
longest AS (SELECT trial, max(len(vals)) AS longest FROM knobs GROUP BY trial),
rejected AS (SELECT trial, count(*) AS bad_knobs FROM knobs JOIN longest USING (trial)
             WHERE len(vals) <> 1 AND len(vals) <> longest GROUP BY trial),
cells AS (
  SELECT trial, section, key, "row", CASE WHEN len(vals) = 1 THEN vals[1] ELSE vals["row" + 1] END AS value
  FROM (SELECT k.*, unnest(range(0, longest))::INT AS "row" FROM knobs k JOIN longest USING (trial)
        WHERE trial NOT IN (SELECT trial FROM rejected))),
digests AS (SELECT trial, "row", md5(string_agg(key || '=' || value, ';' ORDER BY key || '=' || value)) AS feature_digest
            FROM cells GROUP BY trial, "row")"""

# ---- benchmark text -------------------------------------------------------------------

_K = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"


def _kv_sql(text) -> str:
    v, k = text("value"), text(_K)
    return f"""CASE event_type
      WHEN 'view' THEN concat('read   ', {v}, '  5.1 ', {k}, ' 90.0 95.0 100.0 110.0 ', {text('event_id')})
      WHEN 'click' THEN concat('Total QPS = ', {v}, ' (', {k}, ' / 10.0s)')
      WHEN 'error' THEN concat('RX ', {k}, ' bytes : ', {v}, ' MB/s')
      WHEN 'purchase' THEN concat('TX ', {k}, ' bytes : ', {v}, ' MB/s')
      ELSE concat('#type ', {k}) END"""


def _http_sql(text) -> str:
    v, k = text("value"), text(_K)
    return f"""CASE event_type
      WHEN 'view' THEN CASE {_K} % 4
        WHEN 0 THEN '  Latency Distribution (HdrHistogram - Recorded Latency)'
        WHEN 1 THEN concat(' 50.000%   ', {v}, 'ms')
        WHEN 2 THEN concat(' 75.000%   ', {v}, 'us') ELSE concat(' 99.000%   ', {v}, 's') END
      WHEN 'click' THEN concat('#[Mean    =  ', {v}, ', StdDeviation   =  ', {k}, '.5]')
      WHEN 'error' THEN concat('Requests/sec:  ', {v})
      WHEN 'purchase' THEN concat('Transfer/sec:  ', {v}, CASE {_K} % 3 WHEN 0 THEN 'KB' WHEN 1 THEN 'MB' ELSE 'GB' END)
      ELSE 'thread calibration' END"""


def _ingest_sql(text) -> str:
    return f"CASE event_type WHEN 'purchase' THEN concat('Total time: ', {text('value')}, ' seconds') ELSE 'point' END"


_TEXT = {"spark": lambda x: f"cast({x} as string)", "duck": lambda x: f"({x})::VARCHAR"}
_FORMATS = {"kv": _kv_sql, "http": _http_sql, "ingest": _ingest_sql}


def bench_lines(t: Tables, layout: str) -> DataFrame:
    """Benchmark output with one line per event; the user is the run."""
    return t.events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("line_no"),
        F.expr(_FORMATS[layout](_TEXT["spark"])).alias("line"),
    )


def bench_lines_sql(layout: str) -> str:
    return f"""bench_lines AS (
      SELECT user_id AS run_id, event_id AS line_no, {_FORMATS[layout](_TEXT['duck'])} AS line FROM events)"""


# ---- links ----------------------------------------------------------------------------
#
# Every line item is a measured link from its supplier's node to a node of its part.


def links(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_linenumber").alias("run_id"),
        F.expr("l_suppkey % 100").alias("src"),
        F.expr("l_partkey % 100").alias("dst"),
        F.expr("l_quantity + l_discount * 1000").alias("lat"),
    )


LINKS = """links AS (
  SELECT l_linenumber AS run_id, l_suppkey % 100 AS src, l_partkey % 100 AS dst,
         l_quantity + l_discount * 1000 AS lat FROM lineitem)"""
