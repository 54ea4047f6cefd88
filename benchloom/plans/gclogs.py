"""Queries: collection logs, task lines and driver times."""

from __future__ import annotations


from ..operators import gclog
from . import inputs
from .registry import query, r6

RUN = ["run_id"]
_EVENTS = inputs.gc_events_sql()


def _events(t, **options):
    return gclog.gc_events(inputs.driver_lines(t), RUN, **options)


@query(
    "gc_events",
    f"WITH {_EVENTS} SELECT run_id, line_no, collection::BIGINT AS collection, gc_type, gc_time, t FROM gc_events",
)
def gc_events(t):
    return _events(t).select("run_id", "line_no", "collection", "gc_type", "gc_time", "t")


_SIZES = ("young_before", "young_after", "young_size", "whole_before", "whole_after", "total_size",
          "old_before", "old_after", "old_size", "old_free_before", "old_free_after")


@query(
    "gc_region_sizes",
    f"""WITH {_EVENTS} SELECT run_id, line_no, {', '.join(f'round({c}, 6) AS {c}' for c in _SIZES)}
    FROM gc_events""",
)
def gc_region_sizes(t):
    return _events(t).select("run_id", "line_no", *[r6(c).alias(c) for c in _SIZES])


@query(
    "gc_allocation",
    f"""WITH {_EVENTS} SELECT run_id, line_no, round(allocation, 6) AS allocation,
    round(allocation_rate, 6) AS allocation_rate FROM gc_events""",
)
def gc_allocation(t):
    cols = ("allocation", "allocation_rate")
    return _events(t).select("run_id", "line_no", *[r6(c).alias(c) for c in cols])


@query(
    "gc_promotion",
    f"""WITH {_EVENTS} SELECT run_id, line_no, gc_type, round(promotion, 6) AS promotion,
    round(promotion_rate, 6) AS promotion_rate FROM gc_events""",
)
def gc_promotion(t):
    cols = ("promotion", "promotion_rate")
    return _events(t).select("run_id", "line_no", "gc_type", *[r6(c).alias(c) for c in cols])


@query(
    "gc_pause",
    f"WITH {_EVENTS} SELECT run_id, line_no, pause, user_s, sys_s, real_s FROM gc_events",
)
def gc_pause(t):
    return _events(t).select("run_id", "line_no", "pause", "user_s", "sys_s", "real_s")


def _adaptive_sql():
    branches, earlier = [], []
    for text, values in gclog.ADAPTIVE_KINDS:
        not_before = " AND ".join([f"NOT contains(line, '{e}')" for e in earlier] or ["true"])
        for series, before in values:
            number = f"split_part(ltrim(split_part(line, '{before}', 2)), ' ', 1)::DOUBLE"
            branches.append(
                f"SELECT run_id, line_no, gc_time AS t, '{series}' AS series, {number} AS v FROM state "
                f"WHERE state = 'enter' AND contains(line, '{text}') AND {not_before}"
            )
        earlier.append(text)
    return f"WITH {inputs.GC_STATE} " + " UNION ALL ".join(branches)


@query("gc_adaptive_info", _adaptive_sql())
def gc_adaptive_info(t):
    return gclog.adaptive_info(inputs.driver_lines(t), RUN)


def _r2(expression: str) -> str:
    """Two decimals, halves of the printed number away from zero."""
    return f"round(({expression})::VARCHAR::DECIMAL(38, 18), 2)::DOUBLE"


@query(
    "gc_report",
    f"""
    WITH {_EVENTS}
    SELECT run_id, count_if(gc_type = 'minor')::BIGINT AS gcf_driver_minor_gc_count,
           {_r2("coalesce(sum(CASE WHEN gc_type = 'minor' THEN pause::DECIMAL(20, 9) END), 0)")} AS gcf_driver_minor_gc_time,
           count_if(gc_type = 'full')::BIGINT AS gcf_driver_full_gc_count,
           {_r2("coalesce(sum(CASE WHEN gc_type = 'full' THEN pause::DECIMAL(20, 9) END), 0)")} AS gcf_driver_full_gc_time,
           count(*) AS gcf_driver_gc_count, {_r2("sum(pause::DECIMAL(20, 9))")} AS gcf_driver_gc_time,
           {_r2("avg(allocation_rate)")} AS gcf_driver_mem_allocation_rate_mean,
           {_r2("avg(promotion_rate)")} AS gcf_driver_mem_promotion_rate_mean,
           -- mean of kilobytes in whole numbers, halves up
           ((2 * sum(round(total_size * 1000)::BIGINT) + 10 * count(*)) // (20 * count(*)))::DOUBLE / 100
             AS gcf_driver_mem_usage
    FROM gc_events GROUP BY run_id
    """,
)
def gc_report(t):
    return gclog.gc_report(_events(t), RUN, "gcf_driver_")


@query(
    "gc_timeline",
    f"""
    WITH {_EVENTS},
    cells AS (
      SELECT run_id, line_no, t,
             unnest([{', '.join(f"'{s}'" for s in gclog.TIMELINE_SERIES)}, 'minor_gcs', 'full_gcs']) AS series,
             unnest([{', '.join(gclog.TIMELINE_SERIES.values())},
                     CASE WHEN gc_type = 'minor' THEN collection END,
                     CASE WHEN gc_type = 'full' THEN collection END]) AS v
      FROM gc_events)
    SELECT run_id, line_no, t, series,
           CASE WHEN series IN {gclog.ROUNDED_SERIES} THEN {_r2("v")} ELSE round(v, 6) END AS v
    FROM cells WHERE v IS NOT NULL
    """,
)
def gc_timeline(t):
    return gclog.gc_timeline(_events(t), RUN).withColumn("v", r6("v"))


_ZOOM = (200000.0, 2000000.0)


@query(
    "gc_zoom",
    f"""
    WITH {inputs.gc_events_sql(f"gc_time > {_ZOOM[0]} AND gc_time < {_ZOOM[1]}", "collection::DOUBLE")}
    SELECT run_id, line_no, gc_type, t, round(allocation, 6) AS allocation FROM gc_events
    """,
)
def gc_zoom(t):
    events = _events(t, zoom=_ZOOM, by_collection=True)
    return events.select("run_id", "line_no", "gc_type", "t", r6("allocation").alias("allocation"))


@query(
    "task_pending",
    f"""
    WITH {inputs.GC_STATE},
    began AS (SELECT run_id, arg_min(gc_clock, line_no) FILTER (gc_clock IS NOT NULL) AS began
              FROM state GROUP BY run_id),
    tasks AS (
      SELECT s.*, began,
             CASE WHEN contains(line, 'TaskSetManager') AND contains(line, 'Starting') THEN 'start'
                  WHEN contains(line, 'TaskSetManager') AND contains(line, 'Finished') THEN 'finish'
                  WHEN contains(line, 'BlockManagerInfo') AND contains(line, 'Added rdd') THEN 'block' END AS kind
      FROM state s JOIN began USING (run_id)
      WHERE marker IS NULL AND coalesce(state, 'exit') = 'exit'),
    counted AS (
      SELECT *, sum(CASE kind WHEN 'start' THEN 1 WHEN 'finish' THEN -1 ELSE 0 END) OVER w AS pt,
             sum(CASE WHEN kind = 'start' AND contains(line, 'stage 0.0') THEN 1
                      WHEN kind = 'block' THEN -1 ELSE 0 END) OVER w AS pr,
             sum(CASE kind WHEN 'start' THEN 1 ELSE 0 END) OVER w AS st,
             sum(CASE kind WHEN 'finish' THEN 1 ELSE 0 END) OVER w AS fi
      FROM tasks WHERE kind IS NOT NULL
      WINDOW w AS (PARTITION BY run_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT run_id, line_no, kind,
           CASE WHEN collection > 0 THEN greatest(
             epoch(strptime(substr(line, 1, 19), '%Y-%m-%d %H:%M:%S')) - epoch(began), gc_time) END AS t,
           pt::BIGINT AS pending_task, pr::BIGINT AS pending_rdd,
           CASE WHEN kind = 'start' THEN (st % 50)::BIGINT END AS starts,
           CASE WHEN kind = 'finish' THEN (fi % 50)::BIGINT END AS finishes
    FROM counted
    """,
)
def task_pending(t):
    return gclog.task_pending(inputs.driver_lines(t), RUN)


@query(
    "driver_jct",
    f"""
    WITH {inputs.GC_STATE},
    marks AS (
      SELECT run_id, line_no, strptime(substr(line, 1, 19), '%Y-%m-%d %H:%M:%S') AS clock,
             CASE WHEN contains(line, 'Got job 0') THEN 'start'
                  WHEN contains(line, 'Successfully stopped SparkContext') THEN 'end' ELSE 'init' END AS mark
      FROM lines
      WHERE contains(line, 'Got job 0') OR contains(line, 'Successfully stopped SparkContext')
         OR contains(line, 'Running Spark version')),
    times AS (
      SELECT run_id, arg_max(clock, line_no) FILTER (mark = 'init') AS i,
             arg_max(clock, line_no) FILTER (mark = 'start') AS s, arg_max(clock, line_no) FILTER (mark = 'end') AS e
      FROM marks GROUP BY run_id)
    SELECT run_id, epoch(e) - epoch(s) AS jct, epoch(s) - epoch(i) AS init_time FROM times
    """,
)
def driver_jct(t):
    return gclog.driver_jct(inputs.driver_lines(t), RUN)
