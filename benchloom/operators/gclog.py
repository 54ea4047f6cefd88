"""JVM collection logs and driver logs as running state over numbered lines.

Input: ``(run keys, line_no, line)``.  A line opening a collection is followed
by detail lines until a ``[PSYoungGen`` line closes it; everything after that,
up to the next opening, is driver output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import join_null_safe
from .scans import running

_SIZES = r"([0-9]+)K->([0-9]+)K\(([0-9]+)K\)"

# Detail-line kinds in matching order, and the numbers each one carries
# as (series name, text before the number).
ADAPTIVE_KINDS = (
    ("compute_eden_space_size limits", (("avg_young_live", "avg_young_live:"),)),
    (
        "compute_eden_space_size",
        (
            ("live_space", " live_space: "),
            ("free_space", " free_space: "),
            ("minor_time", " minor_time: "),
            ("major_cost", " major_cost: "),
            ("mutator_cost", " mutator_cost: "),
        ),
    ),
    ("compute_old_gen_free_space limits", (("avg_old_live", "avg_old_live:"),)),
    (
        "compute_old_gen_free_space",
        (("old_live_space", " live_space: "), ("old_free_space", " free_space: ")),
    ),
    (
        "tenuring_thresh",
        (
            ("tenure_thresh", " tenuring_thresh: "),
            ("avg_survived_padded_avg", " avg_survived_padded_avg: "),
            ("avg_promoted_padded_avg", " avg_promoted_padded_avg: "),
            ("avg_pretenured_padded_avg", " avg_pretenured_padded_avg: "),
        ),
    ),
    ("AdaptiveSizeStart", (("ada_col_num", " collection: "),)),
    ("survived: ", (("survived", " survived: "), ("promoted", " promoted: "))),
)
# Fixed value: task counters wrap at this many tasks.
TASK_WRAP = 50


def _has(text: str) -> Column:
    return F.contains("line", F.lit(text))


def _number(pattern: str, group: int = 1, of: Column | str = "line") -> Column:
    found = F.regexp_extract(of, pattern, group)
    return F.nullif(found, F.lit("")).try_cast("double")


def _word(index: int) -> Column:
    return F.get(F.split(F.trim("line"), r"\s+"), index)


def _log_clock() -> Column:
    """Time of a driver line from its first two words, in either common date layout."""
    text = F.concat_ws(" ", _word(0), _word(1))
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(text, F.lit("yy/MM/dd HH:mm:ss")),
    )


def collection_state(
    lines: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Number, type and start time of the collection each line belongs to.

    Adds ``marker`` (enter/exit of this line), ``state`` (last marker),
    ``gc_type``, ``gc_time``, ``gc_clock`` and ``collection`` (running number).
    """
    minor = _has("[GC (Allocation") | _has("[GC (Metadata")
    full = ~minor & _has("[Full GC")
    enter = minor | full
    stamp = F.rtrim(_word(1), F.lit(":")).try_cast("double")
    clock = F.try_to_timestamp(
        F.regexp_extract("line", r"^(\S+T[0-9:]+)\.", 1), F.lit("yyyy-MM-dd'T'HH:mm:ss")
    )
    marked = lines.withColumn(
        "marker", F.when(enter, "enter").when(_has("[PSYoungGen"), "exit")
    )
    opened = F.struct(
        F.when(minor, "minor").otherwise("full").alias("type"),
        stamp.alias("time"),
        clock.alias("clock"),
    )
    state = running(
        marked,
        keys,
        "line_no",
        sums={"collection": F.when(enter, 1).otherwise(0).cast("bigint")},
        latest={"state": F.col("marker"), "_opened": F.when(enter, opened)},
    )
    return state.select(
        "*",
        F.col("_opened.type").alias("gc_type"),
        F.coalesce("_opened.time", F.lit(0.0)).alias("gc_time"),
        F.col("_opened.clock").alias("gc_clock"),
    ).drop("_opened")


def gc_events(
    lines: DataFrame,
    keys: Sequence[str],
    zoom: tuple[float, float] | None = None,
    by_collection: bool = False,
    one_line: bool = False,
) -> DataFrame:
    """One row per collection end: type, times, region sizes, allocation and promotion.

    Sizes are kilobytes / 1000.  ``zoom`` keeps an open time interval,
    ``by_collection`` uses the collection number as ``t``, ``one_line`` also
    reads collections that open and close on one line.
    """
    # The longest log bounds its events too, so the raw lines are counted once.
    state = collection_state(lines, keys)
    closes = F.col("marker") == "exit"
    if one_line:
        closes = closes | ((F.col("marker") == "enter") & _has("[PSYoungGen"))
    events = state.filter(closes)
    if zoom is not None:
        events = events.filter((F.col("gc_time") > zoom[0]) & (F.col("gc_time") < zoom[1]))

    young = lambda i: _number(r"\[PSYoungGen: " + _SIZES, i) / 1000
    head = F.element_at(F.split(F.trim(F.split("line", ", ")[0]), r"\s+"), -1)
    whole = lambda i: _number("^" + _SIZES, i, head) / 1000
    sized = events.select(
        *keys,
        "line_no",
        "collection",
        "gc_type",
        "gc_time",
        (F.col("collection").cast("double") if by_collection else F.col("gc_time")).alias("t"),
        _number(r"([0-9.]+) secs\] \[Times:").alias("pause"),
        _number(r"\[Times: user=([0-9.]+)").alias("user_s"),
        _number(r"sys=([0-9.]+),").alias("sys_s"),
        _number(r"real=([0-9.]+)").alias("real_s"),
        young(1).alias("young_before"),
        young(2).alias("young_after"),
        young(3).alias("young_size"),
        whole(1).alias("whole_before"),
        whole(2).alias("whole_after"),
        whole(3).alias("total_size"),
    ).withColumns(
        {
            "old_before": F.col("whole_before") - F.col("young_before"),
            "old_after": F.col("whole_after") - F.col("young_after"),
            "old_size": F.col("total_size") - F.col("young_size"),
        }
    ).withColumns(
        {
            "old_free_before": F.col("old_size") - F.col("old_before"),
            "old_free_after": F.col("old_size") - F.col("old_after"),
        }
    )
    linked = running(
        sized,
        keys,
        "line_no",
        previous={"_prev": F.struct(F.col("young_after").alias("young"), F.col("gc_time").alias("time"))},
    )
    elapsed = F.col("gc_time") - F.coalesce(F.col("_prev.time"), F.lit(0.0))
    return linked.withColumns(
        {
            "allocation": F.col("young_before") - F.coalesce(F.col("_prev.young"), F.lit(0.0)),
            "promotion": F.when(
                F.col("gc_type") == "minor",
                (F.col("young_before") - F.col("young_after"))
                - (F.col("whole_before") - F.col("whole_after")),
            ),
        }
    ).withColumns(
        {
            "allocation_rate": F.try_divide("allocation", elapsed),
            "promotion_rate": F.try_divide("promotion", elapsed),
        }
    ).drop("_prev")


def adaptive_info(
    lines: DataFrame, keys: Sequence[str], by_collection: bool = False,
    zoom: tuple[float, float] | None = None,
) -> DataFrame:
    """Adaptive-size values inside collections as ``(run, series, t, v)``.

    With ``zoom`` only lines of collections inside the open time interval count.
    """
    state = collection_state(lines, keys).filter(F.col("state") == "enter")
    if zoom:
        state = state.filter((F.col("gc_time") > zoom[0]) & (F.col("gc_time") < zoom[1]))
    kind = F.when(F.lit(False), F.lit(None).cast("array<struct<series:string,v:double>>"))
    for text, values in ADAPTIVE_KINDS:
        cells = F.array(
            *[
                F.struct(
                    F.lit(series).alias("series"),
                    _number(rf"\Q{before}\E\s*(\S+)").alias("v"),
                )
                for series, before in values
            ]
        )
        kind = kind.when(_has(text), cells)
    t = F.col("collection").cast("double") if by_collection else F.col("gc_time")
    return state.select(*keys, "line_no", t.alias("t"), F.inline(kind)).filter(
        F.col("v").isNotNull()
    )


def gc_report(events: DataFrame, keys: Sequence[str], prefix: str = "") -> DataFrame:
    """Counts, pause totals, mean rates and mean heap size of each run."""
    minor, full = F.col("gc_type") == "minor", F.col("gc_type") == "full"

    def pauses(test):
        # Decimal sums do not depend on the order of the rows, so rounding is stable.
        exact = F.when(test, F.col("pause")).cast("decimal(20,9)")
        return F.round(F.coalesce(F.sum(exact), F.lit(0)), 2).cast("double")

    measures = {
        "minor_gc_count": F.count_if(minor),
        "minor_gc_time": pauses(minor),
        "full_gc_count": F.count_if(full),
        "full_gc_time": pauses(full),
        "gc_count": F.count(F.lit(1)),
        "gc_time": pauses(F.lit(True)),
        "mem_allocation_rate_mean": F.round(F.avg("allocation_rate"), 2),
        "mem_promotion_rate_mean": F.round(F.avg("promotion_rate"), 2),
        "mem_usage": F.round(F.avg(F.col("total_size").cast("decimal(20,6)")), 2).cast("double"),
    }
    return events.groupBy(*keys).agg(*[m.alias(prefix + n) for n, m in measures.items()])


# Timeline series and the event column each one shows.
TIMELINE_SERIES = {
    "allocation_rates": "allocation_rate",
    "allocation_sizes": "allocation",
    "promotion_rates": "promotion_rate",
    "promotion_sizes": "promotion",
    "total_sizes": "total_size",
    "young_sizes": "young_size",
    "old_sizes": "old_size",
    "whole_before": "whole_before",
    "whole_after": "whole_after",
    "young_before": "young_before",
    "young_after": "young_after",
    "old_before": "old_before",
    "old_after": "old_after",
    "old_free_before": "old_free_before",
    "old_free_after": "old_free_after",
}


# Series that are shown to two decimals.
ROUNDED_SERIES = ("allocation_rates", "allocation_sizes", "promotion_rates", "promotion_sizes")


def gc_timeline(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every series of the collections as ``(run, series, t, v)``; sizes and rates of allocation
    and promotion are rounded to two decimals."""
    number = F.col("collection").cast("double")
    cells = [
        *[F.struct(F.lit(s).alias("series"), F.col(c).alias("v")) for s, c in TIMELINE_SERIES.items()],
        *[
            F.struct(
                F.lit(f"{kind}_gcs").alias("series"),
                F.when(F.col("gc_type") == kind, number).alias("v"),
            )
            for kind in ("minor", "full")
        ],
    ]
    out = events.select(*keys, "line_no", "t", F.inline(F.array(*cells)))
    shown = F.when(F.col("series").isin(*ROUNDED_SERIES), F.round("v", 2)).otherwise(F.col("v"))
    return out.filter(F.col("v").isNotNull()).withColumn("v", shown)


def task_pending(lines: DataFrame, keys: Sequence[str], by_collection: bool = False) -> DataFrame:
    """Tasks in flight and tasks awaiting a cached block after each task line.

    ``t`` is seconds since the first collection, never before the latest one;
    null ahead of the first collection.
    """
    state = collection_state(lines, keys)
    outside = F.col("marker").isNull() & (F.coalesce("state", F.lit("exit")) == "exit")
    starting = outside & _has("TaskSetManager") & _has("Starting")
    finished = outside & ~starting & _has("TaskSetManager") & _has("Finished")
    added = outside & ~starting & ~finished & _has("BlockManagerInfo") & _has("Added rdd")
    kind = F.when(starting, "start").when(finished, "finish").when(added, "block")
    tasks = state.withColumn("kind", kind)
    first = F.when(F.col("gc_clock").isNotNull(), F.col("line_no"))
    began = state.groupBy(*keys).agg(F.min_by("gc_clock", first).alias("_began"))
    tasks = tasks.filter(F.col("kind").isNotNull())
    flag = lambda c: F.when(c, 1).otherwise(0)
    is_kind = lambda k: F.col("kind") == k
    cached = is_kind("start") & _has("stage 0.0")
    counted = running(
        tasks,
        keys,
        "line_no",
        sums={
            "pending_task": flag(is_kind("start")) - flag(is_kind("finish")),
            "pending_rdd": flag(cached) - flag(is_kind("block")),
            "started": flag(is_kind("start")),
            "finished": flag(is_kind("finish")),
        },
    )
    joined = join_null_safe(counted, began, keys, "left")
    since = F.timestamp_diff("SECOND", F.col("_began"), _log_clock()).cast("double")
    t = (
        F.when(F.col("collection") > 0, F.col("collection").cast("double"))
        if by_collection
        else F.when(F.col("collection") > 0, F.greatest(since, "gc_time"))
    )
    wrapped = lambda n: F.col(n) % TASK_WRAP
    return joined.select(
        *keys,
        "line_no",
        "kind",
        t.alias("t"),
        "pending_task",
        "pending_rdd",
        F.when(is_kind("start"), wrapped("started")).alias("starts"),
        F.when(is_kind("finish"), wrapped("finished")).alias("finishes"),
    )


def driver_jct(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seconds from job start to context stop, and from version line to job start.

    The last line of each marker counts; times are the first two words of a line.
    """
    started = _has("Got job 0")
    stopped = ~started & _has("Successfully stopped SparkContext")
    began = ~started & ~stopped & _has("Running Spark version")
    last = lambda test: F.max_by(_log_clock(), F.when(test, F.col("line_no")))
    marks = (
        lines.filter(started | stopped | began)
        .groupBy(*keys)
        .agg(last(began).alias("_init"), last(started).alias("_start"), last(stopped).alias("_end"))
    )
    seconds = lambda a, b: F.timestamp_diff("SECOND", F.col(a), F.col(b)).cast("double")
    return marks.select(
        *keys, seconds("_start", "_end").alias("jct"), seconds("_init", "_start").alias("init_time")
    )
