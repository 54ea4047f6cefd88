"""Collection logs, driver logs and benchmark text, on small literal logs."""

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from benchloom.operators import gclog, results

GC_LOG = """\
2020-01-01T00:00:01.000+0000: 1.0: [GC (Allocation Failure) AdaptiveSizePolicy
 AdaptiveSizeStart: 1.1 collection: 1
PSAdaptiveSizePolicy::compute_eden_space_size limits desired_eden_size: 9 avg_young_live: 77
PSAdaptiveSizePolicy::compute_eden_space_size: costs minor_time: 0.25 major_cost: 0.5 mutator_cost: 0.75 live_space: 12 free_space: 34
AdaptiveSizePolicy::update_averages:  survived: 123  promoted: 45  overflow: false
[PSYoungGen: 1000K->200K(2000K)] 1500K->900K(6000K), 0.0100000 secs] [Times: user=0.01 sys=0.00, real=0.01 secs]
20/01/01 00:00:03 INFO TaskSetManager: Starting task 0.0 in stage 0.0
20/01/01 00:00:03 INFO TaskSetManager: Starting task 1.0 in stage 1.0
20/01/01 00:00:04 INFO BlockManagerInfo: Added rdd_1_1 in memory
2020-01-01T00:00:05.000+0000: 5.0: [Full GC (Ergonomics) AdaptiveSizeStart: 5.0 collection: 2
20/01/01 00:00:05 INFO TaskSetManager: Finished task 9.0 in stage 1.0
[PSYoungGen: 700K->0K(2000K)] [ParOldGen: 700K->600K(4000K)] 1400K->600K(6000K), 0.0500000 secs] [Times: user=0.05 sys=0.00, real=0.05 secs]
20/01/01 00:00:04 INFO TaskSetManager: Finished task 0.0 in stage 0.0"""


def lines(spark, text, run="r"):
    cells = [(run, i, line) for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(cells, "run string, line_no bigint, line string")


def test_collections(spark, limit):
    events = gclog.gc_events(lines(spark, GC_LOG), ["run"]).orderBy("line_no").collect()
    minor, full = events
    assert (minor.gc_type, minor.gc_time, minor.collection, minor.pause) == ("minor", 1.0, 1, 0.01)
    assert (full.gc_type, full.gc_time, full.collection, full.pause) == ("full", 5.0, 2, 0.05)
    assert minor.allocation == pytest.approx(1.0) and minor.promotion == pytest.approx(0.2)
    assert full.allocation == pytest.approx(0.5) and full.promotion is None
    assert minor.allocation_rate == pytest.approx(1.0) and full.allocation_rate == pytest.approx(0.125)
    assert (minor.old_before, minor.old_after) == (pytest.approx(0.5), pytest.approx(0.7))
    assert full.old_free_after == pytest.approx(3.4)
    assert (full.user_s, full.sys_s, full.real_s) == (0.05, 0.0, 0.05)


def test_report_zoom_and_axis(spark):
    events = gclog.gc_events(lines(spark, GC_LOG), ["run"])
    report = gclog.gc_report(events, ["run"], "gcf_").first()
    assert (report.gcf_minor_gc_count, report.gcf_full_gc_count, report.gcf_gc_count) == (1, 1, 2)
    assert (report.gcf_gc_time, report.gcf_mem_usage) == (0.06, 6.0)
    zoomed = gclog.gc_events(lines(spark, GC_LOG), ["run"], zoom=(1.0, 9.0), by_collection=True).collect()
    # The interval is open, and the first event inside it has no earlier young size.
    assert [(e.t, round(e.allocation, 6)) for e in zoomed] == [(2.0, 0.7)]


def test_adaptive_values(spark):
    got = {(r.series, r.v) for r in gclog.adaptive_info(lines(spark, GC_LOG), ["run"]).collect()}
    assert got == {
        ("ada_col_num", 1.0), ("ada_col_num", 2.0), ("avg_young_live", 77.0), ("live_space", 12.0),
        ("free_space", 34.0), ("minor_time", 0.25), ("major_cost", 0.5), ("mutator_cost", 0.75),
        ("survived", 123.0), ("promoted", 45.0),
    }


def test_one_line_collections_are_opt_in(spark):
    text = (
        "2020-01-01T00:00:01.000+0000: 1.0: [GC (Allocation Failure) "
        "[PSYoungGen: 10K->2K(20K)] 15K->9K(60K), 0.01 secs] [Times: user=0.01 sys=0.00, real=0.01 secs]"
    )
    assert gclog.gc_events(lines(spark, text), ["run"]).count() == 0
    assert gclog.gc_events(lines(spark, text), ["run"], one_line=True).first().young_before == 0.01


def test_tasks(spark, limit):
    got = gclog.task_pending(lines(spark, GC_LOG), ["run"]).orderBy("line_no").collect()
    assert [(r.kind, r.pending_task, r.pending_rdd) for r in got] == [
        ("start", 1, 1), ("start", 2, 1), ("block", 2, 0), ("finish", 1, 0),
    ]
    # Seconds since the first collection; never before the latest collection.
    assert [r.t for r in got] == [2.0, 2.0, 3.0, 5.0]


def test_tasks_before_any_collection_have_no_time(spark):
    text = "20/01/01 00:00:03 INFO TaskSetManager: Starting task 0.0 in stage 0.0"
    row = gclog.task_pending(lines(spark, text), ["run"]).first()
    assert (row.t, row.pending_task) == (None, 1)


def test_driver_times(spark):
    text = """\
20/01/01 23:59:50 INFO SparkContext: Running Spark version 3
20/01/01 23:59:55 INFO DAGScheduler: Got job 0
2020-01-02 00:00:10 INFO SparkContext: Successfully stopped SparkContext"""
    row = gclog.driver_jct(lines(spark, text), ["run"]).first()
    assert (row.jct, row.init_time) == (15.0, 5.0)


def test_kv_bench(spark):
    text = """\
#type avg std min
read 101.2 5.1 80.0 90.0 95.0 100.0 110.0 120.5
Total QPS = 9876.5 (98765 / 10.0s)
RX 123456 bytes : 1.2 MB/s
TX 23456 bytes : 0.2 MB/s"""
    row = results.parse_kv_bench(lines(spark, text), ["run"]).first()
    assert row[1:] == ("101.2", "5.1", "80.0", "120.5", "9876.5", "1.2", "0.2")


def test_http_bench(spark, limit):
    text = """\
 50.000%   9.99ms
  Latency Distribution (HdrHistogram - Recorded Latency)
 50.000%    1.20ms
 75.000%  900.00us
 99.000%    1.50s
Requests/sec: 1.0
#[Mean    =        1.300, StdDeviation   =        0.400]
Requests/sec:   999.0
Transfer/sec:     1.5GB"""
    row = results.parse_http_bench(lines(spark, text), ["run"]).first()
    assert row.asDict() == {
        "run": "r", "lat_50pc": 1.2, "lat_75pc": 0.9, "lat_99pc": 1500.0, "rps": 999.0,
        "throughput": 1536.0, "lat_mean": 1.3, "lat_std": 0.4,
    }


def test_ingest_bench(spark, limit):
    text = "\n".join(f"Total time: {v} seconds" for v in (7.5, 1.5, 3.5, 2.5))
    both = lines(spark, text).unionByName(lines(spark, "nothing here", "empty"))
    got = {r.run: r for r in results.parse_ingest_bench(both, ["run"]).collect()}
    # Nearest index of the median of four is 1.5 rounded half to even.
    assert (got["r"].query_latency_50pc, got["r"].query_latency_max) == (3.5, 7.5)
    assert set(got["empty"][1:]) == {-1.0}


def test_ping(spark):
    text = "PING host\nrtt min/avg/max/mdev = 0.080/0.100/0.150/0.020 ms\nrtt min/avg/max/mdev = 9/9/9/9 ms"
    both = lines(spark, text).unionByName(lines(spark, "unreachable", "lost"))
    assert rows_of(results.parse_ping(both, ["run"])) == [("lost", -1.0), ("r", pytest.approx(80.0))]


def test_bench_json(spark):
    df = spark.createDataFrame([('{"results":[{"executionTime":3.5},{"executionTime":9}]}',)], "json string")
    assert results.parse_bench_json(df).first().real_jct == 3.5


def test_app_config(spark):
    docs = [
        ("a", '{"app":{"num_executor":3,"batch_size":7,"driver_memory":"4096m"},"resource":{"m4.large":2}}'),
        ("b", '{"app":{"num_executor":1,"batch_size":2,"exp_configs":{"rate":1,"delay":2,"loss":3}},'
              '"resource":{"c5.large":1}}'),
    ]
    df = results.app_config(spark.createDataFrame(docs, "run string, json string"))
    assert rows_of(df) == [
        ("a", 3, 7, 4096, None, None, None, "m4.large", 2),
        ("b", 1, 2, None, 1.0, 2.0, 3.0, "c5.large", 1),
    ]


def test_unnest_and_valid_latency(spark):
    df = spark.createDataFrame([(["a", "b"], ["c", "d"], ["1.5", "n/a"])], "src array<string>, dst array<string>, lat array<string>")
    flat = results.valid_latencies(results.unnest_columns(df))
    assert rows_of(flat) == [("a", "c", 1.5)]


def test_good_nodes_readings(spark):
    links = spark.createDataFrame(
        [("a", "b", 50.0), ("b", "a", 90.0), ("b", "c", 150.0), ("c", "a", 20.0)],
        "src string, dst string, lat double",
    )
    assert rows_of(results.good_nodes(links)) == [("a",), ("b",)]
    assert rows_of(results.never_in_tail(links)) == [("a",)]


def test_to_numeric_leaves_mixed_columns(spark):
    df = spark.createDataFrame([("1.5", "x"), (None, "2")], "a string, b string")
    out = results.to_numeric(df, ["a", "b"])
    assert [f.dataType.simpleString() for f in out.schema] == ["double", "string"]


def test_postproc_keeps_debug_on_request(spark):
    df = spark.createDataFrame([(1, 2, 3)], "qps int, debug_x int, numRun int")
    assert results.trial_postproc(df, "dedicated").columns == ["qps", "tenancy"]
    assert results.trial_postproc(df, "dedicated", debug=True).columns == ["qps", "debug_x", "tenancy"]


def test_random_partition_is_even_and_whole(spark, limit):
    logs = spark.range(23).select(F.lit("app").alias("app"), F.col("id").alias("log"))
    parts = results.random_partition(logs, ["app"], ["log"], 4)
    sizes = [r["count"] for r in parts.groupBy("part").count().orderBy("part").collect()]
    assert sizes == [6, 6, 6, 5]
    few = results.random_partition(logs.limit(2), ["app"], ["log"], 4)
    assert sorted(r.part for r in few.collect()) == [0, 1]
