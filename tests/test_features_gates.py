import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from benchloom.functions import scalars
from benchloom.operators import features, gates

SAMPLES = "run int, pod string, container string, name string, node string, seq int, value double"


def samples(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], SAMPLES)


def test_container_features(spark, limit):
    rows = [
        ("app-driver", "main", "container_cpu_total", "n0", 1, 5.0),
        ("app-driver", "main", "container_cpu_total", "n0", 2, 4.0),
        ("app-exec-3", "main", "container_mem", "n1", 1, 2.0),
        ("app-exec-3", "main", "container_mem", "n1", 2, 4.0),
        ("app-exec-3", "main", "container_last_seen", "n1", 3, 9.0),
        ("app-exec-3", "", "container_mem", "n1", 4, 9.0),
    ]
    got = {r.feature: r.value for r in features.container_features(samples(spark, rows), ["run"]).collect()}
    # The counter keeps its last value even though it fell.
    assert got.pop("cf_driver_main_container_cpu_total") == 4.0
    assert got["cf_exec_3_main_container_mem_mean"] == 3.0
    assert got["cf_exec_3_main_container_mem_95_pc"] == pytest.approx(3.9)
    assert len(got) == len(features.SUMMARY_STATS)


def test_node_features_use_first_samples(spark):
    pods = spark.createDataFrame([(1, "x-driver", "n0"), (1, "x-exec-1", "n1"), (1, "x-exec-2", "n2")],
                                 "run int, pod string, node string")
    info = spark.createDataFrame(
        [(1, f"10.0.0.{i}", f"n{i}", "master" if i == 9 else "node") for i in (0, 1, 2, 3, 9)],
        "run int, ip string, name string, role string",
    )
    data = [(1, f"10.0.0.{i}:9100", "load", s, 10.0 * i + s) for i in (0, 1, 2, 3, 9) for s in (1, 2)]
    node = spark.createDataFrame(data, "run int, instance string, name string, seq int, value double")
    got = {r.feature: r.value for r in features.node_features(node, info, pods, ["run"]).collect()}
    assert got["nf_driver_load"] == 1.0
    assert (got["nf_exec_load_min"], got["nf_exec_load_max"], got["nf_exec_load_mean"]) == (11.0, 21.0, 16.0)
    assert len(got) == 1 + len(features.SUMMARY_STATS)


def test_series_are_told_apart(spark, limit):
    pods = spark.createDataFrame([(1, "x-driver", "n0"), (1, "x-exec-1", "n1")], "run int, pod string, node string")
    info = spark.createDataFrame([(1, f"10.0.0.{i}", f"n{i}", "node") for i in (0, 1)],
                                 "run int, ip string, name string, role string")
    data = [(1, f"10.0.0.{i}:9100", "load", s, f"cpu={c}", v) for i in (0, 1)
            for c, s, v in ((1, 1, 10.0), (0, 2, 30.0), (1, 3, 99.0), (0, 4, 98.0))]
    node = spark.createDataFrame(data, "run int, instance string, name string, seq int, series string, value double")
    got = {r.feature: r.value for r in features.node_features(node, info, pods, ["run"]).collect()}
    assert (got["nf_exec_load_min"], got["nf_exec_load_max"]) == (10.0, 30.0)
    assert got["nf_driver_load"] == 30.0          # the series that starts last
    rows = [("app-exec-3", "main", "container_mem", "n1", s, v) for s, v in ((1, 2.0), (2, 50.0), (3, 4.0), (4, 70.0))]
    rows += [("app-exec-3", "main", "container_cpu_total", "n1", s, v) for s, v in ((1, 9.0), (2, 5.0), (3, 8.0))]
    two = samples(spark, rows).withColumn("series", F.concat(F.lit("disk="), F.col("seq") % 2))
    got = {r.feature: r.value for r in features.container_features(two, ["run"]).collect()}
    assert (got["cf_exec_3_main_container_mem_min"], got["cf_exec_3_main_container_mem_max"]) == (50.0, 70.0)
    assert got["cf_exec_3_main_container_cpu_total"] == 5.0


def test_runs_without_the_pick_feature_are_reported(spark):
    df = spark.createDataFrame([(1, "cf_exec_1_main_mem", 1.0), (2, "cf_driver_x", 2.0)],
                               "run int, feature string, value double")
    got = rows_of(features.executor_pick(df, ["run"]))
    assert got == [(1, f"rejected_without_{features.PICK_FEATURE}", None), (2, "cf_driver_x", 2.0)]


def test_pod_node_map_last_wins(spark):
    rows = [("p", "c", "m", "old", 1, 0.0), ("p", "c", "m", "new", 2, 0.0)]
    assert rows_of(features.pod_node_map(samples(spark, rows), ["run"])) == [(1, "p", "new")]


def test_executor_pick(spark, limit):
    cpu = "cf_exec_{}_" + features.PICK_FEATURE
    rows = [(1, cpu.format(i), float(i % 4)) for i in range(20)]
    rows += [(1, "cf_exec_19_executor_mem", 7.0), (1, "cf_exec_1_executor_disk", 3.0), (1, "cf_driver_x", 1.0)]
    df = spark.createDataFrame(rows, "run int, feature string, value double")
    got = {r.feature: r.value for r in features.executor_pick(df, ["run"]).collect()}
    # Index int(20 * 0.95) = 19: the last of the executors tied at value 3, by id as text.
    assert got == {
        "cf_driver_x": 1.0,
        "cf_exec_" + features.PICK_FEATURE: 3.0,
        "cf_exec_executor_mem": None,
        "cf_exec_executor_disk": None,
    }


def test_executor_summary(spark):
    rows = [(1, "cf_exec_1_a_b", 1.0), (1, "cf_exec_2_a_b", 3.0)]
    df = spark.createDataFrame(rows, "run int, feature string, value double")
    got = {r.feature: r.value for r in features.executor_summary(df, ["run"]).collect()}
    assert got["cf_exec_a_b_50_pc"] == 2.0 and got["cf_exec_a_b_max"] == 3.0


STAGES = "run int, stage_id bigint, submitted bigint, completed bigint"


def test_completion_times(spark, limit):
    rows = [(1, 0, 10, 20), (1, 11, 15, 50), (1, 30, 40, 90), (2, 0, 5, 9)]
    got = features.job_completion_time(spark.createDataFrame(rows, STAGES), ["run"])
    assert rows_of(got) == [(1, 30, 80), (2, None, 4)]


def test_completion_times_with_equal_ends(spark, limit):
    rows = [(1, i, 0, 7) for i in range(20)]
    got = features.job_completion_time(spark.createDataFrame(rows, STAGES), ["run"])
    assert rows_of(got) == [(1, 0, 7)]


def test_stage_sums_skip_text(spark):
    rows = [(1, [(1, "m", "2"), (2, "m", "x"), (3, "t", "y")]), (1, [(1, "m", "3.5")])]
    df = spark.createDataFrame(rows, "run int, accumulables array<struct<ID:bigint,Name:string,Value:string>>")
    assert rows_of(features.stage_metric_sums(df, ["run"])) == [(1, "m", 5.5), (1, "t", None)]


FEATURES = [("a", "r1", "x"), ("a", "r1", "y"), ("a", "r2", "x"), ("a", "r2", "z"), ("b", "r1", "q")]


def tall(spark, extra=()):
    rows = [(a, r, f, float(i)) for i, (a, r, f) in enumerate([*FEATURES, *extra])]
    return spark.createDataFrame(rows, "app_id string, run_id string, feature string, value double")


def test_minimum_set_and_gates(spark):
    minimum = gates.min_feature_set(tall(spark))
    assert rows_of(minimum) == [("a", "x"), ("b", "q")]
    dropped = gates.gate_features(tall(spark), minimum, ["app_id", "feature"], keep=False)
    assert {r.feature for r in dropped.collect()} == {"y", "z"}


def test_complete_runs_count_skips(spark):
    minimum = spark.createDataFrame([("a", "x"), ("a", "y")], "app_id string, feature string")
    complete, skipped = gates.complete_runs(tall(spark), minimum)
    assert {(r.run_id, r.feature) for r in complete.collect()} == {("r1", "x"), ("r1", "y")}
    assert rows_of(skipped) == [("a", 1)]


def test_modes(spark):
    names = ["jct", "full_jct", "API_Name", "cf_a_total", "cf_b", "nf_x_avail", "internal_y", "num_executor", "w"]
    df = spark.createDataFrame([(0,) * len(names)], names)
    columns = lambda mode, *a: gates.mode_columns(df, mode, *a)
    assert columns("all") == names[2:]
    assert columns("cf_total_fw") == ["cf_a_total", "internal_y"]
    assert columns("node_all_ne") == ["nf_x_avail", "num_executor"]
    assert columns("none", ["w", "jct"]) == ["w"]
    assert columns({"w", "cf_b"}, [], ["API_Name"]) == ["API_Name", "cf_b", "w"]
    with pytest.raises(ValueError):
        columns("other")


def test_complete_logs(spark):
    entries = [("l1", "info", "n"), ("l1", "input", "c")] + [("l1", "output", o) for o in "abcd"]
    entries += [("l2", "info", "n"), ("l2", "input", "c")] + [("l2", "output", o) for o in "aabc"]
    df = spark.createDataFrame(entries, "log string, entry_type string, name string")
    assert [r.log for r in gates.complete_logs(df, ["log"]).collect()] == ["l1"]


def test_drop_nested_and_features(spark):
    df = spark.createDataFrame([([1], {"a": 1}, 2, 3)], "l array<int>, m map<string,int>, x int, jct int")
    assert gates.drop_nested(df).columns == ["x", "jct"]
    assert gates.drop_features(gates.drop_nested(df)).columns == ["x"]
    with pytest.raises(ValueError):
        gates.drop_features(df, ["nope"])


def test_scalar_helpers(spark):
    df = spark.createDataFrame(
        [("Yes", 1), ("No", 2), ("16.0 GiB", 3), ("$0.192 hourly", 4), ("Up to 10 Gigabit", 5), ("", 6),
         ("unavailable", 7), ("1e5", 8)], "cell string, i int",
    )
    got = df.select("i", scalars.normalize_value(F.col("cell")), scalars.normalize_number(F.col("cell")))
    assert rows_of(got) == [
        (1, "1", 1.0), (2, "0", 0.0), (3, "16.0", 16.0), (4, "0.192", 0.192), (5, "Up", None),
        (6, None, None), (7, "0", 0.0), (8, "1e5", None),
    ]
    one = spark.range(1)
    name = F.lit("cf_exec_3_executor_cpu_max")
    row = one.select(
        scalars.normalize_name(F.lit("a.b:c d")), scalars.container_id(F.lit("x-exec-3"), F.lit("main")),
        scalars.container_id(F.lit("x-driver-1"), F.lit("main")), scalars.container_id(F.lit("p"), F.lit("")),
        scalars.executor_of(name), scalars.executor_feature(name), scalars.parse_duration_ms(F.lit("1.5s")),
        scalars.parse_rate_mb(F.lit("512KB")), scalars.parse_rate_mb(F.lit("5B")),
    ).first()
    assert tuple(row) == (
        "a_b_c_d", "exec_3_main", "driver_main", "", "3", "executor_cpu_max", 1500.0, 0.5, None,
    )


def test_digest_equal_only_for_equal_configs(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (1, "b", None), (1, "a", "None ")],
                               "x int, y string, z string")
    digests = [r[0] for r in df.select(scalars.config_digest(["z", "x", "y"])).collect()]
    assert digests[0] == digests[1] and len(set(digests)) == 3
