import json

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from benchloom.operators import configs, gates, results
from benchloom.session import scratch_path, shared_dir
from benchloom.sources import batches, catalog, eventlog, logs, metrics, registry, store

KNOBS = "trial string, section string, key string, values array<string>"
TRIALS = [
    ("t", "resource", "numServer", ["1", "2", "3"]),
    ("t", "resource", "serverType", ["m5"]),
    ("t", "meta", "numRun", ["2"]),
    ("bad", "app", "a", ["1", "2", "3"]),
    ("bad", "app", "b", ["1", "2"]),
    ("one", "app", "a", ["x"]),
]


@pytest.fixture
def knobs(spark):
    return spark.createDataFrame(TRIALS, KNOBS)


def test_expand_and_reject(spark, knobs):
    expanded, rejected = configs.config_expand(knobs)
    got = {(r.trial, r.key): r["values"] for r in expanded.collect()}
    assert got == {
        ("t", "numServer"): ["1", "2", "3"], ("t", "serverType"): ["m5"] * 3,
        ("t", "numRun"): ["2"] * 3, ("one", "a"): ["x"],
    }
    assert rows_of(rejected) == [("bad", 1)]


def test_runs_and_demand(spark, knobs):
    expanded, _ = configs.config_expand(knobs)
    cells = configs.config_explode(expanded)
    runs = configs.config_runs(cells).collect()
    assert sorted(((r.trial, r.row, r.run, r.run_id) for r in runs), key=lambda r: (r[1:] == (0, None, None), r)) == [
        ("t", row, run, f"t/{row}/{run}") for row in range(3) for run in range(2)
    ] + [("one", 0, None, None)]
    assert {r.problem for r in runs if r.run is None} == {"numRun"}
    assert len({r.feature_digest for r in runs if r.run is not None}) == 3
    types = spark.createDataFrame([("m5",)], "instance_type string")
    demand, errors = configs.instance_demand(cells, types)
    assert rows_of(demand) == [("t", i, "m5", i + 1) for i in range(3)]
    assert errors.count() == 0
    none, errors = configs.instance_demand(cells, types.filter("false"))
    assert none.count() == 0 and {r.error for r in errors.collect()} == {"unknown type"}
    _, errors = configs.instance_demand(cells.filter("key != 'serverType'"), types)
    assert {r.error for r in errors.collect()} == {"missing type"}


def test_runs_carry_bucket_debug_and_demand(spark):
    cells = spark.createDataFrame(
        [("t", r, "meta", k, v) for r in (0, 1) for k, v in (("numRun", "2"), ("logBucket", "logs"))]
        + [("t", 0, "meta", "debug", "true"), ("t", 1, "meta", "debug", "perhaps")]
        + [("t", r, "resource", k, v) for r in (0, 1)
           for k, v in (("numServer", "3"), ("serverType", "m5"), ("numClient", "2"), ("clientType", "m5"))]
        + [("w", 0, "meta", "numRun", "1"), ("w", 0, "resource", "numServer", "1"),
           ("w", 0, "resource", "serverType", "x9")]
        + [("z", 0, "meta", "numRun", "0"), ("z", 0, "resource", "numServer", "1")],
        "trial string, row int, section string, key string, value string",
    )
    types = spark.createDataFrame([("m5",)], "instance_type string")
    got = configs.config_runs(cells, available=types).collect()
    assert sorted((r.trial, r.row, r.run, r.run_id, r.log_bucket, r.debug, r.demand) for r in got if r.trial == "t") == [
        ("t", row, run, f"t/{row}/{run}", "logs", row == 0, {"m5": 5}) for row in (0, 1) for run in (0, 1)
    ]
    assert sorted((r.trial, r.problem, r.run, r.run_id, r.log_bucket, r.debug, r.demand) for r in got if r.trial != "t") == [
        ("w", "resource", None, None, None, False, None), ("z", "numRun", None, None, None, False, None),
    ]
    assert configs.config_runs(cells.limit(0), available=types).count() == 0
    assert "demand" not in configs.config_runs(cells).columns


def test_validate(spark, knobs):
    missing = rows_of(configs.config_missing(knobs, ["numRun", "a"]))
    assert missing == [("bad", "numRun"), ("one", "numRun"), ("t", "a")]
    with pytest.raises(ValueError):
        configs.require_valid(knobs)
    assert configs.require_valid(knobs.filter("trial = 't'"), ["numRun"]).count() == 3


def test_cross_sample_is_distinct_and_whole(spark, limit):
    pools = [("t", "s", "a", list("abc")), ("t", "s", "b", list("xy")), ("t", "s", "c", list("123"))]
    df = spark.createDataFrame(pools, KNOBS)
    def combos(n):
        found = {}
        for r in configs.cross_sample(df, n).collect():
            found.setdefault(r.combo, {})[r.key] = r.value
        return sorted(tuple(sorted(c.items())) for c in found.values())
    every = combos(100)
    assert len(every) == len(set(every)) == 18
    some = combos(5)
    assert len(set(some)) == 5 and set(some) <= set(every)


@pytest.mark.parametrize("knobs_", [10, 30])
def test_cross_sample_of_many_knobs(spark, knobs_):
    """Ten knobs of ten values, and more combinations than a whole number holds."""
    pools = [("t", "s", f"k{i:02d}", list("0123456789")) for i in range(knobs_)]
    found = {}
    for r in configs.cross_sample(spark.createDataFrame(pools, KNOBS), 20).collect():
        found.setdefault(r.sample, {})[r.key] = r.value
    assert len(found) == len({tuple(sorted(c.items())) for c in found.values()}) == 20
    assert all(len(c) == knobs_ and None not in c.values() for c in found.values())
    assert all(len({c[f"k{i:02d}"] for c in found.values()}) > 1 for i in range(knobs_))


def test_instance_groups_carry_forward(spark, limit):
    rows = [("t", i, "img" if i == 0 else ("new" if i == 15 else None), "ded" if i == 3 else None) for i in range(30)]
    df = spark.createDataFrame(rows, "trial string, position bigint, image string, tenancy string")
    got = configs.instance_groups(df).orderBy("position").collect()
    assert [r.image for r in got] == ["img"] * 15 + ["new"] * 15
    assert [r.tenancy for r in got] == [None] * 3 + ["ded"] * 27


def test_bipartite_zip_stops_at_the_shorter_side(spark, limit):
    left = spark.range(20).select(F.lit(1).alias("run"), F.col("id").alias("server"))
    right = spark.range(12).select(F.lit(1).alias("run"), (F.col("id") * 10).alias("client"))
    got = results.bipartite_zip(left, right, ["run"], ["server"], ["client"])
    assert sorted((r.server, r.client) for r in got.collect()) == [(i, i * 10) for i in range(12)]


# ---- sources --------------------------------------------------------------------------


def test_log_index_rules(spark):
    root = "sweep-sort-001/"
    paths = ["input/app_configs.json", "input/bench_configs.yaml", "output/eventlogs/p", "output/node/p",
             "output/other/x", "info/nodes.json", "_SUCCESS", "misc/y"]
    df = spark.createDataFrame([(root + p,) for p in paths], "path string")
    got = {(r.app_id, r.log_id, r.name, r.entry_type) for r in logs.log_index(df).collect()}
    assert got == {
        ("sweep-sort", "sweep-sort-001", n, k)
        for n, k in [("app_configs", "input"), ("bench_configs", "input"), ("eventlogs", "output"),
                     ("node", "output"), ("nodes.json", "info"), ("_SUCCESS", "success")]
    }


def test_log_lines_number_each_file(spark, limit, tmp_path):
    for name, count in (("a", 30), ("b", 5)):
        (tmp_path / name).write_text("\n".join(f"{name}{i}" for i in range(count)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")  # several splits per file
    try:
        got = logs.log_lines(spark, str(tmp_path), numbered=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.line[0], r.line_no, r.line[1:]) for r in got) == sorted(
        [("a", i + 1, str(i)) for i in range(30)] + [("b", i + 1, str(i)) for i in range(5)]
    )
    listed = logs.list_entries(spark, str(tmp_path), "a*").collect()
    assert [r.path.split("/")[-1] for r in listed] == ["a"]


def test_metric_flatten(spark):
    docs = [
        json.dumps({"metric": {"__name__": "up", "pod": "p"}, "values": [[1.5, "2"], [2.5, "x"]]}),
        json.dumps({"metric": {"__name__": "up", "az": "z"}, "values": [[3, "4"]]}),
    ]
    samples = metrics.parse_series(spark.createDataFrame([(d,) for d in docs], "json string"))
    flat = metrics.metric_flatten(samples)
    assert flat.columns == ["name", "timestamp", "value", "az", "pod"]
    assert rows_of(flat) == [("up", 1.5, 2.0, "", "p"), ("up", 2.5, None, "", "p"), ("up", 3.0, 4.0, "z", "")]


def test_metric_select_matches_whole_names(spark):
    rows = [("cpu", "a-1", "2024-01-02 00:00:00"), ("cpu_total", "a-1", "2024-01-02 00:00:00"),
            ("cpu", "b-1", "2024-01-02 00:00:00"), ("cpu", "a-1", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "name string, pod string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert metrics.metric_select(df, ["cpu"], "a-.*").count() == 1


def test_stage_events(spark, tmp_path):
    lines = [
        {"Event": "SparkListenerStageCompleted", "Stage Info": {
            "Stage ID": 3, "Submission Time": 10, "Completion Time": 20,
            "Accumulables": [{"ID": 1, "Name": "m", "Value": "5"}]}},
        {"Event": "SparkListenerJobStart"},
    ]
    (tmp_path / "log").write_text("\n".join(json.dumps(line) for line in lines))
    rows = eventlog.read_stages(spark, str(tmp_path)).collect()
    assert [(r.stage_id, r.submitted, r.completed, r.accumulables[0].Value) for r in rows] == [(3, 10, 20, "5")]


def test_catalog_and_selection(spark, tmp_path):
    (tmp_path / "c.csv").write_text('API Name,Memory,Intel AVX\nm5.large,8.0 GiB,Yes\nm5a.large,8.0 GiB,N/A\n')
    rows = catalog.read_catalog(spark, str(tmp_path), F.startswith("API Name", F.lit("m5.")))
    assert rows.columns == ["API_Name", "Memory", "Intel_AVX"] and rows_of(rows) == [("m5.large", "8.0", "1")]
    lines = spark.createDataFrame([('  Name:  "m5.large",',), ('  Name:  "m5a.large",',), ("x",)], "line string")
    supported = catalog.supported_types(lines)
    names = spark.createDataFrame([("m5.large",), ("m5a.large",), ("m5.metal",), ("c5.large",)], "api_name string")
    latest = catalog.select_instances(names, supported, *catalog.SELECTIONS["latest"])
    assert rows_of(latest) == [("m5.large",)]


def test_registry(spark):
    doc = {"sort": {"meta": {"name": "n", "app_type": "spark"}, "spec": {
        "before": {"scale_up": {"bucket": "b", "feature": "static", "min_value": "", "values": []}},
        "after": {"input_scale": {"bucket": "c", "feature": ["dataset_size"], "max_value": 10,
                                                                  "values": [1, 2]}}}}}
    got = registry.registry_flatten(spark.createDataFrame([(json.dumps(doc),)], "json string"))
    assert {(r.phase, r.dimension, r.feature, r.min_value, r.max_value, r["values"]) for r in got.collect()} == {
        ("before", "scale_up", "static", "", None, "[]"),
        ("after", "input_scale", '["dataset_size"]', None, "10", "[1,2]"),
    }


def test_feature_store(spark):
    path = scratch_path(spark, "store")
    rows = [("a", "r.1", "m:x", 1.0), ("a", "r.2", "m:x", 2.0), ("a", "r.1", "y", 3.0), ("b", "r", "z", 4.0)]
    df = spark.createDataFrame(rows, "app_id string, run_id string, feature string, value double")
    store.write_features(df.filter("app_id = 'a'"), path)
    store.write_features(df.filter("app_id = 'b'"), path)
    assert {r.app_id for r in store.list_apps(spark, path).collect()} == {"a", "b"}
    one = store.read_features(spark, path, "a", {"m_x"})
    assert sorted((r.run_id, r.value) for r in one.collect()) == [("r_1", 1.0), ("r_2", 2.0)]
    assert "PartitionFilters: [isnotnull(app_id" in one._jdf.queryExecution().toString()
    wide, skipped = store.load_wide(store.read_features(spark, path, "a"), ["m_x"])
    assert sorted((r.run_id, r.m_x) for r in wide.collect()) == [("r_1", 1.0), ("r_2", 2.0)]
    assert rows_of(skipped) == [("a", 0)]
    store.write_minimum(df.select("app_id", F.lit("y").alias("feature")).distinct(), path + "-minimum")
    stored = spark.read.parquet(path + "-minimum")
    wide, skipped = store.load_wide(store.read_features(spark, path, "a"), ["y"], stored)
    assert sorted((r.run_id, r.y) for r in wide.collect()) == [("r_1", 3.0)]
    assert rows_of(skipped) == [("a", 1)]
    # a log whose name the store normalised is known as parsed
    logs_ = spark.createDataFrame([("a", "r.1"), ("a", "r.9"), ("b", "r")], "app_id string, log_id string")
    known = store.read_features(spark, path).select("app_id", F.col("run_id").alias("log_id"))
    none = spark.createDataFrame([], "app_id string")
    assert rows_of(gates.unparsed_logs(logs_, known, none)) == [("a", "r.9")]
    assert store.drop_app(spark, path, "a")
    assert {r.app_id for r in store.list_apps(spark, path).collect()} == {"b"}


def test_store_of_many_apps(spark):
    """Many small apps share a bounded number of folders, and each is read and dropped alone."""
    n = 4 * store.BUCKETS
    df = spark.range(3 * n).selectExpr(f"concat('app-', id % {n}) AS app_id", "concat('r.', id) AS run_id",
                                       "'x' AS feature", "CAST(id AS double) AS value")
    df = df.unionByName(spark.createDataFrame([(None, "q", "x", 1.0), ("", "q", "x", 2.0)], df.schema))
    path = scratch_path(spark, "store")
    store.write_features(df, path)
    store.write_features(df.filter("app_id = 'app-7'"), path)
    places = lambda rows: {f.rsplit("/", 2)[1] for f in rows.inputFiles()}
    assert len(places(spark.read.parquet(path))) <= store.BUCKETS
    one = store.read_features(spark, path, "app-7")
    assert one.count() == 6
    assert "app_id_bucket" in one._jdf.queryExecution().toString().split("PartitionFilters: ")[1].split("]")[0]
    assert store.drop_app(spark, path, "app-7")
    assert not store.drop_app(spark, path, "app-7")
    left = rows_of(store.read_features(spark, path).select("app_id", "value"))
    assert left == rows_of(df.filter("app_id IS DISTINCT FROM 'app-7'").select("app_id", "value"))
    path = scratch_path(spark, "batches")
    assert batches.write_batch(df, path, "one")
    assert len(places(spark.read.parquet(f"{path}/rows"))) <= store.BUCKETS
    assert batches.read_batches(spark, path, "app-9").count() == 3


def test_feature_batches(spark):
    rows = [("a", "r.1", "x", 1.0), ("a", "r.1", "y", 1.0), ("a", "r.2", "x", 2.0), ("a", "r.2", "x", 2.5),
            ("a", "r.3", "x", 3.0), ("a", "r.3", "y", None), ("b", "q", "z", 4.0), (None, "q", None, 5.0)]
    df = spark.createDataFrame(rows, "app_id string, run_id string, feature string, value double")
    parts = {"one": "run_id = 'r.1'", "two": "run_id = 'r.2' OR run_id = 'q'", "three": "run_id = 'r.3'", "none": "false"}
    stored = rows_of(store.encode_features(df).select("app_id", "run_id", "feature", "value"))
    names = lambda found: sorted(map(repr, found))  # noqa: E731  (nulls do not sort)
    expected = names(rows_of(gates.min_feature_set(store.encode_features(df))))
    for order in (["one", "two", "three", "none"], ["none", "three", "one", "two"]):
        path = scratch_path(spark, "batches")
        for name in order:
            batches.stage_batch(df.filter(parts[name]), path)  # an attempt that never commits
            assert batches.write_batch(df.filter(parts[name]), path, name)
            assert not batches.write_batch(df, path, name)
        got = batches.read_batches(spark, path).select("app_id", "run_id", "feature", "value")
        assert names(rows_of(got)) == names(stored)
        assert names(rows_of(batches.min_feature_set(spark, path))) == expected
        assert batches.read_batches(spark, path, "b").count() == 1
        assert {r.batch for r in batches.committed(spark, path).collect()} == set(order)
    path = scratch_path(spark, "batches")
    batches.stage_batch(df, path)
    assert batches.read_batches(spark, path).count() == 0
    assert batches.min_feature_set(spark, path).count() == 0


def test_trials(spark):
    path = scratch_path(spark, "trials")
    df = spark.createDataFrame([("m", "t1", 1), ("m", "t2", 2)], "app string, trial string, qps int")
    store.write_trial(df, path)
    assert [r.qps for r in store.load_trial(spark, path, "m", "t2").collect()] == [2]


def test_scratch_follows_the_session(spark):
    old = spark.conf.get("spark.checkpoint.dir", None)
    if old:
        assert shared_dir(spark) == old.rstrip("/")
    else:
        assert scratch_path(spark, "x").startswith(shared_dir(spark))
