import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchloom.operators.ranks import first_share, group_percentiles, with_rank
from benchloom.operators.scans import running

rng = random.Random(5)
# One group holds more than a third of the rows; one key is null.
DATA = [
    ("hot" if i % 5 < 2 else (None if i % 5 == 2 else f"g{i % 7}"), i, round(rng.random() * 20, 1))
    for i in range(120)
]
SCHEMA = "g string, id int, v double"


def groups():
    out = {}
    for g, i, v in DATA:
        out.setdefault(g, []).append((v, i))
    return out


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 1.0])
def test_first_share(spark, share):
    many = DATA + [("big", i, 0.0) for i in range(1000, 3000)] + [("twice", 9, 1.0)] * 2 + [("one", 1, 1.0)]
    rows = spark.createDataFrame(many, SCHEMA).withColumn("d", F.md5(F.col("id").cast("string")))
    ranked = with_rank(rows, ["g"], ["d", "id"], "r", "n").collect()
    want = sorted((str(r.g), r.id, r.n, r.r <= math.ceil(r.n * share)) for r in ranked)
    got = first_share(rows, ["g"], "d", ["id"], share)
    assert got.columns == [*rows.columns, "_n", "_first"]
    assert sorted((str(r.g), r.id, r._n, r._first) for r in got.collect()) == want


def test_rank_and_total(spark, limit):
    ranked = with_rank(spark.createDataFrame(DATA, SCHEMA), ["g"], [F.desc("v"), "id"], "r", "n")
    got = {(r.g, r.id): (r.r, r.n) for r in ranked.collect()}
    for g, cells in groups().items():
        for place, (_v, i) in enumerate(sorted(cells, key=lambda c: (-c[0], c[1])), 1):
            assert got[(g, i)] == (place, len(cells))


def test_global_rank(spark, limit):
    ranked = with_rank(spark.createDataFrame(DATA, SCHEMA), [], ["v", "id"], "r", "_total")
    got = sorted((r.r, r.v, r.id, r._total) for r in ranked.collect())
    assert [g[0] for g in got] == list(range(1, len(DATA) + 1))
    assert [(g[1], g[2]) for g in got] == sorted((v, i) for _g, i, v in DATA)
    assert {g[3] for g in got} == {len(DATA)}


def expected_percentile(values, p, nearest):
    values = sorted(values)
    at = (len(values) - 1) * p
    if nearest:
        return values[int(np.round(at))]
    low, high = math.floor(at), math.ceil(at)
    return values[low] + (values[high] - values[low]) * (at - low)


@pytest.mark.parametrize("interpolation", ["linear", "nearest"])
def test_percentiles(spark, limit, interpolation):
    probs = {"a": 0.05, "b": 0.5, "c": 0.95}
    df = spark.createDataFrame(DATA, SCHEMA)
    out = group_percentiles(df, ["g"], "v", probs, interpolation, [F.count("v").alias("n")])
    got = {r.g: r for r in out.collect()}
    for g, cells in groups().items():
        values = [v for v, _i in cells]
        assert got[g].n == len(values)
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(
                expected_percentile(values, p, interpolation == "nearest")
            )


@pytest.mark.parametrize("interpolation", ["linear", "nearest"])
def test_percentiles_skip_nulls_and_keep_groups(spark, limit, interpolation):
    rows = [("a", float(i)) for i in range(10)] + [("a", None)] * 9 + [("b", None)] * 9
    out = group_percentiles(
        spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"m": 0.5}, interpolation,
        [F.count(F.lit(1)).alias("n")],
    )
    got = {r.g: (r.m, r.n) for r in out.collect()}
    assert got["a"] == (4.5 if interpolation == "linear" else 4.0, 19)
    assert got["b"] == (None, 9)


def test_global_percentile(spark, limit):
    out = group_percentiles(spark.createDataFrame(DATA, SCHEMA), [], "v", {"q": 0.99})
    expected = expected_percentile([v for _g, _i, v in DATA], 0.99, False)
    assert out.first().q == pytest.approx(expected)


def test_percentiles_of_infinities_and_ties(spark, limit):
    inf = math.inf
    rows = [("i", v) for v in [1.0, inf, inf, inf, None]] + [("t", 5.0)] * 90
    rows += [("t", float(k)) for k in range(10)] + [("n", v) for v in [math.nan, 1.0, 2.0]]
    rows += [("m", -inf), ("m", 3.0), (None, 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"q": 0.25, "m": 0.5, "h": 0.99}
    out = group_percentiles(df, ["g"], "v", probs, aggs=[F.count(F.lit(1)).alias("n")])
    got = {r.g: (r.q, r.m, r.h, r.n) for r in out.collect()}
    assert got["i"] == (inf, inf, inf, 5)
    assert got["t"][:2] == (5.0, 5.0) and got["t"][3] == 100
    assert got["n"][1] == 2.0 and math.isnan(got["n"][2])
    assert got["m"][1] == -inf and got[None] == (7.0, 7.0, 7.0, 1)
    whole = group_percentiles(df, [], "v", {"m": 0.5}, aggs=[F.count(F.lit(1)).alias("n")]).first()
    assert (whole.m, whole.n) == (5.0, len(rows))
    none = group_percentiles(df.limit(0), [], "v", {"m": 0.5}, aggs=[F.count(F.lit(1)).alias("n")])
    assert [tuple(r) for r in none.collect()] == [(0, None)]


def test_aggregates_ride_along(spark, limit):
    rows = [("a", 2.0, 1), ("a", 2.0, 5), ("a", 8.0, 3), ("a", None, 9), ("b", None, None), (None, 1.0, 4)]
    df = spark.createDataFrame(rows, "g string, v double, o int")
    merged = {
        "top": ("max", "o"), "low": ("min", "o"), "all": ("sum", "o"), "n": ("count", "o"),
        "mean": ("mean", "v"), "mean_o": ("mean", "o"),
    }
    out = group_percentiles(df, ["g"], "v", {"m": 0.5}, merged=merged)
    assert out.columns == ["g", *merged, "m"]
    assert {tuple(r) for r in out.collect()} == {
        ("a", 9, 1, 18, 4, 4.0, 4.5, 2.0), ("b", None, None, None, 0, None, None, None),
        (None, 4, 4, 4, 1, 1.0, 4.0, 1.0),
    }
    whole = group_percentiles(df, [], "v", {"m": 0.5}, merged=merged).collect()
    assert [tuple(r) for r in whole] == [(9, 1, 22, 5, 3.25, 4.4, 2.0)]
    none = group_percentiles(df.limit(0), [], "v", {"m": 0.5}, merged=merged).collect()
    assert [tuple(r) for r in none] == [(None, None, None, None, None, None, None)]


def test_no_rows_meet_in_one_task(spark, limit):
    df = spark.createDataFrame(DATA, SCHEMA)
    plan = group_percentiles(df, ["g"], "v", {"m": 0.5})._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_running_state(spark, limit):
    df = spark.createDataFrame(DATA, SCHEMA)
    marked = F.when(F.col("v") > 12, F.col("v"))
    out = running(
        df, ["g"], "id",
        sums={"s": (F.col("v") > 5).cast("int")}, latest={"l": marked}, previous={"p": marked},
    )
    got = {(r.g, r.id): (r.s, r.l, r.p) for r in out.collect()}
    state = {}
    for g, i, v in DATA:
        total, last = state.get(g, (0, None))
        before = last
        total, last = total + (v > 5), v if v > 12 else last
        state[g] = (total, last)
        assert got[(g, i)] == (total, last, before)
