"""Benchmark output and result frames.

Parsers take tall lines, ``(run keys, line_no, line)``, and give one row per run.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from .features import run_stats
from .ranks import join_null_safe, with_rank
from .scans import running

# Measures that add up over load generators; others are averaged.
SUMMED = ("rps", "throughput")
# Bookkeeping columns of a result frame.
BOOKKEEPING = ("ins_type_num", "logBucket", "run_id", "nodes", "assigned", "numRun")
# Fixed value: links slower than this (microseconds) are tail links.
TAIL_LATENCY = 100.0


def _words() -> Column:
    return F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")


def _last(test: Column, value: Column) -> Column:
    """Value of the last line that passes the test."""
    return F.max_by(value, F.when(test, F.col("line_no")))


def parse_kv_bench(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key-value benchmark: read latencies, request rate and goodput, as text."""
    words = _words()
    kind = F.get(words, 0)
    starts = lambda p: F.startswith(kind, F.lit(p))
    read = kind == "read"
    second_last = F.try_element_at(words, F.lit(-2))
    return lines.groupBy(*keys).agg(
        _last(read, F.get(words, 1)).alias("avg_lat_read"),
        _last(read, F.get(words, 2)).alias("std_lat_read"),
        _last(read, F.get(words, 3)).alias("min_lat_read"),
        _last(read, F.get(words, 8)).alias("99th_lat_read"),
        _last(starts("Total"), F.get(words, 3)).alias("qps"),
        _last(starts("RX"), second_last).alias("rx_goodput"),
        _last(starts("TX"), second_last).alias("tx_goodput"),
    )


def parse_http_bench(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """HTTP benchmark: latency percentiles (ms), mean and deviation, rates.

    A histogram header starts the percentile section, a mean line the
    statistics section; lines count only in their own section.
    """
    has = lambda text: F.contains("line", F.lit(text))
    sections = running(
        lines,
        keys,
        "line_no",
        latest={"section": F.when(has("#[Mean"), "stat").when(has("HdrHistogram"), "cdf")},
    )
    cdf, stat = F.col("section") == "cdf", F.col("section") == "stat"
    words = _words()
    end = F.element_at(words, -1)
    duration = scalars.parse_duration_ms(end)
    at50 = cdf & has("50.000%")
    at75 = cdf & ~has("50.000%") & has("75.000%")
    at99 = cdf & ~has("50.000%") & ~has("75.000%") & has("99.000%")
    rate = scalars.parse_rate_mb(end)
    mean = stat & has("#[Mean")
    return sections.groupBy(*keys).agg(
        _last(at50, duration).alias("lat_50pc"),
        _last(at75, duration).alias("lat_75pc"),
        _last(at99, duration).alias("lat_99pc"),
        _last(stat & has("Requests/sec"), end.try_cast("double")).alias("rps"),
        _last(stat & has("Transfer/sec") & rate.isNotNull(), rate).alias("throughput"),
        _last(mean, scalars.parse_duration_ms(F.rtrim(F.get(words, 2), F.lit(",")))).alias("lat_mean"),
        _last(mean, scalars.parse_duration_ms(F.rtrim(F.get(words, 5), F.lit("]")))).alias("lat_std"),
    )


def parse_ingest_bench(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ingest benchmark: statistics over every ``Total time:`` value, -1 when there is none."""
    times = lines.filter(F.contains("line", F.lit("Total time:"))).select(
        *keys, F.get(_words(), 2).try_cast("double").alias("_time")
    )
    runs = lines.select(*keys).distinct()
    stats = run_stats(runs, times, keys, "_time")
    return stats.select(
        *keys, *[F.col(c).alias(f"query_latency_{c}") for c in stats.columns if c not in keys]
    )


def parse_ping(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest round trip (microseconds) of each link from its first summary line, else -1."""
    latency = scalars.ping_latency_us(F.col("line"))
    first = F.min_by(latency, F.when(latency.isNotNull(), F.col("line_no")))
    return lines.groupBy(*keys).agg(F.coalesce(first, F.lit(-1.0)).alias("lat_min_us"))


def parse_bench_json(documents: DataFrame, json: str = "json") -> DataFrame:
    """Execution time of the first result of a benchmark report."""
    time = F.get_json_object(json, "$.results[0].executionTime").try_cast("double")
    return documents.withColumn("real_jct", time).drop(json)


# ---- run inputs -----------------------------------------------------------------------

APP_CONFIG_SCHEMA = (
    "struct<app:struct<num_executor:int,batch_size:int,driver_memory:string,"
    "exp_configs:struct<rate:double,delay:double,loss:double>>,resource:map<string,int>>"
)


def app_config(documents: DataFrame, json: str = "json") -> DataFrame:
    """Chosen application settings and the (first) instance type with its count."""
    config = F.from_json(json, APP_CONFIG_SCHEMA)
    memory = F.rtrim(config["app"]["driver_memory"], F.lit("m")).try_cast("int")
    network = config["app"]["exp_configs"]
    complete = network["rate"].isNotNull()
    resource = F.get(F.map_entries(config["resource"]), 0)
    return documents.select(
        *[c for c in documents.columns if c != json],
        config["app"]["num_executor"].alias("num_executor"),
        config["app"]["batch_size"].alias("batch_size"),
        memory.alias("driver_memory"),
        network["rate"].alias("rate"),
        F.when(complete, network["delay"]).alias("delay"),
        F.when(complete, network["loss"]).alias("loss"),
        resource["key"].alias("instance_type"),
        resource["value"].alias("num_instance"),
    )


def bench_config(documents: DataFrame, json: str = "json") -> DataFrame:
    size = F.get_json_object(json, "$.common.numExamples").try_cast("bigint")
    return documents.withColumn("dataset_size", size).drop(json)


def merge_run(inputs: DataFrame, outputs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join input structs ``app``, ``bench``, ``resource`` with ``output`` and ``jct``, flattened."""
    merged = join_null_safe(inputs, outputs, keys, "inner")
    return merged.select(*keys, "app.*", "bench.*", "resource.*", "output.*", "jct")


def join_instances(
    runs: DataFrame, catalogue: DataFrame, on: str, threads: str | None = None, vcpus: str = "vCPUs"
) -> DataFrame:
    """Attach instance attributes by type; a negative thread count means all vCPUs.

    The catalogue is broadcast only if its measured size allows it.
    """
    out = runs.join(catalogue, on, "left")
    if threads:
        used = F.when(F.col(threads) < 0, F.col(vcpus)).otherwise(F.col(threads))
        out = out.withColumn(threads, used)
    return out


# ---- result frames --------------------------------------------------------------------


def client_rollup(
    clients: DataFrame, keys: Sequence[str], summed: Collection[str] = SUMMED
) -> DataFrame:
    """Combine the load generators of a run: sum rates, average everything else."""
    measures = [c for c in clients.columns if c not in keys]
    return clients.groupBy(*keys).agg(
        *[(F.sum(c) if c in summed else F.avg(c)).alias(c) for c in measures]
    )


def attach_link_latency(runs: DataFrame, links: DataFrame, keys: Sequence[str], latency: str) -> DataFrame:
    mean = links.groupBy(*keys).agg(F.avg(latency).alias("avg_client_server_lat"))
    return join_null_safe(runs, mean, keys, "left")


def version_regression(runs: DataFrame, tag: str, measures: Sequence[str], per_k: Collection[str] = ("qps",)):
    """Mean of each measure by version tag; request rates in thousands."""
    means = [
        (F.avg(m) / 1000 if m in per_k else F.avg(m)).alias(m) for m in measures
    ]
    return runs.groupBy(tag).agg(*means)


def trial_postproc(results: DataFrame, tenancy: Column | str, debug: bool = False) -> DataFrame:
    """Add the tenancy; drop bookkeeping and, unless debugging, ``debug_`` columns."""
    value = F.lit(tenancy) if isinstance(tenancy, str) else tenancy
    hidden = [c for c in results.columns if c.startswith("debug_") and not debug]
    return results.withColumn("tenancy", value).drop(*BOOKKEEPING, *hidden)


def to_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn text columns into numbers where every value parses; leave the others.

    One aggregate over all columns decides.
    """
    bad = df.agg(
        *[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in columns]
    ).first()
    return df.withColumns({c: F.col(c).cast("double") for c in columns if bad[c] == 0})


def unnest_columns(df: DataFrame) -> DataFrame:
    """Rows of parallel array columns (one cell per column holds the whole frame)."""
    arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    others = [c for c in df.columns if c not in arrays]
    return df.select(*others, F.inline(F.arrays_zip(*arrays)))


def valid_latencies(links: DataFrame, latency: str = "lat") -> DataFrame:
    """Rows whose latency is a number."""
    number = F.col(latency).try_cast("double")
    return links.withColumn(latency, number).filter(F.col(latency).isNotNull())


def mesh_rows(links: DataFrame, configs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Link measurements with the knobs of their run on every row."""
    return join_null_safe(links, configs, keys, "inner")


def measured_pairs(links: DataFrame, keys: Sequence[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """Unordered node pairs that were measured, each once; a node with itself is no pair."""
    return (
        links.filter(F.col(src) != F.col(dst))
        .groupBy(*keys, F.least(src, dst).alias("node_a"), F.greatest(src, dst).alias("node_b"))
        .agg(F.count(F.lit(1)).alias("samples"))
    )


def bipartite_zip(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence, right_order: Sequence
) -> DataFrame:
    """Pair the i-th left row with the i-th right row of each run; the longer side's rest is left out."""
    ranked_left = with_rank(left, keys, left_order, "position")
    ranked_right = with_rank(right, keys, right_order, "position")
    return join_null_safe(ranked_left, ranked_right, [*keys, "position"], "inner")


def remap_destinations(links: DataFrame, addresses: DataFrame, dst: str = "dst") -> DataFrame:
    """Replace external destination addresses by internal ones (``external``, ``internal``).

    A link to an unknown address stays, with ``known`` false and no destination.
    """
    named = addresses.select(F.col("external").alias(dst), "internal", F.lit(True).alias("known"))
    return (
        links.join(named, dst, "left")
        .withColumns({dst: F.col("internal"), "known": F.coalesce("known", F.lit(False))})
        .drop("internal")
    )


def good_nodes(links: DataFrame, latency: str = "lat", above: float = TAIL_LATENCY) -> DataFrame:
    """Nodes that are both source and destination of some link that is not a tail link."""
    low = links.filter(F.col(latency) <= above)
    return low.select(F.col("src").alias("node")).intersect(low.select(F.col("dst").alias("node")))


def never_in_tail(links: DataFrame, latency: str = "lat", above: float = TAIL_LATENCY) -> DataFrame:
    """Nodes without any tail link, the stricter reading of :func:`good_nodes`."""
    ends = links.select(
        F.explode(F.array("src", "dst")).alias("node"), (F.col(latency) > above).alias("_tail")
    )
    return ends.groupBy("node").agg(F.max("_tail").alias("_tail")).filter(~F.col("_tail")).select("node")


def best_by_component(trials: DataFrame, score: str = "mean_accuracy") -> DataFrame:
    """Best score of each component count, as an error in percent."""
    return trials.groupBy("num_component").agg((F.max(score) * -100).alias("error_percent"))


def labels_by_x(rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Distribution of labels of each distinct feature vector: one row per distinct label."""
    return rows.groupBy(*features, label).agg(F.count(F.lit(1)).alias("copies"))


def parsed_by_type(rows: DataFrame, keys: Sequence[str] = ("app_id", "API_Name")) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def random_partition(logs: DataFrame, keys: Sequence[str], unique: Sequence[str], parts: int, seed: str = "0"):
    """Assign each log of an app to one of ``parts`` near-equal random parts (from 0)."""
    order = scalars.order_key(seed, *[F.col(c) for c in (*keys, *unique)])
    ranked = with_rank(logs.withColumn("_order", order), keys, ["_order", *unique], "_rank", "_n")
    # The first n % parts parts hold one more log than the others.
    small = F.floor(F.col("_n") / parts)
    big_rows = (F.col("_n") % parts) * (small + 1)
    place = F.col("_rank") - 1
    part = F.when(place < big_rows, F.floor(place / (small + 1))).otherwise(
        F.col("_n") % parts + F.floor((place - big_rows) / F.greatest(small, F.lit(1)))
    )
    return ranked.withColumn("part", part.cast("int")).drop("_order", "_rank", "_n")


def sample_rows(rows: DataFrame, unique: Sequence[str], count: int, seed: str = "0") -> DataFrame:
    """``count`` rows in reproducible random order; a top-n, so no full sort."""
    order = scalars.order_key(seed, *[F.col(c) for c in unique])
    return rows.orderBy(order, *unique).limit(count)


def row_limit(rows: DataFrame, unique: Sequence[str], count: int) -> DataFrame:
    """Exactly the first ``count`` rows in key order."""
    return rows.orderBy(*unique).limit(count)


def top_candidates(scores: DataFrame, order: Sequence[str], n: int = 1) -> DataFrame:
    """The ``n`` best settings by mean score, with standard deviation; ties go by ``order``."""
    # A top-n first: ranks of the kept rows do not depend on the others.
    best = scores.orderBy(F.desc("mean_test_score"), *order).limit(n)
    return with_rank(best, [], [F.desc("mean_test_score"), *order], "rank")
