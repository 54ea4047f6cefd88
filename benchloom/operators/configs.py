"""Trial configurations: knobs to configurations to runs.

Knobs are tall, ``(trial, section, key, values)`` with ``values`` an array of
text, so any number of trials is expanded by one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from .ranks import join_null_safe
from .scans import running

TRIAL = ["trial"]
CONFIG = ["trial", "row"]

# What a trial must define.
REQUIRED_KEYS = ("tenancy", "logBucket", "resultBucket", "numRun")


def config_expand(knobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repeat single values to the longest list of the trial.

    Returns the expanded knobs and the trials rejected because one of their
    lists has another length.
    """
    size = F.size("values")
    longest = knobs.groupBy(*TRIAL).agg(F.max(size).alias("_longest"))
    sized = join_null_safe(knobs, longest, TRIAL, "inner")
    wrong = sized.filter((size != 1) & (size != F.col("_longest")))
    rejected = wrong.groupBy(*TRIAL).agg(F.count(F.lit(1)).alias("bad_knobs"))
    repeated = F.when(size == 1, F.array_repeat(F.col("values")[0], F.col("_longest"))).otherwise(
        F.col("values")
    )
    expanded = join_null_safe(sized, rejected.drop("bad_knobs"), TRIAL, "left_anti")
    return expanded.withColumn("values", repeated).drop("_longest"), rejected


def config_explode(expanded: DataFrame) -> DataFrame:
    """One row per (trial, configuration row, key) with its value."""
    others = [c for c in expanded.columns if c != "values"]
    return expanded.select(*others, F.posexplode("values").alias("row", "value"))


def cross_sample(knobs: DataFrame, count: int, seed: str = "0") -> DataFrame:
    """Sample ``count`` configurations per trial, without replacement, from all knob combinations.

    A combination is a number below the number of combinations, and its mixed-radix digits
    pick one value per knob (keys in name order).  The i-th sample is ``(a * i + b) mod total``
    with ``a`` and ``b`` from the MD5 of seed and trial, ``a`` raised until it shares no factor
    with ``total``: distinct numbers, without listing any others.  Knobs beyond the largest
    whole number a column holds get digits from the MD5 of seed, trial, i and key.
    """
    pools = knobs.groupBy(*TRIAL).agg(
        # One configuration's knobs: as many elements as the trial file has keys.
        F.sort_array(F.collect_list(F.struct("key", "values"))).alias("_knobs")
    )
    sizes = F.transform("_knobs", lambda k: F.size(k["values"]).cast("bigint"))
    upto = F.transform(
        sizes,
        lambda _s, i: F.aggregate(
            F.slice(sizes, F.lit(1), i + 1), F.lit(1).cast("bigint"), lambda a, n: F.try_multiply(a, n)
        ),
    )
    digest = scalars.order_key(seed, F.col("trial"))
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint")
    shares = lambda a: F.exists(  # noqa: E731  a factor with some size
        F.filter("_sizes", lambda s: s > 1),
        lambda s: F.exists(F.sequence(F.lit(2).cast("bigint"), s), lambda d: (s % d == 0) & (a % d == 0)),
    )
    found = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(1000)), lambda k: F.col("_a") + k), lambda a: ~shares(a)
    )
    drawn = (
        pools.withColumns({"_sizes": sizes, "_upto": upto})
        .withColumn("_total", F.array_max("_upto"))
        .withColumns({"_a": part(1) % F.col("_total"), "_b": part(16) % F.col("_total")})
        .withColumn("_a", F.get(found, 0))
        .withColumn("_i", F.explode(F.sequence(
            F.lit(0).cast("bigint"), F.least(F.lit(count).cast("bigint"), "_total") - 1)))
        .withColumn("combo", (
            (F.col("_a").cast("decimal(38,0)") * F.col("_i").cast("decimal(19,0)") + F.col("_b"))
            % F.col("_total")).cast("bigint"))
    )
    drawn = drawn.select(*TRIAL, "combo", "_i", F.inline(F.arrays_zip("_knobs", "_sizes", "_upto")))
    free = F.conv(F.substring(
        scalars.order_key(seed, F.col("trial"), F.col("_i"), F.col("_knobs.key")), 1, 15), 16, 10
    ).cast("bigint")
    digit = F.when(
        F.col("_upto").isNotNull(),
        F.expr("(combo div (_upto div _sizes)) % _sizes"),
    ).otherwise(free % F.col("_sizes"))
    return drawn.select(
        *TRIAL, "combo", F.col("_i").alias("sample"), F.col("_knobs.key").alias("key"),
        F.get(F.col("_knobs.values"), digit.cast("int")).alias("value"),
    )


def _digest() -> Column:
    pair = F.concat_ws("=", "key", F.coalesce("value", F.lit("None")))
    return F.md5(F.array_join(F.sort_array(F.collect_list(pair)), ";"))


def config_digests(cells: DataFrame, config: Sequence[str] = CONFIG) -> DataFrame:
    """Digest of each configuration, equal exactly when its key/value pairs are equal."""
    return cells.groupBy(*config).agg(_digest().alias("feature_digest"))


def config_runs(
    cells: DataFrame, config: Sequence[str] = CONFIG, available: DataFrame | None = None
) -> DataFrame:
    """One row per run: configuration, digest, run number and run path (``numRun`` times each).

    A run carries the ``logBucket`` and the ``debug`` flag (false if not set) of its
    configuration, and with ``available`` instance types its demand as a map from type to
    number.  The path names the whole configuration, so no two runs share it.  A configuration
    whose ``numRun`` is missing or no positive number, or whose resources are in error, has one
    row with ``problem`` (``numRun`` before ``resource``) and no run.
    """

    def setting(key: str, kind: str) -> Column:
        return F.max(F.when(F.col("key") == key, F.col("value").try_cast(kind)))

    runs = cells.groupBy(*config).agg(
        _digest().alias("feature_digest"),
        setting("numRun", "int").alias("_runs"),
        setting("logBucket", "string").alias("log_bucket"),
        F.coalesce(setting("debug", "boolean"), F.lit(False)).alias("debug"),
    )
    carried = ["feature_digest", "log_bucket", "debug"]
    good = F.coalesce(F.col("_runs") > 0, F.lit(False))
    problem = F.when(~good, "numRun")
    if available is not None:
        by_type = _role_rows(cells, available, config).groupBy(*config, "instance_type").agg(
            F.sum("n").alias("n"), F.max("error").alias("error")
        )
        pair = F.when(F.col("n").isNotNull(), F.struct("instance_type", "n"))
        needs = by_type.groupBy(*config).agg(
            F.max("error").alias("_wrong"), F.collect_list(pair).alias("_pairs")
        )
        usable = F.col("_wrong").isNull() & (F.size("_pairs") > 0)
        # only pairs that are used become a map: its keys must not be null
        demand = F.map_from_entries(F.when(usable, F.col("_pairs")))
        runs = join_null_safe(runs, needs, config, "left").withColumn("demand", demand)
        problem = problem.when(F.col("_wrong").isNotNull(), "resource")
        carried.append("demand")
    numbers = F.when(F.col("problem").isNull(), F.sequence(F.lit(0), F.greatest("_runs", F.lit(1)) - 1))
    path = scalars.run_path(*[F.col(c).cast("string") for c in (*config, "run")])
    return (
        runs.withColumn("problem", problem)
        .select(*config, *carried, "problem", F.explode_outer(numbers).alias("run"))
        .withColumn("run_id", F.when(F.col("run").isNotNull(), path))
    )


def _role_rows(cells: DataFrame, available: DataFrame, config: Sequence[str]) -> DataFrame:
    """Number, type and ``error`` of each role of a configuration's resources."""
    is_num = F.startswith("key", F.lit("num"))
    is_type = ~is_num & F.endswith("key", F.lit("Type"))
    role = F.lower(
        F.when(is_num, F.replace("key", F.lit("num"), F.lit(""))).otherwise(
            F.replace("key", F.lit("Type"), F.lit(""))
        )
    )
    roles = (
        cells.filter((F.col("section") == "resource") & (is_num | is_type))
        .groupBy(*config, role.alias("role"))
        .agg(
            F.max(F.when(is_num, F.col("value").try_cast("bigint"))).alias("n"),
            F.max(F.when(is_type, F.col("value"))).alias("instance_type"),
        )
    )
    known = available.select("instance_type", F.lit(True).alias("_known")).distinct()
    checked = join_null_safe(roles, known, ["instance_type"], "left")
    untyped = F.col("n").isNotNull() & F.col("instance_type").isNull()
    unknown = F.col("instance_type").isNotNull() & F.col("_known").isNull()
    error = F.when(untyped, "missing type").when(unknown, "unknown type")
    return checked.withColumn("error", error).drop("_known")


def instance_demand(
    cells: DataFrame, available: DataFrame, config: Sequence[str] = CONFIG
) -> tuple[DataFrame, DataFrame]:
    """Instances each configuration needs, by type, and the configurations in error.

    ``num<Role>`` counts pair with ``<Role>Type`` types.  An error is a count
    without type or a type that is not ``available`` (column ``instance_type``).
    """
    checked = _role_rows(cells, available, config)
    errors = checked.filter(F.col("error").isNotNull()).select(*config, "role", "error")
    fine = join_null_safe(
        checked.filter(F.col("n").isNotNull()), errors.select(*config).distinct(), config, "left_anti"
    )
    demand = fine.groupBy(*config, "instance_type").agg(F.sum("n").alias("num_instance"))
    return demand, errors


def config_missing(knobs: DataFrame, required: Sequence[str] = REQUIRED_KEYS) -> DataFrame:
    """(trial, key) for every required key a trial lacks."""
    wanted = knobs.select("trial").distinct().select(
        "trial", F.explode(F.array(*[F.lit(k) for k in required])).alias("key")
    )
    return join_null_safe(wanted, knobs.select("trial", "key"), ["trial", "key"], "left_anti")


def require_valid(knobs: DataFrame, required: Sequence[str] = REQUIRED_KEYS) -> DataFrame:
    """``knobs``, or an error naming some of what is missing."""
    missing = config_missing(knobs, required).limit(5).collect()
    if missing:
        raise ValueError(f"trial configuration lacks {[(r.trial, r.key) for r in missing]}")
    return knobs


def instance_groups(groups: DataFrame, keys: Sequence[str] = TRIAL, position: str = "position") -> DataFrame:
    """Groups without image or tenancy inherit them from the last group before that has them."""
    filled = running(
        groups.withColumnsRenamed({"image": "_image", "tenancy": "_tenancy"}),
        keys,
        position,
        latest={"image": F.col("_image"), "tenancy": F.col("_tenancy")},
    )
    return filled.drop("_image", "_tenancy")
