"""Exact ranks and percentiles per group, the same way for groups of any size.

Rows are range-partitioned by group and order, so that a group of any size spans as many
tasks as it needs and small groups share one.  The partitions are written once: their
number of rows per group turns local positions into ranks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on ``keys`` where null equals null; key columns appear once."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def _before(parts: DataFrame, keys: Sequence[str], amount: str, before: str, total: str):
    """Per group and partition: what the group's earlier partitions hold, and the whole group."""
    # One row per (group, partition): a group crosses partition borders only where it is large.
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_at_pid").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumns(
        {
            before: F.coalesce(F.sum(amount).over(earlier), F.lit(0)),
            total: F.sum(amount).over(group),
        }
    )


def with_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    rank: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in its group, and optionally the group size.

    ``order`` must end in a unique column: it makes the result deterministic and lets
    range partitioning split rows that are equal otherwise.
    """
    keys = list(keys)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    local = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_at_mid", F.monotonically_increasing_id())
    )
    # The ids depend on the sampled range bounds: fix them before using them twice.
    local = materialize(local, "ranged").withColumn("_at_pid", F.shiftright("_at_mid", 33))
    starts = local.groupBy(*keys, "_at_pid").agg(
        F.min("_at_mid").alias("_at_start"), F.count(F.lit(1)).alias("_at_rows")
    )
    offsets = _before(starts, keys, "_at_rows", "_at_before", "_at_total").drop("_at_rows")
    out = join_null_safe(local, offsets, [*keys, "_at_pid"], "inner").withColumn(
        rank, F.col("_at_mid") - F.col("_at_start") + F.col("_at_before") + 1
    )
    if total:
        out = out.withColumn(total, F.col("_at_total"))
    return out.drop("_at_mid", "_at_pid", "_at_start", "_at_before", "_at_total")


def first_share(
    df: DataFrame, keys: Sequence[str], digest: str, unique: Sequence[str], share: float
) -> DataFrame:
    """Adds ``_n``, the rows of the group, and ``_first``: is the row among the first ``_n * share``
    (rounded up) in the order of ``digest`` and ``unique``?

    ``digest`` is hex text that is spread evenly.  Rows are counted by group and the digest's first
    digits, which tells for all but one value of them on which side of the border the rows lie.
    Only the rows with that value are sorted, a 256th of them where groups are large.
    """
    keys = list(keys)
    dealt = df.withColumn("_at_digits", F.substring(digest, 1, 2))
    counts = dealt.groupBy(*keys, "_at_digits").agg(F.count(F.lit(1)).alias("_at_rows"))
    # At most 256 rows per window group.
    group = Window.partitionBy(*keys)
    upto = F.sum("_at_rows").over(group.orderBy("_at_digits"))
    counts = counts.withColumns({"_at_upto": upto, "_n": F.sum("_at_rows").over(group)})
    wanted = F.ceil(F.col("_n") * F.lit(float(share)))
    before = F.col("_at_upto") - F.col("_at_rows")
    border = (before < wanted) & (wanted <= F.col("_at_upto"))
    borders = materialize(
        counts.groupBy(*keys).agg(
            F.max("_n").alias("_n"),
            F.max(F.when(border, F.col("_at_digits"))).alias("_at_border"),
            F.max(F.when(border, wanted - before)).alias("_at_wanted"),
        ),
        "borders",
    )
    met = join_null_safe(dealt, borders, keys, "inner")
    # without a border (a share of 0) no row is among the first
    near = F.coalesce(F.col("_at_digits") == F.col("_at_border"), F.lit(False))
    sure = met.filter(~near).withColumn(
        "_first", F.coalesce(F.col("_at_digits") < F.col("_at_border"), F.lit(False)))
    ranked = with_rank(materialize(met.filter(near), "border-rows"), keys, [digest, *unique], "_at_rank")
    ranked = ranked.withColumn("_first", F.col("_at_rank") <= F.col("_at_wanted"))
    columns = [*df.columns, "_n", "_first"]
    return sure.select(*columns).unionByName(ranked.select(*columns))


def _percentile(p: float, value: str, interpolation: str) -> Column:
    """The percentile of a group whose rows are distinct values with their first rank."""
    exact = (F.col("_total") - 1) * F.lit(float(p))

    def at(position: Column) -> Column:
        held = (F.col("_first") <= position) & (position < F.col("_first") + F.col("_n"))
        return F.max(F.when(held, F.col(value)))

    if interpolation == "nearest":
        return at(F.bround(exact))
    low, high = at(F.floor(exact)), at(F.ceil(exact))
    share = F.max(exact - F.floor(exact))
    # equal ends are the answer themselves: infinities must not meet a zero share
    return F.when(low == high, low).otherwise(low * (1 - share) + high * share)


# How a partial aggregate of one distinct value is made and merged.
_MERGED = {
    "max": (F.max, F.max),
    "min": (F.min, F.min),
    "sum": (F.sum, F.sum),
    "count": (F.count, F.sum),
}


def group_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    interpolation: str = "linear",
    aggs: Sequence[Column] = (),
    merged: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Exact percentiles of ``value`` per group, together with any other aggregates.

    ``interpolation`` is ``linear`` or ``nearest`` (the sample whose index is
    (n - 1) * p rounded half to even).  Null values do not count as samples; the other
    aggregates see every row.  Without keys there is one row, also for an empty frame.

    Equal values are counted before anything is sorted, so a value that fills most of a
    group is one row.  The distinct values are range-partitioned by group and value and
    written once; the source is neither copied nor read again.  ``merged`` names aggregates
    that ride along as (``max``, ``min``, ``sum``, ``count`` or ``mean``, column).  Only free
    aggregates (``aggs``) read the source a second time.
    """
    one = not keys
    groups = ["_all"] if one else list(keys)
    rows = df.withColumn("_all", F.lit(1)) if one else df
    steps, results = {}, {}
    for name, (kind, column) in (merged or {}).items():
        for part in ("sum", "count") if kind == "mean" else (kind,):
            steps[f"_{name}_{part}"] = (part, column)
        results[name] = (
            F.try_divide(F.sum(f"_{name}_sum"), F.sum(f"_{name}_count")) if kind == "mean"
            else _MERGED[kind][1](f"_{name}_{kind}")
        )
    counts = (
        rows.groupBy(*groups, value)
        .agg(
            F.count(value).alias("_n"),  # 0 for the null value: it keeps its group
            *[_MERGED[part][0](column).alias(name) for name, (part, column) in steps.items()],
        )
        .repartitionByRange(*groups, value)
        .withColumn("_at_pid", F.spark_partition_id())
    )
    counts = materialize(counts, "values")
    parts = counts.groupBy(*groups, "_at_pid").agg(F.sum("_n").alias("_part"))
    offsets = _before(parts, groups, "_part", "_before", "_total").drop("_part")
    local = Window.partitionBy(*groups, "_at_pid").orderBy(value)
    upto = F.sum("_n").over(local.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = join_null_safe(
        counts.withColumn("_upto", upto), offsets, [*groups, "_at_pid"], "inner"
    ).withColumn("_first", F.col("_before") + F.col("_upto") - F.col("_n"))
    out = placed.groupBy(*keys).agg(
        *[column.alias(name) for name, column in results.items()],
        *[_percentile(p, value, interpolation).alias(n) for n, p in probs.items()],
    )
    if not aggs:
        return out
    free = df.groupBy(*keys).agg(*aggs)
    if one:  # one row on either side
        free, out = (side.withColumn("_all", F.lit(1)) for side in (free, out))
    return join_null_safe(free, out, groups, "left").drop("_all")
