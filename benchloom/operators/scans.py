"""Running state over ordered rows (logs), the same way for logs of any length.

Every log is cut into chunks of consecutive positions: windows run inside the chunks
and the state at the end of each chunk is carried into the later ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ranks import join_null_safe

CHUNK_ROWS = 100_000  # positions of a log that one task orders


def running(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    sums: Mapping[str, Column] | None = None,
    latest: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running columns per group in ``position`` order.

    ``position`` is an integer unique in its group and roughly dense (a line
    number).  ``sums`` are inclusive running sums, ``latest`` the last non-null
    value up to this row, ``previous`` the last non-null value before it.
    """
    sums, latest, previous = dict(sums or {}), dict(latest or {}), dict(previous or {})
    keys = list(keys)
    fed = df.select(
        "*",
        *[e.alias(f"_in_{n}") for n, e in {**sums, **latest, **previous}.items()],
    )
    fed = materialize(
        fed.withColumn("_chunk", F.floor(F.col(position) / F.lit(CHUNK_ROWS))), "scanned"
    )
    parts = [*keys, "_chunk"]
    ordered = Window.partitionBy(*parts).orderBy(position)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)

    local = {n: F.sum(f"_in_{n}").over(upto) for n in sums}
    local |= {n: F.last(f"_in_{n}", ignorenulls=True).over(upto) for n in latest}
    local |= {n: F.last(f"_in_{n}", ignorenulls=True).over(before) for n in previous}
    inputs = [f"_in_{n}" for n in local]
    out = fed.select("*", *[e.alias(n) for n, e in local.items()])

    def end_state(name):
        cell = F.col(f"_in_{name}")
        if name in sums:
            return F.sum(cell)
        return F.max_by(cell, F.when(cell.isNotNull(), F.col(position)))

    ends = fed.groupBy(*parts).agg(*[end_state(n).alias(f"_end_{n}") for n in local])
    # One row per chunk: the window below is CHUNK_ROWS times smaller than the log.
    earlier = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = ends.select(
        *parts,
        *[
            (
                F.sum(f"_end_{n}").over(earlier)
                if n in sums
                else F.last(f"_end_{n}", ignorenulls=True).over(earlier)
            ).alias(f"_carry_{n}")
            for n in local
        ],
    )
    joined = join_null_safe(out, carried, parts, "inner")
    merged = {
        n: (
            F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_carry_{n}"), F.lit(0))
            if n in sums
            else F.coalesce(F.col(n), F.col(f"_carry_{n}"))
        )
        for n in local
    }
    return joined.withColumns(merged).drop(
        *inputs, "_chunk", *[f"_carry_{n}" for n in local]
    )
