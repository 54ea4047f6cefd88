"""Nearest neighbours without comparing all pairs: sorting on one feature, cells on several."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ranks import join_null_safe, with_rank
from .scans import running


def nearest(
    train: DataFrame, queries: DataFrame, keys: Sequence[str], x: str, unique: Sequence[str], k: int
) -> DataFrame:
    """The ``k`` train rows nearest to each distinct query value, within its group.

    Returns the train columns with ``query``, ``distance`` and ``place`` (1 is
    nearest).  At equal distance smaller values come first; equal values come in
    ``unique`` order above the query and in reverse order below it.

    Train rows are numbered in ``x`` order.  The neighbours of a value lie among
    the k positions before and the k positions after its insertion point, so each
    query meets at most 2k rows.
    """
    keys = list(keys)
    numbered = with_rank(train.filter(F.col(x).isNotNull()), keys, [x, *unique], "_pos")
    # Distinct values of both sides; the running row count gives the insertion point.
    sides = train.select(*keys, F.col(x).alias("_x"), F.lit(1).alias("_n"), F.lit(False).alias("_query"))
    asked = queries.select(*keys, F.col(x).alias("_x"), F.lit(0).alias("_n"), F.lit(True).alias("_query"))
    values = (
        sides.unionByName(asked)
        .filter(F.col("_x").isNotNull())
        .groupBy(*keys, "_x")
        .agg(F.sum("_n").alias("_n"), F.max("_query").alias("_query"))
    )
    ordered = with_rank(values, keys, ["_x"], "_at")
    placed = running(ordered, keys, "_at", sums={"_upto": F.col("_n")})
    before = F.col("_upto") - F.col("_n")
    candidates = placed.filter("_query").select(
        *keys,
        F.col("_x").alias("query"),
        F.explode(F.sequence(F.greatest(before - (k - 1), F.lit(1)), before + k)).alias("_pos"),
    )
    met = join_null_safe(candidates, numbered, [*keys, "_pos"], "inner").withColumn(
        "distance", F.abs(F.col(x) - F.col("query"))
    )
    above = F.col(x) >= F.col("query")
    order = [F.col("distance"), above, F.when(above, F.col("_pos")).otherwise(-F.col("_pos"))]
    # At most 2k rows per window group.
    place = F.row_number().over(Window.partitionBy(*keys, "query").orderBy(*order))
    return met.withColumn("place", place).filter(F.col("place") <= k).drop("_pos")


def outermost(rows: DataFrame, keys: Sequence[str], x: str, unique: Sequence[str], k: int) -> DataFrame:
    """The first and the last ``k`` rows of each value of ``x``, in ``unique`` order.

    No other row can be among the ``k`` nearest of any query: values above a query are met from
    their first row on, values below it from their last row back.  Tasks leave out rows before
    anything is shuffled.
    """
    value = [*keys, x]
    order = [*unique, *[c for c in rows.columns if c not in {*value, *unique}]]
    numbered = lambda *by: rows.withColumn(
        "_nth", F.row_number().over(Window.partitionBy(*value).orderBy(*by))).filter(F.col("_nth") <= k)
    first = numbered(*order)
    last = numbered(*[F.desc(c) for c in order])
    counts = rows.groupBy(*value).agg(F.count(F.lit(1)).alias("_rows"))
    # of a value with fewer than 2k rows none comes twice
    last = join_null_safe(last, counts, value, "inner").filter(F.col("_rows") - F.col("_nth") >= k)
    return first.drop("_nth").unionByName(last.drop("_nth", "_rows"))


def weighted_label(y: Column, distance: Column, weights: str) -> Column:
    """Aggregate: mean label, or labels weighted by inverse distance.

    With distance weights, rows at distance 0 decide alone if there are any.
    """
    if weights == "uniform":
        return F.avg(y)
    exact = F.avg(F.when(distance == 0, y))
    near = F.try_divide(F.sum(F.try_divide(y, distance)), F.sum(F.try_divide(F.lit(1.0), distance)))
    return F.coalesce(exact, near)


def knn_regress(
    train: DataFrame,
    test: DataFrame,
    x: str,
    y: str,
    unique: Sequence[str],
    k: int = 5,
    weights: Mapping[str, str] | str = "uniform",
    keys: Sequence[str] = (),
) -> DataFrame:
    """``test`` with a ``prediction`` from its k nearest train rows.

    ``weights`` may map several column names to weightings; one search serves all.
    """
    named = {"prediction": weights} if isinstance(weights, str) else weights
    found = nearest(train.select(*keys, *unique, x, y), test.select(*keys, x), keys, x, unique, k)
    predicted = found.groupBy(*keys, F.col("query").alias(x)).agg(
        *[weighted_label(F.col(y), F.col("distance"), w).alias(n) for n, w in named.items()]
    )
    return join_null_safe(test, predicted, [*keys, x], "left")


# ---- several features ------------------------------------------------------------------

BITS = 48      # finest grid: 2 ** 48 steps of a feature's range
STEP = 4       # digits of the cell code per level: a cell has at most 16 children
LEAF = 32      # a cell with at most so many different vectors is not divided


def _finite(columns: Sequence[str]) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return test


def _coded(vectors: DataFrame, keys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """Adds ``_code``: the binary digits of the scaled features, interleaved, coarse ones first."""
    ranges = vectors.groupBy(*keys).agg(
        *[f(x).alias(f"_{n}_{x}") for x in xs for n, f in (("low", F.min), ("high", F.max))]
    )
    coded = join_null_safe(vectors, ranges, keys, "inner")
    digits = []
    for x in xs:
        low, high = F.col(f"_low_{x}"), F.col(f"_high_{x}")
        # halves, so that the width of the widest range is finite
        share = F.coalesce(F.try_divide(F.col(x) / 2 - low / 2, high / 2 - low / 2), F.lit(0.0))
        step = F.least(F.floor(share * float(1 << BITS)), F.lit((1 << BITS) - 1).cast("bigint"))
        digits.append(F.lpad(F.bin(step), BITS, "0"))
    code = F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.lit(BITS)), lambda i: F.concat(*[F.substring(d, i, F.lit(1)) for d in digits])
        ),
        "",
    )
    return coded.withColumn("_code", code).drop(*[f"_{n}_{x}" for x in xs for n in ("low", "high")])


def _nearer(frontier: DataFrame, asked: Sequence[str], xs: Sequence[str], k: int) -> DataFrame:
    """Drops the cells of a query that cannot hold one of its ``k`` nearest rows.

    The boxes whose farthest corners are nearest hold k rows together, so the k-th row is no
    farther than the last of those corners; what begins beyond it is dropped.  Rounding is
    monotone, so the bounds hold for the computed distances too.
    """
    nearest_corner = farthest_corner = F.lit(0.0)
    for x in xs:
        q, low, high = F.col(f"_q_{x}"), F.col(f"_low_{x}"), F.col(f"_high_{x}")
        gap = F.greatest(low - q, q - high, F.lit(0.0))
        reach = F.greatest(F.abs(q - low), F.abs(q - high))
        nearest_corner, farthest_corner = nearest_corner + gap * gap, farthest_corner + reach * reach
    query = Window.partitionBy(*asked)
    upto = F.sum("_n").over(query.orderBy("_far"))
    return (
        frontier.withColumns({"_near": nearest_corner, "_far": farthest_corner})
        .withColumn("_upto", upto)
        .withColumn("_reach", F.min(F.when(F.col("_upto") >= k, F.col("_far"))).over(query))
        .filter(F.col("_reach").isNull() | (F.col("_near") <= F.col("_reach")))
        .drop("_far", "_upto", "_reach")
    )


def nearest_vectors(
    train: DataFrame,
    queries: DataFrame,
    keys: Sequence[str],
    xs: Sequence[str],
    unique: Sequence[str],
    k: int,
) -> DataFrame:
    """The ``k`` train rows nearest to each distinct query vector, within its group.

    Returns the train columns with ``_q_<x>`` (the query), ``distance`` (Euclidean) and
    ``place``.  At equal distance smaller vectors come first, by ``xs`` in turn, then rows in
    ``unique`` order.  Rows and queries with a null, NaN or infinite feature take no part; a
    group with fewer than ``k`` rows gives all it has.  Features count as doubles.

    No query meets all rows.  Vectors lie in a tree of cells, each with its bounding box and
    number of rows.  All queries descend together, a level per step: cells with many vectors
    are replaced by their children, and cells that boxes and counts rule out are dropped.  A
    query keeps a few cells around itself, however its group is spread: crowded cells are
    divided on, and of equal vectors only the first ``k`` rows are kept.  Made for a few
    features; with many, boxes rule out little.
    """
    keys, xs, unique = list(keys), list(xs), list(unique)
    if not keys:
        one = [side.withColumn("_all", F.lit(1)) for side in (train, queries)]
        return nearest_vectors(*one, ["_all"], xs, unique, k).drop("_all")
    asked = [*keys, *[f"_q_{x}" for x in xs]]
    double = {x: F.col(x).cast("double") + 0.0 for x in xs}  # one zero only
    rows = with_rank(train.withColumns(double).filter(_finite(xs)), [*keys, *xs], unique, "_nth")
    rows = rows.filter(F.col("_nth") <= k)
    vectors = materialize(
        _coded(rows.groupBy(*keys, *xs).agg(F.count(F.lit(1)).alias("_n")), keys, xs), "vectors"
    )
    points = queries.withColumns(double).filter(_finite(xs)).select(
        *keys, *[F.col(x).alias(f"_q_{x}") for x in xs]
    ).distinct()

    def cells(level: int) -> DataFrame:
        digits = level * STEP
        return (
            vectors.withColumn("_cell", F.substring("_code", 1, digits))
            .groupBy(*keys, "_cell")
            .agg(
                F.sum("_n").alias("_n"),
                F.count(F.lit(1)).alias("_vectors"),
                *[f(x).alias(f"_{n}_{x}") for x in xs for n, f in (("low", F.min), ("high", F.max))],
            )
            .withColumn("_parent", F.substring("_cell", 1, max(0, digits - STEP)))
            .withColumn("_level", F.lit(level))
        )

    last = -(-BITS * len(xs) // STEP)
    # Level 0: one cell per group.
    root = cells(0).drop("_parent")
    frontier = materialize(join_null_safe(points, root, keys, "inner"), "frontier")
    for level in range(1, last + 1):
        open_ = frontier.filter((F.col("_level") == level - 1) & (F.col("_vectors") > LEAF))
        if open_.isEmpty():
            break
        met = join_null_safe(
            open_.select(*asked, F.col("_cell").alias("_parent")), cells(level), [*keys, "_parent"], "inner"
        ).drop("_parent")
        kept = frontier.filter((F.col("_level") < level - 1) | (F.col("_vectors") <= LEAF)).drop("_near")
        frontier = materialize(_nearer(kept.unionByName(met), asked, xs, k), "frontier")
    # The vectors of the cells that are left, each as a cell of its own.
    levels = [r[0] for r in frontier.select("_level").distinct().collect()]  # at most last + 1
    found = None
    for level in sorted(levels) or [0]:
        inside = vectors.withColumn("_cell", F.substring("_code", 1, level * STEP)).drop("_code")
        own = frontier.filter(F.col("_level") == level).select(*asked, "_cell")
        met = join_null_safe(own, inside, [*keys, "_cell"], "inner")
        found = met if found is None else found.unionByName(met)
    boxes = found.withColumns({f"_{n}_{x}": F.col(x) for x in xs for n in ("low", "high")})
    near = _nearer(boxes, asked, xs, k).select(*asked, *xs, "_near")
    met = join_null_safe(near, rows.drop("_nth"), [*keys, *xs], "inner")
    order = Window.partitionBy(*asked).orderBy("_near", *xs, *unique)
    return (
        met.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= k)
        .withColumn("distance", F.sqrt("_near"))
        .drop("_near")
    )


def knn_regress_vectors(
    train: DataFrame,
    test: DataFrame,
    xs: Sequence[str],
    y: str,
    unique: Sequence[str],
    k: int = 5,
    weights: Mapping[str, str] | str = "uniform",
    keys: Sequence[str] = (),
) -> DataFrame:
    """``test`` with a ``prediction`` from its k nearest train rows on several features.

    Like ``knn_regress``; a test row with a null or non-finite feature, or whose group has no
    train row, gets null.
    """
    named = {"prediction": weights} if isinstance(weights, str) else weights
    xs = list(xs)
    found = nearest_vectors(train.select(*keys, *unique, *xs, y), test.select(*keys, *xs), keys, xs, unique, k)
    predicted = found.groupBy(*keys, *[f"_q_{x}" for x in xs]).agg(
        *[weighted_label(F.col(y), F.col("distance"), w).alias(n) for n, w in named.items()]
    )
    points = [f"_q_{x}" for x in xs]
    asked = test.withColumns({f"_q_{x}": F.col(x).cast("double") + 0.0 for x in xs})
    return join_null_safe(asked, predicted, [*keys, *points], "left").drop(*points)
