"""Regressors and their tuning."""

from __future__ import annotations

import itertools
import logging
import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import ArithmeticException, IllegalArgumentException
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import errors, scalars
from ..session import materialize
from . import trees
from .neighbours import nearest, outermost, weighted_label
from .ranks import first_share, join_null_safe

# Forest grid of the tuning step.  None lets a tree grow to its end.
FOREST_GRID = {
    "bootstrap": (True, False),
    "maxDepth": (1, 10, 100, None),
    "featureSubsetStrategy": ("all", "sqrt"),
    "minInstancesPerNode": (1, 10),
    "minInstancesToSplit": (2, 10),
    "numTrees": (1, 10, 100),
}
# And of the linear support vector family.
SVR_GRID = {
    "C": (0.01, 0.05, 0.1, 0.5, 1.0, 2.0),
    "epsilon": (0.01, 0.05, 0.1, 0.5, 1.0, 2.0),
}


def settings(grid: dict[str, Sequence]) -> list[dict]:
    """Every combination of a grid's values."""
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def assemble(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    rows = df.withColumn("label", F.col(label).cast("double"))
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)


def linear(fit_intercept: bool = True) -> LinearRegression:
    """Ordinary least squares by the normal equation."""
    return LinearRegression(solver="normal", fitIntercept=fit_intercept)


def forest(n_trees: int = 100, depth: int = 2, seed: int = 42, **params) -> RandomForestRegressor:
    """Random forest over all features; ``leafCol`` gives the leaf of every tree."""
    return RandomForestRegressor(
        numTrees=n_trees, maxDepth=depth, seed=seed, leafCol="leaf",
        **{"featureSubsetStrategy": "all", **params},
    )


# A forest keeps a count per tree with every row, about 500 bytes for 100 trees.
FIT_ROWS = 500_000


def fit(estimator, rows: DataFrame):
    """Fit on persisted rows: estimators pass over their input several times.

    Rows are dealt anew only where partitions hold more than ``FIT_ROWS`` of them.
    """
    data = rows.select("features", "label")
    parts = -(-data.count() // FIT_ROWS)
    data = (data.repartition(parts) if parts > data.rdd.getNumPartitions() else data).persist()
    try:
        return estimator.fit(data)
    finally:
        data.unpersist()


# ---- constants as models --------------------------------------------------------------


def predict_best_possible(df: DataFrame, x: Sequence[str], y: str) -> DataFrame:
    """Per feature vector, the constant with the least squared relative error."""
    inverse = F.try_divide(F.lit(1.0), F.col(y))
    best = df.groupBy(*x).agg(
        F.try_divide(F.sum(inverse), F.sum(inverse * inverse)).alias("prediction")
    )
    return join_null_safe(df, best, list(x), "inner")


def predict_naive(df: DataFrame, y: str, train: DataFrame | None = None) -> DataFrame:
    """The mean label (of ``train`` if given) for every row."""
    mean = (train if train is not None else df).agg(F.avg(y)).scalar()
    return df.withColumn("prediction", mean)


def predict_line(train: DataFrame, test: DataFrame, x: str, y: str) -> DataFrame:
    """``test`` with the least-squares line of one feature, from one aggregate of ``train``."""
    slope = train.agg(F.regr_slope(y, x)).scalar()
    offset = train.agg(F.regr_intercept(y, x)).scalar()
    return test.withColumn("prediction", slope * F.col(x) + offset)


# A feature whose variance is this small a share of it once the earlier ones are taken out
# depends on them (or is constant) and gets weight 0.
DEPENDENT = 1e-10


def least_squares(
    train: DataFrame, keys: Sequence[str], features: Sequence[str], label: str
) -> DataFrame:
    """Least squares on several features for every key, in one aggregate and one plan.

    Returns ``keys``, ``weights`` (in the order of ``features``), ``intercept`` and ``n``.
    The covariances of a key merge from partial aggregates, so no key is too big; elimination
    runs in column expressions, a projection per feature.  Rows with a null or a value that is
    not finite in a feature or the label take no part; a key without others is left out.
    Constant and dependent features have weight 0.  Without keys there is one row, if any.
    """
    count = len(features)
    number = {**{i: F.col(f).cast("double") for i, f in enumerate(features)}, count: F.col(label).cast("double")}
    usable = reduce(lambda a, b: a & b, [F.abs(c) < float("inf") for c in number.values()])
    rows = train.filter(usable).select(*keys, *[c.alias(f"_x{i}") for i, c in number.items()])
    names = [
        (i, j) for i in range(count) for j in range(i, count + 1)
    ]  # upper triangle; column ``count`` is the label
    state = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f"_x{i}").alias(f"_m{i}") for i in number],
        *[F.covar_pop(f"_x{i}", f"_x{j}").alias(f"_a{i}_{j}") for i, j in names],
    ).filter("n > 0").withColumns({f"_v{i}": F.col(f"_a{i}_{i}") for i in range(count)})
    for p in range(count):
        # a dependent feature takes nothing from the later ones
        free = F.col(f"_a{p}_{p}") > DEPENDENT * F.col(f"_v{p}")
        state = state.withColumns({
            f"_f{p}_{j}": F.when(free, F.col(f"_a{p}_{j}") / F.col(f"_a{p}_{p}")).otherwise(0.0)
            for j in range(p + 1, count + 1)
        })
        state = state.withColumns({
            f"_a{i}_{j}": F.col(f"_a{i}_{j}") - F.col(f"_a{p}_{i}") * F.col(f"_f{p}_{j}")
            for i, j in names if i > p
        })
    for p in reversed(range(count)):
        later = [F.col(f"_f{p}_{j}") * F.col(f"_w{j}") for j in range(p + 1, count)]
        state = state.withColumn(f"_w{p}", reduce(lambda a, b: a - b, later, F.col(f"_f{p}_{count}")))
    weights = [F.col(f"_w{i}") for i in range(count)]
    offset = reduce(
        lambda a, i: a - weights[i] * F.col(f"_m{i}"), range(count), F.col(f"_m{count}")
    )
    return state.select(*keys, F.array(*weights).alias("weights"), offset.alias("intercept"), "n")


def predict_linear(
    train: DataFrame, test: DataFrame, keys: Sequence[str], features: Sequence[str], label: str
) -> DataFrame:
    """``test`` with the ``prediction`` of its key's :func:`least_squares`.

    Null for a key without training rows and where a feature is null.
    """
    fitted = least_squares(train, keys, features, label).select(
        *keys, F.col("weights").alias("_weights"), F.col("intercept").alias("_intercept")
    )
    met = (
        join_null_safe(test, fitted, list(keys), "left") if keys
        else test.join(fitted, F.lit(True), "left")  # one row
    )
    total = reduce(
        lambda a, i: a + F.get("_weights", F.lit(i)) * F.col(features[i]), range(len(features)),
        F.col("_intercept"),
    )
    return met.withColumn("prediction", total).drop("_weights", "_intercept")


def baseline_mean(train: DataFrame, test: DataFrame, y: str) -> DataFrame:
    """Relative root mean squared error of predicting the training mean."""
    predicted = predict_naive(test, y, train)
    return predicted.agg(errors.rrmse(F.col(y), F.col("prediction")).alias("rrmse"))


# ---- linear support vector regression -------------------------------------------------


def fit_svr_linear(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    c: float = 1.0,
    epsilon: float = 0.1,
    iterations: int = 60,
    rate: float = 0.5,
) -> dict[str, float]:
    """Weights and ``intercept`` minimising |w|²/2 + C · Σ max(0, |error| - ε).

    Full-batch sub-gradient descent with averaged iterates; a step is one
    aggregate over the rows.  Features should be scaled.
    """
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features],
                     F.col(label).cast("double").alias("_y")).persist()
    try:
        count = rows.count()
        weights, bias = {f: 0.0 for f in features}, 0.0
        mean_w, mean_b, kept = {f: 0.0 for f in features}, 0.0, 0
        for step in range(1, iterations + 1):
            predicted = reduce(
                lambda a, f: a + F.col(f) * F.lit(weights[f]), features, F.lit(bias)
            )
            error = F.col("_y") - predicted
            side = F.when(F.abs(error) > epsilon, F.signum(error)).otherwise(F.lit(0.0))
            pull = rows.agg(
                F.sum(side).alias("_b"), *[F.sum(side * F.col(f)).alias(f) for f in features]
            ).first()
            size = rate / math.sqrt(step)
            for f in features:
                weights[f] -= size * (weights[f] / (c * count) - pull[f] / count)
            bias += size * pull["_b"] / count
            if step > iterations // 2:
                kept += 1
                mean_b += (bias - mean_b) / kept
                for f in features:
                    mean_w[f] += (weights[f] - mean_w[f]) / kept
    finally:
        rows.unpersist()
    return {**mean_w, "intercept": mean_b}


def apply_linear(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    terms = [F.col(f) * F.lit(w) for f, w in weights.items() if f != "intercept"]
    return df.withColumn("prediction", reduce(lambda a, b: a + b, terms, F.lit(weights["intercept"])))


# ---- tuning ---------------------------------------------------------------------------


def with_folds(df: DataFrame, unique: Sequence[str], folds: int = 3, seed: str = "0") -> DataFrame:
    """Assign each row a reproducible random fold."""
    order = scalars.order_key(seed, *[F.col(c) for c in unique])
    number = F.conv(F.substring(order, 1, 8), 16, 10).cast("bigint")
    return df.withColumn("fold", (number % folds).cast("int"))


def _others(rows: DataFrame, folds: int) -> DataFrame:
    """Training rows: each row once for every fold it is not in."""
    every = F.array(*[F.lit(i) for i in range(folds)])
    return rows.withColumn("fold", F.explode(F.array_except(every, F.array("fold"))))


def _scored(folds: DataFrame, params: Sequence[str]) -> DataFrame:
    """Mean and deviation over folds of the negated error."""
    return folds.groupBy(*params).agg(
        F.avg(-F.col("error")).alias("mean_test_score"),
        F.stddev_pop("error").alias("std_test_score"),
    )


# Settings that one pass over the rows scores.
SCORED_AT_ONCE = 24


def _fold_errors(
    met: DataFrame, names: Sequence[str], settings: Sequence[tuple], y: Sequence[Column],
    predictions: Sequence[Column], scorer: Callable[[Column, Column], Column],
) -> DataFrame:
    """``fold``, ``names`` and ``error`` of every setting; ``met`` has a row once, not per setting."""
    passes = []
    for start in range(0, len(settings), SCORED_AT_ONCE):
        some = range(start, min(start + SCORED_AT_ONCE, len(settings)))
        scored = met.groupBy("fold").agg(*[scorer(y[i], predictions[i]).alias(f"_e{i}") for i in some])
        cells = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, settings[i])],
                                   F.col(f"_e{i}").alias("error")) for i in some])
        passes.append(scored.select("fold", F.inline(cells)).filter("error IS NOT NULL"))
    return reduce(DataFrame.unionByName, passes)


def _cell_errors(
    rows: DataFrame, predicted: DataFrame, on: Sequence[str], names: Sequence[str],
    settings: Sequence[tuple], y: str, scorer: Callable[[Column, Column], Column],
) -> DataFrame:
    """:func:`_fold_errors` of ``predicted``: a ``prediction`` per ``on`` and setting.

    The predictions of a cell become columns, which its rows meet once.  A row whose cell has no
    prediction of a setting does not count for it.
    """
    def of(setting: tuple) -> Column:
        same = reduce(lambda a, b: a & b, [F.col(n) == F.lit(v) for n, v in zip(names, setting)])
        return F.max(F.when(same, F.struct("prediction")))

    wide = predicted.groupBy(*on).agg(*[of(p).alias(f"_p{i}") for i, p in enumerate(settings)])
    met = join_null_safe(rows.select(*on, y), materialize(wide, "predictions"), on, "inner")
    cells = [F.col(f"_p{i}") for i in range(len(settings))]
    return _fold_errors(met, names, settings, [F.when(c.isNotNull(), F.col(y)) for c in cells],
                        [c["prediction"] for c in cells], scorer)


def linear_through_rows(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Closed-form line per group, with and without intercept."""
    fit = rows.groupBy(*keys).agg(
        F.try_divide(F.covar_pop(x, y), F.var_pop(x)).alias("_slope"),
        F.avg(x).alias("_mx"),
        F.avg(y).alias("_my"),
        F.try_divide(F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x))).alias("_origin"),
    )
    slope = F.coalesce("_slope", F.lit(0.0))
    lines = F.array(
        F.struct(
            F.lit(True).alias("fit_intercept"),
            slope.alias("slope"),
            (F.col("_my") - slope * F.col("_mx")).alias("intercept"),
        ),
        F.struct(
            F.lit(False).alias("fit_intercept"),
            F.coalesce("_origin", F.lit(0.0)).alias("slope"),
            F.lit(0.0).alias("intercept"),
        ),
    )
    return fit.select(*keys, F.inline(lines))


def grid_linear(rows: DataFrame, x: str, y: str, folds: int = 3, scorer=errors.rmsre) -> DataFrame:
    """Scores of the linear family; ``rows`` has a ``fold`` column."""
    lines = linear_through_rows(_others(rows, folds), ["fold"], x, y)
    tested = join_null_safe(rows, lines, ["fold"], "inner")
    pred = F.col("slope") * F.col(x) + F.col("intercept")
    fold_scores = tested.groupBy("fold", "fit_intercept").agg(scorer(F.col(y), pred).alias("error"))
    return _scored(fold_scores, ["fit_intercept"])


def knn_sizes(rows: int) -> list[int]:
    """Neighbour counts to try: the first min(⌊log2 n⌋, 6) powers of two."""
    return [2**i for i in range(min(int(math.log2(rows)), 6))] if rows > 1 else [1]


def grid_knn(
    rows: DataFrame, x: str, y: str, unique: Sequence[str], folds: int = 3,
    sizes: Sequence[int] | None = None, scorer=errors.rmsre,
) -> DataFrame:
    """Scores of the neighbour family.  One search with the largest k serves the whole grid."""
    sizes = list(sizes or knn_sizes(rows.count()))
    kept = outermost(rows.select("fold", *unique, x, y), ["fold"], x, unique, max(sizes))
    train = _others(materialize(kept, "outermost"), folds).select("fold", *unique, x, y)
    found = nearest(train, rows.select("fold", x).distinct(), ["fold"], x, unique, max(sizes))
    tried = found.withColumn("n_neighbors", F.explode(F.array(*[F.lit(s) for s in sizes]))).filter(
        F.col("place") <= F.col("n_neighbors")
    )
    predicted = tried.groupBy("fold", F.col("query").alias(x), "n_neighbors").agg(
        *[weighted_label(F.col(y), F.col("distance"), w).alias(w) for w in ("uniform", "distance")]
    )
    options = F.array(
        *[F.struct(F.lit(w).alias("weights"), F.col(w).alias("prediction")) for w in ("uniform", "distance")]
    )
    options = predicted.select("fold", x, "n_neighbors", F.inline(options))
    names = ["n_neighbors", "weights"]
    tried = list(itertools.product(sizes, ("uniform", "distance")))
    fold_scores = _cell_errors(rows, options, ["fold", x], names, tried, y, scorer)
    return _scored(fold_scores, names)


def _forest_fit(params: dict, features: int) -> dict:
    """What a setting comes down to; settings with equal values share their fits."""
    setting = {"bootstrap": True, "maxDepth": 5, "featureSubsetStrategy": "all",
               "minInstancesPerNode": 1, "minInstancesToSplit": 2, "numTrees": 20, **params}
    tried = features if setting["featureSubsetStrategy"] == "all" else max(1, math.isqrt(features))
    depth = setting["maxDepth"]
    return {
        "bootstrap": setting["bootstrap"], "tried": tried, "min_leaf": setting["minInstancesPerNode"],
        "min_split": setting["minInstancesToSplit"],
        "max_depth": trees.MAX_DEPTH if depth is None else min(depth, trees.MAX_DEPTH),
        "trees": setting["numTrees"],
    }


def _text(params: dict) -> str:
    return ",".join(f"{k}={str(v).lower()}" for k, v in sorted(params.items()))


def grid_forest(
    rows: DataFrame, features: Sequence[str], y: str, unique: Sequence[str], grid: Sequence[dict],
    folds: int = 3, scorer: Callable[[Column, Column], Column] = errors.rmsre, seed: str = "0",
    max_bins: int = trees.MAX_BINS,
) -> DataFrame:
    """Scores of forest settings; ``rows`` has a ``fold`` column.

    All settings are scored from shared fits (see :mod:`trees`).  A forest's trees come first in
    any larger forest, a shallow tree is the top of a deep one, trees without bootstrap that try
    every feature are equal, and with one feature there is nothing to choose from.  So one deep
    tree grows per fold, bootstrap sample and least leaf and node sizes, all in the same jobs,
    and is read at every depth and forest size of the grid.
    """
    features, size = list(features), len(features)
    fits = [(p, _forest_fit(p, size)) for p in grid]
    bagged = max((f["trees"] for _, f in fits if f["bootstrap"]), default=0)
    drawn = max((f["trees"] for _, f in fits if not f["bootstrap"] and f["tried"] < size), default=1)
    known = rows.select("fold", *unique, y, *[F.col(x).cast("double").alias(x) for x in features]).dropna()
    for x in features:
        known = trees.binned(known, [], x, max_bins)
    known = materialize(known, "forest-rows")
    sums = materialize(trees.tree_sums(known, ["fold", *features], y, unique, bagged, seed), "tree-sums")
    cells = trees.with_asked(
        trees.without_fold(sums, [*features, "bootstrap", "tree"], folds),
        known.select("fold", *features), ["fold", *features], bagged)

    kinds = sorted({(f["bootstrap"], f["tried"], f["min_leaf"], f["min_split"]) for _, f in fits})
    names = ("bootstrap", "tried", "min_leaf", "min_split")
    kind = lambda k: F.struct(*[F.lit(v).alias(f"_{n}") for n, v in zip(names, k)])
    cells = cells.select("*", F.inline(F.array(*[kind(k) for k in kinds])))
    cells = cells.filter("bootstrap = _bootstrap").drop("_bootstrap").withColumnsRenamed(
        {f"_{n}": n for n in names[1:]})
    # A tree of all rows differs from the next only where features are drawn.
    copies = F.when(~F.col("bootstrap") & (F.col("tried") < size), F.sequence(F.lit(0), F.lit(drawn - 1)))
    cells = cells.withColumn("tree", F.explode(F.coalesce(copies, F.array("tree"))))
    keys = ["fold", *names, "tree"]
    subset = F.col("tried") if any(k[1] < size for k in kinds) else None
    nodes, placed = trees.grow(cells, keys, features, max(f["max_depth"] for _, f in fits),
                               F.col("min_leaf"), F.col("min_split"), subset, seed)
    values = trees.at_depth(placed.filter("asked"), nodes, keys, [f["max_depth"] for _, f in fits])
    means = trees.forest_means(values, ["fold", *features, *names, "max_depth"], [f["trees"] for _, f in fits])
    by = [*names, "max_depth", "trees"]
    tried = sorted({tuple(f[c] for c in by) for _, f in fits})
    tested = _cell_errors(known, means, ["fold", *features], by, tried, y, scorer)
    settings = rows.sparkSession.createDataFrame(
        [(_text(p), *[f[c] for c in by]) for p, f in fits],
        "params string, bootstrap boolean, tried int, min_leaf int, min_split int, max_depth int, trees int")
    return settings.join(_scored(tested, by), by).select("params", "mean_test_score", "std_test_score")


SVR_LOT = 1 << 20     # rows of a task that are sorted together
SVR_LISTS = 1 << 12   # lists whose borders are searched together


def _sorted_lists(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stream of ``(fold, x, y)`` as lists: the sorted labels of a fold's value, as bytes."""
    lot, held = [], 0
    for part in itertools.chain(parts, [None]):
        if part is not None:
            lot.append(part)
            held += part.num_rows
        if held and (part is None or held >= SVR_LOT):
            fold, x, y = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in lot])
                          for c in ("fold", "x", "y"))
            order = np.lexsort((y, x, fold))
            fold, x, y = fold[order], x[order], y[order]
            starts = np.flatnonzero(np.r_[True, (fold[1:] != fold[:-1]) | (x[1:] != x[:-1])])
            ends = np.append(starts, len(y)).astype(np.int32) * np.int32(y.itemsize)
            labels = pa.Array.from_buffers(
                pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(y.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(fold[starts]), pa.array(x[starts]), labels], ["fold", "x", "labels"])
            lot, held = [], 0


def _passed(labels: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, equal: bool) -> np.ndarray:
    """How many labels of each sorted list lie below each of its values ``at``, or equal it."""
    low = np.broadcast_to(starts[:, None], at.shape).copy()
    high = np.broadcast_to(ends[:, None], at.shape).copy()
    for _ in range(int((ends - starts).max()).bit_length()):
        middle = (low + high) >> 1
        found = labels[np.minimum(middle, len(labels) - 1)]
        on = (found <= at if equal else found < at) & (low < high)
        high = np.where(on, high, middle)
        low = np.where(on, middle + 1, low)
    return low - starts[:, None]


def _svr_pulls(weights: np.ndarray, bias: np.ndarray, epsilon: np.ndarray, scales: np.ndarray):
    """Sub-gradient sums of every fold and setting over a stream of sorted lists.

    Labels outside the band of a setting pull at it, with a sign each; in a sorted list they are
    counted by binary search.
    """
    def pulls(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_w, by_b = np.zeros_like(weights), np.zeros_like(bias)
        for part in parts:
            if not part.num_rows:
                continue
            fold, x = (part.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "x"))
            lists = part.column("labels")
            borders = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset:lists.offset + part.num_rows + 1]
            labels = np.frombuffer(lists.buffers()[2], np.uint8)[borders[0]:borders[-1]].view(float)
            borders = (borders.astype(np.int64) - borders[0]) // labels.itemsize
            for f, (mean_x, dev_x, mean_y, dev_y) in enumerate(scales):
                train = np.flatnonzero(fold != f)
                for some in (train[i:i + SVR_LISTS] for i in range(0, len(train), SVR_LISTS)):
                    u = (x[some] - mean_x) / dev_x
                    starts, ends = borders[some], borders[some + 1]
                    line = bias[f] + u[:, None] * weights[f]
                    under = _passed(labels, starts, ends, mean_y + dev_y * (line - epsilon), False)
                    upto = _passed(labels, starts, ends, mean_y + dev_y * (line + epsilon), True)
                    side = ((ends - starts)[:, None] - upto - under).astype(float)
                    by_w[f] += u @ side
                    by_b[f] += side.sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([by_w.ravel().tolist()]), pa.array([by_b.ravel().tolist()])], ["w", "b"])

    return pulls


def grid_svr(
    rows: DataFrame, x: str, y: str, grid: Sequence[dict], folds: int = 3, scorer=errors.rmsre,
    iterations: int = 60, rate: float = 0.5,
) -> DataFrame:
    """Scores of linear support vector settings; ``rows`` has a ``fold`` column.

    The steps of ``fit_svr_linear`` for all folds and settings at once, one job per step.  Tasks
    sort the labels of equal values once, so that a step searches lists and reads no row again.
    Both columns are scaled by the fold's training rows, which is what ``epsilon`` refers to;
    predictions are scaled back before they are scored.
    """
    cells = [F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")]
    known = rows.select("fold", *cells).dropna()
    data = known.mapInArrow(_sorted_lists, "fold int, x double, labels binary").persist()
    try:
        stats = _others(known, folds).groupBy("fold").agg(
            F.count("*").alias("n"), F.avg("x").alias("mx"), F.stddev_pop("x").alias("sx"),
            F.avg("y").alias("my"), F.stddev_pop("y").alias("sy"))
        found = {r.fold: r for r in stats.collect()}
        held = sorted(found)  # a fold that holds every row has nothing to be fitted on
        scales = np.array([[found[f].mx, found[f].sx or 1.0, found[f].my, found[f].sy or 1.0]
                           if f in found else [0.0, 1.0, 0.0, 1.0] for f in range(folds)])
        count = np.array([[found[f].n if f in found else 1] for f in range(folds)], float)
        c, epsilon = (np.array([p[k] for p in grid], float) for k in ("C", "epsilon"))
        weights = np.zeros((folds, len(grid)))
        bias, mean_w, mean_b, kept = (np.zeros_like(weights) for _ in range(4))
        for step in range(1, iterations + 1):
            sums = data.mapInArrow(_svr_pulls(weights, bias, epsilon, scales),
                                   "w array<double>, b array<double>").collect()
            by_w, by_b = (np.sum([r[k] for r in sums], 0).reshape(weights.shape) for k in ("w", "b"))
            size = rate / math.sqrt(step)
            weights = weights - size * (weights / (c * count) - by_w / count)
            bias = bias + size * by_b / count
            if step > iterations // 2:
                kept += 1
                mean_w += (weights - mean_w) / kept
                mean_b += (bias - mean_b) / kept
    finally:
        data.unpersist()
    lines = []
    for f in held:
        mean_x, dev_x, mean_y, dev_y = scales[f].tolist()
        slopes = [w * dev_y / dev_x for w in mean_w[f].tolist()]
        lines.append((f, slopes, [
            mean_y + dev_y * b - slope * mean_x for slope, b in zip(slopes, mean_b[f].tolist())]))
    lines = rows.sparkSession.createDataFrame(lines, "fold int, slopes array<double>, intercepts array<double>")
    tested = join_null_safe(rows.select("fold", x, y), lines, ["fold"], "inner")
    tried = [(float(p["C"]), float(p["epsilon"])) for p in grid]
    predictions = [F.get("slopes", F.lit(i)) * F.col(x) + F.get("intercepts", F.lit(i)) for i in range(len(tried))]
    fold_scores = _fold_errors(tested, ["C", "epsilon"], tried, [F.col(y)] * len(tried), predictions, scorer)
    return _scored(fold_scores, ["C", "epsilon"])


# What a fit can raise on its data; anything else, a lost cluster included, ends the search.
FIT_ERRORS = (ValueError, ArithmeticError, ArithmeticException, IllegalArgumentException)


def grid_search(
    rows: DataFrame, x: str, y: str, unique: Sequence[str], forest_grid: Sequence[dict] = (),
    folds: int = 3, seed: str = "0", svr_grid: Sequence[dict] = (),
) -> DataFrame:
    """Best setting of each family by cross-validated relative error.

    Scores that agree to nine digits are equal; the setting whose text comes first is taken.  A
    family that cannot be fitted to the rows (:data:`FIT_ERRORS`), or none of whose settings has
    a score, gets the row ``default`` without scores.
    """
    spark = rows.sparkSession
    folded = with_folds(rows.select(*unique, x, y), unique, folds, seed).persist()
    text = lambda name: F.concat(F.lit(f"{name}="), F.col(name).cast("string"))
    families = {
        "linear_regression": (lambda: grid_linear(folded, x, y, folds), text("fit_intercept")),
        "nearest_neighbors": (lambda: grid_knn(folded, x, y, unique, folds),
                              F.concat_ws(",", text("n_neighbors"), text("weights"))),
    }
    if forest_grid:
        families["random_forest"] = (
            lambda: grid_forest(folded, [x], y, unique, forest_grid, folds, seed=seed), F.col("params"))
    if svr_grid:
        families["svm"] = (lambda: grid_svr(folded, x, y, svr_grid, folds),
                           F.concat_ws(",", text("C"), text("epsilon")))
    best = []
    try:
        for family, (search, params) in families.items():
            try:
                tried = search().select(params.alias("params"), "mean_test_score", "std_test_score")
                good = [r for r in tried.collect()  # a row per setting
                        if r.mean_test_score is not None and not math.isnan(r.mean_test_score)]
            except FIT_ERRORS:
                logging.getLogger(__name__).warning(
                    "search of %s failed, its default is used", family, exc_info=True)
                good = []
            first = min(good, key=lambda r: (-round(r.mean_test_score, 9), r.params), default=("default", None, None))
            best.append((family, *first))
    finally:
        folded.unpersist()
    return spark.createDataFrame(
        best, "family string, params string, mean_test_score double, std_test_score double")


def rank_features_by_forest(
    df: DataFrame, features: Sequence[str], label: str, unique: Sequence[str],
    splits: int = 3, test_share: float = 0.3, n_trees: int = 20, depth: int = 4,
    max_bins: int = trees.MAX_BINS, seed: str = "42",
) -> DataFrame:
    """Mean r² of a 20-tree depth-4 forest on each single feature, over random splits.

    The trees of all features and splits grow in the same jobs, whatever their number.  Rows are
    never repeated per feature or tree: draws are made once per row and split, and errors come from
    the mean and variance of the test labels of each value.  Rows without a feature's value or the
    label do not count for it; a feature none of whose splits has a score (no test rows, or equal
    labels) has a null.
    """
    names = {f: f"_x{i}" for i, f in enumerate(features)}
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    rows = df.select(*unique, value(label).alias("_y"), *[value(f).alias(c) for f, c in names.items()])
    rows = rows.filter("_y IS NOT NULL")

    def tall(wide: DataFrame, *columns: str) -> DataFrame:
        cell = [F.struct(F.lit(f).alias("feature"), F.col(c).alias("_x")) for f, c in names.items()]
        return wide.select(*columns, F.inline(F.array(*cell))).filter("_x IS NOT NULL")

    crowded = trees.bin_ends(tall(rows), ["feature"], "_x", max_bins)
    ends = crowded.agg(F.map_from_entries(F.collect_list(F.struct("feature", "_ends")))).scalar()
    rows = rows.withColumn("_bins", ends)
    rows = rows.withColumns({
        c: trees.in_bin(F.col(c), F.try_element_at("_bins", F.lit(f))) for f, c in names.items()}).drop("_bins")
    rows = rows.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    key = F.concat_ws("|", "split", *unique)
    share = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    rows = rows.withColumn("_test", share < test_share)
    by = ["feature", "split", "_x"]
    sums = materialize(trees.tree_sums(rows.filter("NOT _test"), ["split"], "_y", [*unique, "split"], n_trees, seed,
                                       names).filter("bootstrap"), "tree-sums")
    test = materialize(tall(rows.filter("_test"), "split", "_y").groupBy(*by).agg(
        F.count("_y").alias("_n"), F.avg("_y").alias("_mean"), F.var_pop("_y").alias("_var"),
        F.min("_y").alias("_min"), F.max("_y").alias("_max")), "test-values")
    cells = trees.with_asked(sums, test.select(*by), by, n_trees)
    keys = ["feature", "split", "bootstrap", "tree"]
    nodes, placed = trees.grow(cells, keys, ["_x"], depth)
    values = trees.at_depth(placed.filter("asked"), nodes, keys, [depth])
    means = trees.forest_means(values, by, [n_trees])
    # At most as many rows per window group as a feature has values.
    n, mean, group = F.col("_n"), F.col("_mean"), Window.partitionBy("feature", "split")
    met = test.join(means, by).withColumn("_center", F.sum(n * mean).over(group) / F.sum(n).over(group))
    off = lambda at: F.sum(n * (F.col("_var") + (mean - F.col(at)) * (mean - F.col(at))))
    spread = F.when(F.min("_min") < F.max("_max"), off("_center"))  # rounding must not make equal labels differ
    scores = met.groupBy("feature", "split").agg((1 - F.try_divide(off("prediction"), spread)).alias("r2"))
    names = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    ranked = names.join(scores, "feature", "left").groupBy("feature").agg(F.round(F.avg("r2"), 3).alias("r2"))
    return ranked.orderBy(F.desc("r2"), F.desc("feature"))


def prediction_sweep(
    rows: DataFrame, specs: Sequence[str], unique: Sequence[str], test_size: float = 0.5, seed: str = "0"
) -> DataFrame:
    """Relative error of the closed-form families for every spec, in one plan.

    ``rows`` is tall: the ``specs`` columns name trial, feature and target; ``x``
    and ``y`` hold the values.  Each value of x is split separately.
    """
    specs = list(specs)
    keyed = rows.withColumn("_order", scalars.order_key(seed, *[F.col(c) for c in unique]))
    dealt = first_share(keyed, [*specs, "x"], "_order", unique, test_size)
    both = F.col("_n") * F.lit(float(test_size)) < 1
    split = materialize(
        dealt.select(*specs, "x", "y", (both | ~F.col("_first")).alias("train"), (both | F.col("_first")).alias("test")),
        "sweep-split",
    )
    train, test = split.filter("train"), split.filter("test")

    # Everything is fitted from one row per value.
    inverse = F.try_divide(F.lit(1.0), F.col("y"))
    values = materialize(
        train.groupBy(*specs, "x").agg(
            F.count("y").alias("n"),
            F.avg("y").alias("mean"),
            F.try_divide(F.sum(inverse), F.sum(inverse * inverse)).alias("best_possible"),
        ),
        "sweep-values",
    )
    n, x = F.col("n"), F.col("x")
    means = values.groupBy(*specs).agg(
        F.try_divide(F.sum(x * n), F.sum(n)).alias("_mx"),
        F.try_divide(F.sum(F.col("mean") * n), F.sum(n)).alias("naive"),
    )
    gap = x - F.col("_mx")
    fitted = (
        join_null_safe(values, means, specs, "inner")
        .groupBy(*specs, "_mx", "naive")
        .agg(
            F.coalesce(
                F.try_divide(
                    F.sum(n * gap * (F.col("mean") - F.col("naive"))), F.sum(n * gap * gap)
                ),
                F.lit(0.0),
            ).alias("_slope")
        )
    )
    groups = values.select(*specs, "x", "best_possible")
    tested = join_null_safe(join_null_safe(test, groups, [*specs, "x"], "left"), fitted, specs, "inner")
    y = F.col("y")
    return tested.groupBy(*specs).agg(
        errors.rmsre(y, F.col("naive") + F.col("_slope") * gap).alias("linear"),
        errors.rmsre(y, F.coalesce("best_possible", "naive")).alias("best_possible"),
        errors.rmsre(y, F.col("naive")).alias("naive"),
    )
