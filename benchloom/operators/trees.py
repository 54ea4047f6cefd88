"""Regression trees for many groups at once, level by level.

A group is anything a tree is fitted for: a fold, a tree of a forest, a feature, a leaf of an
earlier tree.  All trees of all groups grow in the same jobs.  Rows are reduced to *cells* first,
one per group and distinct feature vector, with the weight ``w`` of their training rows and the
weighted label sum ``s``.  A level is one aggregate of cells per (group, node, feature, value),
running sums over the values, the best split per node, and one join that sends the cells on.
Only cells of nodes that were split go to the next level.

Nodes are numbered as in a heap: the root is 1, the children of n are 2n and 2n + 1.  So a tree
cut at depth d holds the answer of a fit with that depth: the greedy choice of a split does not
depend on what grows below it.

Splits lie in the middle between neighbouring training values.  The best split has the least
squared error; ties go to the first feature, then to the smallest threshold.  A node is split
only if that lowers the squared error by more than rounding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.digests import digests
from ..session import materialize
from .ranks import join_null_safe

MAX_DEPTH = 62     # node numbers fit 64 bits
MAX_BINS = 256     # values of a feature per group that splits can lie between
MIN_GAIN = 1e-12   # of the sum of squares a node explains
DIGITS = 4         # hex digits of a digest per bootstrap draw (of 32)


def poisson_marks() -> list[str]:
    """Cumulated probabilities of 0, 1, 2, ... Poisson draws of mean 1, in hex digits."""
    marks, total, k = [], 0.0, 0
    while len(marks) < 8:
        total += math.exp(-1) / math.factorial(k)
        marks.append(f"{int(total * 16**DIGITS):0{DIGITS}x}")
        k += 1
    return marks


CELLS_HELD = 16_384  # cells whose sums a task holds at once


def _drawn(by: Sequence[str], tall: Sequence[str], trees: int, seed: str):
    """Partial sums of draws and drawn labels per cell over a stream of ``by, tall, _y, _text``.

    A cell holds the values of ``by`` and, with ``tall``, the number and value of one of its columns.
    """
    heads = [f"{seed}.{b}".encode() for b in range(-(-trees // (32 // DIGITS)))]
    marks = [int(m, 16) for m in poisson_marks()]
    draws = np.searchsorted(marks, np.arange(1 << 4 * DIGITS), side="right").astype(np.uint8)

    def codes(part: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
        """A number per row, equal only for equal values of the columns."""
        code = np.zeros(part.num_rows, np.int64)
        for name in names:
            column = part.column(name).dictionary_encode(null_encoding="encode")
            code = code * len(column.dictionary) + column.indices.to_numpy(zero_copy_only=False)
            code = np.unique(code, return_inverse=True)[1]
        return code

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, both, types = {}, np.zeros((0, 2, trees)), None

        def batch() -> pa.RecordBatch:
            cells = list(zip(*place))
            columns = [pa.array(values, kind) for values, kind in zip(cells, types)]
            ends = pa.array(np.arange(len(place) + 1, dtype=np.int32) * trees)
            columns += [pa.ListArray.from_arrays(ends, both[:len(place), i].ravel()) for i in range(2)]
            return pa.RecordBatch.from_arrays(columns, [*by, *(["_at", "_x"] if tall else []), "w", "s"])

        for part in parts:
            if not part.num_rows:
                continue
            shown = digests(part.column("_text"), heads).reshape(part.num_rows, -1).view(">u2")
            drawn = draws[shown[:, :trees]]
            y = part.column("_y").fill_null(0.0).to_numpy(zero_copy_only=False)
            shared = codes(part, by)
            for at, name in enumerate(tall or [None]):
                names, rows = list(by), np.arange(part.num_rows)
                code = shared
                if tall:
                    names.append(name)
                    rows = np.flatnonzero(part.column(name).is_valid().to_numpy(zero_copy_only=False))
                    code = codes(part, names)[rows]
                order = np.argsort(code, kind="stable")
                rows, code = rows[order], code[order]
                if not len(rows):
                    continue
                starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
                first = pa.array(rows[starts])
                cells = [part.column(c).take(first) for c in names]
                if tall:
                    cells.insert(len(by), pa.array([at] * len(starts), pa.int32()))
                types = [c.type for c in cells]
                found = [place.setdefault(c, len(place)) for c in zip(*(c.to_pylist() for c in cells))]
                if len(place) > len(both):
                    both = np.concatenate([both, np.zeros((max(len(place), 2 * len(both)) - len(both), 2, trees))])
                weights, labels = drawn[rows].astype(float), y[rows]
                weighed = np.stack([np.ones(len(rows)), labels])
                plain = np.isfinite(labels).all()
                for to, a, b in zip(found, starts.tolist(), [*starts[1:].tolist(), len(rows)]):
                    if plain:
                        both[to] += weighed[:, a:b] @ weights[a:b]
                    else:  # a label counts only where its row is drawn
                        w = weights[a:b]
                        both[to, 0] += w.sum(0)
                        both[to, 1] += np.multiply(w, labels[a:b, None], out=np.zeros_like(w), where=w > 0).sum(0)
                if len(place) >= CELLS_HELD:
                    yield batch()
                    place, both = {}, np.zeros((0, 2, trees))
        if place:
            yield batch()

    return sums


def tree_sums(rows: DataFrame, by: Sequence[str], y: str, unique: Sequence[str], trees: int,
              seed: str, tall: Mapping[str, str] | None = None) -> DataFrame:
    """``by, bootstrap, tree, w, s``: rows drawn and their label sum, per tree.

    A bootstrap sample holds a row as often as a Poisson draw of mean 1 says, read from digests
    of the row's ``unique`` columns; the first samples do not depend on how many follow.
    Without bootstrap there is one tree, number 0, which holds every row once.  Rows are
    reduced before they are shuffled: a task adds up arrays with a place per tree, so that a row
    is never repeated per tree.

    ``tall`` maps names to columns: then a row counts once for every column it has a value of,
    ``feature`` is the name and ``_x`` the value, and the draws are made once for all of them.
    """
    by, tall = list(by), dict(tall or {})
    cell = [*by, "feature", "_x"] if tall else by
    label = F.col(y).cast("double").alias("_y")
    whole = rows.select(*by, label)
    if tall:
        whole = rows.select(*by, label, F.inline(F.array(*[
            F.struct(F.lit(n).alias("feature"), F.col(c).alias("_x")) for n, c in tall.items()])))
        whole = whole.filter("_x IS NOT NULL")
    whole = whole.groupBy(*cell).agg(
        F.count(F.lit(1)).cast("double").alias("w"), F.sum("_y").alias("s"))
    whole = whole.select(*cell, F.lit(False).alias("bootstrap"), F.lit(0).alias("tree"), "w", "s")
    if not trees:
        return whole
    # What order_key writes behind the seed: its digests are taken of whole batches.
    text = F.concat_ws("|", F.lit(""), *[F.col(c).cast("string") for c in unique])
    fed = rows.select(*by, *tall.values(), label, text.alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in fed.schema}
    shape = [f"`{c}` {kinds[c]}" for c in by]
    if tall:
        shape += ["_at int", f"_x {kinds[next(iter(tall.values()))]}"]
    drawn = fed.mapInArrow(_drawn(by, list(tall.values()), trees, seed),
                           ", ".join([*shape, "w array<double>", "s array<double>"]))
    if tall:
        drawn = drawn.withColumn("feature", F.element_at(F.array(*map(F.lit, tall)), F.col("_at") + 1))
    each = drawn.select(*cell, F.posexplode(F.arrays_zip("w", "s")).alias("tree", "_sums")).filter("_sums.w > 0")
    bagged = each.groupBy(*cell, "tree").agg(F.sum("_sums.w").alias("w"), F.sum("_sums.s").alias("s"))
    return whole.unionByName(bagged.withColumn("bootstrap", F.lit(True)))


def bin_ends(rows: DataFrame, keys: Sequence[str], x: str, max_bins: int = MAX_BINS) -> DataFrame:
    """``keys`` and ``_ends``, the bins of the groups with more than ``max_bins`` values of ``x``."""
    values = rows.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_rows"))
    shares = [(i + 1) / max_bins for i in range(max_bins)]
    ends = values.groupBy(*keys).agg(
        F.count("*").alias("_values"),
        F.array_distinct(F.percentile_approx(x, shares, 10_000)).alias("_ends"))
    return materialize(ends.filter(F.col("_values") > max_bins).drop("_values"), "bins")


def in_bin(x: Column, ends: Column) -> Column:
    """The value that stands for ``x`` among the bins ``ends``; ``x`` itself where there are none."""
    up = F.coalesce(F.array_min(F.filter(ends, lambda e: e >= x)), F.array_max(ends))
    return F.when(ends.isNull() | x.isNull(), x).otherwise(up)


def binned(rows: DataFrame, keys: Sequence[str], x: str, max_bins: int = MAX_BINS) -> DataFrame:
    """``rows`` with at most ``max_bins`` values of ``x`` per group.

    Groups with no more distinct values keep theirs.  In others a value becomes the next of
    ``max_bins`` quantiles (Spark's approximate ones, to a ten-thousandth of the rows).
    """
    keys = list(keys) or ["_all"]
    if keys == ["_all"]:
        rows = rows.withColumn("_all", F.lit(1))
    met = join_null_safe(rows, bin_ends(rows, keys, x, max_bins), keys, "left")
    return met.withColumn(x, in_bin(F.col(x), F.col("_ends"))).drop("_ends", "_all")


def grow(cells: DataFrame, keys: Sequence[str], features: Sequence[str], max_depth: int = MAX_DEPTH,
         min_leaf: Column | int = 1, min_split: Column | int = 2, max_features: Column | None = None,
         seed: str = "0") -> tuple[DataFrame, DataFrame]:
    """Grow one tree per group of ``cells`` (``keys``, ``features``, ``w``, ``s``).

    Cells of weight 0 take no part in the fit but are sent down the tree: rows to predict.
    ``min_leaf`` and ``min_split`` are weights and may be key columns.  ``max_features`` bounds
    the features tried at a node, drawn by digest from ``seed``, the keys and the node.

    Returns ``nodes`` (``keys, node, w, value``) of all depths and ``placed``, the cells with
    the ``node`` they end in and its ``depth``.  Cells without a feature's value are left out.
    Groups without weight have no tree.
    """
    keys, features = list(keys), list(features)
    min_leaf = F.lit(min_leaf) if isinstance(min_leaf, int) else min_leaf
    min_split = F.lit(min_split) if isinstance(min_split, int) else min_split
    known = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])
    cells = materialize(cells, "tree-sums")  # read twice, and costly to make
    alive = cells.groupBy(*keys).agg(F.sum("w").alias("_w")).filter("_w > 0").drop("_w")
    active = materialize(join_null_safe(cells.filter(known), alive, keys, "inner")
                         .withColumn("node", F.lit(1).cast("bigint")), "tree-cells")
    tried = [F.struct(F.lit(i).alias("_feature"), F.col(f).cast("double").alias("_value"))
             for i, f in enumerate(features)]
    nodes, placed = [], []
    for depth in range(max_depth + 1):
        seen = Observation()
        splits = _best_splits(active, keys, tried, min_leaf, min_split, max_features, seed)
        level = materialize(splits.observe(seen, F.count("best").alias("splits")), "tree-level")
        nodes.append(level.select(*keys, "node", "w", "value"))
        if depth == max_depth or not seen.get["splits"]:
            placed.append(active.withColumn("depth", F.lit(depth)))
            break
        split = level.select(*keys, "node", "best")
        met = join_null_safe(active, split, [*keys, "node"], "inner")
        value = F.element_at(F.array(*[F.col(f).cast("double") for f in features]), F.col("best.feature") + 1)
        below = F.col("node") * 2 + (value > F.col("best.threshold")).cast("bigint")
        sent = materialize(met.withColumns({
            "node": F.when(F.col("best").isNull(), F.col("node")).otherwise(below),
            "_ends": F.col("best").isNull()}).drop("best"), "tree-cells")
        placed.append(sent.filter("_ends").drop("_ends").withColumn("depth", F.lit(depth)))
        active = sent.filter("NOT _ends").drop("_ends")
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, placed)


def _best_splits(active, keys, tried, min_leaf, min_split, max_features, seed) -> DataFrame:
    """``keys, node, w, value`` and ``best``, the split of each node or null."""
    group = [*keys, "node"]
    met = active.filter("w > 0")
    options = F.array(*tried)
    if max_features is not None:
        order = lambda i: scalars.order_key(seed, *[F.col(k) for k in group], F.lit(i))
        chosen = F.transform(F.slice(F.array_sort(F.array(*[
            F.struct(order(i).alias("by"), F.lit(i).alias("feature")) for i in range(len(tried))])),
            F.lit(1), max_features), lambda c: c["feature"])
        met = met.withColumn("_chosen", chosen)
        options = F.filter(options, lambda o: F.array_contains("_chosen", o["_feature"]))
    hist = met.select(*group, "w", "s", F.inline(options)).groupBy(*group, "_feature", "_value").agg(
        F.sum("w").alias("_w"), F.sum("s").alias("_s"))
    # At most as many rows per window group as a feature has values in a group.
    line = Window.partitionBy(*group, "_feature")
    upto = line.orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.select(*group, "_feature", "_value", F.lead("_value").over(line.orderBy("_value")).alias("_next"),
                       F.sum("_w").over(upto).alias("_wl"), F.sum("_s").over(upto).alias("_sl"),
                       F.sum("_w").over(line).alias("_w"), F.sum("_s").over(line).alias("_s"))
    w, s, wl, sl = (F.col(c) for c in ("_w", "_s", "_wl", "_sl"))
    score = F.try_divide(sl * sl, wl) + F.try_divide((s - sl) * (s - sl), w - wl)
    base = s * s / w
    good = (F.col("_next").isNotNull() & (wl >= min_leaf) & (w - wl >= min_leaf) & (w >= min_split)
            & (score - base > F.lit(MIN_GAIN) * base))
    best = F.min(F.when(good, F.struct(
        (-score).alias("loss"), F.col("_feature").alias("feature"),
        ((F.col("_value") + F.col("_next")) / 2).alias("threshold"))))
    return hist.groupBy(*group).agg(
        F.max("_w").alias("w"), (F.max("_s") / F.max("_w")).alias("value"), best.alias("best"))


def at_depth(placed: DataFrame, nodes: DataFrame, keys: Sequence[str], depths: Sequence[int]) -> DataFrame:
    """``placed`` once per depth, with the ``value`` of the tree cut at ``max_depth``."""
    cut = placed.withColumn("max_depth", F.explode(F.array(*[F.lit(d) for d in sorted(set(depths))])))
    over = "CASE WHEN depth > max_depth THEN shiftright(node, depth - max_depth) ELSE node END"
    cut = cut.withColumn("node", F.expr(over))
    return join_null_safe(cut, nodes.drop("w"), [*keys, "node"], "inner")


def without_fold(sums: DataFrame, by: Sequence[str], folds: int) -> DataFrame:
    """Sums of the rows outside each fold; ``by`` follows ``fold``."""
    every = F.array(*[F.lit(f) for f in range(folds)])
    other = sums.withColumn("fold", F.explode(F.array_except(every, F.array("fold"))))
    return other.groupBy("fold", *by).agg(F.sum("w").alias("w"), F.sum("s").alias("s"))


def with_asked(train: DataFrame, asked: DataFrame, by: Sequence[str], trees: int) -> DataFrame:
    """Cells of training sums and, in every tree, the feature vectors to predict (``asked``)."""
    every = F.concat(
        F.array(F.struct(F.lit(False).alias("bootstrap"), F.lit(0).alias("tree"))),
        F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda i: F.struct(
            F.lit(True).alias("bootstrap"), i.alias("tree"))) if trees else F.array())
    asked = asked.distinct().select("*", F.inline(every)).withColumns(
        {"w": F.lit(0.0), "s": F.lit(0.0), "asked": F.lit(True)})
    both = train.withColumn("asked", F.lit(False)).unionByName(asked)
    return both.groupBy(*by, "bootstrap", "tree").agg(
        F.sum("w").alias("w"), F.sum("s").alias("s"), F.max("asked").alias("asked"))


def forest_means(values: DataFrame, by: Sequence[str], counts: Sequence[int]) -> DataFrame:
    """``by, trees, prediction``: the mean over the first trees, for forests of each size."""
    sizes = sorted(set(counts))
    of = values.groupBy(*by).agg(
        *[F.avg(F.when(F.col("tree") < n, F.col("value"))).alias(f"_{n}") for n in sizes])
    return of.select(*by, F.inline(F.array(*[F.struct(
        F.lit(n).alias("trees"), F.col(f"_{n}").alias("prediction")) for n in sizes])))
