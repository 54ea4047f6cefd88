"""Probabilistic forests: pools of training labels per leaf, Gaussian mixtures, second stages."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import errors
from ..session import materialize
from . import trees
from .neighbours import nearest
from .ranks import with_rank

# Added to every component variance; gain in mean log-likelihood below which a
# mixture is settled; steps after which an unsettled one is left.
VARIANCE_FLOOR = 1e-6
TOLERANCE = 1e-3
MOST_STEPS = 100
# Tables read in every step are cut finer, so that all cores share a small one.
ITERATED_ROW_GROUP_MB = 8
# Labels of a part in one row of the table that every step reads, and pools in one row that meets it.
CHUNK = 256
BLOCK = 64
# Labels are met in up to 3 * CELLS cells; a cell of more than NODES distinct labels stands for
# them by sums at NODES points (see _certain).
CELLS = 1024
NODES = 24
RHO = 4.0             # sum of the half axes of the ellipse around a cell, in half widths
NOTHING = -40.0       # log of a share that no sum shows


def leaf_vector(leaf: Column | str = "leaf") -> Column:
    """Leaf ids of all trees as an integer array (a single tree gives one element)."""
    return F.transform(vector_to_array(leaf), lambda v: v.cast("int"))


def with_leaves(model, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with ``leaves``, the leaf of every tree of a fitted forest.

    Written out, because every later step reads them and walking the trees is the
    costly part.
    """
    leafed = model.transform(rows).select(*columns, leaf_vector("leaf").alias("leaves"))
    return materialize(leafed, "leaves", ITERATED_ROW_GROUP_MB)


def forest_leaves(train: DataFrame, test: DataFrame, x: Sequence[str], y: str, unique: Sequence[str],
                  n_trees: int = 100, depth: int = 2, seed: str = "42",
                  frames: Sequence[DataFrame] | None = None) -> list[DataFrame]:
    """``train`` and ``test`` with ``leaves``, of a bagged forest fitted on ``train``.

    All trees grow in the same jobs, from one cell per tree and distinct feature vector.
    ``frames`` get leaves instead of ``train`` and ``test``, such as their distinct vectors.
    """
    x = list(x)
    frames = frames or (train, test)
    sums = trees.tree_sums(train, x, y, unique, n_trees, seed).filter("bootstrap")
    asked = reduce(DataFrame.unionByName, [f.select(*x) for f in frames])
    cells = trees.with_asked(sums, asked, x, n_trees).filter("bootstrap")
    _, placed = trees.grow(cells, ["tree"], x, depth)
    reached = placed.groupBy(*x).agg(F.array_sort(F.collect_list(F.struct("tree", "node"))).alias("_at"))
    leaves = materialize(reached.select(*x, F.transform("_at", lambda c: c["node"].cast("int")).alias("leaves")),
                         "leaves")
    return [part.join(leaves, x) for part in frames]


def leaf_samples(train: DataFrame, label: str = "label") -> DataFrame:
    """Training labels of each (tree, leaf), equal labels counted in ``copies``.

    ``train`` carries ``leaves``, the leaf id of every tree.
    """
    cells = train.select(F.posexplode("leaves").alias("tree", "leaf"), F.col(label).alias("label"))
    return cells.groupBy("tree", "leaf", "label").agg(F.count(F.lit(1)).alias("copies"))


def number_leaves(*frames: DataFrame) -> list[DataFrame]:
    """Add ``pool``, one number per distinct leaf vector over all frames."""
    vectors = reduce(DataFrame.union, [f.select("leaves") for f in frames]).distinct()
    numbers = materialize(with_rank(vectors, [], ["leaves"], "pool"), "leaf-vectors")
    return [f.join(numbers, "leaves") for f in frames]


def pool_parts(test: DataFrame, train: DataFrame, label: str = "label", copies: str | None = None,
               vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The label pool of each leaf vector of ``test``, in parts that pools share.

    Returns ``(part, label, copies)``, the training labels of each leaf vector, and the links
    ``(pool, part, weight)``.  A training label counts once for every tree in which its row
    shares the leaf; rows with the same leaf vector share one pool; a pool of one label counts
    it twice.  Frames come from :func:`number_leaves`.

    Leaves are matched between distinct leaf vectors, not between rows.  The labels of the
    pools are the labels of the parts times the links: nothing holds all of them.  ``copies``
    names the column that counts equal rows of ``train``.  ``vectors``, a frame with the pools and
    leaves of ``train``, spares a pass over its rows.
    """
    rows = F.lit(1) if copies is None else F.col(copies)
    def cells(df, name):
        vectors = df.select(F.col("pool").alias(name), "leaves").distinct()
        return vectors.select(name, F.posexplode("leaves").alias("tree", "leaf"))

    shared = (
        cells(test, "pool")
        .join(cells(train if vectors is None else vectors, "part"), ["tree", "leaf"])
        .groupBy("pool", "part")
        .agg(F.count(F.lit(1)).alias("_trees"))
    )
    labels = train.groupBy(F.col("pool").alias("part"), F.col(label).alias("label")).agg(
        F.sum(rows).cast("bigint").alias("copies")
    )
    labels = materialize(labels, "part-labels")
    # Pool sizes come from the small tables.
    held = labels.groupBy("part").agg(F.sum("copies").alias("_rows"))
    sizes = (
        held.join(shared, "part")
        .groupBy("pool")
        .agg(F.sum(F.col("_rows") * F.col("_trees")).alias("_n"))
    )
    links = materialize(
        shared.join(sizes, "pool").select(
            "pool", "part", F.when(F.col("_n") < 2, F.lit(2)).otherwise(F.col("_trees")).alias("weight")
        ),
        "pool-links",
    )
    return labels, links


def sample_pools(test: DataFrame, train: DataFrame, label: str = "label") -> DataFrame:
    """:func:`pool_parts` joined: ``(pool, label, copies)``; equal labels may take several rows."""
    labels, links = pool_parts(test, train, label)
    return labels.join(links, "part").select(
        "pool", "label", (F.col("copies") * F.col("weight")).alias("copies")
    )


def _log_density(x: Column, weight: Column, mean: Column, var: Column) -> Column:
    log = F.log(weight) - 0.5 * (F.log(2 * math.pi * var) + (x - mean) * (x - mean) / var)
    return F.when(weight > 0, log).otherwise(F.lit(-1e300))


def fit_mixtures(
    pools: DataFrame, keys: Sequence[str], k: int | str, iterations: int = MOST_STEPS,
    k_max: int | None = None, tolerance: float = TOLERANCE,
) -> DataFrame:
    """Gaussian mixture of every pool of ``(keys, label, copies)``: see :func:`fit_pools`."""
    keys = list(keys)
    pools = materialize(pools.dropna(subset=keys).withColumn("part", F.struct(*keys)), "pools")
    named = [k] if isinstance(k, str) and k not in keys else []
    links = pools.groupBy(*keys).agg(
        F.first("part").alias("part"), *[F.first(c).alias(c) for c in named]
    ).withColumn("weight", F.lit(1))
    return fit_pools(pools.select("part", "label", "copies"), links, keys, k, iterations, k_max, tolerance)


def _edges(low: float | None, high: float | None, quantiles: Sequence[float] | None) -> np.ndarray:
    """Where cells begin: at the quantiles, at equal steps between the outermost of them, and in
    steps that widen evenly from there to the least and the greatest label."""
    if low is None:
        return np.zeros(0)
    first, last = quantiles[0], quantiles[-1]
    step, edges = (last - first) / CELLS, [quantiles, np.linspace(first, last, CELLS + 1)]
    for end, out in ((first, low - first), (last, high - last)):
        if abs(out) > step > 0:
            edges.append(end + math.copysign(1, out) * np.geomspace(step, abs(out), CELLS // 2))
    return np.unique(np.concatenate(edges))


def _cells_of(labels: DataFrame, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every cell between ``edges``: its points, how many they are and half the cell's width.

    ``labels`` are distinct.  The points of a cell of few labels are the labels and its width is
    0; others get the Chebyshev points between their least and greatest label.
    """
    size = len(edges) + 1

    def seen(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, low, high = np.zeros(size, np.int64), np.full(size, np.inf), np.full(size, -np.inf)
        few, few_at = np.zeros(0), np.zeros(0, np.int64)
        for part in parts:
            x = part.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(edges, x, side="right")
            counts += np.bincount(at, minlength=size)
            np.minimum.at(low, at, x)
            np.maximum.at(high, at, x)
            few, few_at = np.r_[few, x], np.r_[few_at, at]
            keep = counts[few_at] <= NODES
            few, few_at = few[keep], few_at[keep]
        held = np.flatnonzero(counts)
        order = np.argsort(few_at, kind="stable")
        ends = np.searchsorted(few_at[order], np.r_[held, size])
        yield pa.RecordBatch.from_arrays(
            [pa.array(held), pa.array(counts[held]), pa.array(low[held]), pa.array(high[held]),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(few[order]))],
            ["cell", "n", "low", "high", "few"])

    # At most NODES labels of a cell, or none, reach the driver.
    cells = labels.mapInArrow(seen, "cell bigint, n bigint, low double, high double, few array<double>")
    cells = cells.groupBy("cell").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.flatten(F.collect_list("few")).alias("few"))
    cells = cells.withColumn("few", F.when(F.col("n") <= NODES, F.col("few"))).collect()
    points, filled, half = np.zeros((size, NODES)), np.zeros(size, np.int64), np.zeros(size)
    turns = np.cos((2 * np.arange(NODES) + 1) * math.pi / (2 * NODES))
    for c in cells:
        if c.few is not None:
            points[c.cell], filled[c.cell] = c.few[0], len(c.few)
            points[c.cell, :len(c.few)] = sorted(c.few)
        else:
            half[c.cell] = (c.high - c.low) / 2
            points[c.cell], filled[c.cell] = (c.low + c.high) / 2 + half[c.cell] * turns, NODES
    return points, filled, half


def _cell_sums(edges: np.ndarray, points: np.ndarray, filled: np.ndarray, half: np.ndarray):
    """Weights of the points of each (part, cell) from rows ``_part, label, copies`` in that order.

    A label counts at its own point, or at all points of its cell by Lagrange's polynomials:
    the sum of a polynomial of degree below ``NODES`` over the points is its sum over the labels.
    """
    turn = (2 * np.arange(NODES) + 1) * math.pi / (2 * NODES)
    spots, signs = np.cos(turn), np.sin(turn) * (-1.0) ** np.arange(NODES)

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            ids, x, n = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_part", "label", "copies"))
            at = np.where(np.isfinite(x), np.searchsorted(edges, x, side="right"), -1)
            with np.errstate(all="ignore"):
                wide = half[at] > 0
                u = np.where(wide, (x - (points[at, 0] + points[at, -1]) / 2) / half[at], 0.0)
                share = signs / (u[:, None] - spots)
                share /= share.sum(1, keepdims=True)
            on = (u[:, None] == spots) | (~wide[:, None] & (x[:, None] == points[at]) & (
                np.arange(NODES) < filled[at, None]))
            exact = on.any(1) | ~wide
            share[exact] = on[exact]
            starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (at[1:] != at[:-1])])
            total = np.add.reduceat(share * n[:, None], starts, axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[starts]), pa.array(at[starts]), *map(pa.array, total.T)],
                ["_part", "_cell", *[f"_n{i}" for i in range(NODES)]])

    return sums


def _certain(centre: np.ndarray, half: np.ndarray, w: np.ndarray, m: np.ndarray, v: np.ndarray) -> bool:
    """Do sums over Chebyshev points equal the sums over the labels, to rounding, in all cells?

    A share is a quotient of sums of exponentials.  Where, on the ellipse around a cell, no
    term that matters is turned by more than a sixth of pi against the greatest one, the
    denominator has no zero and the share is below 2, so that its interpolation at ``NODES``
    points is wrong by less than ``8 * RHO ** (1 - NODES) / (RHO - 1)`` (4e-14).
    """
    across, up = half * (RHO + 1 / RHO) / 2, half * (RHO - 1 / RHO) / 2
    m, v = m[:, None], v[:, None]
    offset = np.log(w)[:, None] - 0.5 * np.log(2 * math.pi * v)
    low, mid, high = (offset - 0.5 * (x - m) ** 2 / v for x in (centre - across, centre, centre + across))
    best, each = mid.argmax(0), np.arange(len(centre))
    bend = 1 / v - (1 / v)[best, 0]
    least = np.maximum(low - low[best, each], high - high[best, each])
    least = least + np.maximum(bend, 0) * (across ** 2 + up ** 2) / 2
    slope = [(x - m) / v for x in (centre - across, centre + across)]
    turn = np.maximum(*(abs(g - g[best, each]) for g in slope)) * up
    return bool(((least < NOTHING) | (turn <= math.pi / 6)).all())


def _settled(z: np.ndarray, weight: np.ndarray, centre: np.ndarray, half: np.ndarray, n: float, floor: float,
             k: int, count: int, iterations: int, tolerance: float) -> tuple:
    """Steps of one pool: ``step, w, m, v, fit, gain`` and whether it ended.

    It stops before a step in which the points of a cell would not do for its labels.
    """
    w, m, v = np.zeros(count), (2.0 * np.arange(count) - k + 1) / k, np.ones(count)
    w[:k] = 1 / k
    fit = gain = None
    for step in range(1, iterations + 1):
        live = np.flatnonzero(w > 0)
        fine = len(live) and np.isfinite(v[live]).all() and np.isfinite(m[live]).all()
        if not fine or (len(half) and not _certain(centre, half, w[live], m[live], v[live])):
            return step - 1, w, m, v, fit, gain, False
        gap = z - m[live, None]
        square = gap * gap
        log = (np.log(w[live]) - 0.5 * np.log(2 * math.pi * v[live]))[:, None] - 0.5 * (square / v[live, None])
        top = log.max(0)
        share = np.exp(log - top)
        whole = share.sum(0)
        share /= whole
        mass, first, second = share @ weight, (share * z) @ weight, (share * square) @ weight
        old, before = m, fit
        w, m, v = np.zeros(count), np.zeros(count), np.ones(count)
        for i, j in enumerate(live):
            w[j] = mass[i] / n
            if mass[i]:
                m[j] = first[i] / mass[i]
                # deviations from the last mean: squares of far labels would cancel
                v[j] = max(second[i] / mass[i] - (m[j] - old[j]) ** 2, 0.0)
        v += floor
        fit = float((top + np.log(whole)) @ weight) / n
        gain = None if before is None else abs(fit - before)
        if step == iterations or (gain is not None and gain < tolerance):
            return step, w, m, v, fit, gain, True
    return 0, w, m, v, fit, gain, False


def _pool_steps(points: np.ndarray, filled: np.ndarray, half: np.ndarray, count: int, iterations: int,
                tolerance: float):
    """:func:`_settled` of every pool from its cells, rows in the order of ``_id``."""
    names = [f"_{p}{j}" for j in range(count) for p in "wmv"]
    inside = np.arange(NODES)

    def one(number: int, cell: np.ndarray, weight: np.ndarray, n, floor, mu, sd, k) -> list:
        plain = (cell >= 0).all() and math.isfinite(mu) and math.isfinite(sd)
        most = iterations if plain else 0
        z, wide = (points[cell] - mu) / sd, half[cell] > 0
        use = inside < filled[cell, None]
        centre = (z[wide, 0] + z[wide, -1]) / 2
        step, w, m, v, fit, gain, ends = _settled(
            z[use], weight[use], centre, half[cell][wide] / sd, n, floor, int(k), count, most, tolerance)
        return [number, *np.stack([w, m, v]).T.ravel().tolist(), fit, gain, step, ends]

    def steps(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), *[pa.float64()] * (len(names) + 2), pa.int32(), pa.bool_()]
        out, held = [], []

        def ended():
            cell, weight, facts = (np.concatenate(c) for c in zip(*[h[1:] for h in held]))
            out.append(one(held[0][0], cell, weight, *facts[0].tolist()))

        for part in parts:
            column = lambda c: part.column(c).to_numpy(zero_copy_only=False)
            if not part.num_rows:
                continue
            ids = column("_id")
            weight = np.stack([column(f"_n{i}") for i in range(NODES)], 1)
            facts = np.stack([column(c).astype(float) for c in ("_n", "_floor", "_mu", "_sd", "_k")], 1)
            cell = column("_cell")
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            for a, b in zip(starts, [*starts[1:], len(ids)]):
                if held and held[0][0] != ids[a]:
                    ended()
                    held = []
                held.append((int(ids[a]), cell[a:b], weight[a:b], facts[a:b]))
        if held:
            ended()
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), types)], ["_id", *names, "_fit", "_gain", "_step", "_ends"])

    kinds = ", ".join(f"{n} double" for n in [*names, "_fit", "_gain"])
    return steps, f"_id bigint, {kinds}, _step int, _ends boolean"


def _fit_cells(rows: DataFrame, parts: DataFrame, links: DataFrame, scale: DataFrame, count: int,
               iterations: int, tolerance: float) -> DataFrame:
    """Pools fitted from cells of their labels: ``_id``, parameters, ``_fit, _gain, _step, _ends``.

    Pools whose components become too narrow for the cells come back with ``_ends`` false and
    the parameters of their last step.
    """
    spark = rows.sparkSession
    cores = 4 * spark.sparkContext.defaultParallelism
    label = F.col("label").cast("double").alias("label")
    known = rows.filter(F.col("label").isNotNull()).select("part", label, F.col("copies").cast("double").alias("copies"))
    finite = known.filter(F.abs("label") < F.lit(float("inf"))).select("label")
    ends = finite.agg(F.min("label"), F.max("label"),
                      F.percentile_approx("label", [i / CELLS for i in range(1, CELLS)])).first()
    edges = _edges(*ends)
    grid = _cells_of(finite.distinct(), edges)
    wide = ", ".join(f"_n{i} double" for i in range(NODES))
    cells = (
        known.join(parts.select("part", "_part"), "part").select("_part", "label", "copies")
        .repartitionByRange("_part", "label").sortWithinPartitions("_part", "label")
        .mapInArrow(_cell_sums(edges, *grid), f"_part bigint, _cell bigint, {wide}")
        # pools of a cell are added up where the cell is
        .repartition(cores, "_cell")
    )
    sums = cells.join(links.select("_id", "_part", "weight"), "_part").groupBy("_id", "_cell").agg(
        *[F.sum(F.col(f"_n{i}") * F.col("weight")).alias(f"_n{i}") for i in range(NODES)])
    facts = scale.select("_id", "_n", (VARIANCE_FLOOR / (F.col("_sd") * F.col("_sd"))).alias("_floor"), "_mu", "_sd", "_k")
    fed = sums.join(facts, "_id").repartition(cores, "_id").sortWithinPartitions("_id", "_cell")
    return materialize(fed.mapInArrow(*_pool_steps(*grid, count, iterations, tolerance)), "pool-steps")


def _step_sums(count: int):
    """Sums of one step: every row's labels under every pool of the row, added up by pool."""
    names = [f"_{p}{j}" for j in range(count) for p in "wmv"]
    out = [f"_{p}{j}" for j in range(count) for p in ("s", "sx", "sxx")]

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = lambda column: (column.flatten(), np.concatenate(([0], np.cumsum(
            column.value_lengths().to_numpy(zero_copy_only=False)))))
        for part in parts:
            (x, xs), (copies, _), (pools, ps) = (flat(part.column(c)) for c in ("labels", "copies", "pools"))
            x, copies = x.to_numpy(zero_copy_only=False), copies.to_numpy(zero_copy_only=False)
            cell = {f.name: pools.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(pools.type)}
            ids, at = np.unique(cell["_id"], return_inverse=True)
            total = np.zeros((len(ids), len(out) + 1))
            w, m, v = (np.stack([cell[f"_{p}{j}"] for j in range(count)]) for p in "wmv")
            kind = (1 << np.arange(count)) @ (w > 0)
            with np.errstate(all="ignore"):
                offset = np.log(w) - 0.5 * np.log(2 * math.pi * v)
                for r in range(part.num_rows):
                    span = np.arange(ps[r], ps[r + 1])
                    value, n = x[xs[r]:xs[r + 1]], copies[xs[r]:xs[r + 1]]
                    for some in np.unique(kind[span]):  # pools with the same live components
                        p = span[kind[span] == some]
                        live = [j for j in range(count) if some >> j & 1]
                        z = (value - cell["_mu"][p, None]) / cell["_sd"][p, None]
                        gap = [z - m[j, p, None] for j in live]
                        square = [g * g for g in gap]
                        log = [offset[j, p, None] - 0.5 * (q / v[j, p, None]) for j, q in zip(live, square)]
                        top = reduce(np.maximum, log)
                        share = [np.exp(g - top) for g in log]
                        whole = reduce(np.add, share)
                        weight = cell["weight"][p]
                        got = np.zeros((len(p), len(out) + 1))
                        for j, e, q in zip(live, share, square):
                            e /= whole
                            got[:, 3 * j] = (e @ n) * weight
                            got[:, 3 * j + 1] = ((e * z) @ n) * weight
                            # deviations from the last mean: squares of far labels would cancel
                            got[:, 3 * j + 2] = ((e * q) @ n) * weight
                        got[:, -1] = ((top + np.log(whole)) @ n) * weight
                        total[at[p]] += got  # a pool is once in a row
            yield pa.RecordBatch.from_arrays([pa.array(ids), *map(pa.array, total.T)], ["_id", *out, "_seen"])

    return sums, names, out


def fit_pools(
    labels: DataFrame, links: DataFrame, keys: Sequence[str], k: int | str, iterations: int = MOST_STEPS,
    k_max: int | None = None, tolerance: float = TOLERANCE,
) -> DataFrame:
    """Gaussian mixture of every pool: ``mixture`` (``mean, var, weight`` by rising mean),
    ``steps``, ``gain`` and ``converged``.

    ``labels`` is ``(part, label, copies)`` and ``links`` ``(keys, part, weight)``: a pool holds
    the labels of its parts, ``weight`` times.  ``k`` is a number or the name of a column of
    ``links`` (then give ``k_max``); a pool of n labels gets min(k, n) components.

    Expectation maximisation runs on all pools at once.  Labels are standardised per pool, and
    components start at evenly spaced deviations from the mean.  A pool is settled when a step
    raised the mean log-likelihood of its labels by less than ``tolerance``.  A pool that is not
    settled after ``iterations`` is returned with ``converged`` false and its last ``gain``.

    Labels are reduced once to sums per part and cell, and a task takes a pool through all its
    steps on the sums of its cells, whose number does not grow with the labels.  They give the
    sums over the labels to rounding, as long as no component is narrow against a cell of many
    labels (:func:`_certain`, tested before each step).  Pools that come to such a step go on over
    all their labels: these are written once, in rows of about ``CHUNK``; a step joins them with
    the parameters of the pools of their part and sums responsibilities per pool, so parts and
    pools may have any number of labels.  Settled pools are set aside, and only the others enter
    the next step.
    """
    keys = list(keys)
    k_max = k if isinstance(k, int) else k_max
    wanted = F.lit(k) if isinstance(k, int) else F.first(k)
    copies, label, weight = F.col("copies"), F.col("label"), F.col("weight")
    rows = materialize(labels.groupBy("part", "label").agg(F.sum(copies).alias("copies")), "pool-labels")
    known = F.when(label.isNotNull(), copies)
    parts = materialize(rows.groupBy("part").agg(
        F.sum(copies).alias("_all"), F.sum(known).alias("_known"), F.sum(label * copies).alias("_total"),
        F.try_divide(F.sum(label * copies), F.sum(known)).alias("_mean"), F.count(label).alias("_labels"),
    ).withColumn("_part", F.monotonically_increasing_id()), "pool-parts")
    off = label - F.col("_mean")
    apart = rows.join(parts, "part").groupBy("part").agg(F.sum(off * off * copies).alias("_square"))
    linked = links.join(parts, "part").join(apart, "part")
    moments = linked.groupBy(*keys).agg(
        F.sum(F.col("_all") * weight).alias("_n"),
        F.try_divide(F.sum(F.col("_total") * weight), F.sum(F.col("_all") * weight)).alias("_mu"),
        wanted.alias("_k"),
    )
    far = F.col("_mean") - F.col("_mu")
    spread = linked.join(moments, keys).groupBy(*keys).agg(F.sqrt(F.try_divide(
        F.sum((F.col("_square") + F.col("_known") * far * far) * weight), F.sum(F.col("_all") * weight)
    )).alias("_sd"))
    scale = moments.join(spread, keys).withColumns(
        {
            "_sd": F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1.0)),
            "_k": F.least(F.col("_k"), F.col("_n")).cast("int"),
            "_id": F.monotonically_increasing_id(),
        }
    )
    scale = materialize(scale, "pool-scale")
    many = links.groupBy("part").agg(F.count(F.lit(1)).alias("_pools"))
    links = materialize(
        links.join(scale.select(*keys, "_id"), keys).join(many, "part").join(parts.select("part", "_part"), "part").select(
            "_id", "part", "_part", weight.cast("double").alias("weight"),
            F.pmod(F.xxhash64("_id"), F.ceil(F.col("_pools") / BLOCK)).alias("_block")), "pool-links")

    components = range(k_max)
    sums_of, names, parts_of = _step_sums(k_max)
    floor = VARIANCE_FLOOR / (F.col("_sd") * F.col("_sd"))
    params = scale.select("_id", "_n", floor.alias("_floor"), "_mu", "_sd").join(
        _fit_cells(rows, parts, links, scale, k_max, iterations, tolerance), "_id", "left"
    ).withColumns({  # a pool without labels has nothing to add up in any step
        "_step": F.coalesce("_step", F.lit(iterations)), "_ends": F.coalesce("_ends", F.lit(True))})
    params = materialize(params, "mixture-step")
    settled = [params.filter("_ends")]
    params = params.filter("NOT _ends")
    unsettled = not params.isEmpty()
    if unsettled:
        dealt = F.pmod(F.xxhash64(label), F.ceil(F.col("_labels") / CHUNK))
        cells = F.collect_list(F.struct(label.cast("double").alias("label"), copies.cast("double").alias("copies")))
        chunks = materialize(
            rows.filter(label.isNotNull()).join(parts.select("part", "_labels"), "part")
            .groupBy("part", dealt.alias("_chunk")).agg(cells.alias("cells"))
            .select("part", F.col("cells.label").alias("labels"), F.col("cells.copies").alias("copies"))
            # the work is in the steps: a table of few megabytes still takes every core
            .repartition(4 * rows.sparkSession.sparkContext.defaultParallelism),
            "pool-chunks", ITERATED_ROW_GROUP_MB)
    types = ", ".join(f"{n} double" for n in [*parts_of, "_seen"])
    while unsettled:
        # One row per part and block of pools.  Written out, its size is known: a small table
        # is broadcast and the labels are not shuffled.
        blocks = links.join(params, "_id").groupBy("part", "_block").agg(
            F.collect_list(F.struct("_id", "weight", "_mu", "_sd", *names)).alias("pools"))
        blocks = materialize(blocks.drop("_block"), "mixture-pools")
        met = chunks.join(blocks, "part").select("labels", "copies", "pools")
        sums = met.mapInArrow(sums_of, f"_id bigint, {types}").groupBy("_id").agg(
            *[F.sum(n).alias(n) for n in [*parts_of, "_seen"]])
        sums = params.withColumnsRenamed({f"_m{j}": f"_old{j}" for j in components}).join(sums, "_id", "left")
        update = {}
        for j in components:
            mass, mean = F.col(f"_s{j}"), F.try_divide(F.col(f"_sx{j}"), F.col(f"_s{j}"))
            moved = mean - F.col(f"_old{j}")
            var = F.try_divide(F.col(f"_sxx{j}"), mass) - moved * moved
            update[f"_w{j}"] = mass / F.col("_n")
            update[f"_m{j}"] = F.coalesce(mean, F.lit(0.0))
            update[f"_v{j}"] = F.greatest(F.coalesce(var, F.lit(1.0)), F.lit(0.0)) + F.col("_floor")
        fit = F.col("_seen") / F.col("_n")
        params = sums.select(
            "_id", "_n", "_floor", "_mu", "_sd", *[update[n].alias(n) for n in names], fit.alias("_fit"),
            F.abs(fit - F.col("_fit")).alias("_gain"), (F.col("_step") + 1).alias("_step"))
        # One row per pool.  Written out, because that cuts the lineage.
        ends = F.coalesce(F.col("_gain") < tolerance, F.lit(False)) | (F.col("_step") >= iterations)
        left = Observation()
        params = materialize(params.withColumn("_ends", ends).observe(
            left, F.count(F.when(~ends, 1)).alias("pools")), "mixture-step")
        settled.append(params.filter("_ends"))
        params = params.filter("NOT _ends")
        unsettled = left.get["pools"] > 0
    # Steps in which no pool settled hold no result.
    settled = [s for s in settled if not s.isEmpty()] or settled[:1]
    final = reduce(DataFrame.unionByName, settled).join(scale.select(*keys, "_id"), "_id")
    cells = [
        F.struct(
            (F.col(f"_m{j}") * F.col("_sd") + F.col("_mu")).alias("mean"),
            (F.col(f"_v{j}") * F.col("_sd") * F.col("_sd")).alias("var"),
            F.col(f"_w{j}").alias("weight"),
        )
        for j in components
    ]
    mixture = F.array_sort(F.filter(F.array(*cells), lambda c: c["weight"] > 0))
    return final.select(*keys, mixture.alias("mixture"), F.col("_step").alias("steps"),
                        F.col("_gain").alias("gain"),
                        F.coalesce(F.col("_gain") < tolerance, F.lit(False)).alias("converged"))


def fit_single(pools: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """One-component mixture in closed form: mean and population variance."""
    return pools.groupBy(*keys).agg(
        F.avg(label).alias("mean"), (F.var_pop(label) + VARIANCE_FLOOR).alias("var")
    )


def _component_logs(mixture: Column, y: Column) -> Column:
    return F.transform(mixture, lambda c: _log_density(y, c["weight"], c["mean"], c["var"]))


def log_likelihood(mixture: Column, y: Column) -> Column:
    """Log density of a label under a mixture."""
    logs = _component_logs(mixture, y)
    top = F.array_max(logs)
    return top + F.log(F.aggregate(logs, F.lit(0.0), lambda a, v: a + F.exp(v - top)))


def responsibilities(mixture: Column, y: Column) -> Column:
    """Share of each component in a label's density (they sum to 1)."""
    total = log_likelihood(mixture, y)
    return F.transform(_component_logs(mixture, y), lambda v: F.exp(v - total))


def mixture_score(rows: DataFrame, x: Sequence[str], y: str = "label") -> DataFrame:
    """Mean log-likelihood of the true labels of each distinct feature vector."""
    return rows.groupBy(*x).agg(F.avg(log_likelihood(F.col("mixture"), F.col(y))).alias("score"))


def nearest_mean(mixture: Column, y: Column) -> Column:
    """Component mean closest to the label; the earlier component wins a tie."""
    gaps = F.transform(
        mixture, lambda c, i: F.struct(F.abs(c["mean"] - y).alias("gap"), i.alias("i"), c["mean"].alias("mean"))
    )
    return F.array_min(gaps)["mean"]


def nearest_component_rmsre(mixture: Column, y: Column, swap: bool = False, copies: Column | None = None) -> Column:
    """Relative error (aggregate) of the closest component mean.

    ``swap`` divides by the prediction instead of the truth; ``copies`` counts equal rows.
    """
    chosen = nearest_mean(mixture, y)
    return errors.rmsre(chosen, y, copies) if swap else errors.rmsre(y, chosen, copies)


def tune_pools(
    test: DataFrame, labels: DataFrame, links: DataFrame, label: str = "label",
    counts: Sequence[int] = (1, 2, 3, 4, 5), iterations: int = MOST_STEPS, copies: str | None = None,
) -> DataFrame:
    """Relative error of the nearest component for each component count, all fitted together.

    ``labels`` and ``links`` are as in :func:`fit_pools`, with the key ``pool``; ``copies`` names
    the column that counts equal rows of ``test``.
    """
    tried = links.withColumn("num_component", F.explode(F.array(*[F.lit(c) for c in counts])))
    fitted = fit_pools(labels, tried, ["pool", "num_component"], "num_component", iterations, max(counts))
    held = [] if copies is None else [copies]
    met = test.select("pool", label, *held).join(fitted, "pool")
    return met.groupBy("num_component").agg(
        nearest_component_rmsre(F.col("mixture"), F.col(label), copies=F.col(copies) if held else None).alias("rmsre")
    )


def tune_components(
    test: DataFrame, pools: DataFrame, label: str = "label", counts: Sequence[int] = (1, 2, 3, 4, 5),
    iterations: int = MOST_STEPS,
) -> DataFrame:
    """:func:`tune_pools` of pools given as ``(pool, label, copies)``."""
    labels = materialize(pools.dropna(subset=["pool"]).withColumnRenamed("pool", "part"), "pools")
    links = labels.select(F.col("part").alias("pool"), "part", F.lit(1).alias("weight")).distinct()
    return tune_pools(test, labels, links, label, counts, iterations)


def two_stage_predict(
    train: DataFrame, test: DataFrame, unique: Sequence[str], extra: str, label: str = "label"
) -> DataFrame:
    """Forest whose leaves hold a second, fully grown tree on one extra feature.

    Grown to the end, a tree on one feature predicts the mean label of the
    nearest training value (its thresholds are midpoints, a tie goes to the
    smaller value), so the second stage is a nearest-value join per (tree, leaf).
    Both inputs carry ``leaves``; predictions are averaged over the trees.
    """
    # Whole leaf vectors first: rows that share vector and extra value are one from here on.
    extra_value = F.col(extra).cast("double").alias("_extra")
    sums = train.groupBy("leaves", extra_value).agg(
        F.sum(label).alias("_sum"), F.count(label).alias("_rows")
    )
    stage = (
        sums.select(F.posexplode("leaves").alias("tree", "leaf"), "_extra", "_sum", "_rows")
        .groupBy("tree", "leaf", "_extra")
        .agg((F.sum("_sum") / F.sum("_rows")).alias("_mean"))
    )
    vectors = test.select("leaves", extra_value).distinct()
    asked = vectors.select("leaves", "_extra", F.posexplode("leaves").alias("tree", "leaf"))
    found = nearest(stage, asked.select("tree", "leaf", "_extra"), ["tree", "leaf"], "_extra", [], 1)
    values = found.select("tree", "leaf", F.col("query").alias("_extra"), "_mean")
    predicted = (
        asked.join(values, ["tree", "leaf", "_extra"])
        .groupBy("leaves", "_extra")
        .agg(F.avg("_mean").alias("prediction"))
    )
    rows = test.select(*unique, "leaves", extra_value)
    return rows.join(predicted, ["leaves", "_extra"]).select(*unique, "prediction")
