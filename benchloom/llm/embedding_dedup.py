"""Embedding near-dedup by collision-counting projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, pair_blocks, spread, store

THRESHOLD = 0.98
RECALL = 0.9999
LISTS = 24
COARSE = 5          # coarse cells that a list's sort key starts with
BLOCK_ROWS = 1024   # vectors of one part of a crowded cell
PAIRS = 1 << 19     # pairs looked at together


@dataclass
class Plan:
    """Widths and the count of collisions, calibrated for pairs at the threshold.

    For unit vectors at cosine ``threshold`` the difference of a Gaussian projection is
    normal with deviation d = sqrt(2 - 2 * threshold).  A list sorts vectors by ``coarse``
    cells of width 6 d and, inside them, by one projection; two vectors collide in a list if
    their cells agree and they lie in each other's window of half-width 2 d.  ``needed`` is
    the largest count that such a pair reaches with chance ``recall``; closer pairs reach it
    more often.
    """

    threshold: float
    lists: int
    coarse: int
    recall: float

    def __post_init__(self):
        self.spread = math.sqrt(2 - 2 * self.threshold)
        self.cell, self.window = 6 * self.spread, 2 * self.spread
        # chance that |N(0, d)| stays inside one cell of a randomly shifted grid
        x = np.linspace(0, 6, 20001)
        density = np.sqrt(2 / np.pi) * np.exp(-x * x / 2)
        one = float(np.trapezoid(density * (1 - x / 6), x))
        self.chance = one ** self.coarse * math.erf(2 / math.sqrt(2))
        miss, needed = 0.0, 0
        for count in range(self.lists):
            miss += (math.comb(self.lists, count) * self.chance ** count
                     * (1 - self.chance) ** (self.lists - count))
            if miss > 1 - self.recall:
                break
            needed = count + 1
        if not needed:
            raise ValueError("too few lists for this recall")
        self.needed = needed

    def keys(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell hash and projection of each unit vector in each list."""
        draw = np.random.default_rng(vectors.shape[1])
        cells = np.zeros((len(vectors), self.lists), np.int64)
        for _ in range(self.coarse):
            axes = draw.standard_normal((vectors.shape[1], self.lists))
            shift = draw.uniform(0, self.cell, self.lists)
            cell = np.floor((vectors @ axes + shift) / self.cell).astype(np.int64)
            cells = cells * 1_000_003 + cell
        return cells, vectors @ draw.standard_normal((vectors.shape[1], self.lists))


def _unit(data: list[bytes], kind: str) -> np.ndarray:
    vectors = np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _clean(kind: str):
    def clean(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data = []
            for row in part.column("vector").to_pylist():
                vector = np.array([np.nan if v is None else v for v in row or []], kind)
                usable = len(vector) > 0 and np.isfinite(vector).all() and vector.any()
                data.append((vector + 0.0).tobytes() if usable else None)
            labels = part.column("label")
            data = [d if x is not None else None for d, x in zip(data, labels.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), labels, pa.array(data, pa.binary())], ["id", "label", "data"])

    return clean


def _listed(plan: Plan, kind: str):
    def listed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data = part.column("data").to_pylist()
            cells = np.zeros((len(data), plan.lists), np.int64)
            widths = np.array([len(d) for d in data])
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                cells[at] = plan.keys(_unit([data[k] for k in at], kind))[0] * 31 + width
            yield pa.RecordBatch.from_arrays(
                [part.column("rep"), part.column("label"),
                 pa.array(cells.tolist(), pa.list_(pa.int64()))], ["rep", "label", "cells"])

    return listed


def _window_pairs(order_key: np.ndarray, window: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of a sorted array whose values differ by at most ``window``."""
    ends = np.searchsorted(order_key, order_key + window, "right")
    counts = ends - np.arange(len(order_key)) - 1
    total = np.cumsum(counts)
    start = 0
    while start < len(order_key):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + PAIRS, "right")))
        own = counts[start:stop]
        i = np.repeat(np.arange(start, stop), own)
        step = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        yield i, i + 1 + step
        start = stop


def _collide(plan: Plan, kind: str):
    def collide(group: pd.DataFrame) -> pd.DataFrame:
        ids, copies = group["rep"].to_numpy(), group["copies"].to_numpy()
        width = group["data"].str.len().to_numpy()
        links, near = np.zeros(len(group), np.int64), ids.copy()
        linked = []
        for size in np.unique(width):
            at = np.flatnonzero(width == size)
            rows = group.iloc[at]
            # one row per vector and cell: the vectors themselves are far fewer
            names, first, own = np.unique(rows["rep"], return_index=True, return_inverse=True)
            unit = _unit(rows["data"].iloc[first].tolist(), kind)
            cells, values = plan.keys(unit)
            turn = rows["list"].to_numpy()
            block = pd.factorize(pd.MultiIndex.from_frame(
                rows[["label", "list", "cell", "lo", "hi"]]))[0]
            value = values[own, turn]
            order = np.lexsort((value, block))
            # a gap between blocks keeps windows inside them
            gap = np.ptp(values) + 4 * plan.window if len(values) else 0
            part, mixed = rows["part"].to_numpy()[order], (rows["lo"] != rows["hi"]).to_numpy()[order]
            who, turn = own[order], turn[order]
            for i, j in _window_pairs(block[order] * gap + value[order], plan.window):
                keep = ~mixed[i] | (part[i] != part[j])
                i, j = i[keep], j[keep]
                a, b = who[i], who[j]
                hits = (cells[a] == cells[b]) & (np.abs(values[a] - values[b]) <= plan.window)
                # a pair is judged in the first list in which it collides
                good = (hits.argmax(1) == turn[i]) & (hits.sum(1) >= plan.needed)
                a, b = a[good], b[good]
                close = np.einsum("ij,ij->i", unit[a], unit[b]) >= plan.threshold
                a, b = at[first[a[close]]], at[first[b[close]]]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                linked.append((a, b))
        if not linked:
            return pd.DataFrame({"rep": [], "links": [], "near": []}, dtype="int64")
        a, b = (np.concatenate(x) for x in zip(*linked))
        for _ in range(len(group)):
            before = near.copy()
            np.minimum.at(near, a, near[b])
            np.minimum.at(near, b, near[a])
            if (before == near).all():
                break
        some = links > 0
        return pd.DataFrame({"rep": ids[some], "links": links[some], "near": near[some]})

    return collide


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, lists: int = LISTS,
                    coarse: int = COARSE, recall: float = RECALL, id_column: str = "vec_id",
                    vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: ``id``, ``n_links``, ``component_id``, ``kept``.

    Vectors with the same label are linked at cosine >= ``threshold`` in double precision.
    Vectors that are null, empty, zero or hold null or non-finite components, and vectors
    without a label, link with nothing; vectors of different lengths never link.

    1. Equal vectors of a label become one representative with a number of copies.
    2. Every list hashes the coarse cells of a vector; cells with one vector are dropped.
    3. A task sorts the vectors of its cells by the list's projection.  Windows around each
       vector give pairs, whose collisions over all lists are counted; pairs with ``needed``
       collisions are verified by cosine, in the first list in which they collide.  Crowded
       cells are cut into parts that meet pairwise, so no task holds a whole cell.  A task
       returns counts per vector, never pairs.

    The miss chance of a pair at the threshold is below 1 - ``recall``; every pair reported
    is exact.  Repeated rows count as vectors of their own; ids are expected to be unique
    otherwise.
    """
    plan = Plan(threshold, lists, coarse, recall)
    tag = vectors.schema[label].dataType.simpleString()
    # vectors travel in the width they came in; all arithmetic is double
    kind = "<f4" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    clean = store(
        vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(label).alias("label"),
                       F.col(vector).alias("vector"))
        .mapInArrow(_clean(kind), f"id bigint, label {tag}, data binary"), "vectors")
    usable = clean.where("data IS NOT NULL AND id IS NOT NULL")
    classes = store(usable.groupBy("label", "data").agg(F.min("id").alias("rep"),
                                                        F.count("*").alias("copies")), "classes")
    cells = store(classes.select("rep", "label", "data").mapInArrow(
        _listed(plan, kind), f"rep bigint, label {tag}, cells array<bigint>"), "cells")
    cells = cells.select("rep", "label", F.posexplode("cells").alias("list", "cell"))
    crowds = spread(cells.groupBy("label", "list", "cell").agg(F.count("*").alias("rows"))
                    .where("rows > 1")
                    .withColumn("chunks", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")))
    met = pair_blocks(cells.join(crowds.drop("rows"), ["label", "list", "cell"]),
                      F.col("rep"), F.col("chunks"))
    # whole cells are dealt out by their hash; parts of a crowded cell by their block too
    tasks = max(1, crowds.agg(F.coalesce(F.sum(F.col("rows") * F.col("chunks")), F.lit(0)))
                .first()[0] // 20_000)
    met = met.withColumn("task", F.pmod(F.xxhash64("label", "list", "cell", "lo", "hi"),
                                        F.lit(tasks)))
    found = store(
        met.select("rep", "list", "cell", "part", "lo", "hi", "task")
        .join(classes.select("rep", "label", "data", "copies"), "rep")
        .groupBy("task").applyInPandas(
            _collide(plan, kind), "rep bigint, links bigint, near bigint"), "links")
    near = components(found, "rep", "near")
    counted = (found.groupBy("rep").agg(F.sum("links").alias("links"))
               .join(near, F.col("rep") == F.col("node")).select("rep", "links", "component"))
    per_class = store(
        classes.join(counted, "rep", "left")
        .select("label", "data", "copies", F.coalesce("component", "rep").alias("component"),
                F.coalesce("links", F.lit(0)).alias("links")), "linked")
    result = usable.join(per_class, ["label", "data"]).select(
        "id", (F.col("copies") - 1 + F.col("links")).alias("n_links"),
        F.col("component").alias("component_id"))
    alone = clean.where("data IS NULL OR id IS NULL").select(
        "id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return (result.unionByName(alone)
            .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))))
