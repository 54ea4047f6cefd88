"""What the training-data operators share: stored steps, skew-safe joins, components, blocks."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

FILE_ROWS = 250_000    # narrow rows of a stored step in one task and file
LEAST_TASKS = 12       # below this a step is not narrowed

_KEPT: dict[Hashable, Any] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """``make()``, kept while a Python worker lives or until it keeps something else.

    Workers are used again by later stages, so what several operators keep would add up.
    """
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    _KEPT.clear()


def store(df: DataFrame, name: str, row_group_mb: int = 128,
          rows: int | None = None) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, makes joins on both sides of it
    splittable by adaptive execution, and lets several steps read one costly result.

    ``rows`` is about how many narrow rows come out at most.  With it the last step runs in
    as many tasks as they need, so that a small table is not a file per shuffle partition.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(LEAST_TASKS, -(-rows // FILE_ROWS)))
    path = scratch_path(spark, name)
    (df.write.option("compression", "zstd")
       .option("parquet.block.size", str(row_group_mb << 20)).parquet(path))
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a stored step that nothing reads any more."""
    files = df.inputFiles()
    if files:
        delete(df.sparkSession, files[0].rsplit("/", 1)[0])


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free(taken: list[str], *names: str) -> list[str]:
    """``names``, with underscores in front where ``taken`` holds them already."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly, so that a following join has its own, splittable exchange."""
    return df.repartition(shuffles(df.sparkSession))


def batches(rows: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the incoming batches with about ``limit`` bytes in ``column`` each.

    A single longer value is a slice of its own, so memory follows the longest value.
    """
    for batch in rows:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60,
               rows: int | None = None) -> DataFrame:
    """Connected components of undirected edges, as rows ``(node, component)``.

    ``component`` is the smallest node reachable.  Each round joins every node to the
    smallest neighbour (first for larger, then for smaller neighbours) until the edges
    are stars around the smallest nodes.  Nodes of any degree are safe: the minimum is a
    map-side aggregate, and both join sides are plain exchanges that adaptive execution
    splits.  Loops ``(x, x)`` are allowed and ignored.  Edges are never collected.  ``rows``
    is about how many edges there are at most, if that is known.
    """
    edges = store(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges", rows=rows)
    count = edges.count()
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = spread(both.groupBy("u").agg(F.min("v").alias("m"))
                     .select("u", F.least("u", "m").alias("m")))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = store(large.where("u != v").distinct(), "edges", rows=count)
        discard(edges)
        low = spread(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(
                     F.struct("u", F.col("m").alias("v")),
                     F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.*"))
        edges = store(small.where("u != v").distinct(), "edges", rows=count)
        discard(large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003),
                        F.count_distinct("u")).first()
        if tuple(now) == seen and now[0] == now[2]:
            break
        seen, count = tuple(now), now[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def pair_blocks(df: DataFrame, identity: Column, chunks: Column) -> DataFrame:
    """Copies of each row for the blocks in which it meets the rows of its group.

    A group is cut into ``chunks`` parts by a hash of ``identity``; part i meets part j in
    block (i, j), i <= j.  Adds ``part``, ``lo`` and ``hi``.  Blocks are bounded whatever the
    size of the group, and every pair of rows meets in exactly one block.
    """
    part = F.pmod(F.xxhash64(identity), chunks.cast("bigint")).cast("int")
    return (df.withColumn("part", part)
            .withColumn("other", F.explode(F.sequence(F.lit(0), chunks.cast("int") - 1)))
            .withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
            .drop("other"))
