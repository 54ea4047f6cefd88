"""Experiment logs: listing, bodies and the entry index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import with_rank

# Kinds of output entries, in matching order.
OUTPUT_KINDS = ("eventlogs", "container", "node", "bench", "driver")


def list_entries(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """Path and length of every file below ``folder``; bodies are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder).select("path", "length", "modificationTime")


def log_lines(spark: SparkSession, folder: str, numbered: bool = False) -> DataFrame:
    """Lines of all log files with their path, and on request their line number.

    Files are split like any text source.  Within a file the start of the split
    and the order inside it give the line order, so no file is read as one value.
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .text(folder)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.col("value").alias("line"),
        )
    )
    if not numbered:
        return lines.drop("_block")
    placed = lines.withColumn("_place", F.monotonically_increasing_id())
    return with_rank(placed, ["path"], ["_block", "_place"], "line_no").drop("_block", "_place")


def log_index(paths: DataFrame, path: str = "path") -> DataFrame:
    """Entries ``(app_id, log_id, name, entry_type, path)`` of object keys.

    The first path part is the log; its first two ``-`` words are the app.
    Keys of no known kind are left out.
    """
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    log_id = F.get(parts, 0)
    inside = lambda word: F.array_contains(parts, word)
    entry_type = (
        F.when(inside("output"), "output")
        .when(inside("input"), "input")
        .when(inside("info"), "info")
        .when(F.get(parts, 1) == "_SUCCESS", "success")
    )
    output = F.when(F.lit(False), "")
    for kind in OUTPUT_KINDS:
        output = output.when(inside(kind), kind)
    given = (
        F.when(F.contains(last, F.lit("bench_configs")), "bench_configs")
        .when(F.contains(last, F.lit("configs")), "app_configs")
        .otherwise(last)
    )
    named = (
        F.when(entry_type == "output", output).when(entry_type == "input", given).otherwise(last)
    )
    return paths.select(
        F.array_join(F.slice(F.split(log_id, "-"), 1, 2), "-").alias("app_id"),
        log_id.alias("log_id"),
        named.alias("name"),
        entry_type.alias("entry_type"),
        F.col(path).alias("path"),
    ).filter(F.col("entry_type").isNotNull() & F.col("name").isNotNull())
