"""Instance-type catalogue: reading, supported types and selections."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars

# Instance families and scales.
GENERAL = ("m1", "m2", "m3", "m4", "m5", "m5a", "m5d")
GENERAL_LATEST = ("m5", "m5a", "m5d")
GENERAL_BURSTABLE = ("t1", "t2", "t3")
COMPUTE = ("c1", "c3", "c4", "c5", "c5d", "c5n")
COMPUTE_LATEST = ("c5", "c5d", "c5n")
COMPUTE_FREQ = ("z1d",)
MEMORY = ("r3", "r4", "r5", "r5a", "r5d")
MEMORY_LATEST = ("r5", "r5a", "r5d")
DISK_IO = ("i2", "i3")
SMALL_SCALES = ("nano", "micro", "small")
MEDIUM_SCALES = ("medium",)
LARGE_SCALES = ("large", "xlarge", "2xlarge", "3xlarge", "4xlarge")
# Excluded by the later selections.
FAMILY_BLACKLIST = ("m5a", "r5a", "c1", "m1")
NAME_BLACKLIST = ("m3.medium", "m3.large", "c5d.xlarge", "r5d.large")

# selection -> (families, scales, excluded families, excluded names)
SELECTIONS = {
    "common": (
        GENERAL + GENERAL_BURSTABLE + COMPUTE + COMPUTE_FREQ + MEMORY + DISK_IO,
        SMALL_SCALES + MEDIUM_SCALES + LARGE_SCALES,
        (),
        (),
    ),
    "latest": (
        GENERAL_LATEST + COMPUTE_LATEST + MEMORY_LATEST,
        SMALL_SCALES + MEDIUM_SCALES + LARGE_SCALES,
        FAMILY_BLACKLIST,
        NAME_BLACKLIST,
    ),
    "small": (
        GENERAL + COMPUTE + MEMORY,
        SMALL_SCALES + MEDIUM_SCALES + LARGE_SCALES,
        FAMILY_BLACKLIST,
        NAME_BLACKLIST,
    ),
    "tiny": (
        GENERAL_LATEST + COMPUTE_LATEST + MEMORY_LATEST,
        SMALL_SCALES,
        FAMILY_BLACKLIST,
        NAME_BLACKLIST,
    ),
}


def normalize_catalog(raw: DataFrame, select: Column | None = None, key: str = "API Name") -> DataFrame:
    """Catalogue with normalised attribute names and cell texts, optionally of selected rows."""
    rows = raw if select is None else raw.filter(F.coalesce(select, F.lit(False)))
    cells = [
        scalars.normalize_value(F.col(f"`{c}`")).alias(c.replace(" ", "_")) for c in rows.columns
    ]
    return rows.select(*cells).withColumnRenamed(key, key.replace(" ", "_"))


def read_catalog(spark: SparkSession, path: str, select: Column | None = None) -> DataFrame:
    """Read a catalogue CSV with a header line."""
    return normalize_catalog(spark.read.option("header", "true").csv(path), select)


def supported_types(lines: DataFrame, line: str = "line") -> DataFrame:
    """Distinct instance types named in ``Name: "<type>",`` lines."""
    word = F.get(F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " "), 1)
    return (
        lines.filter(F.contains(line, F.lit("Name:")))
        .select(F.translate(word, '",', "").alias("api_name"))
        .distinct()
    )


def family_scale(name: Column) -> tuple[Column, Column]:
    parts = F.split(name, r"\.")
    return F.get(parts, 0), F.get(parts, 1)


def select_instances(
    names: DataFrame,
    supported: DataFrame,
    families: Collection[str],
    scales: Collection[str],
    not_families: Collection[str] = (),
    not_names: Collection[str] = (),
    name: str = "api_name",
) -> DataFrame:
    """Rows of wanted families and scales that are supported and not excluded."""
    family, scale = family_scale(F.col(name))
    wanted = family.isin(*families) & scale.isin(*scales)
    if not_families:
        wanted = wanted & ~family.isin(*not_families)
    if not_names:
        wanted = wanted & ~F.col(name).isin(*not_names)
    return names.filter(wanted).join(supported.select(F.col("api_name").alias(name)), name, "left_semi")


def family_union(names: DataFrame, *parts: Column, excluded: DataFrame) -> DataFrame:
    """Union of the families each condition selects, without the excluded ones."""
    out = None
    for part in parts:
        chosen = names.filter(part).select("family")
        out = chosen if out is None else out.union(chosen)
    return out.distinct().subtract(excluded.select("family"))
