"""Experiment registry: nested JSON to one row per (app, phase, dimension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LEAF = (
    "struct<bucket:string,feature:string,target_feature:string,groupby_index:string,"
    "min_value:string,max_value:string,values:string>"
)
REGISTRY_SCHEMA = (
    "map<string,struct<meta:struct<name:string,app_type:string>,"
    f"spec:map<string,map<string,{_LEAF}>>>>"
)


def registry_flatten(documents: DataFrame, json: str = "json") -> DataFrame:
    """``feature`` may be a name or a list; either is kept as its JSON text, as ``values`` are."""
    apps = documents.select(F.explode(F.from_json(json, REGISTRY_SCHEMA)).alias("app", "_a"))
    phases = apps.select(
        "app",
        F.col("_a.meta.name").alias("name"),
        F.col("_a.meta.app_type").alias("app_type"),
        F.explode("_a.spec").alias("phase", "_p"),
    )
    leaves = phases.select("app", "name", "app_type", "phase", F.explode("_p").alias("dimension", "_d"))
    return leaves.select("app", "name", "app_type", "phase", "dimension", "_d.*")
