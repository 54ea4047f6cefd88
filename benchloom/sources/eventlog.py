"""Framework event logs: completed stages with their accumulables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGE_SCHEMA = (
    "Event string, `Stage Info` struct<`Stage ID`:bigint,`Submission Time`:bigint,"
    "`Completion Time`:bigint,Accumulables:array<struct<ID:bigint,Name:string,Value:string>>>"
)


def read_stages(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """Completed stages of JSON-lines event logs.

    The run is a field of each line when ``run`` names one, else the file path.
    """
    schema = STAGE_SCHEMA + (f", {run} bigint" if run else "")
    lines = spark.read.option("recursiveFileLookup", "true").schema(schema).json(path)
    key = F.col(run) if run else F.col("_metadata.file_path").alias("run_id")
    info = F.col("`Stage Info`")
    return lines.filter(F.col("Event") == "SparkListenerStageCompleted").select(
        key,
        info["Stage ID"].alias("stage_id"),
        info["Submission Time"].alias("submitted"),
        info["Completion Time"].alias("completed"),
        info["Accumulables"].alias("accumulables"),
    )
