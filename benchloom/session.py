"""Session factory and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "benchloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC and adaptive execution; cluster sizing is left to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` decides.  Only a local session without the setting
    gets a temporary folder, because there driver and executors share one disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="benchloom-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(df: DataFrame) -> None:
    """Delete a materialised frame that nothing reads any more."""
    files = df.inputFiles()
    if files:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "stage", row_group_mb: int = 128) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a later step must see the same rows twice (range bounds,
    generated ids), where several steps read one costly result, or where
    iterations would grow the lineage.  Row groups are the unit of later
    parallel reads: smaller ones suit data that is read many times.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("parquet.block.size", str(row_group_mb << 20)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
