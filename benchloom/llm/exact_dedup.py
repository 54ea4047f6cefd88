"""Exact dedup with a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, store


def text_digests(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, digest)`` with the SHA-256 of each whole text; a null text counts as empty."""
    return docs.select(
        F.col(id_column).alias("id"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"))


class DigestIndex:
    """A table of every digest ever kept, below ``folder``.

    The table is bucketed and sorted by digest, so that a batch of new digests meets it in a
    sort-merge anti-join that shuffles the batch only.  It is plain Parquet: a later session
    opens it again by folder (with the same number of buckets).  A batch that failed before
    its append leaves the index as it was, so it can be ingested again; a batch ingested
    twice adds nothing.
    """

    SCHEMA = "digest binary, keep_id bigint"

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.name = "digest_index_" + hashlib.md5(folder.encode()).hexdigest()
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({self.SCHEMA}) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS "
                  f"LOCATION '{folder}'")

    def rows(self) -> DataFrame:
        """The bucketed table, for joins on the digest without a shuffle of the index."""
        return self.spark.table(self.name)

    def unbucketed(self) -> DataFrame:
        """The same rows as plain files, for joins whose other side may be skewed."""
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder)

    def fresh(self, digests: DataFrame) -> DataFrame:
        """One row per digest of the batch that the index lacks; the largest id is kept.

        Equal digests are aggregated on the map side first, so the anti-join has one row per
        digest and no hot key.
        """
        batch = digests.groupBy("digest").agg(F.max("id").alias("keep_id"))
        return batch.join(self.rows().hint("merge"), "digest", "left_anti")

    def ingest(self, digests: DataFrame) -> None:
        """Append the batch's fresh digests."""
        (self.fresh(digests).repartition(self.buckets, "digest")
         .select("digest", "keep_id").write.insertInto(self.name))
        self.spark.catalog.refreshTable(self.name)


def exact_dedup(members: DataFrame, index: DigestIndex) -> DataFrame:
    """Every row of ``members`` (``id``, ``digest``) with the row that stays for its text.

    ``keep_id`` is what the index keeps, ``group_size`` counts equal texts in ``members``,
    ``kept`` is true for the row that stays.  Both sides of the last join are stored tables,
    so a digest that holds a third of all rows is split.  A null id is never kept unless its
    whole group has null ids; several rows with the kept id are all marked kept.
    """
    sizes = members.groupBy("digest").agg(F.count("*").alias("group_size"))
    stays = spread(sizes.join(index.unbucketed(), "digest"))
    return (members.join(stays, "digest")
            .select("id", "keep_id", "group_size",
                    F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"))


def dedup_newest_first(docs: DataFrame, folder: str, buckets: int, batches: int = 2) -> DataFrame:
    """Ingest ``docs`` in ``batches`` of descending id ranges, then report all rows.

    Later batches hold smaller ids, so what the index already has is the larger id: of equal
    texts the row with the largest id stays, whatever batch it is in.  Rows without an id
    come last.
    """
    spark = docs.sparkSession
    members = store(text_digests(docs), "digests")
    low, high = members.agg(F.min("id"), F.max("id")).first()
    index = DigestIndex(spark, folder, buckets)
    if low is not None:
        step = (high - low) // batches + 1
        for k in range(batches):
            top = high - k * step
            index.ingest(members.where((F.col("id") <= top) & (F.col("id") > top - step)))
    index.ingest(members.where("id is null"))
    return exact_dedup(members, index)
