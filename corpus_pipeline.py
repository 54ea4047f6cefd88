"""From ``documents`` to token ids: five stages, each with one operator of ``benchloom.llm``.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept, and is
written as Parquet below ``spark.checkpoint.dir`` before the next one reads it.  All but the
last return the columns of ``documents``; columns a stage does not know, whatever their names,
come out as they went in.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchloom.llm import jaccard_join, line_dedup, mixing, pieces, toxicity
from benchloom.llm.common import free, store, table
from benchloom.llm.queries import MIX_WEIGHTS, mix_levels

TOXIC = 0.3        # documents that score this or more are rejected
MIX_SHARE = 0.8    # of the tokens that are left, to be spread by the target weights


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8.  The model learns from the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out("doc_id"))
    model = toxicity.train(docs, labels)
    score, = free(docs.columns, "__score")
    return (docs.withColumn(score, model.score(F.col("text")))
            .where(F.col(score) < TOXIC).select(*docs.columns))


def cut_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2.  Every document stays; ``n_chars`` follows a changed text.

    A class of near copies counts for one site, so a copied document is not boilerplate, and
    lines that reach the threshold go from every document, also where they are most of it.
    """
    counts = free(docs.columns, "__n_lines", "__n_removed")
    cut = line_dedup.line_dedup(docs, classes=jaccard_join.text_classes(docs), counts=tuple(counts))
    changed = F.col(counts[1]) > 0
    return (cut.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint"))
                           .otherwise(F.col("n_chars")))
            .select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9.  Of each class of near duplicates the smallest id stays.

    Documents without words or without an id have no class and stay; rows that repeat the id
    that stays all stay.
    """
    name, = free(docs.columns, "__id")
    dropped = (jaccard_join.jaccard_join(docs).where("NOT kept")
               .select(F.col("id").alias(name)).distinct().hint("merge"))
    return docs.join(dropped, docs["doc_id"] == F.col(name), "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7.  No document is taken twice (one epoch)."""
    return mixing.mixed_documents(docs, mix_levels(), MIX_WEIGHTS, share=MIX_SHARE,
                                  max_epochs=1, seed="pipeline")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3.  ``doc_id``, ``n_tokens``, ``ids_crc32``, ``round_trip``, ``ids``."""
    return (pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), check=True)
            .select(F.col("id").alias("doc_id"), "n_tokens", "ids_crc32", "round_trip", "ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_boilerplate),
    ("near duplicates", drop_near_copies),
    ("source mix", mix_sources),
    ("token ids", encode),
]
ORACLE_SQL = None  # a trained score and token ids are beyond SQL; tests compare by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
