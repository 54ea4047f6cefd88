"""Line dedup by distinct-site spread: sketches per line, exact counts near the threshold."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, store

LG_K = 12
MIN_SITES = 10


def lines_of(docs: DataFrame, id_column: str, text: str, site: str) -> DataFrame:
    """``(id, whole, site, pos, digest, size)``: the non-blank lines of every text.

    ``digest`` is the MD5 of the line without spaces at its ends, ``whole`` a hash of the
    text that tells rows with the same id apart.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return (docs.select(F.col(id_column).alias("id"), F.xxhash64(body).alias("whole"),
                        F.col(site).alias("site"), F.posexplode(F.split(body, "\n", -1)))
            .withColumn("line", F.trim("col")).where("line <> ''")
            .select("id", "whole", "site", "pos", F.unhex(F.md5("line")).alias("digest"),
                    F.length("col").alias("size")))


def sketches(lines: DataFrame) -> DataFrame:
    """``(digest, sketch)``: a HyperLogLog sketch of the sites of each line.

    Sketches of several corpora are put together by ``merge`` without reading texts again.
    """
    return (lines.where("site IS NOT NULL").groupBy("digest")
            .agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch")))


def merge(parts: list[DataFrame]) -> DataFrame:
    if len(parts) == 1:
        return parts[0]
    return (reduce(DataFrame.unionByName, parts).groupBy("digest")
            .agg(F.hll_union_agg("sketch").alias("sketch")))


def spread_lines(lines: DataFrame, spread: DataFrame, min_sites: int) -> DataFrame:
    """``digest`` of the lines found on at least ``min_sites`` distinct sites.

    An estimate more than four standard errors (and one site) away from the threshold
    decides; the lines between get exact distinct counts.
    """
    margin = 4 * 1.04 / math.sqrt(1 << LG_K) * min_sites + 1
    found = store(spread.select("digest", F.hll_sketch_estimate("sketch").alias("sites"))
                  .where(F.col("sites") >= min_sites - margin), "spread")
    near = found.where(F.col("sites") <= min_sites + margin)
    exact = (lines.where("site IS NOT NULL").join(near, "digest")
             .groupBy("digest", "site").agg(F.lit(1).alias("one"))
             .groupBy("digest").agg(F.count("*").alias("n"))
             .where(F.col("n") >= min_sites).select("digest"))
    return store(found.where(F.col("sites") > min_sites + margin).select("digest")
                 .unionByName(exact), "boilerplate")


def votes_of(docs: DataFrame, lines: DataFrame, classes: DataFrame, text: str,
             site: str) -> DataFrame:
    """``(digest, site)``: the lines of every distinct text with the site it votes for.

    Texts of one class vote for one site of the class, drawn by hash; a text without a class
    is a class of its own.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    texts = (docs.where(F.col(site).isNotNull())
             .select(F.xxhash64(body).alias("whole"), F.unhex(F.sha2(body, 256)).alias("digest"),
                     F.col(site).alias("site")).distinct())
    named = store(texts.join(classes, "digest", "left").select(
        "whole", "site", F.coalesce(F.col("class_id").cast("string"), F.hex("digest"))
        .alias("copy")), "copies")
    drawn = named.groupBy("copy").agg(F.min_by("site", F.xxhash64("copy", "site")).alias("site"))
    voters = named.select("whole", "copy").distinct().join(drawn, "copy").select("whole", "site")
    # a text that stands in many rows is one row per line here
    return store(lines.where("site IS NOT NULL").select("whole", "digest").distinct()
                 .join(voters, "whole").select("digest", "site"), "votes")


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, id_column: str = "doc_id",
               text: str = "text", site: str = "source", classes: DataFrame | None = None,
               counts: tuple[str, str] = ("__n_lines", "__n_removed")) -> DataFrame:
    """``docs`` with cross-site boilerplate lines taken out of ``text``.

    A line is boilerplate if it stands on at least ``min_sites`` distinct sites; it goes from
    every document, whatever its share.  A text of which nothing remains becomes empty.  All
    rows and columns stay; the numbers of lines and of removed lines are added as ``counts``,
    which must be names ``docs`` does not have.  Blank lines are never boilerplate, a null site
    never counts, a null text stays null, rows with the same id are told apart by their text.

    With ``classes`` (``jaccard_join.text_classes``) each class of near copies counts for one
    site, so that a copied document does not make boilerplate of its lines.
    """
    lines = lines_of(docs, id_column, text, site)
    votes = lines if classes is None else votes_of(docs, lines, classes, text, site)
    spread = spread_lines(votes, merge([sketches(votes)]), min_sites)
    key, hashed, gone = free([*docs.columns, *counts], "__id", "__whole", "__gone")
    hits = (lines.join(spread, "digest").groupBy("id", "whole")
            .agg(F.collect_set("pos").alias(gone))
            .select(F.col("id").alias(key), F.col("whole").alias(hashed), gone))
    body = F.coalesce(F.col(text), F.lit(""))
    parts = F.split(body, "\n", -1)
    joined = docs.join(
        hits, docs[id_column].eqNullSafe(F.col(key)) & (F.xxhash64(body) == F.col(hashed)), "left")
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(gone, i)), "\n")
    return joined.select(
        *[F.when(F.col(gone).isNotNull(), left).otherwise(F.col(c)).alias(c) if c == text
          else F.col(c) for c in docs.columns],
        F.size(parts).cast("bigint").alias(counts[0]),
        F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias(counts[1]))
