"""Hard negatives per anchor and positive, by secondary sort.

Scores are exact integer inner products.  Vectors are dealt into chunks by the hash of their
id and every anchor meets every chunk, so no group of a label is ever gathered.  A chunk keeps,
for each anchor, the pairs that can still be in the result: its best positives, and for every
positive its best negatives inside that positive's window.  These pairs are keyed by (anchor,
descending score, positives first, id), dealt by anchor and sorted within partitions; an iterator
over the sorted stream opens a window at a positive and emits negatives until it is full.  It
holds the open windows of one anchor and nothing else.

A negative's score is compared with a share of the positive's, so windows must be known before
negatives can be left out: the scores are computed twice, once for the positives and once for
the negatives.

Defined results: rows with a null id or label, a null vector, or a null or non-finite component
take no part; of rows that repeat an id the one with the smallest label, then vector, counts;
vectors of different lengths do not meet; components and scores beyond 64 bits saturate;
anchors without positives, and positives without negatives, have no rows; an empty table gives
an empty result.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

CHUNK_MB = 32          # of vectors in a chunk, and of anchors that meet it
SCORES_MB = 16         # of scores at a time
TOP = (1 << 63) - 1


def whole_scores(anchors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors; a float product is used where it is exact."""
    if not anchors.size or not vectors.size:
        return np.zeros((len(anchors), len(vectors)), np.int64)
    largest = int(max(-int(anchors.min()), int(anchors.max()))) * int(
        max(-int(vectors.min()), int(vectors.max())))
    if largest * anchors.shape[1] < 1 << 53:
        return (anchors.astype(float) @ vectors.astype(float).T).astype(np.int64)
    exact = anchors.astype(object) @ vectors.astype(object).T
    return np.clip(exact, -TOP, TOP).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Positions of the first ``n`` by descending score, then id."""
    if len(scores) > n:
        border = np.partition(scores, len(scores) - n)[len(scores) - n]
        near = np.flatnonzero(scores >= border)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:n]]


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores n with low * positive <= 100 * n <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def _by_length(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, pa.Table]]:
    """Ids, labels and vectors of the rows of each vector length."""
    lists = table.column("vector").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    sizes = np.diff(lists.offsets.to_numpy())
    for size in np.unique(sizes).tolist():
        rows = pa.array(np.flatnonzero(sizes == size))
        part = table.take(rows)
        vectors = lists.take(rows).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)
        yield (size, part.column("id").to_numpy(), part.column("label").to_numpy(), vectors, part)


def _meet(pick, schema: pa.Schema):
    """For every anchor of a group, ``pick`` chooses pairs from its scores with the chunk."""
    def run(anchors: pa.Table, chunk: pa.Table) -> pa.Table:
        out = {"anchor": [], "score": [], "id": []}
        held = {size: rest for size, *rest in _by_length(chunk)}
        for size, ids, labels, vectors, part in _by_length(anchors):
            if size not in held:
                continue
            to_ids, to_labels, to_vectors, _ = held[size]
            more = part.column("positives").to_pylist() if "positives" in part.column_names else None
            step = max(1, (SCORES_MB << 17) // max(1, len(to_ids)))
            for start in range(0, len(ids), step):
                scores = whole_scores(vectors[start:start + step], to_vectors)
                for i, row in enumerate(scores, start):
                    found = pick(row, to_ids, labels[i] == to_labels, ids[i], more and more[i])
                    out["anchor"].append(np.full(len(found), ids[i], np.int64))
                    out["score"].append(row[found])
                    out["id"].append(to_ids[found])
        return pa.table({k: np.concatenate(v) if v else np.array([], np.int64)
                         for k, v in out.items()}, schema)

    return run


def _stream(n_positives: int, n_negatives: int, low: int, high: int):
    """Rows of sorted pairs in, ranked negatives out; the state is one anchor's windows."""
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    schema = pa.schema([(n, pa.int32() if n == "rank" else pa.int64()) for n in names])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opened, windows = None, 0, []
        for part in parts:
            rows = {n: [] for n in names}
            for anchor, back, kind, id in zip(*[part.column(c).to_pylist() for c in (
                    "anchor", "back", "kind", "id")]):
                if anchor != now:
                    now, opened, windows = anchor, 0, []
                score = -back
                if kind == 0:
                    if opened < n_positives:
                        opened += 1
                        windows.append([*window(score, low, high), id, score, 0])
                    continue
                for w in windows:
                    if w[0] <= score <= w[1] and w[4] < n_negatives:
                        w[4] += 1
                        for n, v in zip(names, (anchor, w[2], w[4], id, w[3], score)):
                            rows[n].append(v)
                windows = [w for w in windows if w[4] < n_negatives and score >= w[0]]
            yield pa.RecordBatch.from_pydict(rows, schema)

    return run


def whole_vectors(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def mine_hard_negatives(rows: DataFrame, is_anchor: Column, label: Column, id: str = "vec_id",
                        vector: str = "embedding", scale: float = 256, n_positives: int = 5,
                        n_negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` chooses the queries; they search all rows.  The first ``n_positives`` other
    rows of the anchor's label are its positives.  A negative has another label and a score
    between ``low`` and ``high`` per cent of the positive's.  Scores are inner products of
    ``floor(scale * x)``; higher ones come first, then smaller ids.
    """
    spark = rows.sparkSession
    finite = F.forall(F.col(vector), lambda x: F.coalesce(
        F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    used = (rows.select(F.col(id).cast("bigint").alias("id"), label.cast("bigint").alias("label"),
                        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
                        F.when(finite, whole_vectors(F.col(vector), scale)).alias("vector"))
            .where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL"))
    one = used.groupBy("id").agg(F.min(F.struct("label", "vector", "asks")).alias("row"))
    used = store(one.select("id", "row.label", "row.asks", "row.vector"), "whole-vectors")

    size = used.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0)),
                    F.coalesce(F.sum(F.when(F.col("asks"), F.size("vector"))), F.lit(0))).first()
    chunk = CHUNK_MB << 17  # components of eight bytes
    # Twice the cores at least; each chunk sends at most a fixed number of pairs an anchor.
    n_chunks = max(2 * spark.sparkContext.defaultParallelism, -(-size[0] // chunk))
    n_groups = max(1, -(-size[1] // chunk))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    chunks = (used.select("id", "label", "vector", place(1, n_chunks).alias("chunk"),
                          every(n_groups).alias("group"))
              .repartition(n_chunks * n_groups, "group", "chunk").groupBy("group", "chunk"))
    pair = pa.schema([("anchor", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])

    def met(anchors: DataFrame, pick) -> DataFrame:
        # Fresh column identities: both sides read the same stored rows.
        dealt = (anchors.withColumns({"group": place(2, n_groups), "chunk": every(n_chunks)})
                 .select(*[F.col(c).alias(c) for c in [*anchors.columns, "group", "chunk"]])
                 .repartition(n_chunks * n_groups, "group", "chunk").groupBy("group", "chunk"))
        return dealt.cogroup(chunks).applyInArrow(
            _meet(pick, pair), "anchor bigint, score bigint, id bigint")

    def positives(scores, ids, same, anchor, _):
        other = np.flatnonzero(same & (ids != anchor))
        return other[best(scores[other], ids[other], n_positives)]

    def negatives(scores, ids, same, _, given):
        kept = []
        for positive in set(given):
            least, most = window(positive, low, high)
            if least <= most:
                inside = np.flatnonzero(~same & (scores >= max(least, -TOP)) & (scores <= min(most, TOP)))
                kept.append(inside[best(scores[inside], ids[inside], n_negatives)])
        return np.unique(np.concatenate(kept)) if kept else np.array([], np.int64)

    asked = used.where("asks").select("id", "label", "vector")
    first = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    good = store(met(asked, positives).withColumn("place", first)
                 .where(F.col("place") <= n_positives).drop("place"), "positives")
    known = good.groupBy(F.col("anchor").alias("id")).agg(F.collect_list("score").alias("positives"))
    bad = met(asked.join(known, "id"), negatives)

    pairs = (good.withColumn("kind", F.lit(0)).unionByName(bad.withColumn("kind", F.lit(1)))
             .select("anchor", (-F.col("score")).alias("back"), "kind", "id"))
    return (pairs.repartition("anchor").sortWithinPartitions("anchor", "back", "kind", "id")
            .mapInArrow(_stream(n_positives, n_negatives, low, high),
                        "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
                        "positive_score bigint, negative_score bigint"))
