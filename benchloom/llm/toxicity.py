"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, forget, store

GRAMS = (3, 4, 5)
BUCKETS = 1 << 18
MAX_TRAIN = 16_000      # labelled rows the classifier is fitted on, at most
# Buckets with the surest ratios get a weight.  A weight for every bucket fits noise: held out
# on the small check table it rejects 48 of 3,585 clean documents, this selection none.
FEATURES = 4096
SEGMENT = 1 << 18       # characters handled at once
BATCH_BYTES = 1 << 18   # counting takes some 80 bytes of memory for each
FIT_ROWS = 1024         # fitted rows handled at once
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _segments(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Lower-cased pieces of the texts, overlapping by the longest n-gram, in bounded lots."""
    rows, pieces, size = [], [], 0
    for row, text in enumerate(texts):
        text = (text or "").lower().replace("\0", " ")
        for at in range(0, max(1, len(text) - max(GRAMS) + 1), SEGMENT):
            piece = text[at:at + SEGMENT + max(GRAMS) - 1]
            rows.append(row)
            pieces.append(piece)
            size += len(piece)
            if size >= SEGMENT:
                yield rows, pieces
                rows, pieces, size = [], [], 0
    if rows:
        yield rows, pieces


def present(texts: list[str | None], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs of the n-grams whose bucket is marked in ``keep``."""
    found = []
    for rows, pieces in _segments(texts):
        codes = np.frombuffer("\0".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        piece = np.cumsum(codes == 0)
        row = np.array(rows)
        wide = codes.astype(np.uint64)
        hashes = wide
        for n in range(2, max(GRAMS) + 1):
            hashes = hashes[:-1] * _STEP + wide[n - 1:] if len(wide) >= n else wide[:0]
            if n in GRAMS and len(hashes):
                mixed = (hashes ^ (hashes >> np.uint64(29))) * _MIX
                bucket = (mixed >> np.uint64(46)).astype(np.int64)
                inside = piece[: len(bucket)] == piece[n - 1:]
                inside &= codes[: len(bucket)] != 0
                at = np.flatnonzero(keep[bucket] & inside)
                found.append(np.unique(row[piece[at]] * BUCKETS + bucket[at]))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs // BUCKETS, pairs % BUCKETS


@dataclass
class Model:
    """``weights`` holds weight times ratio per bucket; a text's score is a logistic sum."""

    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        keep = self.weights != 0
        total = np.full(len(texts), self.intercept)
        upto = np.cumsum([len(t or "") for t in texts])
        start = 0
        while start < len(texts):  # pairs of a bounded lot of texts at a time
            before = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, before + SEGMENT, "right")))
            row, bucket = present(texts[start:stop], keep)
            total[start:stop] += np.bincount(row, self.weights[bucket], stop - start)
            start = stop
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))

    def score(self, text: Column) -> Column:
        """The score of every whole text as a column; null counts as empty."""
        model = self

        @F.arrow_udf("double")
        def toxicity(texts: pa.Array) -> pa.Array:
            forget()
            rows = iter([pa.RecordBatch.from_arrays([texts], ["text"])])
            scores = [model.scores(part.column("text").to_pylist())
                      for part in batches(rows, "text", BATCH_BYTES)]
            return pa.array(np.concatenate([np.zeros(0), *scores]))

        return toxicity(text)


def count_grams(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of label 0 and 1 that hold each bucket; bucket :data:`BUCKETS` counts all."""
    forget()
    sums = np.zeros((2, BUCKETS + 1), np.int64)
    every = np.ones(BUCKETS, bool)
    for part in batches(parts, "text", BATCH_BYTES):
        label = part.column("label").to_numpy()
        row, bucket = present(part.column("text").to_pylist(), every)
        for k in (0, 1):
            sums[k, :BUCKETS] += np.bincount(bucket[label[row] == k], minlength=BUCKETS)
            sums[k, BUCKETS] += (label == k).sum()
    at = np.flatnonzero(sums.sum(0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], ["bucket", "n", "p"])


def _fit_linear(lists: list[np.ndarray], ratio: np.ndarray, label: np.ndarray,
                steps: int = 150, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch Adam on the ratio-scaled binary features.

    ``lists`` holds the features of each row; a step passes over them in lots of rows.
    """
    w, b = np.ones(len(ratio)) * 0.05, float(np.log(label.mean() / (1 - label.mean())))
    m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for t in range(1, steps + 1):
        pull, missed, scaled = np.zeros(len(ratio)), 0.0, w * ratio
        for start in range(0, len(lists), FIT_ROWS):
            lot = lists[start:start + FIT_ROWS]
            row = np.repeat(np.arange(len(lot)), [len(x) for x in lot])
            col = np.concatenate(lot)
            z = np.bincount(row, scaled[col], len(lot)) + b
            miss = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - label[start:start + FIT_ROWS]
            pull += np.bincount(col, miss[row], len(ratio))
            missed += miss.sum()
        g = np.append(ratio * pull / len(label) + penalty * w, missed / len(label))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text",
          label: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """Fit on ``labels`` rows (id, 0/1 label) joined to their texts.

    At most ``max_train`` labelled ids are used, those with the smallest hash of the id, and of
    rows that repeat an id the one whose text has the smallest hash; that bound is why the ids
    may be broadcast and the features of the fitted rows gathered.  Ids labelled twice
    count as 1 if any label is 1; null labels and ids are ignored.  Ratios are
    log((p + 1) / (P + 2)) - log((n + 1) / (N + 2)) of the documents holding an n-gram; the
    :data:`FEATURES` buckets whose ratio is largest against its error are the features.
    Without both classes only the share of label 1 is learnt (score 0 without any label).
    """
    picked = (labels.select(F.col(id_column).alias("id"), F.col(label).alias("label"))
              .where("id IS NOT NULL AND label IS NOT NULL")
              .groupBy("id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(max_train))
    rows = store(docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
                 .join(F.broadcast(picked), "id").groupBy("id")
                 .agg(F.min_by("text", F.xxhash64("text")).alias("text"),
                      F.max("label").cast("bigint").alias("label"))
                 .select("text", "label"), "labelled")

    counts = (rows.mapInArrow(count_grams, "bucket bigint, n bigint, p bigint")
              .groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).toPandas())
    n, p = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    n[counts["bucket"]], p[counts["bucket"]] = counts["n"], counts["p"]
    negatives, positives = n[-1], p[-1]
    n, p = n[:-1], p[:-1]
    weights = np.zeros(BUCKETS)
    if not positives or not negatives:
        seen = positives + negatives
        share = (positives + 0.5) / (seen + 1) if seen else 1e-12
        return Model(weights, float(np.log(share / (1 - share))))
    ratio = np.log((p + 1) / (positives + 2)) - np.log((n + 1) / (negatives + 2))
    sure = np.abs(ratio) / np.sqrt(1 / (p + 1) + 1 / (n + 1))
    chosen = np.sort(np.argsort(-sure, kind="stable")[:FEATURES])
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))

    def features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for part in batches(parts, "text", BATCH_BYTES):
            row, bucket = present(part.column("text").to_pylist(), place >= 0)
            ends = np.searchsorted(row, np.arange(part.num_rows + 1))
            lists = [place[bucket[a:b]].astype("<i4").tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), pa.array(lists, pa.binary())], ["label", "features"])

    fitted = rows.mapInArrow(features, "label bigint, features binary").toArrow()
    # Views of the gathered buffers, not copies.
    lists = [np.frombuffer(x.as_buffer(), "<i4") for x in fitted.column("features")]
    w, b = _fit_linear(lists, ratio[chosen], (fitted.column("label").to_numpy() == 1).astype(float))
    weights[chosen] = w * ratio[chosen]
    return Model(weights, b)


def held_out(id_column: str) -> Column:
    """Rows whose crc32 of the id as text leaves remainder 2 by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))
