"""N-gram Jaccard join: MinHash banding for candidates, full n-gram sets for the answer."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, components, pair_blocks, spread, store

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
ROWS = 8
BLOCK_BYTES = 4 << 20    # texts of one part of a large cluster
SLICE_BYTES = 4 << 20
COLUMNS = 2048           # shingles per step of the block product
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def bands_for(threshold: float, recall: float, rows: int = ROWS) -> int:
    """Bands of ``rows`` values that meet a pair at ``threshold`` with chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a whole text.

    Words are what white space parts.  A text of fewer than ``words`` words is one shingle
    of all its words; a text without words has none.
    """
    parts = (text or "").split()
    if not parts:
        return np.zeros(0, np.uint64)
    # a word's hash must not depend on the process, so Python's own hash is out
    known: dict[str, int] = {}
    order = np.array([known.setdefault(w, len(known)) for w in parts])
    hashes = _word_hashes(list(known))[order]
    n = min(words, len(parts))
    total = np.full(len(parts) - n + 1, n, np.uint64)
    for k in range(n):
        total = _mix(total * _MUL + hashes[k:len(parts) - n + 1 + k])
    return np.unique(total)


def _word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words: polynomials of their bytes, from prefix sums over all of them."""
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    lengths = np.array([len(d) for d in data])
    ends = np.cumsum(lengths)
    codes = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64) + np.uint64(1)
    place = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)
    powers = np.ones(int(lengths.max()), np.uint64)
    powers[1:] = _MUL
    powers = np.multiply.accumulate(powers)
    sums = np.add.reduceat(_mix(codes) * powers[place], ends - lengths)
    return _mix(sums + lengths.astype(np.uint64) * _MIX)


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of ``count`` multiply-add hashes of 32 bits, always the same."""
    draw = np.random.default_rng(17)
    return (draw.integers(0, 1 << 31, (count, 1), np.uint32) * np.uint32(2) + np.uint32(1),
            draw.integers(0, 1 << 32, (count, 1), np.uint32))


def band_hashes(shingle: np.ndarray, bands: int, rows: int,
                hashes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One 64-bit hash per band of the MinHash signature of a set of shingles."""
    low = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    factor, offset = hashes
    values = (shingle >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(values), 4096):
        for k in range(0, len(low), 64):
            mixed = values[None, at:at + 4096] * factor[k:k + 64]
            mixed += offset[k:k + 64]
            np.minimum(low[k:k + 64], mixed.min(1), out=low[k:k + 64])
    total = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        total = _mix(total * _MUL + low[r::rows])
    return total.view(np.int64)


def _sketch(bands: int, rows: int, words: int):
    def sketch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = permutations(bands * rows)
        for part in batches(parts, "text", SLICE_BYTES):
            keys, hashes, sizes = [], [], []
            for key, text in zip(part.column("rep").to_pylist(), part.column("text").to_pylist()):
                own = shingles(text, words)
                if len(own):
                    keys.append(key)
                    hashes.append(band_hashes(own, bands, rows, hashed))
                    sizes.append(len((text or "").encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()),
                pa.array(hashes, pa.list_(pa.int64()))], ["rep", "size", "bands"])

    return sketch


def _dense_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray,
                 threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i in left, j in right, i < j if both) whose Jaccard reaches ``threshold``.

    Intersections are a block product of 0/1 columns, one for each shingle that at least two
    sets hold: the work follows the shared shingles, and nothing is stored per pair but a
    count.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, copies = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = copies[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    place_l = np.full(len(sets), -1)
    place_l[left] = np.arange(len(left))
    place_r = np.full(len(sets), -1)
    place_r[right] = np.arange(len(right))
    for at in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        own, col = owner[a:b], column[a:b] - at
        one = np.zeros((len(left), min(COLUMNS, width - at)), np.float32)
        two = one if left is right else np.zeros((len(right), one.shape[1]), np.float32)
        hit = place_l[own] >= 0
        one[place_l[own[hit]], col[hit]] = 1
        if two is not one:
            hit = place_r[own] >= 0
            two[place_r[own[hit]], col[hit]] = 1
        common += one @ two.T
    sizes = np.array([len(s) for s in sets], np.float32)
    union = sizes[left][:, None] + sizes[right][None, :] - common
    linked = common >= threshold * union - 0.5
    # float32 leaves ties at the threshold open; whole numbers settle them
    i, j = np.nonzero(linked)
    c, u = common[i, j].astype(np.int64), union[i, j].astype(np.int64)
    exact = c >= np.ceil(threshold * u - 1e-9)
    i, j = left[i[exact]], right[j[exact]]
    return (i[i < j], j[i < j]) if left is right else (i, j)


def _links_of(group: pd.DataFrame, threshold: float, words: int) -> pd.DataFrame:
    """Links inside one block: per document their weighted number and smallest linked id."""
    sets = [shingles(t, words) for t in group["text"]]
    if group["lo"].iloc[0] == group["hi"].iloc[0]:
        left = right = np.arange(len(sets))
    else:
        part = group["part"].to_numpy()
        left = np.flatnonzero(part == group["lo"].iloc[0])
        right = np.flatnonzero(part == group["hi"].iloc[0])
    if len(left) == 0 or len(right) == 0:
        return pd.DataFrame({"rep": [], "links": [], "near": []}, dtype="int64")
    a, b = _dense_links(sets, left, right, threshold)
    ids, weight = group["rep"].to_numpy(), group["copies"].to_numpy()
    links = (np.bincount(a, weight[b], len(sets)) + np.bincount(b, weight[a], len(sets)))
    near = ids.copy()
    np.minimum.at(near, a, ids[b])
    np.minimum.at(near, b, ids[a])
    # the smallest linked id alone need not connect a block: follow it until it settles
    for _ in range(len(sets)):
        before = near.copy()
        np.minimum.at(near, a, near[b])
        np.minimum.at(near, b, near[a])
        if (before == near).all():
            break
    some = links > 0
    return pd.DataFrame({"rep": ids[some], "links": links[some].astype("int64"),
                         "near": near[some]})


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS,
                 rows: int = ROWS, recall: float = RECALL, id_column: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """One row per document: ``id``, ``class_id``, ``n_links``, ``kept``.

    Two documents are linked if the Jaccard similarity of their sets of word n-grams is at
    least ``threshold``.  ``class_id`` is the smallest id reachable by links, ``n_links`` the
    number of other documents linked directly, ``kept`` marks the smallest id of a class.

    1. Equal word sequences become one representative with a number of copies.
    2. Band hashes are shuffled; a band seen in several representatives ties them to the
       smallest one, and connected ties make a cluster.  Bands are chosen so that a pair at
       the threshold meets with chance ``recall``; every link lies inside a cluster.
    No side of these joins has a size bound, so all are sort-merge joins at every size.
    3. Texts of clusters are shuffled once.  Inside a cluster all pairs are compared on full
       n-gram sets by block products; large clusters are cut into parts of bounded bytes,
       each pair of parts in its own task.  Links leave a block as counts, never as pairs.

    Texts without words and null texts link with nothing, nor do rows without an id; they
    are kept.  Rows that share an id and a text count as copies of each other; an id with
    several texts is compared by each of them, so it may link with itself.
    """
    members, per_class = _classes(docs, threshold, words, rows, recall, id_column, text)
    result = members.where("NOT alone").join(per_class, "digest").select(
        "id", "class_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"))
    alone = members.where("alone").select("id", F.col("id").alias("class_id"),
                                          F.lit(0).cast("bigint").alias("n_links"))
    return (result.unionByName(alone)
            .withColumn("kept", F.col("id").eqNullSafe(F.col("class_id"))))


def text_classes(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS,
                 rows: int = ROWS, recall: float = RECALL, id_column: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``(digest, class_id)``: the class of ``jaccard_join`` for each text that has one.

    ``digest`` is the SHA-256 of the text.
    """
    return _classes(docs, threshold, words, rows, recall, id_column, text)[1].select(
        "digest", "class_id")


def _classes(docs: DataFrame, threshold: float, words: int, rows: int, recall: float,
             id_column: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows by digest of their text, and digests with class, copies and links."""
    bands = bands_for(threshold, recall, rows)
    base = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("text"))
    members = store(base.select(
        "id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
        (F.col("id").isNull() | ~F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False)))
        .alias("alone")), "members")
    texts = members.count()
    classes = store(members.where("NOT alone").groupBy("digest")
                    .agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes",
                    rows=texts)
    sketched = store(
        base.join(classes.select(F.col("rep").alias("id")).distinct().hint("merge"), "id")
        .select(F.col("id").alias("rep"), "text")
        .mapInArrow(_sketch(bands, rows, words), "rep bigint, size bigint, bands array<bigint>"),
        "sketches")
    banded = sketched.select("rep", F.posexplode("bands").alias("band", "value"))
    tops = spread(banded.groupBy("band", "value").agg(F.min("rep").alias("top"),
                                                      F.max("rep").alias("last"))
                  .where("top < last").drop("last"))
    ties = (banded.join(tops.hint("merge"), ["band", "value"]).where("rep <> top")
            .select("rep", "top").distinct())
    clusters = (components(ties, "rep", "top", rows=4 * texts).withColumnRenamed("node", "rep")
                .join(sketched.select("rep", "size"), "rep")
                .join(classes.select("rep", "copies"), "rep"))
    clusters = store(clusters, "clusters", rows=texts)
    # a part has at most BLOCK_BYTES of text and 2,048 texts, about
    chunks = spread(clusters.groupBy("component").agg(
        F.ceil(F.sum(F.col("size") + BLOCK_BYTES // 2048) / BLOCK_BYTES).cast("int")
        .alias("chunks")))
    placed = pair_blocks(clusters.join(chunks, "component"), F.col("rep"), F.col("chunks"))
    inside = (placed.select("rep", "copies", "component", "part", "lo", "hi").hint("merge")
              .join(base.withColumnRenamed("id", "rep"), "rep"))
    found = store(inside.groupBy("component", "lo", "hi").applyInPandas(
        lambda g: _links_of(g, threshold, words), "rep bigint, links bigint, near bigint"),
        "links")
    near = components(found, "rep", "near", rows=found.count())
    counted = (found.groupBy("rep").agg(F.sum("links").alias("links"))
               .join(near, F.col("rep") == F.col("node")).select("rep", "links", "component"))
    per_class = store(
        classes.join(counted, "rep", "left")
        .select("digest", F.coalesce("component", "rep").alias("class_id"),
                "copies", F.coalesce("links", F.lit(0)).alias("links")), "linked",
        rows=texts)
    return members, per_class
