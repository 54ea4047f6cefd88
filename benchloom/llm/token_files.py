"""Token-id files: shards of separately compressed documents, one shared dictionary.

Layout below a folder, every number little-endian:

* ``dictionary.bin``: the zstandard dictionary (absent if none could be trained).
* ``shard-NNNNNN.tok``: 4 bytes magic, 32 bytes SHA-256 of the dictionary (zeros without
  one), the frames one after another, then the index: one record per document (``INDEX``),
  then 8 bytes number of documents and 8 bytes offset of the index.
* ``manifest.json``: id width, end id, dictionary hash, and per shard its file, number of
  documents, tokens, first and last id, and the tokens of all shards before it.

Documents are in ascending id order over all shards.  One document is read by its index
record: a seek and one small frame.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, store
from .tokens import BATCH_BYTES, ByteLevelWords, Memo, open_words

MAGIC = b"TOK1"
INDEX = np.dtype([("has_id", "u1"), ("id", "<i8"), ("n_tokens", "<i8"), ("offset", "<i8"),
                  ("length", "<i8"), ("before", "<i8")])
HEAD = len(MAGIC) + 32
DICTIONARY_DOCS = 600           # documents a dictionary is trained on, at most
DICTIONARY_DOC_BYTES = 32_768   # of each of them
DICTIONARY_BYTES = 65_536
SHARD_BYTES = 32 << 20          # serialized ids per shard, about


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def train_dictionary(frames: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of serialized id arrays, empty if they are too few to train."""
    try:
        return zstandard.train_dictionary(size, frames).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes):
    return zstandard.ZstdCompressionDict(data) if data else None


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest() if data else bytes(32)


def _id_arrays(words: ByteLevelWords, memo: Memo, texts: list[str], end: bytes) -> list[bytes]:
    """Each text's ids and the end id; every distinct word of the texts is looked up once."""
    cuts = [words.cut(t) for t in texts]
    flat = pa.array(list(chain.from_iterable(cuts)), pa.string()).dictionary_encode()
    names = flat.dictionary.to_pylist()
    parts = list(map(memo.learn([names]).__getitem__, names))
    pool = np.frombuffer(b"".join(parts), words.width)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // pool.itemsize
    first = np.cumsum(sizes) - sizes
    which = flat.indices.to_numpy()
    ends = np.concatenate(([0], np.cumsum(sizes[which])))
    ids = pool[np.arange(ends[-1]) + np.repeat(first[which] - ends[:-1], sizes[which])]
    bounds = ends[np.cumsum([0, *map(len, cuts)])]
    return [ids[a:b].tobytes() + end for a, b in zip(bounds, bounds[1:])]


def _serialized(rows: Iterator[pa.RecordBatch], tokenizer: str, end_id: int,
                ) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids of rows and each text's token ids, with the end id, as a little-endian array."""
    words, memo = open_words(tokenizer, "id_bytes")
    end = np.array([end_id], words.width).tobytes()
    for batch in batches(rows, "text", BATCH_BYTES):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        yield batch.column("id"), _id_arrays(words, memo, texts, end)


def serialize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``(id, ids)``: the token ids of every text in one little-endian array."""
    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids in _serialized(rows, tokenizer, end_id):
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary())], ["id", "ids"])

    return docs.mapInArrow(encode, "id bigint, ids binary")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int,
                      id_column: str = "doc_id", text: str = "text",
                      shard_bytes: int = SHARD_BYTES) -> dict:
    """Encode every text, write the files described above, and return the manifest.

    The dictionary is trained on at most ``DICTIONARY_DOCS`` documents, those with the
    smallest hash of their id, so it does not depend on how rows are partitioned.  Only
    compressed frames are shuffled into id order.  A shard is written under a name of its
    attempt and then renamed, so a lost task leaves no half shard.  A null text is empty
    (only the end id); rows with a null id come first; rows with the same id stay
    neighbours, ordered by their ids.
    """
    spark = docs.sparkSession
    width = ByteLevelWords(tokenizer).width
    size = np.dtype(width).itemsize
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("text"))
    # only rows whose hash can be among the smallest are sorted
    part = 2 ** 64 * 2 * DICTIONARY_DOCS // max(1, rows.count())
    sample = (rows.where(F.xxhash64("id") <= min(2 ** 63 - 1, part - 2 ** 63))
              .select("id", F.substring("text", 1, DICTIONARY_DOC_BYTES).alias("text"))
              .orderBy(F.xxhash64("id"), "id").limit(DICTIONARY_DOCS))
    learnt = [bytes(r.ids) for r in serialize(sample, tokenizer, end_id).collect()]
    shared = train_dictionary(learnt)

    def compress(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(shared))
        for keys, ids in _serialized(parts, tokenizer, end_id):
            yield pa.RecordBatch.from_arrays([
                keys, pa.array([len(x) // size for x in ids], pa.int64()),
                pa.array([tool.compress(x) for x in ids], pa.binary()),
            ], ["id", "n_tokens", "frame"])

    # one function for both, so that a task has one Python worker and ids stay in it
    frames = store(rows.mapInArrow(compress, "id bigint, n_tokens bigint, frame binary"), "frames")
    tokens = frames.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    shards = max(1, -(-tokens * size // shard_bytes))
    where, base = _place(folder)
    where.create_dir(base, recursive=True)
    if shared:
        with where.open_output_stream(f"{base}/dictionary.bin") as out:
            out.write(shared)
    head = MAGIC + _digest(shared)

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        to, root = _place(folder)
        name = f"shard-{task.partitionId():06d}.tok"
        trial = f"{root}/.{name}-{task.taskAttemptId()}"
        index, out, offset, before = [], None, HEAD, 0
        for part in parts:
            if part.num_rows and out is None:
                out = to.open_output_stream(trial, buffer_size=1 << 20)
                out.write(head)
            for key, n, frame in zip(*(part.column(c).to_pylist() for c in part.schema.names)):
                out.write(frame)
                index.append((key is not None, key or 0, n, offset, len(frame), before))
                offset, before = offset + len(frame), before + n
        if out is None:
            return
        out.write(np.array(index, INDEX).tobytes())
        out.write(np.array([len(index), offset], "<i8").tobytes())
        out.close()
        if to.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
            to.delete_file(f"{root}/{name}")  # of an earlier attempt, with the same content
        to.move(trial, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({
            "shard": [task.partitionId()], "file": [name], "docs": [len(index)],
            "tokens": [before], "first": [index[0][1]], "last": [index[-1][1]]})

    done = (frames.repartitionByRange(shards, F.col("id").asc_nulls_first())
            .sortWithinPartitions(F.col("id").asc_nulls_first(), "frame")
            .mapInArrow(write, "shard bigint, file string, docs bigint, tokens bigint, "
                               "first bigint, last bigint").collect())  # a row per shard
    manifest = {"width": width, "end_id": end_id, "dictionary": _digest(shared).hex(),
                "shards": []}
    start = 0
    for shard in sorted(done, key=lambda r: r.shard):
        manifest["shards"].append({**shard.asDict(), "start": start})
        start += shard.tokens
    with where.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    where, base = _place(folder)
    with where.open_input_stream(f"{base}/manifest.json") as file:
        return json.loads(file.read())


class Shard:
    """One open shard: its index, and the ids of any of its documents."""

    def __init__(self, folder: str, name: str, width: str):
        where, base = _place(folder)
        self.width = width
        self.file = where.open_input_file(f"{base}/{name}")
        head, size = self.file.read_at(HEAD, 0), self.file.size()
        if head[:4] != MAGIC:
            raise ValueError(f"{name} is not a token file")
        data = b""
        if head[4:] != bytes(32):
            with where.open_input_stream(f"{base}/dictionary.bin") as file:
                data = file.read()
        if _digest(data) != head[4:]:
            raise ValueError(f"{name} was written with another dictionary")
        self.tool = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
        n, offset = np.frombuffer(self.file.read_at(16, size - 16), "<i8")
        self.index = np.frombuffer(self.file.read_at(int(n) * INDEX.itemsize, int(offset)), INDEX)

    def ids(self, k: int) -> np.ndarray:
        record = self.index[k]
        frame = self.file.read_at(int(record["length"]), int(record["offset"]))
        return np.frombuffer(self.tool.decompress(frame), self.width)

    def document(self, doc_id: int) -> np.ndarray | None:
        """Ids of the first document with this id, by binary search in the index."""
        nulls = int((self.index["has_id"] == 0).sum())
        k = nulls + int(np.searchsorted(self.index["id"][nulls:], doc_id))
        if k < len(self.index) and self.index["id"][k] == doc_id:
            return self.ids(k)
        return None


def read_token_files(spark: SparkSession, folder: str, digest_only: bool = False) -> DataFrame:
    """Documents of the files: ``(id, start, n_tokens, ids)``, or ``ids_crc32`` for the ids.

    One task per shard reads frame after frame.  ``start`` counts the ids of all documents
    before this one, from the manifest and the shard's index.
    """
    manifest = read_manifest(folder)
    width = manifest["width"]

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, start in zip(part.column("file").to_pylist(),
                                   part.column("start").to_pylist()):
                shard = Shard(folder, name, width)
                for at in range(0, len(shard.index), 1000):
                    records = shard.index[at:at + 1000]
                    arrays = [shard.ids(k) for k in range(at, at + len(records))]
                    last = ([zlib.crc32(a.astype("<u4").tobytes()) for a in arrays]
                            if digest_only else [a.tolist() for a in arrays])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(records["id"], mask=records["has_id"] == 0),
                        pa.array(start + records["before"]),
                        pa.array([len(a) for a in arrays], pa.int64()),
                        pa.array(last, pa.int64() if digest_only else pa.list_(pa.int32())),
                    ], ["id", "start", "n_tokens", "last"])

    shards = spark.createDataFrame(
        [(s["file"], s["start"]) for s in manifest["shards"]], "file string, start bigint")
    last = "ids_crc32 bigint" if digest_only else "ids array<int>"
    return (shards.repartition(max(1, len(manifest["shards"])))
            .mapInArrow(read, f"id bigint, start bigint, n_tokens bigint, {last}"))
