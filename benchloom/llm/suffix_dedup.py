"""Suffix-array dedup: remove passages that a document with a smaller id already holds.

A passage is any string of ``LENGTH`` bytes.  Of the corpus's suffixes only those that can
share their first ``LENGTH`` bytes with another document are sorted:

* Every window of ``LENGTH`` bytes has a seed, the ``SEED`` bytes in it with the smallest
  hash.  Equal windows have equal seeds at the same place.  Neighbouring windows with the same
  seed make a run, the unit that is compared.
* Seeds are shuffled as 5-byte hashes.  Runs whose seed is in one document only are done.
* Runs with a shared seed meet by seed.  Equal runs are merged, and the windows of the others
  are suffix-sorted: a merge sort whose comparison finds the common extension of two suffixes
  by binary search over prefix polynomial hashes, so a comparison takes log2(LENGTH) steps.
  Neighbours that hash alike are verified byte by byte.
* What comes back to a document is one bit per seed and one per window.

A text is read in lots of about ``LOT`` bytes, which are the unit of the shuffles and packed, since
every comparison sends them to what it found out.  Lots merge
equal runs and count what is left of each seed.  A seed with ``HOT`` runs or more over all lots
(a fixed head of a third of all documents) would keep a task busy by itself: its windows, merged
within the lot, are dealt by the hash of all their bytes instead, and sorted and verified in
the same way.  So a group holds a bounded part of them, or one window once per lot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, store

LENGTH = 50
SEED = 20
SEEDS = LENGTH - SEED + 1    # seeds in a window, and windows in a run at most
LOT = 2 << 20
LOT_LEVEL = 3                # of zstandard, for the texts of a lot
BLOCK = 1 << 20              # positions hashed at once; below 2 ** 22
BUCKET_BYTES = 32 << 20      # bytes of corpus per task that compares seeds or runs
HOT = 1 << 14                # different runs of a seed that are sorted together
_LOW = np.uint64((1 << 22) - 1)
_BASE = 0x9E3779B97F4A7C15
_CODES = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    def grow(base: int) -> np.ndarray:
        out = np.full(1 << bits, base & (2**64 - 1), np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return grow(_BASE), grow(pow(_BASE, -1, 1 << 64))


class Prefixes:
    """Prefix polynomial hashes of a byte string, modulo 2 ** 64.

    ``of(a, n)`` hashes the n bytes from a on, whatever place they stand at; bytes are first
    replaced by random 64-bit values.
    """

    def __init__(self, data: np.ndarray, codes: np.ndarray = _CODES):
        self.up, self.down = _powers(max(12, int(len(data)).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * self.up[:len(data)], out=self.sums[1:])

    def of(self, a: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (self.sums[a + n] - self.sums[a]) * self.down[a]

    def everywhere(self, n: int) -> np.ndarray:
        return (self.sums[n:] - self.sums[:-n]) * self.down[:len(self.sums) - n]

    def extension(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, up to ``most``."""
        low = np.zeros(len(a), np.int64)
        step = 1 << (most.bit_length() - 1)
        while step:
            at = np.minimum(low + step, most)
            same = self.of(a, at) == self.of(b, at)
            low = np.where(same, at, low)
            step >>= 1
        return low


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, size = x, 1
    while size * 2 <= width:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    rest = width - size
    return np.minimum(have[:len(have) - rest], have[rest:]) if rest else have


class Runs:
    """The runs of a lot: first window, number of windows, seed, document and content hash."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, skip: np.ndarray):
        start, count, place, seed, text = [], [], [], [], []
        for b in range(0, max(0, len(data) - LENGTH + 1), BLOCK):
            part = data[b:b + BLOCK + LENGTH - 1]
            prefixes = Prefixes(part)
            seeds = _mix(prefixes.everywhere(SEED))
            keys = (seeds & ~_LOW) | np.arange(len(seeds), dtype=np.uint64)
            best = (_sliding_min(keys, SEEDS) & _LOW).astype(np.int64)
            at = np.arange(b, b + len(best))
            doc = np.searchsorted(ends, at, "right")
            window = np.flatnonzero((at + LENGTH <= ends[doc]) & ~skip[doc])
            if not len(window):
                continue
            best = best[window]
            fresh = np.flatnonzero(np.concatenate((
                [True], (np.diff(window) != 1) | (np.diff(best) != 0))))
            first, n = window[fresh], np.diff(np.append(fresh, len(window)))
            start.append(first + b)
            count.append(n)
            place.append(best[fresh] - first)
            seed.append(_mix(seeds[best[fresh]]))
            text.append(_mix(prefixes.of(first, n + (LENGTH - 1))))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.start, self.count = join(start, np.int64), join(count, np.int64)
        self.place = join(place, np.int64)
        self.seed, self.text = join(seed, np.uint64), join(text, np.uint64)
        self.doc = np.searchsorted(ends, self.start, "right")


def _spread_out(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the given stretches, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def merge_equal(data: np.ndarray, start: np.ndarray, size: np.ndarray, text: np.ndarray,
                seed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each stretch the equal stretch that stands for it: the one with the smallest id.

    Equal hashes are verified byte by byte; a stretch that only hashes like another stands
    for itself.
    """
    order = np.lexsort((ids, size, text, seed))
    s, z, t = seed[order], size[order], text[order]
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (z[1:] != z[:-1]) | (t[1:] != t[:-1])))
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    stands = np.empty(len(order), np.int64)
    stands[order] = head
    copy = np.flatnonzero(stands != np.arange(len(stands)))
    for at in range(0, len(copy), 1 << 15):
        own = copy[at:at + (1 << 15)]
        same = (data[_spread_out(start[own], size[own])]
                == data[_spread_out(start[stands[own]], size[own])])
        ends = np.cumsum(size[own])
        good = np.logical_and.reduceat(same, ends - size[own])
        stands[own[~good]] = own[~good]
    return stands


def suffix_sort(prefixes: Prefixes, data: np.ndarray, at: np.ndarray, group: np.ndarray,
                most: int) -> np.ndarray:
    """Order of the suffixes ``at``, by ``group`` and then by their first ``most`` bytes.

    Bottom-up merge sort of all groups at once.  An element finds its place in the other half
    by binary search; a comparison jumps over the common extension found by prefix hashes and
    looks at one byte.
    """
    order = np.argsort(group, kind="stable")
    sorted_group = group[order]
    first = np.searchsorted(sorted_group, sorted_group, "left")
    size = np.searchsorted(sorted_group, sorted_group, "right") - first
    inner = np.arange(len(order)) - first
    width = 1
    while len(size) and width < size.max():
        live = np.flatnonzero(size > width)
        half = inner[live] // width
        left = half % 2 == 0
        base = first[live]
        stop = base + size[live]
        other = np.minimum(base + (half + np.where(left, 1, -1)) * width, stop)
        low, high = other.copy(), np.minimum(other + width, stop)
        mine = at[order[live]]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            a, b = mine[open_], at[order[middle]]
            same = prefixes.extension(a, b, most)
            tie = same >= most
            x = data[np.minimum(a + same, len(data) - 1)]
            y = data[np.minimum(b + same, len(data) - 1)]
            # equal suffixes keep the left half first
            after = np.where(tie, ~left[open_], y < x)
            low[open_] = np.where(after, middle + 1, low[open_])
            high[open_] = np.where(after, high[open_], middle)
        place = base + (half - np.where(left, 0, 1)) * width + inner[live] % width + (low - other)
        moved = order.copy()
        moved[place] = order[live]
        order = moved
        width *= 2
    return order


def repeated_windows(data: np.ndarray, at: np.ndarray, group: np.ndarray,
                     ids: np.ndarray) -> np.ndarray:
    """Marks windows whose bytes also stand in a window of the group with a smaller id.

    Equal windows hash alike, so a window that hashes like no other is not sorted.
    """
    prefixes = Prefixes(data)
    marked = np.zeros(len(at), bool)
    _, which, copies = np.unique(prefixes.of(at, LENGTH), return_inverse=True, return_counts=True)
    several = np.flatnonzero(copies[which] > 1)
    if not len(several):
        return marked
    at, group, ids = at[several], group[several], ids[several]
    order = suffix_sort(prefixes, data, at, group, LENGTH)
    a, g = at[order], group[order]
    same = (g[1:] == g[:-1]) & (prefixes.of(a[1:], LENGTH) == prefixes.of(a[:-1], LENGTH))
    near = np.flatnonzero(same)
    for k in range(0, len(near), 1 << 16):
        own = near[k:k + (1 << 16), None]
        offsets = np.arange(LENGTH)
        same[own[:, 0]] = (data[a[own] + offsets] == data[a[own + 1] + offsets]).all(1)
    run = np.concatenate(([0], np.cumsum(~same)))
    low = np.full(int(run[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, run, ids[order])
    marked[several[order]] = ids[order] > low[run]
    return marked


# ---- lots ------------------------------------------------------------------------------

_LOT_SCHEMA = "lot string, ids array<bigint>, rows array<bigint>, sizes array<bigint>, data binary"


def _lots(size: int):
    """Whole texts of an Arrow stream packed into lots; a longer text is a lot of its own."""
    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LOT_LEVEL)

        def lot(ids, rows, texts):
            return pa.RecordBatch.from_arrays([
                pa.array([f"lot{rows[0]}"]), pa.array([ids], pa.list_(pa.int64())),
                pa.array([rows], pa.list_(pa.int64())),
                pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                pa.array([squeeze.compress(b"".join(texts))], pa.binary())], ["lot", "ids", "rows", "sizes", "data"])

        ids, rows, texts, held = [], [], [], 0
        for part in parts:
            for key, row, text in zip(*(part.column(c).to_pylist() for c in ("id", "row", "text"))):
                body = (text or "").encode("utf-8", "surrogatepass")
                ids.append(key)
                rows.append(row)
                texts.append(body)
                held += len(body)
                if held >= size:
                    yield lot(ids, rows, texts)
                    ids, rows, texts, held = [], [], [], 0
        if rows:
            yield lot(ids, rows, texts)

    return pack


class Lot:
    def __init__(self, part: pa.RecordBatch, k: int):
        get = lambda name: part.column(name)[k].as_py()
        self.name, self.rows = get("lot"), get("rows")
        ids = get("ids")
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(get("data")), np.uint8)
        self.ends = np.cumsum(np.array(get("sizes"), np.int64))
        # a text without an id neither causes removals nor has any
        self.skip = np.array([x is None for x in ids], bool)
        self.ids = np.array([0 if x is None else x for x in ids], np.int64)
        self.runs = Runs(self.data, self.ends, self.skip)

    def different_runs(self, index: np.ndarray) -> np.ndarray:
        """How many different runs each seed has; ``index`` gives the seed of every run."""
        number = np.bincount(index)
        several = np.flatnonzero(number[index] > 1)
        order = several[np.lexsort((self.runs.count[several], self.runs.text[several],
                                    index[several]))]
        x, t, n = index[order], self.runs.text[order], self.runs.count[order]
        copy = (x[1:] == x[:-1]) & (t[1:] == t[:-1]) & (n[1:] == n[:-1])
        return number - np.bincount(x[1:][copy], minlength=len(number))

    def seeds(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct seeds in bucket order: bucket, seed, in two documents?, index per run."""
        seed, index = np.unique(self.runs.seed, return_inverse=True)
        bucket = (seed % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(seed), np.int64)
        place[order] = np.arange(len(seed))
        index = place[index]
        owner = self.ids[self.runs.doc]
        low = np.full(len(seed), np.iinfo(np.int64).max)
        high = np.full(len(seed), np.iinfo(np.int64).min)
        np.minimum.at(low, index, owner)
        np.maximum.at(high, index, owner)
        return bucket[order], seed[order], low < high, index


def _cuts(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of an array sorted by bucket."""
    if len(bucket):
        edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
        for a, b in zip(edges, edges[1:]):
            yield int(bucket[a]), int(a), int(b)


def _seed_rows(buckets: int):
    def emit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                lot = Lot(part, k)
                bucket, seed, twice, index = lot.seeds(buckets)
                number = lot.different_runs(index)
                short = (seed >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                found = []
                for b, i, j in _cuts(bucket):
                    several = np.flatnonzero(number[i:j] > 1)
                    found.append((b, lot.name, short[i:j].tobytes(),
                                  np.packbits(twice[i:j]).tobytes(),
                                  several.astype("<u4").tobytes(),
                                  number[i:j][several].astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([
                    pa.array([f[0] for f in found], pa.int32()),
                    pa.array([f[1] for f in found], pa.string()),
                    pa.array([f[2] for f in found], pa.binary()),
                    *[pa.array([f[n] for f in found], pa.binary()) for n in (3, 4, 5)]],
                    ["bucket", "lot", "seeds", "twice", "several", "numbers"])

    return emit


def _seed_bits(hot: int):
    def compare(group: pa.Table) -> pa.Table:
        blobs = group.column("seeds").to_pylist()
        counts = np.array([len(b) // 5 for b in blobs])
        wide = np.zeros((counts.sum(), 8), np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
        twice = np.concatenate([
            np.unpackbits(np.frombuffer(t, np.uint8), count=n).astype(bool)
            for t, n in zip(group.column("twice").to_pylist(), counts)])
        _, index, lots = np.unique(wide.view("<u8").ravel(), return_inverse=True,
                                   return_counts=True)
        shared = lots > 1
        shared[index[twice]] = True
        ends = np.cumsum(counts)
        runs = np.ones(len(index), np.int64)
        for at, own, n in zip(ends - counts, group.column("several").to_pylist(),
                              group.column("numbers").to_pylist()):
            runs[at + np.frombuffer(own, "<u4").astype(np.int64)] = np.frombuffer(n, "<u4")
        total = np.bincount(index, runs, len(lots)).astype(np.int64)
        hot_seeds = shared & (total >= hot)
        bits, busy = shared[index], hot_seeds[index]
        pack = lambda x: [np.packbits(x[e - n:e]).tobytes() for e, n in zip(ends, counts)]
        return pa.Table.from_arrays([
            group.column("lot"), group.column("bucket"), pa.array(pack(bits), pa.binary()),
            pa.array(pack(busy), pa.binary()),
            pa.array([int(total[hot_seeds].sum())] + [0] * (len(counts) - 1), pa.int64())],
            ["lot", "bucket", "shared", "hot", "hot_runs"])

    return compare


class Compared:
    """A lot with what the seeds' comparison said, and its runs merged among themselves."""

    def __init__(self, part: pa.RecordBatch, k: int, buckets: int):
        self.lot = lot = Lot(part, k)
        self.bucket, _, _, index = lot.seeds(buckets)
        shared, hot = (np.zeros(len(self.bucket), bool) for _ in range(2))
        bits = {b["bucket"]: b for b in part.column("bits")[k].as_py() or []}
        for b, i, j in _cuts(self.bucket):
            shared[i:j] = np.unpackbits(np.frombuffer(bits[b]["shared"], np.uint8), count=j - i)
            hot[i:j] = np.unpackbits(np.frombuffer(bits[b]["hot"], np.uint8), count=j - i)
        runs = lot.runs
        self.hot_runs = np.flatnonzero(shared[index] & hot[index])
        live = np.flatnonzero(shared[index] & ~hot[index])
        self.owner = lot.ids[runs.doc]
        stands = merge_equal(lot.data, runs.start[live], runs.count[live] + LENGTH - 1,
                             runs.text[live], runs.seed[live], self.owner[live])
        self.live, self.stands = live, live[stands]
        sent = np.unique(self.stands)
        order = np.argsort(self.bucket[index[sent]], kind="stable")
        self.sent = sent[order]
        self.sent_bucket = self.bucket[index[self.sent]]

    def hot_windows(self, parts: int) -> "HotWindows":
        return HotWindows(self, parts)


class HotWindows:
    """Windows of hot runs: place, id, the equal window that stands for each, what is sent."""

    def __init__(self, own: Compared, parts: int):
        data, runs, hot = own.lot.data, own.lot.runs, own.hot_runs
        self.at = _spread_out(runs.start[hot], runs.count[hot])
        self.owner = np.repeat(own.owner[hot], runs.count[hot])
        whole = window_hashes(data, self.at)
        size = np.full(len(self.at), LENGTH)
        self.stands = merge_equal(data, self.at, size, whole, np.zeros_like(whole), self.owner)
        sent = np.unique(self.stands)
        part = (whole[sent] % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        self.sent, self.part = sent[order], part[order]


def window_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows at the ascending places ``at``."""
    out = np.zeros(len(at), np.uint64)
    for b in range(0, len(data), BLOCK):
        i, j = np.searchsorted(at, (b, b + BLOCK))
        if i < j:
            out[i:j] = _mix(Prefixes(data[b:b + BLOCK + LENGTH - 1]).of(at[i:j] - b, LENGTH))
    return out


_SENT_SCHEMA = ("hot boolean, bucket int, lot string, seeds binary, owners binary, counts binary, "
                "places binary, body binary")


def _sent_rows(buckets: int, parts: int):
    """What the lots send to be compared: runs by bucket, and the windows of hot runs by part.

    Both leave in one pass over the lots.
    """
    def batch(hot: bool, lot: str, found: list[tuple]) -> pa.RecordBatch:
        names = ["hot", "bucket", "lot", "seeds", "owners", "counts", "places", "body"]
        kinds = [pa.bool_(), pa.int32(), pa.string()] + [pa.binary()] * 5
        rows = [(hot, f[0], lot, *f[1:]) for f in found]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[n] for r in rows], t) for n, t in enumerate(kinds)], names)

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for part in rows:
            for k in range(part.num_rows):
                own = Compared(part, k, buckets)
                runs, found = own.lot.runs, []
                for b, i, j in _cuts(own.sent_bucket):
                    r = own.sent[i:j]
                    body = own.lot.data[_spread_out(runs.start[r], runs.count[r] + LENGTH - 1)]
                    found.append((b, runs.seed[r].tobytes(), own.owner[r].tobytes(),
                                  runs.count[r].astype(np.uint8).tobytes(),
                                  runs.place[r].astype(np.uint8).tobytes(),
                                  squeeze.compress(body.tobytes())))
                yield batch(False, own.lot.name, found)
                if not len(own.hot_runs):
                    continue
                hot, found = own.hot_windows(parts), []
                for b, i, j in _cuts(hot.part):
                    at = hot.at[hot.sent[i:j]]
                    body = own.lot.data[_spread_out(at, np.full(len(at), LENGTH))]
                    found.append((b, None, hot.owner[hot.sent[i:j]].tobytes(), None, None,
                                  squeeze.compress(body.tobytes())))
                yield batch(True, own.lot.name, found)

    return emit


def _masks(group: pa.Table) -> pa.Table:
    """Which windows of a group of runs or hot windows stand in a document with a smaller id."""
    found = (_window_masks if group.column("hot")[0].as_py() else _run_masks)(group)
    return found.append_column("hot", group.column("hot"))


def _run_masks(group: pa.Table) -> pa.Table:
    """Which windows of each run of a bucket stand in a document with a smaller id."""
    tool = zstandard.ZstdDecompressor()
    column = lambda n, kind: [np.frombuffer(x, kind) for x in group.column(n).to_pylist()]
    seeds = column("seeds", np.uint64)
    number = np.array([len(s) for s in seeds])
    seed, owner = np.concatenate(seeds), np.concatenate(column("owners", np.int64))
    count = np.concatenate(column("counts", np.uint8)).astype(np.int64)
    place = np.concatenate(column("places", np.uint8)).astype(np.int64)
    data = np.frombuffer(b"".join(tool.decompress(x) for x in group.column("body").to_pylist()),
                         np.uint8)
    size = count + LENGTH - 1
    start = np.cumsum(size) - size
    text = np.concatenate([
        Prefixes(data[start[i]:start[j - 1] + size[j - 1]]).of(start[i:j] - start[i], size[i:j])
        for i in range(0, len(seed), 1 << 14) for j in [min(len(seed), i + (1 << 14))]])
    stands = merge_equal(data, start, size, text, seed, owner)
    heads = np.unique(stands)
    heads = heads[np.argsort(seed[heads], kind="stable")]
    s = seed[heads]
    alone = np.concatenate(([True], s[1:] != s[:-1])) & np.concatenate((s[1:] != s[:-1], [True]))
    heads = heads[~alone]
    masks = np.zeros(len(seed), np.uint64)
    # whole seeds, a bounded number of bytes at a time
    edges = np.flatnonzero(np.concatenate(([True], np.diff(seed[heads]) != 0))) if len(heads) else []
    limits = list(edges) + [len(heads)]
    a = 0
    while a < len(limits) - 1:
        b = a + 1
        while b < len(limits) - 1 and limits[b] - limits[a] < 1 << 14:
            b += 1
        own = heads[limits[a]:limits[b]]
        body = data[_spread_out(start[own], size[own])]
        base = np.cumsum(size[own]) - size[own]
        at = _spread_out(base, count[own])
        turn = at - np.repeat(base, count[own])
        _, which = np.unique(seed[own], return_inverse=True)
        # equal windows have the seed at the same place
        key = np.repeat(which, count[own]) * LENGTH + np.repeat(place[own], count[own]) - turn
        hit = repeated_windows(body, at, key, np.repeat(owner[own], count[own]))
        bits = np.where(hit, np.uint64(1) << turn.astype(np.uint64), np.uint64(0))
        masks[own] = np.bitwise_or.reduceat(bits, np.cumsum(count[own]) - count[own])
        a = b
    every = (np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)
    result = np.where(owner > owner[stands], every, masks[stands])
    ends = np.cumsum(number)
    return pa.Table.from_arrays([
        group.column("lot"), group.column("bucket"),
        pa.array([result[e - n:e].astype("<u8").tobytes() for e, n in zip(ends, number)],
                 pa.binary())], ["lot", "bucket", "masks"])


def _window_masks(group: pa.Table) -> pa.Table:
    """Which windows of a part also stand in a document with a smaller id."""
    tool = zstandard.ZstdDecompressor()
    owners = [np.frombuffer(x, np.int64) for x in group.column("owners").to_pylist()]
    number = np.array([len(x) for x in owners])
    owner = np.concatenate(owners)
    data = np.frombuffer(b"".join(tool.decompress(x) for x in group.column("body").to_pylist()),
                         np.uint8)
    at = np.arange(len(owner)) * LENGTH
    # equal windows hash alike
    _, which, copies = np.unique(window_hashes(data, at), return_inverse=True, return_counts=True)
    own = np.flatnonzero(copies[which] > 1)
    own = own[np.argsort(which[own], kind="stable")]
    late = np.zeros(len(owner), bool)
    edges = np.flatnonzero(np.diff(which[own], prepend=-1))
    limits = [*edges.tolist(), len(own)]
    a = 0
    while a < len(limits) - 1:
        b = a + 1
        while b < len(limits) - 1 and limits[b] - limits[a] < 1 << 18:
            b += 1
        some = own[limits[a]:limits[b]]
        body = data[_spread_out(at[some], np.full(len(some), LENGTH))]
        late[some] = repeated_windows(body, np.arange(len(some)) * LENGTH, which[some], owner[some])
        a = b
    ends = np.cumsum(number)
    return pa.Table.from_arrays([
        group.column("lot"), group.column("bucket"),
        pa.array([np.packbits(late[e - n:e]).tobytes() for e, n in zip(ends, number)],
                 pa.binary())], ["lot", "bucket", "masks"])


def _removals(buckets: int, parts: int):
    def finish(lots: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in lots:
            for k in range(part.num_rows):
                own = Compared(part, k, buckets)
                lot, runs = own.lot, own.lot.runs
                masks = np.zeros(len(runs.start), np.uint64)
                back = {m["bucket"]: m["masks"] for m in part.column("masks")[k].as_py() or []}
                for b, i, j in _cuts(own.sent_bucket):
                    masks[own.sent[i:j]] = np.frombuffer(back[b], "<u8")
                every = (np.uint64(1) << runs.count.astype(np.uint64)) - np.uint64(1)
                masks[own.live] = np.where(own.owner[own.live] > own.owner[own.stands],
                                           every[own.live], masks[own.stands])
                some = np.flatnonzero(masks)
                at = _spread_out(runs.start[some], runs.count[some])
                turn = (at - np.repeat(runs.start[some], runs.count[some])).astype(np.uint64)
                gone = (np.repeat(masks[some], runs.count[some]) >> turn) & np.uint64(1) == 1
                windows = [at[gone]]
                if len(own.hot_runs):
                    hot = own.hot_windows(parts)
                    late = np.zeros(len(hot.at), bool)
                    back = {m["bucket"]: m["masks"] for m in part.column("late")[k].as_py()}
                    for b, i, j in _cuts(hot.part):
                        late[hot.sent[i:j]] = np.unpackbits(
                            np.frombuffer(back[b], np.uint8), count=j - i)
                    windows.append(hot.at[late[hot.stands] | (hot.owner > hot.owner[hot.stands])])
                windows = np.concatenate(windows)
                change = np.zeros(len(lot.data) + 1, np.int32)
                np.add.at(change, windows, 1)
                np.add.at(change, windows + LENGTH, -1)
                out = np.cumsum(change[:-1]) > 0
                rows = []
                begin = 0
                for row, end in zip(lot.rows, lot.ends):
                    mark, body = out[begin:end], lot.data[begin:end]
                    n = int(mark.sum())
                    spans = int((mark[1:] & ~mark[:-1]).sum() + mark[0]) if n else 0
                    kept = body[~mark] if n else body
                    rows.append((row, end - begin, n, spans,
                                 hashlib.sha256(kept.tobytes()).hexdigest(),
                                 kept.tobytes() if n else None))
                    begin = end
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.int64()),
                    pa.array([r[4] for r in rows], pa.string()),
                    pa.array([r[5] for r in rows], pa.binary()),
                    pa.array([None if s else i for s, i in zip(lot.skip, lot.ids.tolist())],
                             pa.int64())],
                    ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "id"])

    return finish


def suffix_dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", hot: int = HOT,
                 lot_bytes: int = LOT, keep_bytes: bool = False) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256[, kept])`` for every row of ``docs``.

    A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts in a row with
    a smaller id; strings are judged on the input.  ``kept`` (with ``keep_bytes``) holds what
    remains of a changed text, null for an unchanged one; it need not be valid UTF-8 where a
    cut goes through a character.  Null texts count as empty; texts below ``LENGTH`` bytes stay
    whole; rows with the same id never remove each other's bytes; a row without an id is left
    alone and removes nothing.
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    # one row group per few lots, so that a later task is given few of them
    lots = store(rows.mapInArrow(_lots(lot_bytes), _LOT_SCHEMA), "lots", row_group_mb=8)
    held = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, b: a + b)
    total = lots.agg(F.coalesce(F.sum(held), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET_BYTES))
    seeds = lots.mapInArrow(_seed_rows(buckets), "bucket int, lot string, seeds binary, twice binary, "
                           "several binary, numbers binary")
    bits = store(seeds.groupBy("bucket").applyInArrow(
        _seed_bits(hot), "lot string, bucket int, shared binary, hot binary, hot_runs bigint"), "bits")
    hot_runs = bits.agg(F.coalesce(F.sum("hot_runs"), F.lit(0))).first()[0]
    parts = max(1, -(-hot_runs * SEEDS * LENGTH // BUCKET_BYTES))
    told = lots.join(spread(bits.groupBy("lot").agg(F.collect_list(
        F.struct("bucket", "shared", "hot")).alias("bits"))), "lot", "left")
    masks = store(told.mapInArrow(_sent_rows(buckets, parts), _SENT_SCHEMA).groupBy("hot", "bucket")
                  .applyInArrow(_masks, "lot string, bucket int, masks binary, hot boolean"), "masks")
    of = lambda kind: F.collect_list(F.when(kind, F.struct("bucket", "masks")))
    told = told.join(masks.groupBy("lot").agg(
        of(~F.col("hot")).alias("masks"), of(F.col("hot")).alias("late")), "lot", "left")
    out = told.mapInArrow(
        _removals(buckets, parts), "row bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
        "kept_sha256 string, kept binary, id bigint")
    columns = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return out.select(*columns, *(["kept"] if keep_bytes else []))
