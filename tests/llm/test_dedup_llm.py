"""Exact, line, near and passage dedup against brute force on small tables."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from benchloom.llm import embedding_dedup, exact_dedup, jaccard_join, line_dedup, suffix_dedup
from benchloom.llm.common import components
from benchloom.session import scratch_path


def docs_of(spark, values, more=""):
    return spark.createDataFrame(values, "doc_id bigint, text string" + more)


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, k) for k in range(200, 260)]
    links = [*chain, *star, (5, 5), (300, 299), (299, 298), (7, 100), (400, 401)]
    random.Random(1).shuffle(links)
    got = components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert {r.node: r.component for r in got} == roots(nodes, [x for x in links if x[0] != x[1]])
    empty = spark.createDataFrame([], "a bigint, b bigint")
    assert components(empty, "a", "b").count() == 0


def test_small_stored_steps_are_not_a_file_per_partition(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions",
                                           "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for key, value in zip(kept, ("40", "false")):
            spark.conf.set(key, value)
        links = spark.createDataFrame([(i, i % 7) for i in range(7, 600)], "a bigint, b bigint")
        found = components(links, "a", "b")
        assert found.count() == 600 and {r.component for r in found.collect()} == set(range(7))
        assert len(found.inputFiles()) <= 12
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


# ---- exact ------------------------------------------------------------------------------

VALUES = [(1, "x"), (2, "x"), (9, "x"), (3, ""), (4, None), (5, "y"), (6, "Y"), (7, "z" * 100_000),
          (8, "z" * 100_000), (8, "z" * 100_000), (None, "x"), (None, "only null")]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_exact_dedup(spark, batches):
    docs = docs_of(spark, VALUES).selectExpr("*", "1 AS digest", "2 AS id")
    got = exact_dedup.dedup_newest_first(docs, scratch_path(spark, "index"), 3, batches).collect()
    groups = {}
    for key, text in VALUES:
        groups.setdefault(text or "", []).append(key)
    want = Counter()
    for key, text in VALUES:
        group = groups[text or ""]
        keep = max((k for k in group if k is not None), default=None)
        want[key, keep, len(group), key == keep, hashlib.sha256((text or "").encode()).digest()] += 1
    assert Counter((r.id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in got) == want


def test_digest_index_persists(spark):
    folder = scratch_path(spark, "index")
    first = exact_dedup.DigestIndex(spark, folder, 4)
    first.ingest(exact_dedup.text_digests(docs_of(spark, [(1, "a"), (2, "b"), (3, "b")])))
    spark.sql(f"DROP TABLE {first.name}")  # a later session knows the folder only
    again = exact_dedup.DigestIndex(spark, folder, 4)
    batch = exact_dedup.text_digests(docs_of(spark, [(10, "b"), (11, "c"), (12, "c"), (13, None)]))
    plan = again.fresh(batch)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    again.ingest(batch)
    again.ingest(batch)  # a repeated batch adds nothing
    assert sorted(r.keep_id for r in again.unbucketed().collect()) == [1, 3, 12, 13]


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.dedup_newest_first(docs_of(spark, []), scratch_path(spark, "i"), 2).count() == 0


# ---- lines ------------------------------------------------------------------------------


def brute_lines(values, min_sites):
    sites = {}
    for _, text, site in values:
        for line in (text or "").split("\n"):
            if line.strip(" ") and site is not None:
                sites.setdefault(line.strip(" "), set()).add(site)
    out = Counter()
    for key, text, _ in values:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(sites.get(x.strip(" "), ())) < min_sites]
        rest = "\n".join(keep)
        gone = len(lines) - len(keep)
        if gone:
            out[key, rest, len(lines), gone] += 1
        else:
            out[key, text, len(lines), 0] += 1
    return out


def test_line_dedup(spark):
    draw = random.Random(4)
    common = [f"license {k} of the site" for k in range(8)]
    values = []
    for key in range(300):
        lines = [f"own line {draw.random()} and words" for _ in range(draw.randint(0, 4))]
        lines += [common[min(7, int(draw.expovariate(0.6)))] for _ in range(draw.randint(0, 2))]
        lines += [""] * draw.randint(0, 1)
        draw.shuffle(lines)
        site = None if key % 29 == 0 else f"s{draw.randint(0, 30)}"
        values.append((key, "\n".join(lines), site))
    values += [(500, None, "s1"), (501, "", None), (None, values[3][1], "s9"), values[3], values[3],
               (502, " " + common[0] + "  \n" + "text " * 40_000, "s2")]
    docs = docs_of(spark, values, ", source string").selectExpr("*", "1 AS digest", "2 AS pos")
    for sites in (3, 8):
        got = line_dedup.line_dedup(docs, min_sites=sites)
        assert set(docs.columns) <= set(got.columns)
        assert Counter((r.doc_id, r.text, r["__n_lines"], r["__n_removed"])
                       for r in got.collect()) == brute_lines(values, sites)
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_sketches_merge_and_near_lines_are_exact(spark):
    values = [(k, "low" if k < 9 else "edge" if k < 19 else "high", f"s{k}") for k in range(60)]
    docs = docs_of(spark, values, ", source string")
    lines = line_dedup.lines_of(docs, "doc_id", "text", "source")
    halves = [line_dedup.sketches(lines.where(f"id % 2 = {k}")) for k in (0, 1)]
    found = line_dedup.spread_lines(lines, line_dedup.merge(halves), 10)
    assert {bytes(r.digest) for r in found.collect()} == {
        hashlib.md5(x).digest() for x in (b"edge", b"high")}


# ---- n-grams ----------------------------------------------------------------------------


def brute_jaccard(values, threshold=0.8, n=5):
    sets = []
    for _, text in values:
        words = (text or "").split()
        sets.append({tuple(words[k:k + n]) for k in range(max(1, len(words) - n + 1))} if words else set())
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) * 10 >= round(threshold * 10) * len(a | b):
                if values[i][0] is not None and values[j][0] is not None:
                    links.append((j, i))
    near = roots(range(len(values)), links)
    low = {}
    for k, root in near.items():
        if values[k][0] is not None:
            low[root] = min(low.get(root, math.inf), values[k][0])
    n_links = Counter(x for link in links for x in link)
    return Counter((key, low.get(near[k]) if key is not None else None, n_links[k],
                    key is None or key == low[near[k]]) for k, (key, _) in enumerate(values))


def near_texts(seed):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    bases = [[draw.choice(words) for _ in range(draw.randint(30, 90))] for _ in range(12)]
    values = []
    for key in range(220):
        text = list(draw.choice(bases)) if key % 3 else [draw.choice(words) for _ in range(40)]
        for _ in range(draw.randint(0, 3)):
            text[draw.randrange(len(text))] = draw.choice(words)
        values.append((1000 - key, " ".join(text)))
    values += [(1, ""), (2, None), (3, " \n\xa0 "), (4, "a b"), (5, "a  b"), (6, "a b"), (7, "a c"),
               (None, values[0][1]), (None, ""), (8, "t " * 3000), (9, "t " * 2000), (10, "u " * 30_000)]
    return values


@pytest.mark.parametrize("block", [jaccard_join.BLOCK_BYTES, 4096])
def test_jaccard_join(spark, monkeypatch, block):
    """Whole clusters in one block, and clusters cut into many parts."""
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", block)
    values = near_texts(2)
    docs = docs_of(spark, values).selectExpr("*", "1 AS rep", "'y' AS digest", "2 AS id")
    got = jaccard_join.jaccard_join(docs.repartition(3))
    assert Counter(tuple(r) for r in got.collect()) == brute_jaccard(values)


def test_jaccard_at_the_threshold_and_repeats(spark):
    nine = " ".join(f"a{k}" for k in range(13))                  # 9 shingles
    values = [(1, nine), (2, nine + " b"), (3, nine + " b c"), (4, nine + " b c d"), (5, nine)]
    assert Counter(tuple(r) for r in jaccard_join.jaccard_join(docs_of(spark, values)).collect()
                   ) == brute_jaccard(values)
    same = jaccard_join.jaccard_join(docs_of(spark, [(3, nine), (3, nine), (4, "x")])).collect()
    assert sorted(tuple(r) for r in same) == [(3, 3, 1, True), (3, 3, 1, True), (4, 4, 0, True)]
    assert jaccard_join.jaccard_join(docs_of(spark, [])).count() == 0


def test_bands_reach_the_recall():
    bands = jaccard_join.bands_for(0.8, 0.9999, 8)
    assert 1 - (1 - 0.8 ** 8) ** bands >= 0.9999 > 1 - (1 - 0.8 ** 8) ** (bands - 1)


# ---- embeddings -------------------------------------------------------------------------


def brute_vectors(values):
    unit = []
    for _, vector, label in values:
        good = (label is not None and vector and all(x is not None and math.isfinite(x) for x in vector)
                and any(vector))
        unit.append(np.array(vector, float) / np.linalg.norm(vector) if good else None)
    links = [(j, i) for i, a in enumerate(unit) for j in range(i)
             if a is not None and unit[j] is not None and len(a) == len(unit[j])
             and values[i][2] == values[j][2] and float(a @ unit[j]) >= 0.98]
    near = roots(range(len(values)), links)
    low = {}
    for k, root in near.items():
        low[root] = min(low.get(root, math.inf), values[k][0])
    count = Counter(x for link in links for x in link)
    return {(v[0], count[k], low[near[k]], v[0] == low[near[k]]) for k, v in enumerate(values)}


@pytest.mark.parametrize("block", [embedding_dedup.BLOCK_ROWS, 8])
def test_embedding_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    draw = np.random.default_rng(3)
    values, key = [], 1000
    for center in draw.standard_normal((40, 24)):
        for _ in range(draw.integers(1, 14)):
            vector = center + draw.standard_normal(24) * draw.choice([0, 0.05, 0.12, 0.15])
            values.append((key, np.float32(vector).tolist(), int(draw.integers(0, 2))))
            key -= 1
    bad = [None, [], [0.0] * 24, [1.0, None] + [0.0] * 22, [math.nan] + [1.0] * 23,
           [math.inf] + [1.0] * 23, [1.0, 2.0]]
    values += [(2000 + k, v, 1) for k, v in enumerate(bad)]
    values += [(3000, values[0][1], None), (3001, values[0][1], values[0][2]), (3002, [1.0, 2.0], 1)]
    frame = spark.createDataFrame(values, "vec_id bigint, embedding array<float>, label int")
    frame = frame.selectExpr("*", "1 AS rep", "2 AS list", "'z' AS data").repartition(3)
    got = embedding_dedup.embedding_dedup(frame)
    assert {tuple(r) for r in got.collect()} == brute_vectors(values)
    assert embedding_dedup.embedding_dedup(frame.limit(0)).count() == 0


def test_collision_count_is_calibrated():
    plan = embedding_dedup.Plan(0.98, 24, 5, 0.9999)
    draw = np.random.default_rng(1)
    a = draw.standard_normal((4000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    turn = draw.standard_normal(a.shape)
    turn -= (turn * a).sum(1, keepdims=True) * a
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    b = 0.98 * a + math.sqrt(1 - 0.98 ** 2) * turn      # cosine of exactly the threshold
    (ca, va), (cb, vb) = plan.keys(a), plan.keys(b)
    hits = ((ca == cb) & (np.abs(va - vb) <= plan.window)).sum(1)
    assert abs(hits.mean() / plan.lists - plan.chance) < 0.05
    assert (hits >= plan.needed).mean() > 0.998
    (cr, vr) = plan.keys(np.roll(a, 1, 0))
    chance = ((ca == cr) & (np.abs(va - vr) <= plan.window)).sum(1)
    assert (chance >= plan.needed).mean() < 0.01


# ---- passages ---------------------------------------------------------------------------


def brute_passages(values):
    first = {}
    for key, text in values:
        body = (text or "").encode()
        for p in range(len(body) - 49):
            if key is not None:
                first[body[p:p + 50]] = min(key, first.get(body[p:p + 50], key))
    out = Counter()
    for key, text in values:
        body = (text or "").encode()
        gone = np.zeros(len(body), bool)
        for p in range(len(body) - 49):
            if key is not None and first[body[p:p + 50]] < key:
                gone[p:p + 50] = True
        kept = bytes(b for b, g in zip(body, gone) if not g)
        spans = sum(1 for p in range(len(body)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[key, len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("limits", [{}, {"hot": 2}, {"lot_bytes": 300}, {"lot_bytes": 300, "hot": 3}])
def test_suffix_dedup(spark, monkeypatch, limits):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 2000)
    draw = random.Random(3)
    noise = lambda n: "".join(draw.choice("ab c") for _ in range(n))
    passages = [noise(draw.randint(30, 150)) for _ in range(6)]
    values = []
    for key in range(60):
        parts = [draw.choice([noise(draw.randint(0, 80)), draw.choice(passages),
                              draw.choice(passages)[5:70]]) for _ in range(draw.randint(0, 6))]
        values.append((key if key % 17 else None, "".join(parts)))
    values += [(100, "a" * 500), (101, "a" * 300), (102, None), (103, values[5][1]), (104, values[5][1]),
               (7, noise(100) + passages[0]), (105, "é" * 60 + passages[1]), (106, "é" * 60),
               (104, values[5][1]), (107, "b" * 49), (108, "b" * 50), (109, "b" * 50), (-4, passages[2])]
    draw.shuffle(values)
    docs = docs_of(spark, values).selectExpr("*", "1 AS lot", "2 AS row", "3 AS id").repartition(3)
    got = suffix_dedup.suffix_dedup(docs, **limits)
    assert Counter(tuple(r) for r in got.collect()) == brute_passages(values)


def test_suffix_dedup_keeps_bytes_and_takes_nothing(spark):
    text = "".join(random.Random(5).choice("abcdef ") for _ in range(80))
    docs = docs_of(spark, [(1, text), (2, "head " + text + " tail"), (3, None)])
    got = {r.id: r for r in suffix_dedup.suffix_dedup(docs, keep_bytes=True).collect()}
    assert bytes(got[2].kept) == b"head  tail" and got[1].kept is None and got[3].n_bytes == 0
    assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0


def test_suffix_dedup_splits_a_seed_with_many_runs(spark, monkeypatch):
    draw = random.Random(8)
    noise = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))
    head, tails = noise(40), [noise(60) for _ in range(40)]
    values = [(k, noise(9) + head + (draw.choice(tails) if k % 3 else noise(60))) for k in range(120)]
    lots = list(suffix_dedup._lots(6500)(iter([pa.RecordBatch.from_pylist(
        [{"id": k, "row": k, "text": t} for k, t in values])])))
    assert len(lots) < 4
    seeds = pa.Table.from_batches(list(suffix_dedup._seed_rows(1)(iter(lots))))
    rows = suffix_dedup._seed_bits(20)(seeds)    # two or three lots, but many runs
    assert any(any(x) for x in rows.column("hot").to_pylist())
    assert not any(any(x) for x in suffix_dedup._seed_bits(10_000)(seeds).column("hot").to_pylist())
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 2000)
    got = suffix_dedup.suffix_dedup(docs_of(spark, values), hot=20, lot_bytes=6500)
    assert Counter(tuple(r) for r in got.collect()) == brute_passages(values)


def test_suffix_dedup_sends_packed_lots_once(spark, monkeypatch, tmp_path):
    words = "the cat sat on a mat by the old red barn and some more of it".split()
    draw = random.Random(9)
    text = " ".join(draw.choice(words) for _ in range(4000))
    lot = next(suffix_dedup._lots(1000)(iter([pa.RecordBatch.from_pylist([{"id": 1, "row": 1, "text": text}])])))
    assert len(lot.column("data")[0].as_py()) < len(text) / 2
    assert suffix_dedup.Lot(lot, 0).data.tobytes() == text.encode()
    seen = spark.sparkContext.accumulator(0)
    compared = suffix_dedup.Compared

    def counted(part, k, buckets):
        seen.add(1)
        return compared(part, k, buckets)

    monkeypatch.setattr(suffix_dedup, "Compared", counted)
    noise = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))
    head = noise(40)
    values = [(k, noise(9) + head + noise(60)) for k in range(120)]
    got = suffix_dedup.suffix_dedup(docs_of(spark, values).coalesce(1), hot=20, lot_bytes=1 << 20)
    assert len(got.collect()) == 120
    assert seen.value == 2  # to send what is compared, hot or not, and to remove


def test_suffix_sort_orders_like_python():
    draw = random.Random(6)
    data = np.array([draw.choice(b"ab") for _ in range(600)], np.uint8)
    at = np.array(draw.sample(range(540), 300))
    group = np.array([draw.randrange(4) for _ in at])
    order = suffix_dedup.suffix_sort(suffix_dedup.Prefixes(data), data, at, group, 50)
    keys = [(group[k], data[at[k]:at[k] + 50].tobytes()) for k in order]
    assert keys == sorted(keys) and sorted(order) == list(range(300))


def test_equal_hashes_are_verified(monkeypatch):
    data = np.frombuffer(b"x" * 50 + b"y" * 50 + b"x" * 50, np.uint8)
    start, size = np.array([0, 50, 100]), np.array([50, 50, 50])
    same = np.zeros(3, np.uint64)     # all three claim to be equal
    stands = suffix_dedup.merge_equal(data, start, size, same, same, np.array([1, 2, 3]))
    assert stands.tolist() == [0, 1, 0]
