"""Toxicity, source mixing, the registered queries and the pipeline."""

import pathlib
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from benchloom.llm import common, mixing, pieces, tokens, toxicity
from benchloom.llm.common import store
from tools.check_oracle import normal

FOLDER = pathlib.Path("/root/testdata/sf0.001")
tables = pytest.mark.skipif(not FOLDER.exists(), reason="benchmark tables are not here")


# ---- toxicity ---------------------------------------------------------------------------


def toxic_rows(n, seed=1):
    draw = random.Random(seed)
    words = ["".join(draw.choice("aeioubdklmnrst") for _ in range(draw.randint(2, 9))) for _ in range(300)]
    bad = ["grumblefool", "nastywort", "vilethrog"]
    rows, labels = [], []
    for key in range(n):
        text = [draw.choice(words) for _ in range(draw.randint(0, 60))]
        toxic = draw.random() < 0.2
        for _ in range(3 * toxic):
            text.insert(draw.randint(0, len(text)), draw.choice(bad))
        rows.append((key, " ".join(text)))
        labels.append((key, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows(1500)
    docs = spark.createDataFrame([*rows, (None, "x"), (9000, None)], "doc_id bigint, text string")
    truth = spark.createDataFrame(
        [*labels, labels[0], (None, 1), (77_777, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, truth.where(~toxicity.held_out("doc_id")))
    got = docs.select("doc_id", toxicity.held_out("doc_id").alias("held"),
                      model.score(F.col("text")).alias("score")).collect()
    known = dict(labels)
    held = [r for r in got if r.held]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
               for r in got if r.doc_id is not None)
    assert sum((r.score >= 0.3) == known[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_of_long_and_odd_texts(spark):
    rows, labels = toxic_rows(600, 2)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    clean = next(t for (_, t), (_, y) in zip(rows, labels) if not y and len(t) > 200)
    long = clean + " " * toxicity.SEGMENT + "grumblefool nastywort vilethrog"
    short = model.scores([clean, clean + " grumblefool nastywort vilethrog"])
    assert short[0] < 0.3 < short[1]
    assert abs(model.scores([long])[0] - short[1]) < 0.2   # nothing behind a prefix is lost
    odd = model.scores(["", None, "\0", "a\0b", "\ud800", "GRUMBLEFOOL"])
    assert odd[0] == odd[1] and np.isfinite(odd).all()
    again = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert (again.weights == model.weights).all()


def brute_model(rows, labels, features):
    """Choice, ratios, fit and scores with dictionaries instead of arrays, over the same buckets."""
    grams = lambda text: set(toxicity.present([text], np.ones(toxicity.BUCKETS, bool))[1].tolist())
    known = [(grams(t), labels[k]) for k, t in rows if k in labels]
    p, n = Counter(), Counter()
    for held, y in known:
        (p if y else n).update(held)
    ones, zeros = sum(y for _, y in known), sum(1 - y for _, y in known)
    ratio = {g: np.log((p[g] + 1) / (ones + 2)) - np.log((n[g] + 1) / (zeros + 2)) for g in {*p, *n}}
    sure = {g: abs(r) / np.sqrt(1 / (p[g] + 1) + 1 / (n[g] + 1)) for g, r in ratio.items()}
    order = sorted(sorted(ratio, key=lambda g: (-sure[g], g))[:features])
    x = np.zeros((len(known), len(order)))
    for i, (held, _) in enumerate(known):
        x[i] = [ratio[g] if g in held else 0 for g in order]
    y = np.array([y for _, y in known], float)
    w, b = np.full(len(order), 0.05), np.log(y.mean() / (1 - y.mean()))
    m, v = np.zeros(len(order) + 1), np.zeros(len(order) + 1)
    for t in range(1, 151):
        miss = 1 / (1 + np.exp(-(x @ w + b))) - y
        g = np.append(x.T @ miss / len(y) + 1e-4 * w, miss.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    weight = dict(zip(order, w))
    return lambda text: 1 / (1 + np.exp(-(b + sum(weight[g] * ratio[g] for g in grams(text) if g in weight))))


def test_toxicity_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FEATURES", 500)
    monkeypatch.setattr(toxicity, "FIT_ROWS", 7)
    rows, labels = toxic_rows(80, 3)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    score = brute_model(rows, dict(labels), 500)
    texts = [t for _, t in rows] + ["", "grumblefool and words", "q"]
    assert model.scores(texts) == pytest.approx([score(t) for t in texts])


def test_counting_and_kept_memos_are_bounded():
    draw = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz     "
    texts = ["".join(draw.choices(letters, k=3000)) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1] * 250), pa.array(texts)], ["label", "text"])
    pieces.open_encoder(public_tokenizers.path("piece_bpe_32k.model"))
    tokens.open_words(public_tokenizers.path("piece_bpe_32k.model"), "lengths")
    assert len(common._KEPT) == 1
    tracemalloc.start()
    try:
        counts, = toxicity.count_grams(iter([batch]))
        assert tracemalloc.get_traced_memory()[1] < 80 << 20
    finally:
        tracemalloc.stop()
    assert not common._KEPT
    grams = [set(toxicity.present([t], np.ones(toxicity.BUCKETS, bool))[1].tolist()) for t in texts]
    whole = Counter((b, k % 2) for k, own in enumerate(grams) for b in own)
    assert counts.to_pylist() == [{"bucket": b, "n": whole[b, 0], "p": whole[b, 1]}
                                  for b in sorted({b for b, _ in whole})] + [
        {"bucket": toxicity.BUCKETS, "n": 250, "p": 250}]


def test_repeated_ids_fit_one_row_each(spark, monkeypatch):
    rows, labels = toxic_rows(60, 4)
    gathered = []
    fit = toxicity._fit_linear
    monkeypatch.setattr(toxicity, "_fit_linear", lambda lists, ratio, label: gathered.append(len(lists)) or fit(
        lists, ratio, label))
    docs = spark.createDataFrame([(k, f"{t} {i}") for k, t in rows for i in range(20)], "doc_id bigint, text string")
    toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), max_train=40)
    assert gathered == [40]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.train(docs, none).scores(["a", ""]).max() < 0.01
    one = spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")
    assert toxicity.train(docs, one).scores(["a"])[0] < 0.3


# ---- mixing -----------------------------------------------------------------------------


def brute_fill(budget, children):
    """children: name -> (weight, cap); water filling by repeated passes."""
    target, live = dict.fromkeys(children, 0.0), {c for c, (w, _) in children.items() if w}
    left = float(budget)
    while live:
        level = left / sum(children[c][0] for c in live)
        full = {c for c in live if children[c][1] <= children[c][0] * level}
        if not full:
            for c in live:
                target[c] = children[c][0] * level
            break
        for c in full:
            target[c] = float(children[c][1])
            left -= children[c][1]
        live -= full
    return target


def brute_mix(rows, weights, share, epochs, seed):
    import hashlib

    leaves = defaultdict(int)
    for _, leaf, tokens in rows:
        leaves[leaf] += tokens
    caps = defaultdict(int)
    for leaf, tokens in leaves.items():
        for depth in range(4):
            caps[leaf[:depth]] += tokens * epochs
    target = {(): float(int(caps[()] / epochs * share))}
    for depth in range(3):
        for node in [n for n in target if len(n) == depth]:
            kids = {n: (weights[depth].get(n[-1], 1), caps[n])
                    for n in caps if len(n) == depth + 1 and n[:depth] == node}
            target |= brute_fill(target[node], kids)
    out = {}
    for leaf, tokens in leaves.items():
        goal = int(target[leaf] + 1e-6)
        full = goal // tokens if tokens else 0
        rest, sum_ = goal - full * tokens, 0
        own = defaultdict(list)
        for key, at, n in rows:
            if at == leaf:
                own[hashlib.md5(f"{seed}:{full}:{'null' if key is None else key}".encode()).hexdigest()
                    ].append((key, n))
        for h in sorted(own):
            for key, _ in own[h]:
                out[key] = full + (sum_ < rest)  # the document that crosses the target is in
            sum_ += sum(n for _, n in own[h])
    return out, target


@pytest.mark.parametrize("epochs, share", [(1, 0.7), (3, 0.6), (2, 1.9), (1, 1.0), (2, 0.0)])
def test_mix(spark, epochs, share):
    draw = random.Random(epochs)
    values = []
    for key in range(500):
        source = f"src{min(int(draw.expovariate(0.3)), 17)}"
        values.append((key, " ".join(["w"] * draw.randint(0, 30)), draw.choice(["en", "en", "de", "fr"]), source))
    values += [(600, None, None, "src1"), (601, "a b\nc", "en", None), (None, "a b", "de", "src2"),
               (602, "x " * 900, "en", "src3"), (603, "", "xx", "src4")]
    docs = spark.createDataFrame(values, "doc_id bigint, text string, lang string, source string")
    docs = docs.selectExpr("*", "1 AS tokens", "2 AS full", "3 AS cut").repartition(3)
    levels = {"domain": F.when(F.col("source") < "src2", "web").otherwise("books"),
              "language": F.col("lang"), "origin": F.col("source")}
    weights = [{"web": 3}, {"en": 4, "de": 0}, {"src0": 2}]
    words = lambda t: 0 if not t else t.count(" ") + t.count("\n") + 1
    rows = [(k, ("web" if s is not None and s < "src2" else "books", g or "unknown", s or "unknown"), words(t))
            for k, t, g, s in values]
    want, _ = brute_mix(rows, weights, share, epochs, "s")
    got = {r.id: r.epochs for r in mixing.mix(docs, levels, weights, share, epochs, "s").collect()}
    assert got == want
    taken = mixing.mixed_documents(docs, levels, weights, share, epochs, "s")
    assert taken.columns == docs.columns
    assert Counter(r.doc_id for r in taken.collect()) == Counter({k: n for k, n in want.items() if n})
    assert mixing.mix(docs.limit(0), levels, weights, share, epochs, "s").count() == 0


# ---- queries and pipeline ---------------------------------------------------------------


@tables
@pytest.mark.parametrize("name", sorted(n for n in contract.queries() if n.startswith("op")))
def test_registered_query(spark, name):
    """Against its SQL twin, and one row per row of its table."""
    df = contract.queries()[name](spark, str(FOLDER))
    rows = [tuple(r) for r in df.collect()]
    table = "embeddings" if name.startswith("op1_") else "documents"
    if int(name[2:].split("_")[0]) <= 10:  # later ones have other rows
        assert len(rows) == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    sql = contract.oracle_sql().get(name)
    if sql:
        duck = duckdb.connect()
        for file in FOLDER.glob("*.parquet"):
            duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
        twin = duck.execute(sql)
        assert normal(df.columns, rows) == normal([c[0] for c in twin.description], twin.fetchall())


def test_operators_are_registered():
    names = [n for n in contract.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in contract.queries()


# Names the stages use themselves.
CLASHES = ("id", "rep", "__score", "__id", "__whole", "__gone", "__cut", "__n_lines", "__n_removed", "__full",
           "__domain", "__language", "__origin", "__times", "tokens", "digest", "pos", "class_id")


def write_corpus(spark, folder, rows, labels):
    docs = spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.selectExpr("*", *[f"{k} + length(text) AS {c}" for k, c in enumerate(CLASHES)]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")


def corpus(n=700):
    base, labels = toxic_rows(n, 5)
    draw = random.Random(6)
    rows = []
    for key, text in base:
        text = f"{text} and number {key} stands here on its own\nanother line {key}"
        if key % 3 == 0:
            text += "\nshared by many sites"
        rows.append([key, text, draw.choice(["en", "de"]), f"src{draw.randint(0, 19)}", len(text)])
    clean = dict(labels)
    long = next(r for r in rows if not clean[r[0]] and len(r[1]) > 250)
    for k in range(30):
        rows.append([2000 + k, (f"{k} " if k % 2 else "") + long[1], "en", "src1", 0])
    rows += [[3000, None, None, None, None], [3001, "", "en", "src0", 0], [None, "no id at all", "en", "src2", 12],
             [3002, "very long " + " ".join(f"tail{i}" for i in range(20_000)), "en", "src3", 1]]
    return [tuple(r) for r in rows], labels, long[0]


def test_pipeline_stage_by_stage(spark, tmp_path):
    rows, labels, origin = corpus()
    folder = f"file://{tmp_path}"
    write_corpus(spark, folder, rows, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    given = {r[0]: None if r[1] is None else len(r[1]) for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, folder), "stage")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "token ids":
            for key, r in seen[name].items():
                size = given[key]
                assert [r[c] for c in CLASHES] == [None if size is None else k + size for k in range(len(CLASHES))]
        if name != "token ids":
            assert docs.columns == columns
            assert docs.count() == len(seen[name])
    toxic = {k for k, y in labels if y}
    kept = seen["toxicity"].keys()
    every = {r[0] for r in rows}
    assert len(toxic & kept) <= 0.03 * len(toxic)
    assert len((every - toxic) - kept) <= 0.01 * len(every)
    lines = seen["line dedup"]
    assert lines.keys() == kept                                    # no document goes
    many = [k for k, r in lines.items() if "shared by many" in (r.text or "")]
    assert not many, lines[many[0]]
    assert lines[1].text == rows[1][1] if 1 in lines else True
    assert all(r.n_chars == len(r.text) for k, r in lines.items() if k is not None and k < 700)
    near = seen["near duplicates"]
    group = {origin, *range(2000, 2030)}
    assert near.keys() & group == {origin}
    assert lines.keys() - near.keys() == group - {origin}
    assert {3000, 3001, None} <= near.keys()
    assert seen["source mix"].keys() <= near.keys()
    library = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for key, row in seen["token ids"].items():
        assert row.ids == library.encode(seen["source mix"][key].text or "")
        assert row.round_trip and row.n_tokens == len(row.ids)
    assert seen["token ids"].keys() == seen["source mix"].keys()
    whole = corpus_pipeline.run(spark, folder).select("doc_id", "ids_crc32").collect()
    assert Counter(map(tuple, whole)) == Counter((k, r.ids_crc32) for k, r in seen["token ids"].items())


def test_pipeline_cuts_pages_that_are_mostly_boilerplate(spark):
    draw = random.Random(9)
    words = lambda n: " ".join(f"w{draw.randint(0, 10**6)}" for _ in range(n))
    menu, story = [words(15) for _ in range(2)], [words(40) for _ in range(5)]
    rows = [(k, f"{menu[0]}\n{words(12)}\n{menu[1]}", "en", f"s{k}", 1) for k in range(40)]
    # two thirds of a page are menu; a story that 15 sites copied, plain or with a word in front
    rows += [(100 + k, (f"x{k} " if k % 2 else "") + "\n".join(story), "en", f"s{k}", 1)
             for k in range(15)]
    rows += [(200, "\n".join(menu), "en", "s3", 1), (201, None, "en", "s3", None),
             (None, f"{menu[0]}\nno id", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r for r in corpus_pipeline.cut_boilerplate(spark, docs, "").collect()}
    assert len(got) == len(rows)
    for key, text, *_ in rows[:40]:
        assert got[key].text == text.split("\n")[1] and got[key].n_chars == len(got[key].text)
    for key, text, *_ in rows[40:55]:
        assert got[key].text == text
    assert (got[200].text, got[200].n_chars) == ("", 0)    # nothing remains
    assert got[201].text is None and got[None].text == "no id"


def test_pipeline_of_nothing(spark, tmp_path):
    write_corpus(spark, f"file://{tmp_path}", [], [])
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
