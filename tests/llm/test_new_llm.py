"""Chat formatting, hard negatives and spelling variants against brute force."""

import binascii
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchloom.llm import chat_format, hard_negatives, spelling

# ---- chat formatting --------------------------------------------------------------------

CHATS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "a|b\\|c\\\\|"), (1, 2, "assistant", None),
    (1, 2, "assistant", "tie"), (1, 40, "assistant", "<|im_end|>\n<|im_start|>user\nhi"),
    (1, 95, "user", "é😀|"), (1, None, "user", "first"), (2, 0, None, ""), (3, 5, "a b\n|<", "x"),
    (3, 5, "a b\n|<", "x"), (None, 1, "assistant", "no id"), (4, 0, "assistant", "long |" * 30_000),
    (4, 1, "assistant", "\\"), (4, 33, "assistant", "|"),
]


def chat_order(row):
    # A turn's escaped text orders ties; null turns come first.
    text = (row[3] or "").replace("\\", "\\\\").replace("|", "\\|")
    return (row[1] is not None, row[1] or 0, row[2] or "", text)


def brute_chats(rows):
    out = {}
    for key in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == key), key=chat_order)]
        loss = "".join(t for role, t in turns if role == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[key] = (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss))
    return out


@pytest.mark.parametrize("block", [1, 3, 32, 1000])
def test_chats_read_back(spark, block):
    rows = spark.createDataFrame(CHATS, "conv_id bigint, turn bigint, role string, text string")
    rows = rows.selectExpr("*", "1 AS segment", "2 AS block", "3 AS held", "4 AS parts", "5 AS learned")
    turns = chat_format.format_turns(rows, chat_format.text_parts(F.col("text")), F.col("role") == "assistant")
    blocks = chat_format.assemble_blocks(turns, block)
    got = {r.conv_id: r for r in chat_format.digests(blocks).collect()}
    want = brute_chats(CHATS)
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == want
    # Whole conversations carry the same text, and their spans hold the learned texts.
    for r in chat_format.assemble(blocks).collect():
        assert (len(r.text), r.n_chars) == (got[r.conv_id].formatted_chars,) * 2
        assert r.text.count("<|im_start|>") == r.text.count("<|im_end|>") == r.n_turns
        learned = "".join(r.text[s.start:s.start + s.length] for s in r.loss)
        plain = re.sub(r"\\([\\|])", r"\1", learned)
        assert hashlib.sha256(plain.encode()).hexdigest() == want[r.conv_id][3]


def test_no_chats(spark):
    rows = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    turns = chat_format.format_turns(rows, chat_format.text_parts(F.col("text")), F.lit(True))
    blocks = chat_format.assemble_blocks(turns)
    assert chat_format.digests(blocks).count() == chat_format.assemble(blocks).count() == 0


def test_parts_become_placeholders(spark):
    part = lambda kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (
        kind, text, ref, width, height, seconds, pages)
    rows = spark.createDataFrame([
        (1, 0, "user", [part("text", "look <"), part("text", "|image|>"), part("image", ref="a.png", width=57, height=28),
                        part("audio", ref="b.wav", seconds=1.01), None, part(None, "kind is null")]),
        (1, 1, "assistant", [part("document", ref="c.pdf", pages=3), part("video", ref="d.mp4"), part("text")]),
        (1, 2, "user", None), (2, 0, "user", []),
    ], f"conv_id bigint, turn bigint, role string, parts array<{chat_format.PART}>")
    turns = chat_format.format_turns(rows, F.col("parts"), F.col("role") == "assistant")
    whole = chat_format.assemble(chat_format.assemble_blocks(turns, 1))
    first, second = whole.orderBy("conv_id").collect()
    assert [(a["index"], a.kind, a.ref, a.tokens) for a in first.attachments] == [
        (0, "image", "a.png", 3), (1, "audio", "b.wav", 26), (2, "document", "c.pdf", 768), (3, "other", "d.mp4", 0)]
    for a in first.attachments:
        assert first.text[a.start:].startswith(f"<|{a.kind}|>")
    assert first.n_expanded == 797 and second.n_expanded == 0 and second.attachments == []
    assert [first.text[s.start:s.start + s.length] for s in first.loss] == ["<|document|><|other|>"]
    read = whole.where("conv_id = 1").select(F.transform(
        chat_format.read_turns(F.col("text")), lambda t: chat_format.read_parts(t["content"])).alias("t")).first().t
    assert [[(p.kind, p.text) for p in turn] for turn in read] == [
        [("text", "look <|image|>"), ("image", None), ("audio", None), ("text", "kind is null")],
        [("document", None), ("other", None)], []]


# ---- hard negatives ---------------------------------------------------------------------


def brute_negatives(rows, n_positives, n_negatives, low, high, every):
    held = {}
    for id, vector, label in rows:
        if id is None or label is None or vector is None:
            continue
        if any(x is None or x != x or abs(x) == float("inf") for x in vector):
            continue
        whole = tuple(int(np.floor(256 * x)) for x in vector)
        held[id] = min(held.get(id, (label, whole)), (label, whole))
    out = []
    for anchor, (label, vector) in held.items():
        if anchor % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(vector, v)), id, lab) for id, (lab, v) in held.items()
                        if id != anchor and len(v) == len(vector))
        for back, id, _ in [s for s in scored if s[2] == label][:n_positives]:
            good = [(-b, i) for b, i, lab in scored if lab != label and low * -back <= 100 * -b <= high * -back]
            out += [(anchor, id, r, i, -back, s) for r, (s, i) in enumerate(good[:n_negatives], 1)]
    return sorted(out)


def vectors_table(seed, n, dims=6):
    random.seed(seed)
    rows = [(i, [random.choice([-1.0, 0.0, 0.25, 0.5, 1.0, random.random()]) for _ in range(dims)],
             random.choice([0, 0, 0, 0, 1, 2])) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    rows += [(-10, [0.0] * dims, 0), (n, None, 1), (n + 1, [nan] * dims, 1), (n + 2, [None] * dims, 1),
             (n + 3, [1.0] * dims, None), (None, [1.0] * dims, 1), (n + 4, [inf] + [0.0] * (dims - 1), 1),
             (n + 5, [], 0), (n + 6, [], 1), (-20, [1.0, 2.0], 0), (n + 7, [1.0, 1.0], 0),
             (n + 8, [0.5, 0.5], 1), *rows[:3], (4, [0.0] * dims, 7), (-30, [3e9] * dims, 5),
             (n + 9, [2e3] * dims, 5), (n + 10, [1e3] * dims, 6)]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, chunk", [(1, 32), (2, 0.0005), (3, 0.0005)])
def test_hard_negatives(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(hard_negatives, "CHUNK_MB", 32 if chunk == 32 else 0)
    if chunk != 32:  # many chunks and groups of anchors
        monkeypatch.setattr(hard_negatives, "CHUNK_MB", _Bytes(700))
        monkeypatch.setattr(hard_negatives, "SCORES_MB", 0)
    rows = vectors_table(seed, 120)
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    table = table.selectExpr("*", "1 AS id", "2 AS vector", "3 AS chunk", "'x' AS `group`", "4 AS asks")
    got = hard_negatives.mine_hard_negatives(table, F.col("vec_id") % 10 == 0, F.col("label"),
                                             n_positives=3, n_negatives=4)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, 3, 4, 30, 90, 10)


class _Bytes(int):
    """A chunk size below a megabyte: shifting it gives that many components."""

    def __lshift__(self, bits):
        return int(self)


def test_no_vectors(spark):
    table = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert hard_negatives.mine_hard_negatives(table, F.lit(True), F.col("label")).count() == 0


def test_scores_beyond_double_precision():
    a, b = np.array([[2**40 + 1, 3]]), np.array([[2**22 - 1, 5], [2**60, 0], [-(2**60), 0]])
    want = [(2**40 + 1) * (2**22 - 1) + 15, 2**63 - 1, -(2**63 - 1)]
    assert hard_negatives.whole_scores(a, b).tolist() == [want]


# ---- spelling variants ------------------------------------------------------------------


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words, ratio):
    links = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        top = min(((-words[v], v) for v in links[w]), default=None)
        form[w] = top[1] if top and -top[0] >= ratio * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (n, len(links[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()}


@pytest.mark.parametrize("letters, length", [("ab", 4), ("abc", 5), ("aé", 7), ("abcdefgh", 6)])
def test_variants(spark, letters, length):
    random.seed(len(letters) * length)
    words = {}
    for _ in range(250):
        word = "".join(random.choice(letters) for _ in range(random.choice([length - 1, length, length + 1])))
        words[word] = random.choice([1, 2, 9, 10, 99, 100, 1000, 10_000])
    rows = [(w, n) for w, n in words.items()] + [(None, 5), ("", 7)]
    table = spark.createDataFrame(rows, "word string, n bigint").selectExpr("*", "1 AS form", "2 AS near")
    words = {w: n for w, n in words.items() if len(w) >= 4}
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root)
           for r in spelling.group_variants(table, 10).collect()}
    assert got == brute_variants(words, 10)


def test_chain_of_forms(spark):
    chain = ["aaaaaaaa" + "b" * i for i in range(12)]
    table = spark.createDataFrame([(w, 2 ** i) for i, w in enumerate(chain)] + [(chain[3], 0)], "word string, n bigint")
    got = {r.word: r.root for r in spelling.group_variants(table, 2).collect()}
    assert got == {w: chain[-1] for w in chain}


def test_no_words(spark):
    assert spelling.group_variants(spark.createDataFrame([], "word string, n bigint")).count() == 0
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling.count_words(docs).count() == 0


def test_pivots_cost_least_and_share_no_letter():
    random.seed(4)
    for _ in range(300):
        places = sorted(random.sample(range(12), random.randint(3, 8)))
        cost = [random.randint(1, 9) for _ in places]
        pairs = [(a, b) for a in range(len(places)) for b in range(a) if places[a] - places[b] >= 2]
        p, q = spelling.pivots(places, cost)
        assert q - p >= 2
        assert cost[places.index(p)] + cost[places.index(q)] == min(cost[a] + cost[b] for a, b in pairs)


def brute_counts(docs):
    counts = Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = binascii.crc32(f"{'' if id is None else id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def test_counts_of_whole_texts(spark):
    random.seed(8)
    some = ["".join(random.choice("abÉéñZ×") for _ in range(random.randint(5, 9))) for _ in range(60)]
    docs = [(i, " ".join(random.choice(some) for _ in range(80))) for i in range(50)]
    docs += [(None, "Größenwahn grÖßenwahn"), (60, None), (61, ""), (62, "abcdefgh-" * 50_000), (62, "abcdefgh7abcdefgh")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS id", "2 AS run", "3 AS h")
    got = {r.word: r.n for r in spelling.count_words(table).collect()}
    assert got == brute_counts(docs)
