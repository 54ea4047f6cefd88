"""Token counts, token files and pieces against the libraries' own encoders."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb
from tokenizers import Tokenizer

from benchloom.llm import pieces, token_files, tokens
from benchloom.session import scratch_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "th", "e", "ing", " ", "  ", " " * 9, "\n", "\n\n", "\t", "\r", "é", "don't", " 12",
         "▁", "漢字", "!?", ".", ",", "<s>", "</s>", "<|endoftext|>", "\x00", "\x1c", "\x85", "\xa0",
         "　", "᠎", "​", "😀", " the", "word", "²", "ª", "zz"]


def texts(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def bytes_library():
    return Tokenizer.from_file(BYTES)


def rows(spark, values):
    return spark.createDataFrame(values, "doc_id bigint, text string")


def test_counts_equal_the_library(spark, library):
    values = [*texts(2000), "long " * 30_000, "x" * 20_000]
    docs = rows(spark, [*enumerate(values), (None, "no id"), (5000, None), (5001, ""), (5001, "")])
    docs = docs.selectExpr("*", "1 AS n_tokens", "2 AS n_bytes", "3 AS id")  # clashing names
    got = tokens.count_tokens(docs.repartition(3), PIECES).collect()
    assert len(got) == docs.count()
    by_id = {r.id: r for r in got}
    for key, text in enumerate(values):
        assert by_id[key].n_tokens == len(library.encode(text)), repr(text)
        assert by_id[key].n_bytes == len(text.encode())
    assert by_id[5000].n_tokens == 0 and by_id[5000].n_bytes == 0
    assert by_id[None].n_tokens == len(library.encode("no id"))
    assert tokens.count_tokens(docs.limit(0), PIECES).count() == 0


def test_byte_words_equal_the_library(bytes_library):
    words = tokens.ByteLevelWords(BYTES)
    memo = tokens.Memo(words.id_bytes, limit=300)   # forgets many times
    for text in [*texts(4000, 2), "a " * 5000]:
        cut = words.cut(text)
        got = b"".join(map(memo.learn([cut]).__getitem__, cut))
        want = bytes_library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, words.width).tolist() == want, repr(text)


def test_token_files_round_trip(spark, bytes_library):
    values = [(i * 3, t) for i, t in enumerate(texts(500, 3))]
    values += [(None, "first"), (-5, None), (7000, ""), (7001, "word " * 20_000), (7002, "x"), (7002, "x")]
    docs = rows(spark, values).repartition(4)
    place = scratch_path(spark, "tokens")
    manifest = token_files.write_token_files(docs, place, BYTES, 2, shard_bytes=4000)
    assert len(manifest["shards"]) > 3 and manifest["dictionary"] != "00" * 32
    got = token_files.read_token_files(spark, place).collect()
    got.sort(key=lambda r: r.start)
    want = sorted(values, key=lambda v: (v[0] is not None, v[0] or 0))
    start = 0
    for row, (key, text) in zip(got, want, strict=True):
        ids = bytes_library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row.id, row.start, row.n_tokens, row.ids) == (key, start, len(ids), ids)
        start += len(ids)
    crcs = {r.start: r.ids_crc32 for r in token_files.read_token_files(spark, place, True).collect()}
    assert crcs == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    # one document through the offset index
    shard = next(s for s in manifest["shards"] if s["first"] <= 300 <= s["last"])
    opened = token_files.Shard(place, shard["file"], manifest["width"])
    assert opened.document(300).tolist() == next(r.ids for r in got if r.id == 300)
    assert opened.document(301) is None


def test_token_files_check_their_dictionary(spark):
    place = scratch_path(spark, "tokens")
    docs = rows(spark, list(enumerate(texts(400, 4))))
    manifest = token_files.write_token_files(docs, place, BYTES, 2)
    where, base = token_files._place(place)
    with where.open_output_stream(f"{base}/dictionary.bin") as out:
        out.write(b"other")
    with pytest.raises(ValueError, match="dictionary"):
        token_files.Shard(place, manifest["shards"][0]["file"], manifest["width"])


def test_token_files_of_nothing(spark):
    place = scratch_path(spark, "tokens")
    manifest = token_files.write_token_files(rows(spark, []), place, BYTES, 2)
    assert manifest["shards"] == []
    assert token_files.read_token_files(spark, place).count() == 0


def test_merge_model_equals_the_library(library):
    encoder = pieces.Encoder(pieces.PieceModel(PIECES))
    for text in texts(5000, 5):
        ids = np.frombuffer(encoder.encode([text])[0], "<i4").tolist()
        assert ids == library.encode(text), repr(text)
        assert pieces.decode_ids(encoder.model, ids) == text.replace("▁", " ") == library.decode(ids)


def test_stream_commits_within_a_window(library):
    model = pieces.PieceModel(PIECES)
    stream = pieces.StreamingViterbi(model)
    text = "".join(texts(3000, 6)) + "internationalization" * 3000
    marked, ids, held = model.normalize(text), [], 0
    for at in range(0, len(marked), 41):
        ids += stream.feed(marked[at:at + 41])
        held = max(held, len(stream.text))
    assert ids + stream.finish() == library.encode(text)
    assert held < 20 * model.longest


def test_score_model_is_the_best_path():
    """Scores with fractions, so that no two paths tie; all segmentations are tried."""
    spec = pb.ModelProto.FromString(
        sentencepiece.SentencePieceProcessor(model_file=PIECES).serialized_model_proto())
    spec.trainer_spec.model_type = pieces.UNIGRAM
    draw = random.Random(8)
    for piece in spec.pieces:
        piece.score = -draw.random() * 9 - 0.2
    model = pieces.PieceModel(proto=spec.SerializeToString())
    stream = pieces.StreamingViterbi(model)

    def best(text):
        table = [(0.0, [])]
        for end in range(1, len(text) + 1):
            ways = []
            for start in range(max(0, end - model.longest), end):
                piece = text[start:end]
                if piece in model.ids:
                    ways.append((table[start][0] + model.scores[piece],
                                 [*table[start][1], model.ids[piece]]))
                elif end - start == 1:
                    ways.append((table[start][0] + model.floor,
                                 table[start][1] + model.output(piece)))
            table.append(max(ways, key=lambda w: w[0]))
        return table[-1][1]

    for text in [*texts(200, 9), "thinkingofthe" * 60]:
        marked, ids = model.normalize(text), []
        for at in range(0, len(marked), 17):
            ids += stream.feed(marked[at:at + 17])
        assert ids + stream.finish() == best(marked), repr(text)


def test_pieces_as_columns(spark, library):
    values = [*enumerate(texts(300, 10)), (None, "no id"), (900, None), (901, ""), (902, "b" * 5000)]
    docs = rows(spark, values).selectExpr("*", "'x' AS ids", "0 AS id")
    got = {r.id: r for r in pieces.encode_pieces(docs, PIECES, check=True).collect()}
    for key, text in values:
        assert got[key].ids == library.encode(text or "")
        assert got[key].round_trip and got[key].n_tokens == len(got[key].ids)
        assert got[key].ids_crc32 == zlib.crc32(np.array(got[key].ids, "<u4").tobytes())
    back = pieces.decode_pieces(pieces.encode_pieces(docs, PIECES), PIECES)
    assert {r.id: r.text for r in back.collect()} == {
        k: (t or "").replace("▁", " ") for k, t in values}
    assert pieces.encode_pieces(docs.limit(0), PIECES).count() == 0
