"""SentencePiece encoding and decoding by a streaming Viterbi pass."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, kept
from .tokens import BATCH_BYTES, SPACE, Memo

LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
MARKS = ".,;:!?\n"
UNKNOWN_PENALTY = 10.0   # fixed by the file format's library: below the lowest score
UNIGRAM, BPE = 1, 2      # fixed values of the model file
MEMO_PIECES = 600_000


class PieceModel:
    """Pieces, scores and flags of a ``.model`` file."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor()
        if proto is None:
            self.library.Load(path)
        else:
            self.library.LoadFromSerializedProto(proto)
        spec = pb.ModelProto.FromString(self.library.serialized_model_proto())
        self.kind = spec.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        normal = pb.ModelProto.SentencePiece.NORMAL
        pieces = [(i, p) for i, p in enumerate(spec.pieces) if p.type == normal]
        self.ids = {p.piece: i for i, p in pieces}
        self.scores = {p.piece: p.score for _, p in pieces}
        self.names = [p.piece for p in spec.pieces]
        self.unknown = self.library.unk_id()
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = {i: b for b, i in enumerate(self.byte_ids) if i != self.unknown}
        self.silent = {i for i in range(len(self.names)) if self.library.is_control(i)}
        self.longest = max(map(len, self.ids))
        # a string that ends no piece need not be made longer
        self.tails = {p[k:] for p in self.ids for k in range(len(p))}
        self.floor = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.prefix = spec.normalizer_spec.add_dummy_prefix
        probe = "a  \ufb01 " + SPACE + "b\n\t\xa0 "
        plain = (SPACE if self.prefix else "") + probe.replace(" ", SPACE)
        self.identity = self.library.normalize(probe) == plain
        # A boundary that no piece spans is on every path: in front of a space that follows
        # another character and, for these marks, between a mark and a letter.
        denies = lambda pattern: any(re.search(pattern, p) for p in self.ids)
        self.cuts = not denies(f"[^{SPACE}]{SPACE}")
        marks = "".join(c for c in MARKS if not denies(f"[{LETTERS}][{c}]|[{c}][{LETTERS}]"))
        word = f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        if marks:
            word = (f"{SPACE}*[{LETTERS}]+(?=[{SPACE}{marks}]|\\Z)"
                    f"|[{marks}]+(?=[{LETTERS}{SPACE}]|\\Z)|{word}")
        self.word = re.compile(word)
        self.odd, self.start = len(self.names), len(self.names) + 1
        self.kept: dict[int, bool] = {}

    def normalize(self, text: str) -> str:
        if not text:
            return ""
        if self.identity:
            return (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        return self.library.normalize(text)

    def merge(self, text: str) -> list[str]:
        """The pieces that merging the best pair again and again leaves of a short string."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def keeps(self, left: int, right: int) -> bool:
        """Whether merging leaves a boundary just between two pieces.

        ``left`` may be ``start``, the beginning of a text.  An unknown character, ``odd``, is
        in no piece and so never merges.
        """
        if len(self.kept) > MEMO_PIECES:
            self.kept.clear()
        whole = [self.names[i] for i in (left, right) if i < len(self.names)]
        known = left == self.odd or right == self.odd or self.merge("".join(whole)) == whole
        self.kept[left << 20 | right] = known
        return known

    def output(self, character: str) -> list[int]:
        """Ids of an unknown character: its bytes if the model has pieces for them."""
        if not self.bytes_of:
            return [self.unknown]
        return [self.byte_ids[b] for b in character.encode("utf-8", "surrogatepass")]


class StreamingViterbi:
    """Encodes characters as they come and commits ids as soon as they are certain.

    For every position the trellis holds the last piece of the best path to it.  A unigram
    model takes the highest sum of scores.  In a BPE model the path to a position is the
    merge result of the text before it; its last piece is the one that stays apart from the
    path before it when merged.  No piece is longer than ``longest``, so only the last
    ``longest`` positions can be continued; once the paths to all of them run through one
    boundary, everything before it is committed and forgotten.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self.lot = 8 * model.longest
        self._clear()

    def _clear(self) -> None:
        """``last`` and ``size``: id and length of the last piece of the path to a position."""
        self.text, self.last, self.size, self.best = "", [self.model.start], [0], [0.0]
        self.seen = 0      # positions of ``text`` with a path

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        for at in range(0, len(text), self.lot):
            self.text += text[at:at + self.lot]
            self._advance()
            if len(self.text) >= self.lot:
                out += self._commit()
        return out

    def finish(self) -> list[int]:
        out = self._path(len(self.text))
        self._clear()
        return out

    def sorted_words(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of each of the sorted words; what a word shares with the one before is kept."""
        self._clear()
        before = ""
        for word in words:
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del self.last[same + 1:], self.size[same + 1:], self.best[same + 1:]
            self.text, self.seen, before = word, same, word
            self._advance()
            yield self._path(len(word))
        self._clear()

    def _advance(self) -> None:
        if self.model.kind == BPE:
            self._advance_merges()
        else:
            self._advance_scores()
        self.seen = len(self.text)

    def _advance_merges(self) -> None:
        model, text, last, size = self.model, self.text, self.last, self.size
        tails, ids, kept = model.tails, model.ids.get, model.kept.get
        for end in range(self.seen + 1, len(text) + 1):
            # exactly one piece stays apart from the path before it: the first found will do
            start = end - 1
            piece = text[start]
            while True:
                found = ids(piece)
                if found is not None:
                    stays = kept(last[start] << 20 | found)
                    if stays is None:
                        stays = model.keeps(last[start], found)
                    if stays:
                        break
                elif piece not in tails:
                    start, found = end - 1, ids(text[end - 1], model.odd)
                    break
                start -= 1
                if start < 0:
                    start, found = end - 1, ids(text[end - 1], model.odd)
                    break
                piece = text[start:end]
            last.append(found)
            size.append(end - start)

    def _advance_scores(self) -> None:
        model, text, best = self.model, self.text, self.best
        for end in range(self.seen + 1, len(text) + 1):
            top, chosen, size = None, model.odd, 1
            for start in range(max(0, end - model.longest), end):
                piece = text[start:end]
                score = model.scores.get(piece)
                if score is None:
                    if start < end - 1:
                        continue
                    score = model.floor
                total = best[start] + score
                if top is None or total > top:
                    top, chosen, size = total, model.ids.get(piece, model.odd), end - start
            self.last.append(chosen)
            self.size.append(size)
            best.append(top)

    def _commit(self) -> list[int]:
        live = set(range(max(0, self.seen - self.model.longest + 1), self.seen + 1))
        while len(live) > 1:
            furthest = max(live)
            live.discard(furthest)
            live.add(furthest - self.size[furthest])
        edge = live.pop()
        if not edge:
            return []
        out = self._path(edge)
        self.text, self.last = self.text[edge:], self.last[edge:]
        self.size, self.best = self.size[edge:], self.best[edge:]
        self.seen -= edge
        return out

    def _path(self, end: int) -> list[int]:
        out, last, size, odd = [], self.last, self.size, self.model.odd
        while end > 0:
            if last[end] == odd:
                out += reversed(self.model.output(self.text[end - 1]))
            else:
                out.append(last[end])
            end -= size[end]
        out.reverse()
        return out


class Encoder:
    """Whole texts to ids.

    Words, cut in front of spaces that no piece can span, are remembered; a word longer
    than the memo takes goes through the trellis window by window.
    """

    LONG = 64

    def __init__(self, model: PieceModel):
        self.model = model
        self.trellis = StreamingViterbi(model)
        self.memo = Memo(self._encode, MEMO_PIECES)

    def _encode(self, words: list[str]) -> list[bytes]:
        short = sorted(w for w in words if len(w) <= self.LONG)
        found = {w: array("i", i).tobytes()
                 for w, i in zip(short, list(self.trellis.sorted_words(short)))}
        found.update((w, array("i", self.trellis.feed(w) + self.trellis.finish()).tobytes())
                     for w in words if len(w) > self.LONG)
        return [found[w] for w in words]

    def cut(self, text: str) -> list[str]:
        text = self.model.normalize(text)
        if not self.model.cuts:
            return [text] if text else []
        return self.model.word.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        cuts = [self.cut(t) for t in texts]
        short = [[w for w in c if len(w) <= self.LONG] if max(map(len, c), default=0) > self.LONG
                 else c for c in cuts]
        known = self.memo.learn(short)
        return [b"".join(known[w] if len(w) <= self.LONG else self._encode([w])[0] for w in c)
                if short[k] is not c else b"".join(map(known.__getitem__, c))
                for k, c in enumerate(cuts)]


def decode_ids(model: PieceModel, ids: list[int]) -> str:
    """The text of ids: pieces with spaces for their marks, runs of byte pieces as UTF-8."""
    if not ids:
        return ""
    if model.bytes_of and not model.bytes_of.keys().isdisjoint(ids):
        parts, run = [], bytearray()
        for i in ids:
            byte = model.bytes_of.get(i)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run.clear()
            parts.append("" if i in model.silent else model.names[i])
        parts.append(run.decode("utf-8", "replace"))
        text = "".join(parts)
    else:
        text = "".join([model.names[i] for i in ids if i not in model.silent])
    text = text.replace(SPACE, " ")
    return text[1:] if model.prefix and text[:1] == " " else text


def open_encoder(path: str) -> Encoder:
    """The encoder of a model file, kept while a Python worker lives."""
    return kept(("pieces", path), lambda: Encoder(PieceModel(path)))


def _lists(data: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(data) + 1, np.int32)
    np.cumsum([len(d) // 4 for d in data], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets),
                                    pa.array(np.frombuffer(b"".join(data), "<i4")))


def encode_pieces(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text",
                  check: bool = False) -> DataFrame:
    """``(id, ids)`` of every whole text, without begin or end ids; null and empty give [].

    With ``check`` also ``n_tokens``, ``ids_crc32`` (of the ids as little-endian 32-bit
    integers) and ``round_trip``: whether decoding gives the text back, with a mark that
    stands in the text itself read as a space.  Other columns are ignored; repeated rows give
    repeated results.
    """
    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = open_encoder(path)
        for part in batches(parts, "text", BATCH_BYTES):
            texts = [t or "" for t in part.column("text").to_pylist()]
            data = encoder.encode(texts)
            columns = [part.column("id"), _lists(data)]
            if check:
                same = [decode_ids(encoder.model, np.frombuffer(d, "<i4").tolist())
                        == t.replace(SPACE, " ") for d, t in zip(data, texts)]
                columns += [pa.array([len(d) // 4 for d in data], pa.int64()),
                            pa.array([zlib.crc32(d) for d in data], pa.int64()), pa.array(same)]
            yield pa.RecordBatch.from_arrays(
                columns, ["id", "ids", "n_tokens", "ids_crc32", "round_trip"][:len(columns)])

    rows = docs.selectExpr(f"`{id_column}` AS id", f"`{text}` AS text")
    kind = rows.schema["id"].dataType.simpleString()
    more = ", n_tokens bigint, ids_crc32 bigint, round_trip boolean" if check else ""
    return rows.mapInArrow(encode, f"id {kind}, ids array<int>{more}")


def decode_pieces(encoded: DataFrame, path: str, id_column: str = "id",
                  ids: str = "ids") -> DataFrame:
    """``(id, text)`` of id lists; a null list and null ids in it give no text."""
    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = open_encoder(path).model
        for part in parts:
            texts = [decode_ids(model, [i for i in row or [] if i is not None])
                     for row in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.string())],
                                             ["id", "text"])

    rows = encoded.selectExpr(f"`{id_column}` AS id", f"`{ids}` AS ids")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(decode, f"id {kind}, text string")
