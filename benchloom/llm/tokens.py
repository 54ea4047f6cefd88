"""Token counts and ids of whole texts, with the word memo that both encoders share."""

from __future__ import annotations

import gc
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, filterfalse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import batches, kept

MEMO_WORDS = 350_000      # forgotten all at once beyond this, so memory is bounded
BATCH_BYTES = 1 << 20
SPACE = "\u2581"         # how sentencepiece writes a space

_SAFE = re.compile(r"(?<=\S)(?= \S)")
# Characters that libraries do not agree on calling white space.
_DOUBTFUL = re.compile("[\u180e\u200b\ufeff]")
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
# The byte-level pre-tokenizer's pattern with its letters, numbers and white space spelt out
# for the characters up to U+00FF.
_LETTER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_NUMBER = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_BLANK = " \t\n\r\f\v\u0085\u00a0"
_LATIN = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+"
                    f"| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")


class Memo:
    """What ``encode`` gives for each distinct word, for a bounded number of words.

    The words of a batch that are not known yet are encoded in one library call.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable], limit: int = MEMO_WORDS):
        self.encode, self.limit, self.known = encode, limit, {}

    def learn(self, texts: list[list[str]]) -> dict:
        known = self.known
        missing = set(filterfalse(known.__contains__, chain.from_iterable(texts)))
        if len(known) + len(missing) > self.limit:
            self.known = known = {}
            missing = set(chain.from_iterable(texts))
        words = list(missing)
        gc.disable()  # strings and bytes only: nothing for the collector to find
        known.update(zip(words, self.encode(words)))
        gc.enable()
        return known


class ByteLevelWords:
    """A byte-level BPE file of the tokenizers library, used word by word.

    Its pre-tokenizer parts a text by a pattern before any merge, so the parts of a text can
    be encoded on their own.  Texts of characters up to U+00FF are parted by the same
    pattern here.  Other texts, and texts with a special token in them, are only cut at
    spaces between two non-blank characters, where a new part always starts; texts for which
    even that is doubtful are not cut.
    """

    memo_words = 1_200_000    # about 180 MB; parts of words come again more often than words

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.splits = ('"type":"ByteLevel","add_prefix_space":false' in self.tokenizer.to_str()
                       and self.tokenizer.normalizer is None)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def cut(self, text: str) -> list[str]:
        if not self.splits or _DOUBTFUL.search(text):
            return [text]
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _SAFE.split(text)
        if any(s in text for s in self.special):
            return _SAFE.split(text)
        return _LATIN.findall(text)

    def _encode(self, words: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(words, add_special_tokens=False)

    def lengths(self, words: list[str]) -> list[int]:
        return [len(e.ids) for e in self._encode(words)]

    def id_bytes(self, words: list[str]) -> list[bytes]:
        code = "H" if self.width == "<u2" else "I"
        ids = [array(code, e.ids) for e in self._encode(words)]
        if sys.byteorder == "big":
            for one in ids:
                one.byteswap()
        return [one.tobytes() for one in ids]


class PieceWords:
    """A sentencepiece model, used word by word.

    No piece of the model holds a space behind another character (checked here), so no merge
    crosses a boundary before a space, and the library's added first space makes each word
    come out as it does inside a text.
    """

    memo_words = MEMO_WORDS

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        probe = "a  \ufb01 " + SPACE + "b\n\t\xa0 "
        self.splits = (
            not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
            and self.model.normalize(probe) == SPACE + probe.replace(" ", SPACE))

    def cut(self, text: str) -> list[str]:
        """Words without their first space; a text that cannot be cut keeps its own."""
        if not text:
            return []
        if not self.splits:
            return [text]
        marked = SPACE + text.replace(" ", SPACE)
        if SPACE * 2 not in marked and marked[-1] != SPACE:
            return marked[1:].split(SPACE)
        return [SPACE if run == SPACE else run[1:].replace(SPACE, " ")
                for run in _RUNS.findall(marked)]

    def lengths(self, words: list[str]) -> list[int]:
        # a lone space is what remains of the added space: one piece
        return [1 if self.splits and w == SPACE else n for w, n in zip(
            words, map(len, self.model.encode(words, num_threads=1)))]


def open_words(path: str, result: str) -> tuple[ByteLevelWords | PieceWords, Memo]:
    """The words of a tokenizer file and their memo, kept while a Python worker lives."""
    def make() -> tuple[ByteLevelWords | PieceWords, Memo]:
        words = PieceWords(path) if path.endswith(".model") else ByteLevelWords(path)
        return words, Memo(getattr(words, result), words.memo_words)

    return kept(("words", path, result), make)


def count_tokens(docs: DataFrame, tokenizer: str, id_column: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens)`` of every whole text, without added special tokens.

    Arrow batches are re-cut to about 1 MB of text per library call; each text is cut at safe
    boundaries into words, and only lengths leave the function.  A null text counts as empty
    (0 tokens).  Rows are never merged: repeated rows give repeated results, a null id stays
    null.  Other columns are ignored.
    """
    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, memo = open_words(tokenizer, "lengths")
        for batch in batches(rows, "text", BATCH_BYTES):
            cuts = [words.cut(t or "") for t in batch.column("text").to_pylist()]
            known = memo.learn(cuts).__getitem__
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), sizes.cast(pa.int64()),
                pa.array([sum(map(known, c)) for c in cuts], pa.int64()),
            ], ["id", "n_bytes", "n_tokens"])

    rows = docs.selectExpr(f"`{id_column}` AS id", f"`{text}` AS text")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint")
