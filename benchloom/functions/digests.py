"""MD5 of many short texts at once, in array arithmetic."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa

ROWS = 65_536    # messages taken at once: enough for few calls, and their words stay in the cache
SHORT = 55       # bytes of a message of one block

_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [[np.uint32(t) for t in row] for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))]
_WORDS = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)],
          *[7 * i % 16 for i in range(16)]]
_START = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _blocks(words: list[np.ndarray | None], shape: tuple[int, int]) -> np.ndarray:
    """Digests (4 words each) of messages of one block; a word that is None is 0 in all of them."""
    a, b, c, d = (np.full(shape, v) for v in _START)
    mixed, turned = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=mixed)
            np.bitwise_and(mixed, b, out=mixed)
            np.bitwise_xor(mixed, d, out=mixed)
        elif kind == 1:
            np.bitwise_xor(b, c, out=mixed)
            np.bitwise_and(mixed, d, out=mixed)
            np.bitwise_xor(mixed, c, out=mixed)
        elif kind == 2:
            np.bitwise_xor(b, c, out=mixed)
            np.bitwise_xor(mixed, d, out=mixed)
        else:
            np.invert(d, out=mixed)
            np.bitwise_or(mixed, b, out=mixed)
            np.bitwise_xor(mixed, c, out=mixed)
        mixed += a
        mixed += _SINES[i]
        if words[_WORDS[i]] is not None:
            mixed += words[_WORDS[i]]
        turn = _TURNS[kind][i % 4]
        np.left_shift(mixed, turn, out=turned)
        np.right_shift(mixed, np.uint32(32) - turn, out=mixed)
        mixed |= turned
        mixed += b
        a, b, c, d, mixed = d, mixed, b, c, a
    return np.stack([v + s for v, s in zip((a, b, c, d), _START)], -1)


def _laid(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, shift: int) -> list[np.ndarray | None]:
    """The words of messages that hold each text from byte ``shift`` on, ended and with their size."""
    rows = len(sizes)
    block = np.zeros((rows, 64), np.uint8)
    total = int(sizes.sum())
    if total:
        within = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        block.reshape(-1)[np.repeat(np.arange(rows) * 64 + shift, sizes) + within] = data[np.repeat(starts, sizes) + within]
    block[np.arange(rows), sizes + shift] = 0x80
    words = np.ascontiguousarray(block.view("<u4").T)
    words[14] = (sizes + shift) * 8
    return [w if w.any() else None for w in words]


def digests(texts: pa.StringArray, heads: list[bytes]) -> np.ndarray:
    """The MD5 of ``head + text`` for every text and head: bytes, of shape (texts, heads, 16)."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out = np.empty((len(texts), len(heads), 4), "<u4")
    sizes = np.diff(ends)
    short = np.flatnonzero(sizes <= SHORT - max(map(len, heads)))
    for at in range(0, len(short), ROWS):
        some = short[at:at + ROWS]
        many = max(ROWS // len(some), 1)
        for size in sorted({len(h) for h in heads}):
            laid = _laid(data, ends[some], sizes[some], size)
            alike = [i for i, h in enumerate(heads) if len(h) == size]
            for group in (alike[g:g + many] for g in range(0, len(alike), many)):
                words = list(laid)
                front = np.frombuffer(b"".join(heads[i].ljust(-(-size // 4) * 4, b"\0") for i in group), "<u4")
                for j, word in enumerate(front.reshape(len(group), -(-size // 4)).T):
                    words[j] = word[:, None] | (np.uint32(0) if words[j] is None else words[j])
                out[some[:, None], group] = _blocks(words, (len(group), len(some))).swapaxes(0, 1)
    out = out.view(np.uint8)
    if len(short) < len(texts):
        for row in np.setdiff1d(np.arange(len(texts)), short):
            text = data[ends[row]:ends[row + 1]].tobytes()
            out[row] = [list(hashlib.md5(head + text).digest()) for head in heads]
    return out
