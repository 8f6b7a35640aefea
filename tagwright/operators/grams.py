"""Hashed runs of words, a batch of listings at a time: ``(row, bucket, value)`` in numpy.

The hash is that of ``functions.text.bucket`` (the first 32 bits of md5) and its sign that of
``hash_sign`` (the fifth byte), so both ways give the same features. A run of words is a stretch of its
text's bytes; the digests of thousands of stretches are computed at a time, step by step, as a call per
stretch takes several times as long as the digest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import md5

import numpy as np

PRINT = np.dtype([("hash", ">u4"), ("sign", "u1")])
# Characters whose grams are in memory at a time, and grams whose digests are computed together.
CHARS, TOGETHER = 400_000, 16_384
# Bytes of a gram that md5 takes in one block; longer ones are left to hashlib, and so many remembered.
ONE_BLOCK, REMEMBERED = 55, 100_000
SHIFTS = [n for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for n in four * 4]
SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
BEGIN = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
# What is left of four bytes if the text ends after 0 to 4 of them, and the mark that then follows (last: it
# ended before).
LEFT = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
MARK = np.array([0x80, 0x8000, 0x800000, 0x80000000, 0, 0], np.uint32)


@dataclass(frozen=True)
class Hashing:
    """Runs of n words count ``weights[n - 1]``; equal buckets of a row are combined by ``sum`` or
    ``max``; ``l2`` gives the row's part length one. Buckets that cancel out give nothing."""

    weights: tuple[float, ...]
    buckets: int
    signed: bool = False
    combine: str = "sum"
    l2: bool = False


class Prints(dict):
    """First bytes of the md5 of long grams; forgotten all at once when there are too many."""

    def __missing__(self, gram: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[gram] = md5(gram, usedforsecurity=False).digest()[: PRINT.itemsize]
        return found


def _first_words(block: list[np.ndarray | None], count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the md5 of one-block messages, given by word (null: zero in all)."""
    a, b, c, d = (np.full(count, x, np.uint32) for x in BEGIN)
    f, g = np.empty(count, np.uint32), np.empty(count, np.uint32)
    for i, (sine, shift) in enumerate(zip(SINES, SHIFTS)):
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            at = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += sine
        if block[at] is not None:
            f += block[at]
        np.right_shift(f, np.uint32(32 - shift), out=g)
        np.left_shift(f, np.uint32(shift), out=f)
        f |= g
        f += b
        a, d, c, b, f = d, c, b, f, a
    return a + BEGIN[0], b + BEGIN[1]


def prints(text: bytes, starts: np.ndarray, sizes: np.ndarray, known: Prints) -> np.ndarray:
    """The first five bytes of the md5 of stretches of ``text``, as ``PRINT``."""
    out = np.empty(len(starts), PRINT)
    own = np.frombuffer(text + bytes(ONE_BLOCK + 5), np.uint8).astype(np.uint32)
    fours = own[:-3] | own[1:-2] << np.uint32(8) | own[2:-1] << np.uint32(16) | own[3:] << np.uint32(24)
    short = np.flatnonzero(sizes <= ONE_BLOCK)
    # By size, so that few words of a chunk are partly filled.
    short = short[np.argsort(sizes[short].astype(np.uint8), kind="stable")]
    for at in range(0, len(short), TOGETHER):
        some = short[at : at + TOGETHER]
        start, size = starts[some], sizes[some]
        block: list[np.ndarray | None] = [None] * 16
        for i in range(int(size[-1]) // 4 + 1):
            block[i] = fours[start + 4 * i]
            if size[0] < 4 * i + 4:
                left = np.clip(size - 4 * i, -1, 4)
                block[i] = block[i] & LEFT[np.maximum(left, 0)] | MARK[left]
        block[14] = (8 * size).astype(np.uint32)
        first, second = _first_words(block, len(some))
        out["hash"][some] = first.byteswap()
        out["sign"][some] = second & np.uint32(0xFF)
    for i in np.flatnonzero(sizes > ONE_BLOCK).tolist():
        out[i] = np.frombuffer(known[text[starts[i] : starts[i] + sizes[i]]], PRINT)[0]
    return out


def runs_of_rows(texts: Sequence[str | None], chars: int = CHARS) -> Iterator[tuple[int, int]]:
    """``(first, end)`` of runs of rows of about ``chars`` characters."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= chars or i + 1 == len(texts):
            yield first, i + 1
            first, size = i + 1, 0


def cells(texts: Sequence[str | None], how: Hashing, known: Prints) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of every cell of texts whose words are joined by single spaces."""
    count = np.array([text.count(" ") + 1 if text else 0 for text in texts], np.int64)
    joined = " ".join(text for text in texts if text).encode()
    ends = np.flatnonzero(np.frombuffer(joined + b" ", np.uint8) == 32)[: count.sum()]
    starts = np.r_[0, ends[:-1] + 1][: len(ends)]
    at, last = np.repeat(np.arange(len(texts)), count), np.repeat(np.cumsum(count), count)
    place = np.arange(len(ends))
    # The values that cells can have; a cell's place among them is sorted with its key, below it.
    amounts = np.array([w * sign for w in how.weights for sign in (1, -1)], np.float64)
    bits = len(amounts).bit_length()
    keys = []
    for n in range(len(how.weights)):
        first = np.flatnonzero(place + n < last)
        own = prints(joined, starts[first], ends[first + n] - starts[first], known)
        amount = 2 * n + (own["sign"] & 1 if how.signed else 0)
        keys.append((at[first] << 32 | own["hash"].astype(np.int64) % how.buckets) << bits | amount)
    key, value = np.concatenate(keys), np.empty(0)
    if len(key):
        key.sort()
        value, key = amounts[key & (1 << bits) - 1], key >> bits
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        if len(starts) < len(key):
            combine = np.maximum if how.combine == "max" else np.add
            key, value = key[starts], combine.reduceat(value, starts)
        key, value = key[value != 0], value[value != 0]
    row, bucket = key >> 32, key & 0xFFFFFFFF
    if how.l2:
        value = value / np.sqrt(np.bincount(row, value * value, minlength=len(texts)))[row]
    return row, bucket, value
