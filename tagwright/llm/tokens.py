"""Byte-level BPE ids of whole texts, with what occurs often computed once per task process.

The tokenizer splits a text into pre-tokens (words with the space before them, numbers, signs) and
merges bytes within each, so ids of equal pre-tokens are equal. Pre-tokens never reach over a single
space between two other characters, which is why a text may be cut there and the pieces remembered.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Only characters whose class every Unicode version agrees on take the remembered ways; any other
# text goes to the library whole.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏЀ-ҁ]*")
WIDE_GAP = re.compile(r"\s\s")


class Memory(dict):
    """Results by key, in two generations: when the young one is full it becomes the old one, and
    what is asked for again moves back. Holds at most ``2 * limit`` results."""

    def __init__(self, compute: Callable[[str], bytes], limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def turn(self) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()

    def __missing__(self, key: str) -> bytes:
        self.turn()
        found = self.old.get(key)
        if found is None:
            found = self.compute(key)
        self[key] = found
        return found

    def all_of(self, keys: list[str]) -> list[bytes]:
        """The results of many distinct keys; the young generation may outgrow its limit by them."""
        self.turn()
        found, old, compute = list(map(self.get, keys)), self.old, self.compute
        for i, known in enumerate(found):
            if known is None:
                key = keys[i]
                known = old.get(key)
                found[i] = self[key] = compute(key) if known is None else known
        return found


class CachedEncoder:
    """Ids of whole texts.

    ``of_pretoken`` gives the little-endian id bytes (``width`` per id) of one pre-token, ``split``
    cuts a text into pre-tokens, and ``whole`` (if given) encodes texts with characters outside
    ``PLAIN`` and those in which ``added`` finds something. About ``2 * limit`` results of either kind
    are remembered at most.
    """

    def __init__(self, of_pretoken, split, whole=None, width: int = 4, limit: int = 200_000, added=None):
        self.pretokens = Memory(of_pretoken, limit)
        self.split, self.whole, self.width, self.added = split, whole, width, added
        self.pieces = Memory(self._after_space, limit)

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self.pretokens.__getitem__, self.split(text)))

    def _after_space(self, word: str) -> bytes:
        if word.isalpha():
            return self.pretokens.compute(" " + word)
        if word[:-1].isalpha() and word[-1] in ".,;:!?":
            return self.pretokens[" " + word[:-1]] + self.pretokens[word[-1]]
        return self._cut(" " + word)

    def _apart(self, text: str) -> bytes | None:
        """The ids of a text that must not be cut at its spaces; None if it may."""
        if self.added and self.added(text):
            return self.whole(text)
        if not PLAIN.fullmatch(text):
            return self._cut(text) if self.whole is None else self.whole(text)
        return self._cut(text) if WIDE_GAP.search(text) else None

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has. Null counts as empty."""
        dtype = np.dtype(f"<u{self.width}")
        blobs, cut, starts = [], [], []  # ids by piece number; pieces of each text
        numbers, lengths = [], []
        for text in texts:
            apart = self._apart(text or "")
            if apart is not None or not text:
                numbers.append(np.array([len(blobs)], np.int64))
                blobs.append(apart or b"")
            else:
                first = text.find(" ")
                head, tail = (text, None) if first < 0 else (text[:first], text[first + 1 :])
                numbers.append(np.array([len(blobs)], np.int64))
                blobs.append(self._cut(head))
                if tail is not None:
                    starts.append(len(numbers))
                    numbers.append(None)
                    cut.append(tail)
            lengths.append(len(numbers))
        if cut:
            lists = pc.split_pattern(pa.array(cut, pa.large_string()), " ")
            coded = lists.flatten().dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(blobs)
            blobs.extend(self.pieces.all_of(coded.dictionary.to_pylist()))
            edges = lists.offsets.to_numpy()
            for i, at in enumerate(starts):
                numbers[at] = codes[edges[i] : edges[i + 1]]
        if not numbers:
            return np.empty(0, dtype), np.empty(0, np.int64)
        known = np.frombuffer(b"".join(blobs), dtype)
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // self.width
        where = np.cumsum(sizes) - sizes
        pieces = np.concatenate(numbers)
        size = sizes[pieces]
        ends = np.cumsum(size)
        step = np.int32 if max(len(known), ends[-1]) < 1 << 31 else np.int64
        ids = known[np.repeat((where[pieces] - (ends - size)).astype(step), size) + np.arange(ends[-1], dtype=step)]
        last = np.cumsum([len(n) for n in numbers])[np.array(lengths) - 1] - 1
        return ids, np.diff(ends[last], prepend=0)

    def batches(self, texts: Sequence[str | None], chars: int = 4_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(first text, ids, counts)`` for runs of texts of about ``chars`` characters."""
        at, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size >= chars or i + 1 == len(texts):
                yield at, *self.encode(texts[at : i + 1])
                at, size = i + 1, 0


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = [], 0
    for byte in range(256):
        if byte in own:
            table.append(chr(byte))
        else:
            table.append(chr(0x100 + extra))
            extra += 1
    return table


BYTE_CHARACTERS = byte_characters()
_MAPPED = {i: c for i, c in enumerate(BYTE_CHARACTERS)}


def packed(ids: list[int], width: int) -> bytes:
    """Ids as little-endian integers of 2 or 4 bytes."""
    found = array("H" if width == 2 else "I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


def mapped(text: str) -> str:
    """The text's UTF-8 bytes, each as its character."""
    return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(_MAPPED)


_ENCODERS: dict[tuple[str, int, int], CachedEncoder] = {}


def library_encoder(path: str, width: int = 4, limit: int = 200_000) -> CachedEncoder:
    """An encoder on the ``tokenizers`` file at ``path``, one per process and ``limit`` of remembered
    results.

    Ids are those of the library's ``encode(text, add_special_tokens=False)``: where a text holds the
    content of an added token, that token's id. Such texts go to the library whole; the pre-tokens of
    others are merged by the file's own model, which must be a byte-level BPE that splits by
    ``public_tokenizers.PATTERN``.
    """
    key = (path, width, limit)
    if key not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = [regex.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
        added = regex.compile("|".join(added)).search if added else None
        model, pattern = tokenizer.model, regex.compile(public_tokenizers.PATTERN)

        merge, space = model.tokenize, BYTE_CHARACTERS[0x20]

        def of_pretoken(word: str) -> bytes:
            plain = word[0] == " " and word.isascii() and word[1:].isalnum()
            return packed([t.id for t in merge(space + word[1:] if plain else mapped(word))], width)

        def whole(text: str) -> bytes:
            return packed(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, width)

        _ENCODERS[key] = CachedEncoder(of_pretoken, pattern.findall, whole, width, limit, added)
    return _ENCODERS[key]
