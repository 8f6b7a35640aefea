"""Byte-level BPE through a sentencepiece model that is written down directly from ranks.

The model's pieces are the vocabulary's byte strings with each byte as a printable character; a
piece's score is its negative rank, so that the best-scored merge is the one of lowest rank, and its
id is its rank. Text is not normalised and no space is added. Pre-tokens are encoded one by one (and
remembered), decoding maps each id's characters back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.llm.tokens import BYTE_CHARACTERS, CachedEncoder, mapped, packed

# Field numbers and codes of the published sentencepiece model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
BPE = 2


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes | str) -> bytes:
    """One protocol-buffer field: varint, 32-bit float, or bytes with their length."""
    if isinstance(value, float):
        return _number(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    data = value.encode() if isinstance(value, str) else value
    return _number(number << 3 | 2) + _number(len(data)) + data


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file in order of rank (ranks run from 0 without gaps)."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    return [ranks[i] for i in range(len(ranks))]


def sentencepiece_model(vocabulary: list[bytes]) -> bytes:
    """The serialised model; the unknown piece it needs follows the vocabulary and is never used, as
    all 256 bytes are pieces."""
    missing = set(range(256)) - {t[0] for t in vocabulary if len(t) == 1}
    if missing:
        raise ValueError(f"the vocabulary lacks the bytes {sorted(missing)}")
    piece = lambda text, score, kind: _field(PIECES, _field(1, text) + _field(2, score) + _field(3, kind))
    pieces = [
        piece("".join(BYTE_CHARACTERS[b] for b in token), float(-rank), NORMAL)
        for rank, token in enumerate(vocabulary)
    ]
    pieces.append(piece("<unk>", 0.0, UNKNOWN))
    trainer = _field(3, BPE) + _field(4, len(pieces)) + _field(40, len(vocabulary))
    # No dummy prefix, extra white space kept, spaces not replaced, no character map.
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(TRAINER, trainer) + _field(NORMALIZER, normalizer)


class Codec:
    """Encodes and decodes whole texts on one rank file."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        vocabulary = read_ranks(path)
        model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(vocabulary))
        byte_of = {c: b for b, c in enumerate(BYTE_CHARACTERS)}
        self.bytes_of = [bytes(byte_of[c] for c in model.id_to_piece(i)) for i in range(len(vocabulary))]
        encode = model.encode_as_ids
        self.encoder = CachedEncoder(lambda word: packed(encode(mapped(word)), 4), regex.compile(pattern).findall)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per process."""
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(path, pattern)
    return _CODECS[key]


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the SHA-256 of the ids and of the bytes they decode to.

    Null texts count as empty; every row is encoded, repeated ones too; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in batches:
            texts, counts, ids_sha, back_sha = batch.column(1).to_pylist(), [], [], []
            for _, ids, sizes in tool.encoder.batches(texts):
                stops = np.cumsum(sizes)
                for stop, size in zip(stops.tolist(), sizes.tolist()):
                    own = ids[stop - size : stop]
                    counts.append(size)
                    ids_sha.append(hashlib.sha256(own.tobytes()).hexdigest())
                    back_sha.append(hashlib.sha256(tool.decode(own)).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and the ids of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in batches:
            for at, ids, sizes in tool.encoder.batches(batch.column(1).to_pylist()):
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sizes)), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, ids array<int>"
    )


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and the text its ``ids`` stand for (bytes that are no UTF-8 become U+FFFD)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in batches:
            texts = [tool.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
