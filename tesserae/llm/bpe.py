"""Operator 2: byte-level BPE through a sentencepiece model written directly from the vocabulary.

The vocabulary's byte strings become pieces of printable characters, one per byte, scored by their negative rank, with
identity normalisation; sentencepiece then merges in the order of the ranks. Each pre-token is encoded by itself. Decoding
maps ids to pieces and pieces back to bytes.

Null text counts as empty and gives no ids. Empty tables give empty results; repeated rows are encoded each by itself;
columns other than the id and the text are not carried, so their names cannot clash. Every row is handled alone: no
shuffle, and memory bounded by a slice of rows and the fixed caches of tokens.py.
"""

from __future__ import annotations

import base64
import functools
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.common import active, record_batch, released_by_others, slices
from tesserae.llm.tokens import SpacedEncoder, byte_map, mapped

OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 byte string and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of the protocol-buffer wire format."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised BPE model: piece i is the byte string of rank i; the unknown piece comes last and is never used."""
    if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be gapless and hold every byte")
    table, by_rank = byte_map(), sorted(ranks, key=ranks.get)
    pieces = [_field(1, _field(1, "".join(table[b] for b in piece).encode()) + _field(2, float(-rank)) + _field(3, 1)) for rank, piece in enumerate(by_rank)]
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks))  # BPE, vocabulary size, id of the unknown piece
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no dummy prefix, white space as it is
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normalizer)


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        encode, table = self.processor.encode_as_ids, byte_map()
        self.encoder = SpacedEncoder(pattern, lambda p: array("I", encode(mapped(p, table))).tobytes(), dtype="<u4")
        back = {c: b for b, c in table.items()}
        self.bytes_of = [bytes(back[c] for c in self.processor.id_to_piece(i)) for i in range(len(ranks))]

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return self.encoder(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


released_by_others(codec.cache_clear)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded (binary: the bytes that the ids stand for)."""

    def run(batches):
        active("bpe")
        c = codec(ranks_path, pattern)
        for part in slices(batches):
            ids = c.encoder.many(part.column(1))
            yield record_batch(OUT, part.column(0), ids, [c.decode(x) for x in ids])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded binary")
