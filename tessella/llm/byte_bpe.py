"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: A match of the pattern never spans the place between a non-blank and a blank, and which match begins at a place
#: never depends on what is before it. So a text may be cut there and its parts encoded one by one.
_SAFE = re.compile(r"[A-Za-z0-9](?=[ \n])")
_codecs: dict[str, "Codec"] = {}


class Codec:
    """tiktoken's encoding of a rank file, and the bytes of each id."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def encode(self, text: str, size: int) -> bytes:
        return b"".join(np.array(self.encoding.encode_ordinary(part), "<u4").tobytes() for part in safe_parts(text, size))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def safe_parts(text: str, size: int) -> Iterator[str]:
    """Parts of ``text`` of about ``size`` characters, cut where no token can span; without such a place it stays whole."""
    at = 0
    while len(text) - at > size and (cut := _SAFE.search(text, at + size)):
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def codec(path: str) -> Codec:
    """The worker's codec for a file."""
    if path not in _codecs:
        _codecs[path] = Codec(path, public_tokenizers.PATTERN)
    return _codecs[path]


def encode(docs: DataFrame, ranks: str = RANKS, size: int = 1 << 16) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit numbers as binary) of every row of ``docs`` (doc_id, text, ...).

    A null or empty text has no ids; repeated rows give repeated rows, no rows none; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [own.encode(t, size) if t else b"" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``, the raw bytes of its ids; null ids are null bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [None if x is None else own.decode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
