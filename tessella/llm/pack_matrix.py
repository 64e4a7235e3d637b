"""Token-id output: best-fit-decreasing packing into id matrices, with segment lengths and position resets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.packing import best_fit_decreasing
from tessella.llm.wordbpe import encoder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ROWS = "sequence_id long, n_tokens int, n_segments int, doc_ids array<long>, pieces array<int>, starts array<long>, cu_seqlens array<int>, ids binary, positions binary"


def packed_rows(docs: DataFrame, capacity: int = 4096, end_id: int = 49407, pad_id: int = 0, window: int = 1 << 22, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows of packed id matrices over all rows of ``docs``, without a shuffle.

    Each document is its ids and ``end_id``; longer ones are cut every ``capacity`` tokens, so no id is lost. A task
    packs the pieces of about ``window`` tokens at a time, which bounds its memory whatever its partition holds, by
    best fit decreasing over a segment tree of free capacities. ``ids`` and ``positions`` are matrix rows of
    ``capacity`` little-endian 16-bit numbers, padded with ``pad_id`` and 0; positions start anew in each segment;
    ``cu_seqlens`` has 0 and the end of every segment. sequence_id is unique: the task's number times 2^32 and the
    row's. The string of a special token in a text is ordinary text here: else a text could hold the end token and so
    end its own segment. Null and empty texts are one end token; a null doc_id is carried along; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, end, step = encoder(vocabulary, "<u2", special=False), end_id.to_bytes(2, "little"), 2 * capacity
        count = np.arange(capacity, dtype="<u2")
        task, held, tokens, done = TaskContext.get().partitionId(), [], 0, 0
        pad = pad_id.to_bytes(2, "little")

        def flush() -> pa.RecordBatch:
            nonlocal done
            lengths = np.array([len(p[3]) // 2 for p in held], dtype=np.int64)
            bins = best_fit_decreasing(lengths, capacity)
            columns: list[list] = [[] for _ in range(9)]
            for k, own in enumerate(bins):
                sizes = lengths[own]
                total = int(sizes.sum())
                ends = np.append(0, np.cumsum(sizes))
                row = ((task << 32) + done + k, total, len(own), *([held[i][c] for i in own] for c in range(3)), ends, b"".join(held[i][3] for i in own) + pad * (capacity - total), b"".join([count[:n].tobytes() for n in sizes.tolist()]) + bytes(2 * (capacity - total)))
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            done += len(bins)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in ROWS.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for doc, ids in zip(part.column(0).to_pylist(), codes.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    tokens += len(ids) // 2
                    held += [(doc, k, s // 2, ids[s : s + step]) for k, s in enumerate(range(0, len(ids), step))]
                if tokens >= window:
                    yield flush()
                    held, tokens = [], 0
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROWS)


def write_packed(docs: DataFrame, path: str, **options: int) -> None:
    """Write the packed matrices as Parquet: a row of each file is a matrix row with its segments and positions."""
    packed_rows(docs, **options).write.mode("overwrite").parquet(path)
