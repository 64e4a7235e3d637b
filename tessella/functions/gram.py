"""Gram matrices of many vectors, in blocks of columns, without a row for each pair of columns of each vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(vectors: DataFrame, block: int = 256, held: int = 64) -> DataFrame:
    """(key, i, j, g): sums of x[i] * x[j], i < j, over the ``vectors`` (key long, x array<double>) of each key.

    A task multiplies its own rows, block of columns by block of columns, and hands on one matrix for each key and pair
    of blocks, earlier if it holds more than ``held``. The pairs of blocks are the keys under which tasks' matrices are
    added up, one after another. The vectors of a key have one length.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}

        def out() -> pa.RecordBatch:
            found = [[k[0] for k in sums], [k[1] for k in sums], [k[2] for k in sums], [s.tobytes() for s in sums.values()], [s.shape[1] for s in sums.values()]]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds, strict=True)], names=["key", "bi", "bj", "sums", "wide"])
            sums.clear()
            return batch

        for batch in batches:
            keys, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            for key in np.unique(keys):
                rows = np.flatnonzero(keys == key)
                size = int(ends[rows[0] + 1] - ends[rows[0]])
                x = values[ends[rows][:, None] + np.arange(size)]
                for bi in range(0, size, block):
                    for bj in range(bi, size, block):
                        product = x[:, bi : bi + block].T @ x[:, bj : bj + block]
                        at = (int(key), bi, bj)
                        sums[at] = sums[at] + product if at in sums else product
                        if len(sums) > held:
                            yield out()
        if sums:
            yield out()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, whole = None, None

        def out() -> pa.RecordBatch:
            i, j = np.indices(whole.shape)
            i, j = i.ravel() + at[1], j.ravel() + at[2]
            good = i < j
            columns = [pa.array(np.full(int(good.sum()), at[0])), pa.array(i[good]), pa.array(j[good]), pa.array(whole.ravel()[good])]
            return pa.RecordBatch.from_arrays(columns, names=["key", "i", "j", "g"])

        for batch in batches:
            for key, bi, bj, sums, wide in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(sums).reshape(-1, wide)
                if (key, bi, bj) != at:
                    if at:
                        yield out()
                    at, whole = (key, bi, bj), own.copy()
                else:
                    whole += own
        if at:
            yield out()

    summed = vectors.select(F.col("key").cast("long").alias("key"), "x").mapInArrow(parts, "key long, bi int, bj int, sums binary, wide int")
    return summed.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj").mapInArrow(total, "key long, i long, j long, g double")
