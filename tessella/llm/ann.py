"""Nearest neighbours by cosine: anisotropic product quantisation, four-bit table scans, exact reranking.

Only ids and codes of rows meet the queries, in blocks; the vectors are joined to the few pairs that the table scores
let through, and score them exactly. Unit vectors are quantised in sub-spaces of a few dimensions with 16 centres each. The loss weighs the part of the
residual that is parallel to the vector more than the rest, as that part is what moves the scores of its best queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import checkpoint


@dataclass(frozen=True)
class Ann:
    """``sample`` bounds the vectors that the centres are fitted on; every vector is indexed."""

    dims: int = 2
    sample: int = 8192
    #: Inner products from here up should be kept; sets the weight of the parallel residual.
    threshold: float = 0.2
    rounds: int = 8
    #: Rows and queries of a block; the share of a query's best rows whose error either margin covers.
    rows: int = 1 << 16
    queries: int = 128
    cover: float = 0.95


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Quantiser:
    """Centres of every sub-space and the margins of the table scores; ``fit`` and ``codes`` take unit vectors."""

    def __init__(self, p: Ann, d: int) -> None:
        self.p, self.d = p, d
        self.parts = -(-d // p.dims)
        self.eta = max(1.0, (d - 1) * p.threshold**2 / (1 - p.threshold**2))

    def _split(self, x: np.ndarray) -> np.ndarray:
        pad = self.parts * self.p.dims - self.d
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), self.parts, self.p.dims)

    def fit(self, x: np.ndarray) -> "Quantiser":
        rng = np.random.Generator(np.random.PCG64(5))
        parts = self._split(x)
        self.centres = np.stack([parts[rng.integers(0, len(x), 16), m] for m in range(self.parts)])
        codes = self._assign(parts, None, 1)
        for _ in range(self.p.rounds):
            self._move(parts, codes)
            codes = self._assign(parts, codes, 1)
        probe = x[:: max(1, len(x) // 64)]
        exact, table = probe @ x.T, np.einsum("qmd,nmd->qn", self._split(probe), self._restore(codes), optimize=True)
        best = np.argsort(-exact, axis=1)[:, 1:65]
        error = np.take_along_axis(exact - table, best, axis=1)
        #: How far below and above its exact score a good row's table score may lie.
        self.below, self.above = (max(0.0, float(np.quantile(e, self.p.cover))) if error.size else 1.0 for e in (error, -error))
        return self

    def _restore(self, codes: np.ndarray) -> np.ndarray:
        return self.centres[np.arange(self.parts)[None, :], codes]

    def _assign(self, parts: np.ndarray, codes: np.ndarray | None, sweeps: int) -> np.ndarray:
        """Codes by coordinate descent on |r|^2 + (eta - 1) (r . x)^2, sub-space by sub-space."""
        if codes is None:
            codes = np.stack([((parts[:, m, None, :] - self.centres[m][None]) ** 2).sum(-1).argmin(1) for m in range(self.parts)], axis=1)
        codes = codes.copy()
        along = ((parts - self._restore(codes)) * parts).sum(-1)
        total = along.sum(1)
        for _ in range(sweeps):
            for m in range(self.parts):
                r = parts[:, m, None, :] - self.centres[m][None]
                own = (r * parts[:, m, None, :]).sum(-1)
                cost = (r**2).sum(-1) + (self.eta - 1) * ((total - along[:, m])[:, None] + own) ** 2
                codes[:, m] = cost.argmin(1)
                now = np.take_along_axis(own, codes[:, m, None], axis=1)[:, 0]
                total += now - along[:, m]
                along[:, m] = now
        return codes

    def _move(self, parts: np.ndarray, codes: np.ndarray) -> None:
        """Each centre to the least-squares minimum of the loss of its vectors, the other sub-spaces held."""
        along = ((parts - self._restore(codes)) * parts).sum(-1)
        total = along.sum(1)
        eye = np.eye(self.p.dims)
        for m in range(self.parts):
            x, other = parts[:, m], total - along[:, m]
            for c in range(16):
                own = codes[:, m] == c
                if own.any():
                    y = x[own]
                    a = own.sum() * eye + (self.eta - 1) * y.T @ y
                    b = (y + (self.eta - 1) * (other[own] + (y**2).sum(1))[:, None] * y).sum(0)
                    self.centres[m, c] = np.linalg.solve(a, b)
            now = ((x - self.centres[m][codes[:, m]]) * x).sum(-1)
            total += now - along[:, m]
            along[:, m] = now

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Two four-bit codes to a byte."""
        codes = self._assign(self._split(x), None, 2).astype(np.uint8)
        codes = np.pad(codes, ((0, 0), (0, self.parts % 2)))
        return codes[:, 0::2] | (codes[:, 1::2] << 4)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and byte of a code, the scores of its 256 values."""
        t = np.einsum("qmd,mcd->qmc", self._split(q), self.centres)
        t = np.pad(t, ((0, 0), (0, self.parts % 2), (0, 0)))
        low, high = t[:, 0::2], t[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(q), -1, 256).astype(np.float32)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part: no null or non-finite component, and not zero."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(F.coalesce(good, F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)


def _of_length(good: DataFrame, d: int, n: int, is_query, k: int, p: Ann) -> DataFrame:
    """(query_id, vec_id, score) with the nearest rows of the queries among the ``n`` vectors of length ``d`` of ``good``."""
    spark = good.sparkSession
    same = good.where(F.size("v") == d)
    chosen = F.xxhash64("vec_id", F.lit(17)).bitwiseAND(F.lit((1 << 31) - 1)) < int(min(1.0, p.sample / n) * (1 << 31))
    sample = [r.v for r in same.where(chosen).select("v").collect()] or [r.v for r in same.select("v").limit(1).collect()]
    shared = spark.sparkContext.broadcast(Quantiser(p, d).fit(_unit(sample)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, d)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([c.tobytes() for c in shared.value.codes(_unit(x))], pa.binary())], names=["vec_id", "v", "code"])

    copies = Window.partitionBy("v").orderBy("vec_id")
    base = same.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("vec_id", "v").mapInArrow(index, "vec_id long, v binary, code binary")
    asked = same.where(is_query(F.col("vec_id"))).select("vec_id", "v").mapInArrow(index, "vec_id long, v binary, code binary").drop("code")
    base, asked = checkpoint(base), checkpoint(asked)
    row_blocks, query_blocks = (max(1, -(-t.count() // m)) for t, m in ((base, p.rows), (asked, p.queries)))
    # both sides hold i and j as int: keys of other types hash to other partitions, where a cogroup misses them
    deal = lambda t, own, m, other, o: t.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(o - 1))))
    left = deal(base.drop("v"), "i", row_blocks, "j", query_blocks).groupBy("i", "j")
    right = deal(asked, "j", query_blocks, "i", row_blocks).groupBy("i", "j")
    margin = shared.value.below + shared.value.above

    def scan(rows: pa.Table, ask: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        if rows.num_rows and ask.num_rows:
            ids, codes = rows.column("vec_id").to_numpy(), np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
            tables, columns = shared.value.tables(_unit(_matrix(ask.column("v").combine_chunks()))), np.ascontiguousarray(codes.T)
            need = k + len(ids) - len(np.unique(ids))  # rows that surely hold k ids
            for m, own in enumerate(ask.column("vec_id").to_pylist()):
                rough = np.zeros(len(ids), dtype=np.float32)
                for table, code in zip(tables[m], columns, strict=True):
                    rough += table[code]
                rough[ids == own] = -np.inf
                least = np.partition(rough, -need)[-need] if len(ids) > need else -np.inf
                best = np.flatnonzero((rough >= least - margin) & (ids != own))
                found.append((np.full(len(best), own), ids[best], rough[best]))
        return pa.table([np.concatenate(c) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "rough"])

    pairs = left.cogroup(right).applyInArrow(scan, "query_id long, vec_id long, rough float")
    pairs = checkpoint(pairs.groupBy("query_id", "vec_id").agg(F.max("rough").alias("rough")))
    top = Window.partitionBy("query_id").orderBy(F.col("rough").desc(), "vec_id")
    least = pairs.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).groupBy("query_id").agg(F.min("rough").alias("least"))
    pairs = pairs.join(least, "query_id").where(F.col("rough") >= F.col("least") - F.lit(margin)).select("query_id", "vec_id")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, x = _matrix(batch.column(2)), _matrix(batch.column(3))
                exact = (x * q).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q, axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(exact)], names=["query_id", "vec_id", "score"])

    both = pairs.join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").join(base.select("vec_id", "v"), "vec_id")
    exact = both.select("query_id", "vec_id", "q", "v").mapInArrow(score, "query_id long, vec_id long, score double")
    return exact.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def nearest(vectors: DataFrame, is_query, k: int = 5, p: Ann = Ann()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of each row of ``vectors`` (vec_id, embedding, ...) that
    the condition ``is_query`` on vec_id takes, other than itself; the larger cosine first, then the smaller vec_id.

    Vectors that are null, zero or hold null or non-finite components take no part; those of another length have no
    cosine with a query and are searched among themselves. Equal rows count once; a vec_id of several vectors has the
    largest score of any of them, and is never its own neighbour; other columns are not looked at. With no others
    there are no rows. Of equal vectors only the ``k`` + 1 of smallest vec_id can be among anyone's nearest, so no more go on.
    Codes and queries meet in blocks of bounded size; the rows whose table score comes within both margins of a
    query's k-th are joined with their vectors and scored exactly.
    """
    spark = vectors.sparkSession
    good = checkpoint(usable(vectors).distinct())
    found = [_of_length(good, r.d, r.n, is_query, k, p) for r in good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    rows = reduce(DataFrame.union, found)
    if len(found) > 1:  # a vec_id may have vectors of several lengths
        rows = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
