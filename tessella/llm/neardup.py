"""MinHash near-duplicate detection: universal hash minima, banding, signature check, exact confirmation, components.

Near-duplicates are documents whose sets of distinct word shingles have a Jaccard similarity of at least ``threshold``.
The path is: one pass over the texts makes set fingerprints and signatures; documents of equal sets become one class;
each class is compared, on the full shingle sets, with the nearest, by signature, of the smallest members of its band
buckets; then members of a bucket that this left in different components, and that the signatures let through, form
clusters, in which all such members are compared on the full sets, block by block. Pairs that are in one component
already are never looked at, a task hands on no more links than it takes to connect what it has seen, and nothing but
counters reaches the driver. From the buckets on, only documents that share one with another class are carried along.
Every intermediate table is dropped when its successors are written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Tables, checkpoint, mix, runs, shingles, text_buffers, width, words
from tessella.llm.graph import connected_components


@dataclass(frozen=True)
class NearDup:
    """Parameters. 32 bands of 4 miss a pair at similarity 0.75 with probability 5e-6, and less above it."""

    size: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    #: Pairs whose signatures agree in a smaller share are dropped: of pairs at similarity 0.75 that loses 3 in 100,000.
    floor: float = 0.6
    #: The partners of one document are spread over so many groups when they are confirmed.
    chunks: int = 1024
    #: Members, and shingles, of a block of those that are compared with one another.
    block: int = 256
    load: int = 1 << 17


SIGNATURES = "doc_id long, n_shingles long, fp1 long, fp2 long, sig binary"


def _sets(batch: pa.RecordBatch, column: str, size: int) -> Iterator[np.ndarray]:
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    for at, to in runs(offsets):
        hashes, counts = words(data, offsets[at : to + 1])
        ends = np.cumsum(counts)
        for k, end in enumerate(ends):
            yield shingles(hashes[end - counts[k] : end], size)


def signatures(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """One row per document: set size, 128-bit set fingerprint, 16 bits of each minimum."""
    n = p.bands * p.rows
    rng = np.random.Generator(np.random.PCG64(7))
    a = (rng.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1))[:, None]
    b = rng.integers(0, 2**64, n, dtype=np.uint64)[:, None]
    salt = np.uint64(0xA0761D6478BD642F)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 512
        space = np.empty((n, step), dtype=np.uint64)
        for batch in batches:
            sizes, one, two, sigs = [], [], [], []
            for found in _sets(batch, "text", p.size):
                sizes.append(len(found))
                least = np.full(n, 2**64 - 1, dtype=np.uint64)
                for at in range(0, len(found), step):
                    part = found[None, at : at + step]
                    out = space[:, : part.shape[1]]
                    np.multiply(a, part, out=out)
                    np.add(out, b, out=out)
                    np.minimum(least, out.min(axis=1), out=least)
                one.append(int(mix(found).sum(dtype=np.uint64).view(np.int64)) if len(found) else None)
                two.append(int(mix(found ^ salt).sum(dtype=np.uint64).view(np.int64)) if len(found) else None)
                sigs.append((mix(least) >> np.uint64(48)).astype(np.uint16).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "fp1", "fp2", "sig"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SIGNATURES)


def _bands(own: DataFrame, p: NearDup) -> DataFrame:
    """(key, doc_id, n): the band keys of each signature, a hash of a band's number and its minima."""
    key = F.expr(f"explode(transform(sequence(0, {p.bands - 1}), k -> xxhash64(k, substring(sig, {2 * p.rows} * k + 1, {2 * p.rows}))))")
    return own.select(key.alias("key"), "doc_id", "n")


def _similar(pairs: DataFrame, own: DataFrame, p: NearDup) -> DataFrame:
    """The pairs (a, b) whose set sizes allow the threshold and whose signatures agree in a share of at least ``p.floor``, and the share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (2, 3))
            share = (one == two).mean(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share)], names=["a", "b", "share"]).filter(pa.array(share >= p.floor))

    left, right = (own.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}")) for k in "ab")
    rows = pairs.join(right, "b").join(left, "a").where(F.expr(f"100 * least(na, nb) >= {p.percent} * greatest(na, nb)"))
    return rows.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, share double")


def confirmed(pairs: DataFrame, texts: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their full shingle sets.

    The partners of ``a`` are spread over groups by hash, so that a document of very many partners meets them in many
    tasks; a group gets the text of ``a`` once, so no more than two texts are shipped for a pair. A task streams its
    rows and holds one set at a time besides that of ``a``.
    """
    percent, size = p.percent, p.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, []
        for batch in batches:
            a, chunk, b = (batch.column(k).to_pylist() for k in range(3))
            good_a, good_b = [], []
            for k, found in enumerate(_sets(batch, "text", size)):
                if b[k] is None:
                    own = [*own, found] if hub == (a[k], chunk[k]) else [found]
                    hub = a[k], chunk[k]
                elif hub == (a[k], chunk[k]) and len(found):
                    both = [(x, len(np.intersect1d(x, found, assume_unique=True))) for x in own]
                    if any(len(x) and 100 * m >= percent * (len(x) + len(found) - m) for x, m in both):
                        good_a.append(a[k])
                        good_b.append(b[k])
            yield pa.RecordBatch.from_arrays([pa.array(good_a, pa.int64()), pa.array(good_b, pa.int64())], names=["a", "b"])

    dealt = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(p.chunks)).alias("chunk"), "b")
    need = dealt.select("a", "chunk", F.col("b").cast("long").alias("b"), F.col("b").alias("doc_id")).union(dealt.select("a", "chunk", F.lit(None).cast("long"), F.col("a")).distinct())
    return (
        need.join(texts, "doc_id")
        .select("a", "chunk", "b", "text")
        .repartition(width(pairs.sparkSession), "a", "chunk")
        .sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
        .mapInArrow(run, "a long, b long")
    )


def _dealt(members: DataFrame, key: str, weight, most: int) -> DataFrame:
    """Members (key, doc_id, n, comp) of groups of several components, dealt to pairs of blocks (i, j) of ``most`` weight.

    Members outside their group's largest component are cut into blocks, which meet each other and the blocks of that
    component, so every pair in different components meets; pairs within the largest one never do.
    """
    counts = members.groupBy(key, "comp").agg(F.sum(weight).alias("m"))
    counts = counts.groupBy(key).agg(F.count("*").alias("comps"), F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("all")).where("comps > 1")
    blocks = lambda n: F.ceil(n / most).cast("int")
    counts = counts.select(key, F.col("top.comp").alias("main"), blocks(F.col("top.m")).alias("inner"), blocks(F.col("all") - F.col("top.m")).alias("outer"))
    dealt = members.join(counts, key).withColumn("out", F.col("comp") != F.col("main"))
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("out"), F.col("outer")).otherwise(F.col("inner"))).cast("int")
    dealt = dealt.withColumn("own", F.when(F.col("out"), own).otherwise(F.col("outer") + own))
    # a block pair is (i, j) with i of the outer blocks and i <= j
    at = F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda i: F.struct(F.least(i, "own").alias("i"), F.greatest(i, "own").alias("j")))
    beyond = F.transform(F.sequence(F.col("outer"), F.col("outer") + F.col("inner") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j")))
    return dealt.withColumn("at", F.explode(F.when(F.col("out"), F.concat(at, beyond)).otherwise(at))).select(F.col(key).alias("key"), "at.i", "at.j", "own", "doc_id", "n", "comp")


class _Apart:
    """Which components a task has connected; ``join`` says whether two of them were apart."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _compared(dealt: DataFrame, content: str, compare) -> DataFrame:
    """(a, b) that ``compare(own, n, comp, ids, contents)`` yields for the rows of each block pair, without repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def found() -> list[tuple[int, int]]:
            if len(rows) < 2 or (key[1] != key[2] and rows[0][0] == rows[-1][0]):
                return []
            own, ids, n, comp = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(4))
            return list(compare(own, n, comp, ids, [r[4] for r in rows]))

        def batch_of(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            out: list[tuple[int, int]] = []
            for r in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if r[:3] != key:
                    out += found()
                    key, rows = r[:3], []
                rows.append(r[3:])
            yield batch_of(out)
        yield batch_of(found())

    dealt = dealt.select("key", "i", "j", "own", "doc_id", "n", "comp", content)
    return dealt.repartition(width(dealt.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "own").mapInArrow(run, "a long, b long").distinct()


def _clusters(members: DataFrame, sigs: DataFrame, p: NearDup) -> DataFrame:
    """Pairs of components that hold members of one bucket (key, doc_id, n, comp) whose signatures agree enough."""
    floor, percent = p.floor, p.percent

    def compare(own: np.ndarray, n: np.ndarray, comp: np.ndarray, ids: np.ndarray, contents: list) -> Iterator[tuple[int, int]]:
        sig, right, apart = np.frombuffer(b"".join(contents), np.uint16).reshape(len(n), -1), np.flatnonzero(own == own[-1]), _Apart()
        for x in np.flatnonzero(own == own[0]):
            y = right[(comp[right] != comp[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))]
            y = y[(sig[y] == sig[x]).mean(axis=1) >= floor] if len(y) else y
            for other in np.unique(comp[y]).tolist():
                if apart.join(int(comp[x]), other):
                    yield int(comp[x]), other

    return _compared(_dealt(members, "key", F.lit(1), p.block).join(sigs.select("doc_id", "sig"), "doc_id"), "sig", compare)


def _links(members: DataFrame, texts: DataFrame, p: NearDup) -> DataFrame:
    """Pairs of components of a cluster, of members (cluster, doc_id, n, comp) that reach the threshold."""
    percent, size = p.percent, p.size

    def compare(own: np.ndarray, n: np.ndarray, comp: np.ndarray, ids: np.ndarray, contents: list) -> Iterator[tuple[int, int]]:
        sets = list(_sets(pa.RecordBatch.from_arrays([pa.array(contents, pa.string())], names=["text"]), "text", size))
        sizes = np.array([len(x) for x in sets])
        if not sizes.all():  # another text of a document may be empty
            some = np.flatnonzero(sizes)
            own, comp, sets, sizes = own[some], comp[some], [sets[k] for k in some], sizes[some]
            if not len(some):
                return
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.append(0, np.cumsum(sizes))
        right, apart = np.flatnonzero(own == own[-1]), _Apart()
        theirs = codes[ends[right[0]] : ends[right[-1] + 1]]  # rows come in the order of their blocks
        starts = ends[right] - ends[right[0]]
        mine = np.zeros(int(codes.max()) + 1, dtype=np.int32)
        for x in np.flatnonzero(own == own[0]):
            mine[codes[ends[x] : ends[x + 1]]] = 1
            both = np.add.reduceat(mine[theirs], starts)
            mine[codes[ends[x] : ends[x + 1]]] = 0
            near = (100 * both >= percent * (sizes[x] + sizes[right] - both)) & (comp[right] != comp[x])
            for y in right[near].tolist():
                if apart.join(int(comp[x]), int(comp[y])):
                    yield int(comp[x]), int(comp[y])

    return _compared(_dealt(members, "cluster", F.col("n"), p.load).join(texts, "doc_id"), "text", compare)


def near_duplicates(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, anything else).

    A text that is null, empty or without words has an empty set: n_shingles 0, its own component, kept. Rows that
    share a doc_id are one node of the graph, which has the links of all their texts. A row without doc_id is linked with nothing: component_id null, kept
    false. Equal rows give equal rows; an empty table gives an empty one; other columns are not looked at.
    """
    tables = Tables(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = tables.put(signatures(docs, p))
    full = sigs.where("n_shingles > 0 and doc_id is not null")
    same = ["fp1", "fp2", "n_shingles"]
    classes = tables.put(full.groupBy(*same).agg(F.min("doc_id").alias("rep")))
    rest = sigs.where("n_shingles = 0 or doc_id is null").select("doc_id", F.col("n_shingles").alias("n"), F.lit(None).cast("long").alias("rep"), F.lit(None).cast("binary").alias("sig"))
    own_sig = F.when(F.col("doc_id") == F.col("rep"), F.col("sig")).alias("sig")
    members = tables.put(full.join(classes, same).select("doc_id", F.col("n_shingles").alias("n"), "rep", own_sig).union(rest))
    tables.drop(sigs, classes)
    own = members.where("sig is not null").select("doc_id", "n", "sig")

    bands = _bands(own, p)
    hubs = tables.put(bands.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").select("key", "hub"))
    shared = tables.put(bands.join(hubs, "key"))
    tables.drop(hubs)
    ids = shared.select("doc_id").distinct()
    texts = tables.put(docs.join(ids, "doc_id", "left_semi"))
    own = tables.put(own.join(ids, "doc_id", "left_semi"))
    stars = shared.where("hub < doc_id").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    nearest = tables.put(_similar(stars, own, p).groupBy("b").agg(F.max_by("a", F.struct("share", -F.col("a"))).alias("a")).select("a", "b"))
    first = tables.put(connected_components(confirmed(nearest, texts, p)))
    tables.drop(nearest)

    known = tables.put(shared.select("key", "doc_id", "n").join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("comp")))
    tables.drop(shared)
    mixed = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    apart = tables.put(known.join(mixed, "key"))
    cluster = connected_components(_clusters(apart, own, p)).select(F.col("node").alias("comp"), F.col("component").alias("cluster"))
    near = tables.put(known.select("doc_id", "n", "comp").distinct().join(cluster, "comp"))
    more = tables.put(_links(near, texts, p))
    # the texts of one doc_id are one node
    ends = members.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("doc_id")
    twice = tables.put(members.where("rep is not null").join(ends, "doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct())
    if more.isEmpty() and twice.isEmpty():
        last = first
    else:
        last = connected_components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more).union(twice))
    label = members.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep")).join(last.withColumnRenamed("node", "rep"), "rep", "left")
    label = label.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    result = checkpoint(label.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")))
    tables.clear()
    return result
