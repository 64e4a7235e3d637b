"""Ranked lexical search over bit-sliced Bloom signatures.

Documents with about as many distinct terms stand together in blocks. A block has a bitmap for each row of its Bloom
filter, one bit for each document; the bitmaps of a term's rows, taken together by AND, mark every document that holds
the term, and some that don't. Further rows tell documents that hold it at least 2, 4 or 16 times. For a query, the
weights of the marked terms, summed up document by document at each of these levels and multiplied by what a level can
add at the document's length, bound the score from above. A task keeps the best exact scores of each query so far: a
document whose bound is below all of them can't be among the best and is left; all others are scored exactly from the
block's lists of terms and counts. So the result is that of scoring every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import NO_TERM, Tables, mix, runs, steps, text_buffers, word_places

#: A level's documents hold a term at least so many times.
LEVELS = (1, 2, 4, 16)
#: Keeps a level's rows apart from those of the others.
SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], dtype=np.uint64)
BLOCKS = "rows long, n_docs long, n_terms long, ids binary, lengths binary, bits binary, ends binary, terms binary, counts binary"


@dataclass(frozen=True)
class Search:
    top: int = 50
    #: Filter rows for each distinct term of the largest document of a block, to the next power of two; at most 2^20.
    rows_per_term: int = 8
    #: Distinct terms of all documents of a block.
    block_terms: int = 1 << 16
    #: Terms of the queries that meet the index in one pass.
    load: int = 1 << 17


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts: terms with repeats of each, distinct terms of each, then the distinct terms' sorted hashes and counts."""
    hashes, lengths, _, _ = word_places(data, offsets, blank=NO_TERM)
    text = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])])) if len(hashes) else np.zeros(0, np.int64)
    return lengths, np.bincount(text[first], minlength=len(lengths)), hashes[first], np.diff(np.append(first, len(hashes)))


def _probes(terms: np.ndarray, level: int, rows: int) -> list[np.ndarray]:
    """The three filter rows of each term at a level."""
    x, last = mix(terms ^ SALTS[level]), np.uint64(rows - 1)
    return [((x >> np.uint64(20 * k)) & last).astype(np.int64) for k in range(3)]


def _block(members: list[tuple], rows: int) -> dict:
    """A block of documents (id, length, terms, counts) with its bitmaps."""
    sizes = np.array([len(m[2]) for m in members])
    terms, counts, doc = np.concatenate([m[2] for m in members]), np.concatenate([m[3] for m in members]), np.repeat(np.arange(len(members)), sizes)
    bits = np.zeros((rows, -(-len(members) // 8)), dtype=np.uint8)
    for level, least in enumerate(LEVELS):
        held = counts >= least
        for row in _probes(terms[held], level, rows):
            np.bitwise_or.at(bits, (row, doc[held] >> 3), (128 >> (doc[held] & 7)).astype(np.uint8))
    lengths = np.array([m[1] for m in members], dtype=np.int64)
    return {
        "rows": rows, "n_docs": len(members), "n_terms": int(lengths.sum()), "ids": np.array([m[0] for m in members], dtype=np.int64).tobytes(), "lengths": lengths.tobytes(),
        "bits": bits.tobytes(), "ends": np.cumsum(sizes).tobytes(), "terms": terms.tobytes(), "counts": counts.astype(np.uint32).tobytes(),
    }


def _batch(blocks: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(blocks, schema=pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.binary()) for c in BLOCKS.split(", ")]))


def index(docs: DataFrame, p: Search = Search()) -> DataFrame:
    """The blocks over ``docs`` (doc_id, text), made where the texts are read; texts without terms and rows without
    doc_id are in none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = {}
        held: dict[int, int] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_buffers(batch.column(1))
            for at, to in runs(offsets, 1 << 21):
                lengths, sizes, terms, counts = term_counts(data, offsets[at : to + 1])
                ends = np.cumsum(sizes)
                for k in np.flatnonzero(lengths):
                    rows = min(1 << 20, 1 << int(max(8, sizes[k]) * p.rows_per_term - 1).bit_length())
                    own = slice(ends[k] - sizes[k], ends[k])
                    waiting.setdefault(rows, []).append((int(ids[at + k]), int(lengths[k]), terms[own].copy(), counts[own].copy()))
                    held[rows] = held.get(rows, 0) + int(sizes[k])
                    if held[rows] >= p.block_terms:
                        del held[rows]
                        yield _batch([_block(waiting.pop(rows), rows)])
        for rows, members in waiting.items():
            yield _batch([_block(members, rows)])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCKS)


def queries_of(items: DataFrame) -> DataFrame:
    """(item_id, terms): the sorted hashes of the distinct terms of an item; rows of one item_id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, sizes, terms, _ = term_counts(*text_buffers(batch.column(1)))
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms.view(np.int64))], names=["item_id", "term"])

    found = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, term long")
    return found.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def _numbers(batch: pa.RecordBatch, column: str, row: int, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(column)[row].as_buffer(), dtype=kind)


def _document_counts(blocks: DataFrame, asked: np.ndarray) -> np.ndarray:
    """How many documents hold each term of ``asked``, which is sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), dtype=np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                terms = _numbers(batch, "terms", k, np.uint64)
                at = np.minimum(np.searchsorted(asked, terms), len(asked) - 1)
                total += np.bincount(at[asked[at] == terms], minlength=len(asked))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "docs"])

    out = np.zeros(len(asked), dtype=np.int64)
    for r in blocks.select("terms").mapInArrow(run, "at long, docs long").groupBy("at").agg(F.sum("docs").alias("docs")).collect():
        out[r["at"]] = r["docs"]
    return out


@dataclass
class _Queries:
    """A group of queries: their items, distinct terms, each item's places among them and weights; the best results so far."""

    items: list[int]
    terms: np.ndarray
    at: list[np.ndarray]
    weights: np.ndarray
    n_docs: int
    n_terms: int


def _gain(tf: np.ndarray | int, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class _Best:
    """The best exact scores of one query, equal ones by ascending document."""

    def __init__(self, top: int) -> None:
        self.top, self.scores, self.ids = top, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        """A smaller score is not among the best."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores > 0
        scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
        order = np.lexsort((ids, -scores))[: self.top]
        self.scores, self.ids = scores[order], ids[order]


def bounds(bits: np.ndarray, q: _Queries, m: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of each query of the group, an upper bound of every document's score, from the block's bitmaps alone."""
    rows, marked = len(bits), []
    for level in range(len(LEVELS)):
        one, two, three = (bits[row] for row in _probes(q.terms, level, rows))
        both = one & two & three
        marked.append(both & marked[-1] if marked else both)
    ceilings = [_gain(most, m) for most in (*(least - 1 for least in LEVELS[1:]),)] + [np.full(len(m), 1_000_000)]
    adds = [ceilings[0], *(b - a for a, b in zip(ceilings, ceilings[1:], strict=False))]
    used = [x.any(axis=1) for x in marked]
    for k, at in enumerate(q.at):
        total, kind = np.zeros(len(m), dtype=np.int64), np.float32 if q.weights[at].sum() < 1 << 24 else np.float64
        for level, add in enumerate(adds):
            own = at[used[level][at]]
            if not len(own):
                break
            sums = q.weights[own].astype(kind) @ np.unpackbits(marked[level][own], axis=1, count=len(m)).astype(kind)
            total += sums.astype(np.int64) * add
        yield k, total


def _scores(docs: np.ndarray, at: np.ndarray, q: _Queries, m: np.ndarray, posts: tuple) -> np.ndarray:
    """Exact scores of the documents ``docs`` of a block for the query with terms ``at``."""
    begin, size, term, tf = posts
    weight = np.zeros(len(q.terms), dtype=np.int64)
    weight[at] = q.weights[at]
    places, owner = steps(begin[docs], size[docs]), np.repeat(np.arange(len(docs)), size[docs])
    out = np.zeros(len(docs), dtype=np.int64)
    np.add.at(out, owner, weight[term[places]] * _gain(tf[places], m[docs][owner]))
    return out


def _posts(batch: pa.RecordBatch, row: int, docs: np.ndarray, q: _Queries) -> tuple:
    """The asked terms that ``docs`` of a block hold: begin and size by document, then terms and counts."""
    ends, terms, counts = _numbers(batch, "ends", row, np.int64), _numbers(batch, "terms", row, np.uint64), _numbers(batch, "counts", row, np.uint32)
    starts = np.concatenate([[0], ends[:-1]])
    places, owner = steps(starts[docs], (ends - starts)[docs]), np.repeat(docs, (ends - starts)[docs])
    at = np.minimum(np.searchsorted(q.terms, terms[places]), len(q.terms) - 1)
    asked = q.terms[at] == terms[places]
    size = np.bincount(owner[asked], minlength=len(ends))
    return np.cumsum(size) - size, size, at[asked], counts[places[asked]].astype(np.int64)


def _search(blocks: DataFrame, q: _Queries, p: Search) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(p.top) for _ in q.items]
        looked = np.zeros(len(q.items), dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths = _numbers(batch, "ids", row, np.int64), _numbers(batch, "lengths", row, np.int64)
                m = 50 + (50 * lengths * q.n_docs) // q.n_terms
                bits = _numbers(batch, "bits", row, np.uint8).reshape(batch.column("rows")[row].as_py(), -1)
                left = {}
                for k, bound in bounds(bits, q, m):
                    docs = np.flatnonzero(bound >= best[k].least())
                    if len(docs):
                        left[k] = docs[np.argsort(-bound[docs], kind="stable")], bound
                if not left:
                    continue
                posts = _posts(batch, row, np.unique(np.concatenate([docs for docs, _ in left.values()])), q)
                for k, (docs, bound) in left.items():
                    # the most promising ones first: they raise what the others have to reach
                    for part in (docs[: p.top], docs[p.top :]):
                        part = part[bound[part] >= best[k].least()]
                        if len(part):
                            best[k].add(_scores(part, q.at[k], q, m, posts), ids[part])
                            looked[k] += len(part)
        size = [len(b.ids) for b in best]
        columns = [np.repeat(np.array(q.items, dtype=np.int64), size), *(np.concatenate([np.zeros(0, np.int64), *x]) for x in ([b.ids for b in best], [b.scores for b in best])), np.repeat(looked, size)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["item_id", "doc_id", "score", "looked"])

    return blocks.mapInArrow(run, "item_id long, doc_id long, score long, looked long")


def search(docs: DataFrame, items: DataFrame, p: Search = Search()) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item, by score, equal ones by ascending doc_id.

    Terms are runs of letters, digits and non-ASCII characters, with A-Z lower-cased, and are told apart by 64-bit
    hashes. Null texts have none; a document or item without terms, or without id, takes no part; repeated documents
    are ranked one by one; rows of one item_id are one item. Other columns aren't looked at; without documents or items
    there are no rows.

    Items meet the index in groups of about ``load`` terms by hash. A task hands on ``top`` rows an item, which meet
    in two steps.
    """
    tables = Tables(docs.sparkSession)
    blocks = tables.put(index(docs, p), compression="uncompressed")  # hashes don't shrink; a codec would hold pages of many blocks off the heap
    asked = tables.put(queries_of(items))
    seen = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    groups = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // p.load)
    found = []
    for g in range(groups if seen[0] else 0):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect()
        if not rows:
            continue
        own = [np.array(r["terms"], dtype=np.int64).view(np.uint64) for r in rows]
        terms = np.unique(np.concatenate(own))
        held = _document_counts(blocks, terms)
        weights = np.floor(1000 * np.log((2 * seen[0] + 2) / (2 * held + 1))).astype(np.int64)
        q = _Queries([r["item_id"] for r in rows], terms, [np.searchsorted(terms, x) for x in own], weights, seen[0], seen[1])
        found.append(_search(blocks, q, p))
    every = reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long, looked long")
    order = [F.col("score").desc(), "doc_id"]
    every = every.withColumn("k", F.row_number().over(Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(16))).orderBy(*order))).where(F.col("k") <= p.top).drop("k")
    best = every.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= p.top)
    out = tables.put(best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    tables.drop(blocks, asked)
    return out


def search_sql(docs: str = "documents", items: str = "benchmark", top: int = 50) -> str:
    """The same result in DuckDB SQL, by scoring every document."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = lambda t: f"regexp_extract_all(translate({t}, '{upper}', '{lower}'), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms('text')} AS words FROM {docs} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
h AS (SELECT r, doc_id, len(words)::BIGINT AS n FROM d WHERE len(words) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM h),
t AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY 1, 2),
q AS (SELECT DISTINCT item_id, unnest({terms('text')}) AS term FROM {items} WHERE item_id IS NOT NULL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, s WHERE term IN (SELECT term FROM q) GROUP BY 1),
x AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN t USING (term) JOIN h USING (r), s GROUP BY 1, 2),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x JOIN h USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {top}
"""
