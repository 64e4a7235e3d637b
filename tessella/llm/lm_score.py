"""Language-model scores by online logistic context mixing, beside an add-one unigram score.

The text is its lower-cased words, each with one blank after it, and an end mark. A symbol is coded as a few binary
decisions, its path in the Huffman tree of what follows the two symbols before it, and several predictors speak on each. Three of them look up how often
either outcome followed their context within the word, hashed into tables that are summed over all words of the
training documents. On the first symbols of a word two of the three look across words instead: by the word before, and by
the ends of the two words before, where training text had that context more than once. The fourth is a match: where the last words were seen in another training document, it follows that
document on until it is wrong; what it knows is a table of the training documents' own passages, which grows with them.
Logits are mixed by weights that the longest context's count and the match's length select; weights, and a map that
refines the mixed probability, learn after every eight decisions, about three letters, in large steps first. They begin
with constants: whatever is learnt ahead of a text, trees, tables and passages, is learnt from all training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import LOWER, Tables, checkpoint, mix, runs, steps, text_buffers, width, word_places
from tessella.llm.mixer import BLANK, CONTEXTS, END, PAIRS, UNMATCHED, Code, Start, decisions, mixed, pairs, quantised, since

#: The hash that stands for the end token among word hashes.
END_WORD = np.uint64(0x5851F42D4C957F2D)
#: Stands for the end mark in a passage; no UTF-8 text holds it.
END_BYTE = 255
_CHUNK = 1 << 15
#: Words whose decisions are laid out together; their arrays stay in a core's cache.
_WORDS = 8000
#: What a crossing table says of a context met once or never.
UNMET = -128
#: Words whose decisions are copied together.
_TAKEN = 1 << 15
#: Predictors over the words before; they speak on the first ``LEAD`` symbols of a word, in place of the two short contexts within it, which say the same there as the longest.
CROSSING, LEAD = 2, 3


@dataclass(frozen=True)
class Mixer:
    """``run``: bytes of text that are scored together; ``lane``: decisions after which a long text's learning starts anew."""

    run: int = 1 << 22
    lane: int = 8192
    rate: float = 0.002
    refine: float = 0.02
    #: Steps of learning after which the first, larger rates have lost half of what they are above ``rate`` and ``refine``.
    settle: float = 50
    #: Slots of a context table: four times the distinct training words, up to 2 to the power of this.
    bits: int = 21
    #: A code tree is made of a context that holds at least this share of all symbols, so there are no more than its inverse.
    share: float = 1 / (1 << 14)
    #: A match may start after so many words, where their hash is a multiple of ``every``, and lasts up to ``passage`` bytes.
    order: int = 4
    every: int = 32
    passage: int = 192
    #: Words whose counts every task holds; the counts of all others are joined.
    frequent: int = 1 << 17
    #: Decisions of frequent words that a worker keeps.
    kept: int = 1 << 22


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each hash among the distinct ones, these in the order in which they are met, and where they first are."""
    code, found = pd.factorize(hashes)
    return code, found, np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1) > 0) if len(code) else np.zeros(0, np.int64)


def _places(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``word_places``, by runs of texts that fit a core's cache."""
    parts = [word_places(data, edges[at : to + 1]) for at, to in runs(edges)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _gathered(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """Byte strings of ``data``, lower-cased."""
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32).tobytes()), pa.py_buffer(LOWER[data[steps(first, size)]].tobytes())])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, letters, n): how often each word, with its hash, is found in ``docs``; the end token (no letters) counts once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "letters", "n"]
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for lo, hi in runs(offsets, 1 << 24):
                hashes, _, first, size = _places(data, offsets[lo : hi + 1])
                code, found, where = _distinct(hashes)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), _gathered(data, first[where], size[where]), pa.array(np.bincount(code, minlength=len(found)))], names=names)
            yield pa.RecordBatch.from_arrays([pa.array([END_WORD.view(np.int64)]), pa.array([b""]), pa.array([batch.num_rows], pa.int64())], names=names)

    found = docs.select("text").mapInArrow(run, "word long, letters binary, n long").where("n > 0")
    return found.groupBy("word", "letters").agg(F.sum("n").alias("n"))


def _units(letters: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of words (lower-case bytes), each with a blank after it, one after another, and where each starts; no letters are the end mark."""
    data, offsets = text_buffers(letters)
    size = np.diff(offsets)
    starts = np.append(0, np.cumsum(size + 1))
    symbols = np.full(int(starts[-1]), BLANK, np.uint16)
    symbols[steps(starts[:-1], size)] = data[int(offsets[0]) : int(offsets[-1])]
    symbols[starts[:-1][size == 0]] = END
    return symbols, starts[:-1]


def fit_code(counts: DataFrame, p: Mixer) -> Code:
    """The trees of the symbols in their contexts; of the counts of all words, only those of frequent contexts reach the driver."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, starts = _units(batch.column(0))
            key = pairs(symbols, since(len(symbols), starts)) * 258 + symbols
            n = np.repeat(batch.column(1).to_numpy(), np.diff(np.append(starts, len(symbols))))
            found, back = np.unique(key, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(found // 258), pa.array(found % 258), pa.array(np.bincount(back, n, len(found)).astype(np.int64))], names=["context", "symbol", "n"])

    found = checkpoint(counts.select("letters", "n").mapInArrow(local, "context long, symbol long, n long").groupBy("context", "symbol").agg(F.sum("n").alias("n")))
    sizes = found.groupBy("context").agg(F.sum("n").alias("all"))
    least = (found.agg(F.sum("n")).first()[0] or 0) * p.share
    seen: dict[int, dict[int, int]] = {}
    for r in found.join(sizes.where(F.col("all") >= least), "context").collect():
        seen.setdefault(r.context, {})[r.symbol] = r.n
    return Code(seen)


_SENT = "chunk int, zeros int, slots binary, n binary"


def _planes(x: np.ndarray, size: int) -> bytes:
    """The lowest ``size`` bytes of whole numbers, all lowest ones first; the higher ones are nearly all 0, which shuffles compress."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T[:size]).tobytes()


def _numbers(planes: bytes, size: int) -> np.ndarray:
    """What ``_planes`` was given."""
    return sum(x.astype(np.int64) << 8 * k for k, x in enumerate(np.frombuffer(planes, np.uint8).reshape(size, -1)))


def _sent(held: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's sums (2 x slots) that aren't 0, chunk by chunk: those of outcome 0, of which there are ``zeros``, then of 1, by the steps from slot to slot."""
    per = min(_CHUNK, held.shape[1])
    for c in range(-(-held.shape[1] // per)):
        part = held[:, c * per : (c + 1) * per]
        some = [np.flatnonzero(x) for x in part]
        if len(some[0]) + len(some[1]):
            slots = np.concatenate([np.diff(x, prepend=0) for x in some])
            n = np.concatenate([x[k] for x, k in zip(part, some, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([len(some[0])], pa.int32()), pa.array([_planes(slots, 2)], pa.binary()), pa.array([_planes(n, 4)], pa.binary())], names=["chunk", "zeros", "slots", "n"])


def _summed(sent: DataFrame, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(logits, classes) of ``many`` slots, of the sums that tasks sent. A chunk is summed as a stream."""
    per = min(_CHUNK, many)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros((2, per))

        def done() -> pa.RecordBatch:
            logit, kind = quantised(*held)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([logit.tobytes()], pa.binary()), pa.array([kind.tobytes()], pa.binary())], names=["chunk", "logit", "kind"])

        for batch in batches:
            for chunk, zeros, slots, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if chunk != now:
                    if now is not None:
                        yield done()
                    now, held = chunk, np.zeros((2, per))
                for side, (k, x) in enumerate(zip(np.split(_numbers(slots, 2), [zeros]), np.split(_numbers(n, 4), [zeros]), strict=True)):
                    held[side, np.cumsum(k)] += x
        if now is not None:
            yield done()

    chunks = -(-many // per)
    rows = sent.repartition(min(width(sent.sparkSession), chunks), "chunk").sortWithinPartitions("chunk").mapInArrow(total, "chunk int, logit binary, kind binary").collect()
    logits, kinds = np.zeros(chunks * per, np.int8), np.zeros(chunks * per, np.uint8)
    for r in rows:
        logits[r.chunk * per : (r.chunk + 1) * per] = np.frombuffer(r.logit, np.int8)
        kinds[r.chunk * per : (r.chunk + 1) * per] = np.frombuffer(r.kind, np.uint8)
    return logits[:many], kinds[:many]


def context_tables(counts: DataFrame, bits: int, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """(logits, classes), CONTEXTS x 2^bits: what each slot of the predictors' tables says, summed over all words.

    A task sums its words over whole tables and sends the slots in use, chunk by chunk; a chunk is summed as a stream.
    """
    spark = counts.sparkSession
    many = CONTEXTS << bits
    shared = spark.sparkContext.broadcast(code)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, many), np.float32)
        flat = held.ravel()
        for batch in batches:
            for at in range(0, batch.num_rows, _WORDS):
                part = batch.slice(at, _WORDS)
                symbols, starts = _units(part.column(0))
                bit, slot, depth = decisions(symbols, starts, bits, shared.value)
                size = np.add.reduceat(depth, starts)
                n = np.repeat(part.column(1).to_numpy().astype(np.float32), size)
                for m in range(CONTEXTS):
                    np.add.at(flat, slot[m].astype(np.intp) + ((bit.astype(np.intp) * CONTEXTS + m) << bits), n)
        yield from _sent(held)

    logits, kinds = _summed(counts.select("letters", "n").mapInArrow(local, _SENT), many)
    return logits.reshape(CONTEXTS, -1), kinds.reshape(CONTEXTS, -1)


def anchors(rows: DataFrame, p: Mixer) -> DataFrame:
    """(anchor, row, at, passage): where a match may start in each row (row, text, learn), as the hash of the words before and the number of the word; of training rows also what follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            row, learn = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in runs(offsets):
                hashes, many, first, _ = word_places(data, offsets[lo : hi + 1])
                n = len(hashes)
                key = np.zeros(n, np.uint64)
                for k in range(1, p.order + 1):
                    key[p.order :] += mix(hashes[p.order - k : n - k] + np.uint64(k))
                key = mix(key)
                within = np.arange(n) - np.repeat(np.cumsum(many) - many, many)
                at = np.flatnonzero((within >= p.order) & (key % np.uint64(p.every) == 0))
                text = np.searchsorted(np.cumsum(many), at, side="right")
                whole = data[offsets[lo] : offsets[hi]].tobytes().lower()
                follows: list[bytes | None] = []
                for a, end, known in zip((first[at] - offsets[lo]).tolist(), (offsets[lo + text + 1] - offsets[lo]).tolist(), learn[lo + text].tolist(), strict=True):
                    stop = min(a + p.passage, end)
                    follows.append(b" ".join(whole[a:stop].split()) + (b" \xff" if stop == end else b"") if known else None)
                yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(row[lo + text]), pa.array(within[at].astype(np.int32)), pa.array(follows, pa.binary())], names=["anchor", "row", "at", "passage"])

    return rows.select("row", "text", "learn").mapInArrow(run, "anchor long, row long, at int, passage binary")


def passages(found: DataFrame) -> DataFrame:
    """(anchor, one, other): for each anchor that is in several rows, what follows it in two training rows, as (row, passage)."""
    fact = F.when(F.col("passage").isNotNull(), F.struct("row", "passage"))
    found = found.groupBy("anchor").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.min(fact).alias("one"), F.max(fact).alias("other"))
    return found.where("a < b and one is not null").select("anchor", "one", "other")


def answers(found: DataFrame, known: DataFrame) -> DataFrame:
    """(row, found): the passages of other training rows that a row's anchors meet, each with the number of the word it continues from."""
    met = found.select("anchor", "row", "at").distinct().join(known, "anchor")
    other = F.when(F.col("one.row") != F.col("row"), F.col("one.passage")).when(F.col("other.row") != F.col("row"), F.col("other.passage"))
    met = met.select("row", "at", other.alias("passage")).where("passage is not null")
    return met.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "passage"))).alias("found"))


class Runs:
    """Runs of numbers, one after another; new ones come at the end, and any are taken by their places among the runs."""

    def __init__(self, kind: type) -> None:
        self.data, self.ends = np.zeros(1 << 16, kind), np.zeros(1, np.int64)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.data[at]

    def add(self, data: np.ndarray, size: np.ndarray) -> None:
        held = int(self.ends[-1])
        if held + len(data) > len(self.data):
            self.data = np.concatenate([self.data[:held], np.zeros(max(len(data), held // 2), self.data.dtype)])
        self.data[held : held + len(data)] = data
        self.ends = np.append(self.ends, held + np.cumsum(size))

    def cut(self, n: int) -> None:
        """Leave the first ``n`` runs."""
        self.ends = self.ends[: n + 1].copy()

    def take(self, which: np.ndarray) -> np.ndarray:
        """The runs of these places, one after another; Arrow copies each as a whole."""
        own = pa.Array.from_buffers(pa.large_binary(), len(self.ends) - 1, [None, pa.py_buffer(self.ends * self.data.itemsize), pa.py_buffer(self.data)])
        return np.frombuffer(own.take(pa.array(which)).buffers()[2], self.data.dtype)


class Words:
    """Of words a worker has met: four bytes for each decision (three logits, the outcome and the trust), the symbols with their numbers of decisions, and the base score.

    The ``known`` words stay from task to task, up to ``most`` decisions; if none are given, all words stay. All others are laid out anew whenever they are asked for: they are too rare to come again soon.
    """

    def __init__(self, tables: tuple[np.ndarray, np.ndarray, Code], known: np.ndarray | None, unigram: np.ndarray, most: int) -> None:
        self.logits, self.kinds, self.code = tables
        self.known, self.unigram = known, unigram
        self.bits, self.most = int(self.logits.shape[1]).bit_length() - 1, most
        # the leading decisions once more, with their slots in the table of the longest context; symbols, with their numbers of decisions
        self.codes, self.leads, self.symbols = Runs(np.uint32), Runs(np.uint64), Runs(np.uint32)
        # where a known word is among the runs, by its place among the known ones, or that of any word, by its hash
        self.number, self.index, self.held = np.full(0 if known is None else len(known), -1, np.int32), {}, 0

    def _lay(self, words: pa.Array) -> None:
        symbols, starts = _units(words)
        bit, slot, depth = decisions(symbols, starts, self.bits, self.code)
        codes = np.empty((len(bit), 4), np.int8)
        for m in range(CONTEXTS):
            codes[:, m] = self.logits[m].take(slot[m])
        codes[:, 3] = bit + 2 * self.kinds[CONTEXTS - 1].take(slot[CONTEXTS - 1])
        codes = codes.view(np.uint32)[:, 0]
        units = np.diff(starts, append=len(symbols))
        many = np.add.reduceat(depth, starts)
        lead = np.add.reduceat(np.where(since(len(symbols), starts) < LEAD, depth, 0), starts)
        leading = steps(np.cumsum(many) - many, lead)
        self.codes.add(codes, many)
        self.leads.add(codes[leading] | slot[CONTEXTS - 1][leading].astype(np.uint64) << np.uint64(32), lead)
        self.symbols.add(symbols | depth.astype(np.uint32) << np.uint32(16), units)

    def places(self, hashes: np.ndarray, first: np.ndarray, size: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word's decisions are in ``codes``, how many, and the log10 of its unigram probability, not a number if it isn't known."""
        code, found, where = _distinct(hashes)
        if int(self.codes.ends[self.held]) > self.most:
            self.index, self.held = {}, 0
            self.number[:] = -1
        for runs_ in (self.codes, self.leads, self.symbols):
            runs_.cut(self.held)
        worth = np.full(len(found), np.nan)
        if self.known is None:
            at = np.fromiter(map(self.index.get, found.tolist(), repeat(-1)), np.int64, len(found))
            stay = new = np.flatnonzero(at < 0)
        elif len(self.known):
            spot = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
            often = self.known[spot] == found
            worth = np.where(often, self.unigram[spot], np.nan)
            at = np.where(often, self.number[spot], -1).astype(np.int64)
            stay = np.flatnonzero(often & (at < 0))
            new = np.concatenate([stay, np.flatnonzero(~often)])
        else:
            at, stay, new = np.empty(len(found), np.int64), np.zeros(0, np.int64), np.arange(len(found))
        at[new] = self.held + np.arange(len(new))
        for k in range(0, len(new), _WORDS):
            own = where[new[k : k + _WORDS]]
            self._lay(_gathered(data, first[own], size[own]))
        if self.known is None:
            self.index.update(zip(found[stay].tolist(), at[stay].tolist(), strict=True))
        elif len(stay):
            self.number[spot[stay]] = at[stay]
        self.held += len(stay)
        self.at = at[code]
        ends = self.codes.ends
        return ends[self.at], np.diff(ends)[self.at], worth[code]

    def crossing(self, keys: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a part of the words last asked for: the number of leading decisions of each, these, and their slots in each crossing table, by the words' ``keys``."""
        at = self.at[part]
        lead, both = np.diff(self.leads.ends)[at], self.leads.take(at)
        seen = (both >> np.uint64(32)).astype(np.uint32)
        slot = np.empty((CROSSING, len(seen)), np.uint32)
        for m, x in enumerate(slot):
            x[:] = np.repeat(keys[m, part], lead)
            x ^= seen
            x *= np.uint32(0x9E3779B1)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x85EBCA77)
            x >>= np.uint32(32 - self.bits)
        return lead, both.astype(np.uint32), slot


def _tokens(data: np.ndarray, edges: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``word_places`` with the end token after the last word of the texts, or parts of texts, that ``last`` marks."""
    hashes, many, first, length = _places(data, edges)
    stop = np.cumsum(many)[last]
    hashes, first, length = (np.insert(x, stop, v) for x, v in ((hashes, END_WORD), (first, 0), (length, 0)))
    return hashes, many + last, first, length


def _heads(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first ``size`` symbols of words, at most ``LEAD``, as numbers; 0 for the end token."""
    out = np.zeros(len(first), np.uint64)
    for k in range(LEAD):
        some = size > k
        out[some] |= (LOWER[data[first[some] + k]].astype(np.uint64) + np.uint64(1)) << np.uint64(9 * k)
    return out


def _before(data: np.ndarray, hashes: np.ndarray, many: np.ndarray, first: np.ndarray, length: np.ndarray, carried: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Each token's keys of what stands before it in its text (CROSSING x n): the word before, and the ends of the two words before; and what the next part of the last text begins with."""
    word, tail = (hashes >> np.uint64(32)).astype(np.uint32), np.zeros(len(hashes), np.uint32)
    for k in (1, 2):
        some = length >= k
        tail[some] |= LOWER[data[first[some] + length[some] - k]].astype(np.uint32) << np.uint32(8 * (k - 1))
    begin = (np.cumsum(many) - many)[many > 0]
    # word, last tail, tail before it, as they stand before the first token
    old = np.zeros(3, np.uint32) if carried is None else carried
    one, two, three = (np.zeros(len(hashes), np.uint32) for _ in range(3))
    one[1:], two[1:], three[2:] = word[:-1], tail[:-1], tail[:-2]
    one[begin], two[begin], three[begin] = 0, 0, 0
    three[(begin + 1)[begin + 1 < len(hashes)]] = 0
    if carried is not None and len(hashes):
        one[0], two[0], three[0] = old
        if len(hashes) > 1:
            three[1] = old[1]
    three <<= np.uint32(16)
    three |= two
    ends = np.array([word[-1], tail[-1], two[-1]], np.uint32) if len(hashes) else old
    return np.stack([one, three * np.uint32(0xC2B2AE3D)]), ends


def _groups(offsets: np.ndarray, data: np.ndarray, run: int) -> Iterator[list[tuple[int, int, int]]]:
    """(text, from, to) of neighbouring texts of about ``run`` bytes; a longer text comes part by part."""
    for lo, hi in runs(offsets, run):
        cuts = [(k, a, b) for k in range(lo, hi) for a, b in _parts(data, int(offsets[k]), int(offsets[k + 1]), run)]
        yield from [cuts] if hi - lo > 1 or len(cuts) == 1 else [[c] for c in cuts]


def crossing_tables(texts: DataFrame, tables: tuple, p: Mixer) -> np.ndarray:
    """Logits, CROSSING x slots: what followed the words before in the training ``texts`` (text), summed as ``context_tables`` are; ``UNMET`` where that was once or never."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(tables)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Words(shared.value, None, np.zeros(0), p.kept)
        held = np.zeros((2, CROSSING << cache.bits), np.float32)
        flat, one = held.ravel(), np.float32(1)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            carried = None
            for group in _groups(offsets, data, min(p.run, 1 << 19)):
                last = np.array([b == offsets[k + 1] for k, _, b in group])
                hashes, many, first, length = _tokens(data, np.array([group[0][1], *(b for _, _, b in group)]), last)
                keys, ends = _before(data, hashes, many, first, length, carried)
                carried = None if last[-1] else ends
                # the leading decisions are those of a word's first symbols, of which there are few
                short = np.minimum(length, LEAD)
                cache.places(_heads(data, first, short), first, short, data)
                for c in range(0, len(hashes), _TAKEN):
                    _, own, slot = cache.crossing(keys, slice(c, c + _TAKEN))
                    bit = (own >> np.uint32(24) & np.uint32(1)).astype(np.intp) * CROSSING
                    for m in range(CROSSING):
                        np.add.at(flat, slot[m] + (bit + m << cache.bits), one)
        yield from _sent(held)

    bits = int(tables[0].shape[1]).bit_length() - 1
    logits, kinds = _summed(texts.select("text").mapInArrow(local, _SENT), CROSSING << bits)
    return np.where(kinds > 0, logits, np.int8(UNMET)).reshape(CROSSING, -1)


#: The class of a match by its length, as far as that changes it.
_KIND = np.digitize(np.arange(65), [16, 32, 64]).astype(np.int8) + np.int8(1)


def _follow(codes: np.ndarray, depths: np.ndarray, symbols: np.ndarray, words: np.ndarray, at: int, begin: int, passage: np.ndarray, code: Code) -> int:
    """Mark in ``codes`` the decisions that a passage predicts, signed by the predicted outcome; gives the symbol after the last one it speaks on.

    The passage begins with symbol ``at``, whose decisions begin at ``begin``; ``words`` are the first symbols of words. It
    predicts until it is wrong, at a text's end at the latest: only its own last symbol can be an end mark. A wrong
    symbol's path is the predicted one's up to the decision where they part.
    """
    n = min(len(passage), len(symbols) - at)
    wrong = passage[:n] != symbols[at : at + n]
    good = int(wrong.argmax()) if wrong.any() else n
    flags = codes.view(np.uint8)[3::4]
    kinds = _KIND.take(np.arange(good + 1), mode="clip")
    said = np.repeat(kinds[:good], depths[at : at + good])
    own = flags[begin : begin + len(said)]
    own += np.where(own & 1, said, -said).astype(np.uint8) << 3
    to = at + good
    if good == n:
        return to
    place = to - int(words[np.searchsorted(words, to, side="right") - 1])
    before = [int(symbols[to - k]) + 1 if place >= k else 0 for k in (1, 2)]
    one = code.path(code.tree_of[before[0] + 258 * before[1]], passage[good])
    own = flags[begin + len(said) : begin + len(said) + int(depths[to])]
    k = min(len(one), len(own))
    part = int((one[:k] != own[:k] & 1).argmax()) + 1
    own[:part] += (kinds[good] * (2 * one[:part].astype(np.int8) - 1)).astype(np.uint8) << 3
    return to + 1


def _parts(data: np.ndarray, a: int, b: int, most: int) -> list[tuple[int, int]]:
    """A text in parts of about ``most`` bytes that end with a word."""
    out = []
    while b - a > most:
        cut = a + most
        while cut < b and data[cut] not in b" \t\n\v\f\r":
            cut += 1
        out.append((a, cut))
        a = cut
    return [*out, (a, b)]


def scored(batches: Iterator[pa.RecordBatch], tables, known: np.ndarray, often: np.ndarray, scale: int, p: Mixer, cache: Words | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, learn, n_tokens, top_known, top_base, score, n_bytes, rare) of batches (doc_id, text, learn, found). ``cache`` keeps words laid out with the same tables by tasks before."""
    crossing, start = tables[3], Start()
    cache = cache or Words(tables[:3], known, np.log10((often + 1) / scale), p.kept)
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        n = batch.num_rows
        n_tokens, n_known, base, total, size = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        rare: list[list[np.ndarray]] = [[] for _ in range(n)]
        met = np.append(0, np.cumsum(batch.column(3).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).tolist()
        met_at, met_passage = batch.column(3).flatten().flatten()
        spots, (passages_, cuts) = met_at.to_numpy(zero_copy_only=False).tolist(), text_buffers(met_passage)
        carried, skipped = None, 0
        for group in _groups(offsets, data, p.run):
            last = np.array([b == offsets[k + 1] for k, _, b in group])
            hashes, many, first, length = _tokens(data, np.array([group[0][1], *(b for _, _, b in group)]), last)
            keys, after = _before(data, hashes, many, first, length, carried)
            carried = None if last[-1] else after
            ends = np.cumsum(many)
            _, depth, worth = cache.places(hashes, first, length, data)
            sums = np.append(0, np.cumsum(depth))
            codes = np.empty(int(sums[-1]), np.uint32)
            for c in range(0, len(depth), _TAKEN):
                part = slice(c, c + _TAKEN)
                here = sums[:-1][part] - sums[c]
                own = codes[sums[c] : sums[c] + here[-1] + depth[part][-1]]
                np.add(cache.codes.take(cache.at[part]), UNMATCHED, out=own)
                lead, head, slot = cache.crossing(keys, part)
                head += UNMATCHED
                raw = head.view(np.int8).reshape(-1, 4)
                for m in range(CROSSING):
                    # a context met once or never leaves the word's own
                    said = crossing[m].take(slot[m])
                    np.copyto(raw[:, m], said, where=said != UNMET)
                own[steps(here, lead)] = head
            symbols = cache.symbols.take(cache.at)
            symbols, depths = symbols & np.uint32(0xFFFF), symbols >> np.uint32(16)
            units = np.where(hashes == END_WORD, 1, length + 1)
            words = np.cumsum(units) - units
            of = np.append(0, ends)
            begin, width_, lanes_of = [], [], []
            hit = ~np.isnan(worth)
            worth[~hit] = 0
            for g, (k, _, _) in enumerate(group):
                a, b = of[g], of[g + 1]
                n_tokens[k] += b - a
                n_known[k] += int(hit[a:b].sum())
                base[k] += float(worth[a:b].sum())
                size[k] += int(units[a:b].sum())
                rare[k].append(hashes[a:b][~hit[a:b]].view(np.int64))
                free = 0
                for x in range(met[k], met[k + 1]):
                    token = a + spots[x] - skipped
                    if a <= token < b and words[token] >= free:
                        passage = passages_[cuts[x] : cuts[x + 1]].astype(np.uint32)
                        passage[passage == END_BYTE] = END
                        free = _follow(codes, depths, symbols, words, int(words[token]), int(sums[token]), passage, cache.code)
                for x in range(int(sums[a]), int(sums[b]), p.lane):
                    begin.append(x), width_.append(min(p.lane, int(sums[b]) - x)), lanes_of.append(k)
            skipped = 0 if last[-1] else skipped + int(ends[-1])
            value, _ = mixed(codes, np.array(begin, np.int64), np.array(width_, np.int64), start, p.rate, p.refine, p.settle)
            np.add.at(total, np.array(lanes_of, np.int64), value)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([sum(map(len, x)) for x in rare])).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *(y for x in rare for y in x)])))
        columns = [batch.column(0), batch.column(2), pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(total / np.log(10)), pa.array(size), lists]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "learn", "n_tokens", "top_known", "top_base", "score", "n_bytes", "rare"])


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words of the largest counts, at most ``most``, by a histogram of the counts' sizes."""
    kind = F.floor(F.log2("n") * 16)
    sizes = sorted(((r.k, r.c) for r in counts.groupBy(kind.alias("k")).agg(F.count("*").alias("c")).collect()), reverse=True)
    held, least = 0, None
    for k, c in sizes:
        if held + c > most:
            break
        held, least = held + c, k
    return counts.where(kind >= (least if least is not None else 1 << 30)).select("word", "n")


def score(docs: DataFrame, training, p: Mixer = Mixer()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    ``training`` is the condition for the rows to learn from; a training row is never its own match, but its words are
    in the counts. ``score`` is the log10 probability of the words in order and the end, ``n_bytes`` the length of what
    it covers (each word and a blank, and the end), ``bits_per_byte`` -score * log2(10) / n_bytes. A null or empty text
    is its end token alone. Without training rows all counts are 0. Rows of equal doc_id and text are one document, and
    get equal rows each; no rows give none; other columns are not looked at. A text is scored in parts of ``p.run``
    bytes, so a long one needs no more memory than what holds it.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(training, F.lit(False)).alias("learn"), F.xxhash64("doc_id", "text").alias("row"))
    counts = tables.put(word_counts(rows.where("learn")))
    seen = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, scale = int(seen.n), int(seen.n) + int(seen.v) + 1
    bits = min(p.bits, max(10, (4 * int(seen.v)).bit_length()))
    code = fit_code(counts, p)
    found = (*context_tables(counts, bits, code), code)
    found += (crossing_tables(rows.where("learn"), found, p),)
    top = _frequent(counts, p.frequent).toPandas()
    top = top.sort_values("word", key=lambda c: c.to_numpy().view(np.uint64))
    places = tables.put(anchors(rows, p))
    known = tables.put(passages(places))
    met = tables.put(answers(places, known))
    tables.drop(places, known)
    # the text is joined once; its key is the row's, of which repeated rows have the same
    both = rows.join(met, "row", "left").select("doc_id", "text", "learn", "found")
    often, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    # a worker holds one copy of what is broadcast, so the words that a task lays out are there for its next one
    shared = spark.sparkContext.broadcast((found, often, n, scale, p, Words(found[:3], often, np.log10((n + 1) / scale), p.kept)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scored(batches, *shared.value)

    out = both.mapInArrow(run, "doc_id long, learn boolean, n_tokens long, top_known long, top_base double, score double, n_bytes long, rare array<long>")
    out = tables.put(out.withColumn("row", F.monotonically_increasing_id()))
    tables.drop(met)
    rest = out.select("row", F.explode("rare").alias("word")).join(counts.select("word", "n"), "word", "left")
    one = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(scale)))
    rest = rest.groupBy("row").agg(F.sum(one).alias("rest_base"), F.count("n").alias("rest_known"))
    joined = checkpoint(out.drop("rare").join(rest, "row", "left"))
    tables.clear()
    return joined.select(
        "doc_id", "n_tokens", (F.col("top_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("top_base") + F.coalesce("rest_base", F.lit(0.0))).alias("base_score"), "score", "n_bytes", (-F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
