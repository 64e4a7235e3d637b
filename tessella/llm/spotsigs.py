"""Document fingerprints by SpotSigs: chains of content words that follow common words.

A common word is an anchor; it and the next ``chain`` content words (words that aren't common) are a signature. Where
``gap`` words or more passed without a common word, as in tables, lists and other languages, a word anchors by its own
hash instead, one in ``every``; both rules look at nearby words only, so an edit changes the signatures around it and no
others. A text with words but without a whole chain has its word sequence as its one signature. The fingerprint is the
set of a text's signatures, and likeness is the Jaccard similarity of two sets. Sets are put into classes by length:
where the classes, or the signatures counted so far, rule out a likeness of ``floor``, the comparison ends.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import NO_TERM, SHINGLE_KEYS, STEP, mix, runs, text_buffers, width, word_places

#: The most common function words of English, German, French and Spanish.
COMMON = tuple(
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this to was were which with you "
    "als am auf aus bei das dass dem den der des die ein eine er es hat ich im ist mit nach nicht sich sie sind und von war wie zu zum zur für über "
    "au aux avec ce dans de du elle en est et il la le les leur mais ne nous ont ou par pas pour que qui sa se son sont sur un une vous "
    "al como con del el ella ellos entre era esta este fue ha las lo los más muy no o para pero por si sin su sus también una y ya".split()
)


@dataclass(frozen=True)
class Spots:
    common: tuple[str, ...] = COMMON
    chain: int = 3
    #: After so many words without a common one, one word in ``every`` anchors by its hash.
    gap: int = 8
    every: int = 4


def _hashes(listed: tuple[str, ...]) -> np.ndarray:
    """Sorted hashes of single words."""
    data = [w.encode() for w in listed]
    ends = np.cumsum([0, *map(len, data)])
    return np.sort(word_places(np.frombuffer(b"".join(data), np.uint8), ends, blank=NO_TERM)[0])


def signature_sets(data: np.ndarray, offsets: np.ndarray, p: Spots = Spots()) -> list[np.ndarray]:
    """The sorted 48-bit signatures of each of several texts that lie one after another in ``data``."""
    hashes, counts, _, _ = word_places(data, offsets, blank=NO_TERM)
    ends, n = np.cumsum(counts), len(counts)
    if not len(hashes):
        return [np.zeros(0, np.uint64)] * n
    text, known = np.repeat(np.arange(n), counts), _hashes(p.common)
    common = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
    at = np.arange(len(hashes))
    last = np.maximum(np.maximum.accumulate(np.where(common, at, -1)), np.repeat(ends - counts, counts) - 1)
    anchor = np.flatnonzero(common | ((at - last >= p.gap) & (mix(hashes) % np.uint64(p.every) == 0)))
    content, after = np.flatnonzero(~common), np.cumsum(~common)[anchor]
    whole = after + p.chain <= len(content)
    anchor, after = anchor[whole], after[whole]
    whole = text[content[after + p.chain - 1]] == text[anchor]
    anchor, after = anchor[whole], after[whole]
    total = hashes[anchor] * SHINGLE_KEYS[0]
    for k in range(p.chain):
        total += hashes[content[after + k]] * SHINGLE_KEYS[k + 1]
    found, cuts, out = mix(total) >> np.uint64(16), np.searchsorted(text[anchor], np.arange(n + 1)), []
    for k in range(n):
        own = found[cuts[k] : cuts[k + 1]]
        if not len(own) and counts[k]:
            own = hashes[ends[k] - counts[k] : ends[k]]
            own = mix((own * np.cumprod(np.full(len(own), STEP))).sum(keepdims=True) + np.uint64(len(own))) >> np.uint64(16)
        out.append(np.unique(own))
    return out


def length_class(size: int, floor: float) -> int:
    """Sets of a likeness of ``floor`` or more are in one class or in neighbouring ones."""
    return int(math.log(max(size, 1)) / -math.log(floor) + 1e-9) if 0 < floor < 1 else 0


def likeness(a: np.ndarray, b: np.ndarray, floor: float = 0.0, ranges: int = 8) -> float:
    """Jaccard similarity of two sorted sets if it reaches ``floor``, else 0; two empty sets are equal.

    The sets meet range by range of signatures. What is common so far and the smaller rest bound what can be common in
    the end; a bound too small for ``floor`` ends the comparison.
    """
    na, nb = len(a), len(b)
    if not na or not nb:
        return float(na == nb)
    if floor > 0 and (abs(length_class(na, floor) - length_class(nb, floor)) > 1 or min(na, nb) < floor * max(na, nb)):
        return 0.0
    edges = np.arange(1, ranges, dtype=np.uint64) * np.uint64((1 << 48) // ranges) if floor > 0 else np.zeros(0, np.uint64)
    ca, cb = ([0, *np.searchsorted(x, edges).tolist(), len(x)] for x in (a, b))
    common = 0
    for k in range(len(ca) - 1):
        common += len(np.intersect1d(a[ca[k] : ca[k + 1]], b[cb[k] : cb[k + 1]], assume_unique=True))
        best = common + min(na - ca[k + 1], nb - cb[k + 1])
        if best < floor * (na + nb - best):
            return 0.0
    return common / (na + nb - common)


def written(found: np.ndarray) -> str:
    """A set as text: 8 characters of base64 for each signature, in ascending order."""
    return base64.b64encode(found.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def read(text: str) -> np.ndarray:
    """The set that ``written`` gave."""
    six = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.hstack([np.zeros((len(six), 2), np.uint8), six]).view(">u8").ravel().astype(np.uint64)


def _sets_of(texts: list[str], p: Spots) -> list[np.ndarray]:
    data, offsets = text_buffers(pa.array(texts, pa.large_string()))
    return [x for at, to in runs(offsets) for x in signature_sets(data, offsets[at : to + 1], p)]


def fingerprints(docs: DataFrame, p: Spots = Spots()) -> DataFrame:
    """(doc_id, fingerprint, n_signatures) of each row of ``docs`` (doc_id, text). A null text is empty; an empty text has
    no signatures. Equal rows give equal rows; other columns aren't looked at; no rows give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            sets = [x for at, to in runs(offsets) for x in signature_sets(data, offsets[at : to + 1], p)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(written, sets), pa.string()), pa.array(map(len, sets), pa.int64())], names=["doc_id", "fingerprint", "n_signatures"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string, n_signatures long")


def compare(pairs: DataFrame, floor: float = 0.0) -> DataFrame:
    """``pairs`` (a, b: fingerprints, and more) with the column ``likeness``: Jaccard where it reaches ``floor``, else 0."""

    @F.pandas_udf("double")
    def found(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(read(x or ""), read(y or ""), floor) for x, y in zip(a, b, strict=True)], dtype=float)

    return pairs.withColumn("likeness", found("a", "b"))


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long"


def _in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """``docs`` (doc_id, text) dealt into ranges of (doc_id, hash of the text), sorted, each followed by the first row of
    the next range, the last by the very first row; ``more`` marks those.

    The ranges come from a pass over ids and hashes; only the first key of each range reaches the driver.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    key = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("i"), "h")
    firsts = rows.select(key.alias("key")).repartitionByRange(ranges, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("key")).select("key.*").collect()
    cuts = sorted((r.i, r.h) for r in firsts)
    if not cuts:
        return rows.select(F.lit(0).alias("range"), F.lit(False).alias("more"), "doc_id", "text", "h")

    @F.pandas_udf("int")
    def code(i: pd.Series, h: pd.Series) -> pd.Series:
        """Twice the row's range, and 1 for its first key."""
        found = (bisect.bisect_right(cuts, k) - 1 for k in zip(i.tolist(), h.tolist(), strict=True))
        return pd.Series([2 * b + (cuts[b] == k) for b, k in zip(found, zip(i.tolist(), h.tolist(), strict=True), strict=True)], dtype="int32")

    n = len(cuts)
    rows = rows.withColumn("code", code(F.coalesce("doc_id", F.lit(-(2**63))), "h")).withColumn("own", F.floor(F.col("code") / 2).cast("int"))
    one, two = F.struct(F.col("own").alias("range"), F.lit(False).alias("more")), F.struct(F.pmod(F.col("own") - 1, F.lit(n)).alias("range"), F.lit(True).alias("more"))
    rows = rows.withColumn("place", F.explode(F.when(F.col("code") % 2 == 1, F.array(one, two)).otherwise(F.array(one))))
    return rows.select("place.range", "place.more", "doc_id", "text", "h")


def edited_fingerprints(docs: DataFrame, p: Spots = Spots(), ranges: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how like they are to it, as is the next document's.

    In the edited text the last half of the code points, rounded down, give way to the first as many (or all) of the
    next document by doc_id; after the last comes the first. A null text is empty; a null doc_id goes first; rows of one
    doc_id are ordered by a hash of the text, so repeated rows follow one another and a single row follows itself.
    Other columns aren't looked at; an empty table gives no rows. Texts are dealt once, in ranges of ids; a task holds one batch of them.
    """
    ranges = ranges or 4 * width(docs.sparkSession)

    def pairs(own: list[tuple], carry: tuple | None) -> tuple[list[tuple], tuple | None]:
        """((own, next) texts) of neighbouring rows of a range; a range's last row stands for no text of its own."""
        out, last = [], carry
        for row in own:
            if last is not None and last[0] == row[0] and not last[1]:
                out.append((last[2], last[3], row[3]))
            last = row
        return out, last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            for at, to in runs(text_buffers(batch.column(3))[1], 1 << 22):
                part = batch.slice(at, to - at)
                found, carry = pairs(list(zip(*(c.to_pylist() for c in part.columns), strict=True)), carry)
                if not found:
                    continue
                ids, texts, nexts = zip(*found, strict=True)
                edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts, strict=True)]
                sets, theirs, following = _sets_of(list(texts), p), _sets_of(edited, p), _sets_of([nexts[-1]], p)
                follow = [*sets[1:], following[0]]
                for k in range(len(texts) - 1):
                    if nexts[k] is not texts[k + 1]:  # a range ended here
                        follow[k] = _sets_of([nexts[k]], p)[0]
                columns = [
                    pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(map(written, sets)), pa.array(map(written, theirs)),
                    pa.array(map(likeness, sets, theirs), pa.float64()), pa.array(map(likeness, sets, follow), pa.float64()), pa.array(map(len, sets), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in EDITED.split(", ")])

    dealt = _in_ranges(docs, ranges).repartition(width(docs.sparkSession), "range").sortWithinPartitions("range", "more", F.col("doc_id").asc_nulls_first(), "h", "text")
    return dealt.select("range", "more", "doc_id", "text").mapInArrow(run, EDITED)
