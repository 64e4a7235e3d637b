"""Language identification as inference of a mixture: expectation-maximisation over byte n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import text_buffers


@dataclass(frozen=True)
class LangId:
    """``order``-byte n-grams hashed to 2^``bits`` buckets. A language joins a document's set if it gains
    ``penalty`` * log(n-grams) in log-likelihood, which counts a 1/``order`` for each n-gram as they overlap."""

    order: int = 4
    bits: int = 14
    smooth: float = 0.5
    rounds: int = 15
    penalty: float = 2.0


#: ASCII letters in lower case and bytes of other characters stand for themselves, all else for a blank.
_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _grams(text: np.ndarray, p: LangId) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams that aren't blank, and how often each is found; the text counts as between blanks."""
    x = np.full(len(text) + 2 * (p.order - 1), 32, dtype=np.uint32)
    x[p.order - 1 : p.order - 1 + len(text)] = _FOLD[text]
    n = len(x) - p.order + 1
    code = x[:n].copy()
    for k in range(1, p.order):
        code <<= np.uint32(8)
        code |= x[k : n + k]
    blank = np.uint32(int.from_bytes(b" " * p.order, "big") & 0xFFFFFFFF)
    code = code[code != blank]
    count = np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - p.bits), minlength=1 << p.bits)
    found = np.flatnonzero(count)
    return found, count[found].astype(np.float64)


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def ngram_counts(docs: DataFrame, p: LangId = LangId()) -> DataFrame:
    """(lang, bucket, n) over all rows of ``docs`` (text, lang) that have both; a task sums before it hands on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            data, ends = text_buffers(batch.column(0))
            for k, lang in enumerate(batch.column(1).to_pylist()):
                found, n = _grams(data[ends[k] : ends[k + 1]], p)
                own = sums.get(lang)
                if own is None:
                    own = sums[lang] = np.zeros(1 << p.bits)
                own[found] += n
        for lang, own in sums.items():
            found = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found, pa.int32()), pa.array(own[found].astype(np.int64))], names=["lang", "bucket", "n"])

    rows = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, bucket int, n long")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, p: LangId = LangId()) -> tuple[list[str], np.ndarray]:
    """The languages in order and their n-gram probabilities: languages * 2^bits numbers, whatever the corpus."""
    rows = ngram_counts(docs, p).toPandas()
    langs = sorted(rows["lang"].unique().tolist())
    count = np.zeros((len(langs), 1 << p.bits))
    count[rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64), rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy()
    return langs, (count + p.smooth) / (count.sum(axis=1, keepdims=True) + p.smooth * (1 << p.bits))


def mixture(prob: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Shares of the languages (rows of ``prob``) that expectation-maximisation finds, and the log-likelihood."""
    share = np.full(len(prob), 1 / len(prob))
    total = n.sum()
    for _ in range(rounds):
        both = share @ prob
        share = share * (prob @ (n / both)) / total
        share /= share.sum()
    return share, float(n @ np.log(share @ prob))


def language_set(prob: np.ndarray, n: np.ndarray, p: LangId) -> tuple[list[int], np.ndarray]:
    """The languages of least penalised likelihood among the nested sets by share, and their shares.

    No set is likelier than the mixture of all, so one language is taken at once if that gains less than the penalty.
    """
    share, most = mixture(prob, n, p.rounds)
    order = np.argsort(-share, kind="stable").tolist()
    cost = p.penalty * np.log(max(2.0, n.sum()))
    own, at, like = order[:1], np.ones(1), float(n @ np.log(prob[order[0]]))
    while len(own) < len(order) and (most - like) / p.order > cost:
        more = order[: len(own) + 1]
        found, likely = mixture(prob[more], n, p.rounds)
        if (likely - like) / p.order <= cost:
            break
        own, at, like = more, found, likely
    return own, at


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], p: LangId = LangId()) -> DataFrame:
    """``docs`` (doc_id, text, ...) to doc_id, lang_pred, score, n_langs: the main language and its share in the mixture.

    A text that is null or has no letter is ``und`` with score 0 and no languages, and so is every text for a model
    without languages. Repeated rows give repeated rows; no rows give none; only doc_id and text are looked at.
    """
    langs, shared = model[0], docs.sparkSession.sparkContext.broadcast(model[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prob = shared.value
        ascii_letter = np.zeros(256, dtype=bool)
        ascii_letter[65:91] = ascii_letter[97:123] = True
        for batch in batches:
            data, ends = text_buffers(batch.column(1))
            pred, score, many = [], [], []
            for k in range(batch.num_rows):
                text = data[ends[k] : ends[k + 1]]
                if not langs or not (ascii_letter[text].any() or has_letter(text.tobytes())):
                    pred.append("und"), score.append(0.0), many.append(0)
                    continue
                found, n = _grams(text, p)
                own, share = language_set(prob[:, found], n, p)
                best = int(np.argmax(share))
                pred.append(langs[own[best]]), score.append(float(min(1.0, share[best]))), many.append(len(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(many, pa.int32())], names=["doc_id", "lang_pred", "score", "n_langs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_langs int")


def held_out(doc_id: str, parts: int, part: int = 2):
    """Whether crc32 of the id as text leaves ``part``; a row without id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))
