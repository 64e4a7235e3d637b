"""Small cases of the training-data operators: nulls, empty and long texts, ties, repeated rows, empty tables, more columns."""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import ann, byte_bpe, chat, common, langid, licences, lm_score, mixer, neardup, pack_documents, pack_matrix, quality
from tessella.llm.graph import connected_components
from tessella.llm.packing import CapacityTree, best_fit_decreasing, plan_packing
from tessella.llm.wordbpe import encoder

WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(WORDS)
NEAR = " ".join(WORDS[:390] + ["x"] * 1 + WORDS[391:])
ROWS = [(1, LONG, "en", "a"), (2, NEAR, "en", "a"), (3, LONG + "\n", "en", None), (4, None, None, "b"), (5, "", "de", "b"), (6, " \t\n", "de", "b"), (7, "one two", "de", "b"), (8, "One TWO", "de", "b"), (8, "One TWO", "de", "b"), (None, LONG, "en", "a"), (9, "12 34 !!", "fr", "c")]
SCHEMA = "doc_id long, text string, lang string, source string, n_shingles int, length string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, "x") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def test_near_duplicates(docs, none):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    want = {1: (396, 1, True), 2: (396, 1, False), 3: (396, 1, False), 4: (0, 4, True), 5: (0, 5, True), 6: (0, 6, True), 7: (1, 7, True), 8: (1, 7, False), 9: (1, 9, True), -1: (396, None, False)}
    assert {r[0]: r[1:] for r in got} == want and len(got) == len(ROWS)
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_in_a_cluster(spark):
    """Edited copies of one text, linked with some of the others only, against all pairs."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(120):
        words = list(WORDS[:150])
        for at in rng.choice(150, int(rng.integers(0, 9)), replace=False):
            words[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(words)))
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(146)} for k, t in rows}
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neardup.NearDup(block=16, load=1000, chunks=8)).collect()}
    assert got == {k: find(k) for k in sets}


def test_quality(docs, none):
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert quality.quality(docs).count() == len(ROWS) and quality.quality(none).count() == 0
    assert got[1].n_words == 400 and got[1].kept and not got[4].kept and got[4].n_words == 0


def test_frequent_lines(spark):
    bad = "home news sports weather travel contact about imprint"
    rows = [(k, "\n".join([bad] + [f"l{k}a{j} b{k}c{j} d{k}e{j} f{k}g{j} h{k}i{j} j{k}k{j}" for j in range(14)]), "h") for k in range(40)] + [(99, "\n".join([bad] * 1 + [bad.upper()] * 9), "h")]
    got = {r.doc_id: (r.n_words, r.words_left, r.kept) for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == (92, 84, True) and got[99][2] is False


def test_frequent_lines_that_stand_together(spark):
    """Header and footer in all of a host's unlike documents: both go, whichever has the lower hash; exact copies count once."""
    head, foot = "home news sports weather travel contact105", "about imprint privacy terms careers press help"
    rows = [(k, "\n".join([head] + [" ".join(f"l{k}a{j}b{i}" for i in range(6)) for j in range(12)] + [foot]), "h") for k in range(30)]
    rows += [(100 + k, "\n".join(" ".join(f"m{j}c{i}" for i in range(6)) for j in range(12)), "h") for k in range(25)]
    got = {r.doc_id: (r.n_words, r.words_left) for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[k] == (85, 72) for k in range(30)) and all(got[100 + k] == (72, 72) for k in range(25))


def test_language(spark):
    rng = np.random.default_rng(1)
    vocab = {"xx": ["aba", "bab", "cab", "dab"], "yy": ["oki", "koi", "lok", "mok"]}
    rows = [(k, " ".join(rng.choice(vocab["xx" if k % 2 else "yy"], 40)), "xx" if k % 2 else "yy") for k in range(60)]
    train = spark.createDataFrame(rows[:40], "doc_id long, text string, lang string")
    test = spark.createDataFrame(rows[40:] + [(100, None, None), (101, "123 !", None), (102, "é", None), (103, rows[0][1] + " " + rows[1][1], None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(test, langid.fit(train)).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows[40:])
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[102].lang_pred != "und" and got[103].n_langs == 2
    assert {r.lang_pred for r in langid.identify(test, langid.fit(train.limit(0))).collect()} == {"und"}


def test_capacity_tree_and_best_fit():
    tree = CapacityTree(10)
    tree.add(3), tree.add(7)
    assert [tree.first(w) for w in (1, 3, 4, 7, 8, 10)] == [3, 3, 7, 7, -1, -1]
    lengths = np.array([6, 5, 4, 4, 1])
    bins = best_fit_decreasing(lengths, 10)
    assert sorted(i for b in bins for i in b) == [0, 1, 2, 3, 4] and all(lengths[b].sum() <= 10 for b in bins) and len(bins) == 2


def least_sequences(lengths, capacity):
    """The lower bound L2 of Martello and Toth: pieces over half a sequence can't share, the rest fills what they leave."""
    best = 0
    for k in range(capacity // 2 + 1):
        alone, half = lengths > capacity - k, (lengths > capacity // 2) & (lengths <= capacity - k)
        small = lengths[(lengths >= k) & (lengths <= capacity // 2)].sum()
        over = small - (half.sum() * capacity - lengths[half].sum())
        best = max(best, int(alone.sum() + half.sum() + max(0, -(-int(over) // capacity))))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 41, 300)
    count = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    plan, filled, dealt = plan_packing(count, 40), {}, {}
    for length, lo, hi, first, per, offset in plan.segments:
        for r in range(lo, hi):
            assert r == dealt.get(length, 0)
            dealt[length] = r + 1
            filled.setdefault(first + (r - lo) // per, []).append((offset + (r - lo) % per * length, length))
    assert dealt == count and len(filled) == plan.sequences
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 40
    assert plan.sequences <= min(len(best_fit_decreasing(lengths, 40)), least_sequences(lengths, 40) + 1)


def test_packing(docs, none):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = pack_documents.pack(docs, capacity=64).collect()
    want = sorted((r[0] or -1, len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in ROWS)
    sums = sorted((r.doc_id or -1, r.length) for r in got)
    assert sum(n for _, n in sums) == sum(n for _, n in want) and all(r.length <= 64 for r in got)
    assert pack_documents.pack(none).count() == 0


def odd_texts(n):
    """Words of letters, marks, combining marks, letters that lower-case to two code points, white space, special tokens."""
    rng = np.random.default_rng(11)
    parts = ["a", "KAD\u0130", "\u0130", "stra\u00dfe", "e\u0301", "\u0301", "\u0391\u03a3", "it's", "12", "\u4e2d\u6587", "\u01c5", "\u1e9e", ",", ".", "!?", "'", "'ll", "_", "\u00bd", "\ufb01n", "\U0001f600", "<|endoftext|>", "<|startoftext|>", "<|", " ", " ", " ", "\n", "\t", "\u00a0", "\x1c", "\u2003", "therhean", "Esndha"]
    return ["".join(rng.choice(parts, int(rng.integers(1, 24)))) for _ in range(n)]


@pytest.mark.parametrize("special", [True, False])
def test_ids_of_words_are_the_librarys(special):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = not special
    texts = ["a <|endoftext|> b", "KAD\u0130,", *odd_texts(10_000)]
    got = encoder(public_tokenizers.path("word_bpe_49k.json"), "<u4", special).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_packing_against_the_library(spark):
    """Each piece's start, length and checksum by the library's ids, and offsets without gaps or overlaps."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(12)
    rows = [(k, " ".join(rng.choice(WORDS, int(n)))) for k, n in enumerate(rng.integers(0, 60, 200))] + list(enumerate(odd_texts(100), 200)) + [(300, LONG * 20), (301, None), (302, ""), (7, "again"), (7, "again")]
    got = pack_documents.pack(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, length string"), capacity=64).collect()
    want = []
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(doc, k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    held = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 64 and len(held) <= least_sequences(np.array([r.length for r in got]), 64) + 1


def test_matrix_of_repeated_rows_and_long_texts(spark):
    """Windows of few tokens, repeated rows and a text over many rows: every id once, in order; fill of the rows."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    rng = np.random.default_rng(13)
    rows = [(k, " ".join(rng.choice(WORDS, int(n)))) for k, n in enumerate(rng.integers(0, 40, 400))] + [(7, "again"), (7, "again"), (500, LONG * 9), (501, "a <|endoftext|> b"), (502, None)]
    got = pack_matrix.packed_rows(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), capacity=256, window=8192).collect()
    found, used = [], 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u2")
        used += r.n_tokens
        assert not ids[r.n_tokens :].any() and len(r.doc_ids) == r.n_segments
        found += [(doc, piece, start, ids[a:b].tolist()) for doc, piece, start, a, b in zip(r.doc_ids, r.pieces, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True)]
    want = []
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 49407]
        want += [(doc, k, s, ids[s : s + 256]) for k, s in enumerate(range(0, len(ids), 256))]
    assert sorted(found) == sorted(want)
    assert used >= 0.95 * 256 * len(got)


def test_written_matrices(spark, docs, tmp_path):
    pack_matrix.write_packed(docs, str(tmp_path / "packed"), capacity=64)
    again = spark.read.parquet(str(tmp_path / "packed")).collect()
    key = lambda r: (r.n_tokens, r.doc_ids == [None], str(r.doc_ids), bytes(r.ids), bytes(r.positions))
    assert sorted(map(key, again)) == sorted(map(key, pack_matrix.packed_rows(docs, capacity=64).collect()))


def test_matrix(docs, none):
    rows = pack_matrix.packed_rows(docs, capacity=64, window=128).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = {}
    for r in rows:
        ids, at = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == 64 and r.cu_seqlens[-1] == r.n_tokens
        for doc, piece, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert at[a:b].tolist() == list(range(b - a))
            found.setdefault(doc, {})[piece] = ids[a:b].tolist()
    assert sum((found[1][k] for k in sorted(found[1])), []) == [*library.encode(LONG, add_special_tokens=False).ids, 49407]
    assert pack_matrix.packed_rows(none).count() == 0


def test_nearest_over_many_partitions(spark):
    """Every block of rows meets every block of queries wherever the shuffle puts them."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "97")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), lambda i: i % 50 == 0, 5, ann.Ann(rows=150, queries=4)).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit @ unit.T
    np.fill_diagonal(score, -2)
    best = {(q, int(i)) for q in range(0, 600, 50) for i in np.argsort(-score[q])[:5]}
    assert len(got) == 60
    assert len(best & {(r.query_id, r.vec_id) for r in got}) >= 54


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16))
    x[100:140] = x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0, 5, ann.Ann(rows=200, queries=8)).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in range(0, 600, 50):
        score = unit @ unit[q]
        score[q] = -9
        best = np.lexsort((np.arange(600), -np.round(score, 12)))[:5].tolist()
        own = [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
        assert len(own) == 5
        hit += len(set(own) & set(best))
        if q == 100:
            assert own == best
    assert hit >= 0.9 * 60
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), lambda i: i % 50 == 0).count() == 0


def test_nearest_of_odd_rows(spark):
    """Repeated rows, one id with two vectors, more than k + 1 equal vectors, two lengths, a column of a clashing name."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 4))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(50, 62)] * 3 + [(7, x[0].tolist()), (100, [1.0, 1.0]), (150, [1.0, 0.0]), (101, [-1.0, 1.0])]
    got = {}
    for r in ann.nearest(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string"), lambda i: i % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in (0, 50, 100, 150):
        best = {}
        for _, a in [r for r in rows if r[0] == q]:
            for i, b in rows:
                if i != q and len(a) == len(b):
                    best[i] = max(best.get(i, -2), round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 12))
        want = sorted(best.items(), key=lambda kv: (-kv[1], kv[0]))[:5]
        assert [i for _, i, _ in sorted(got[q])] == [i for i, _ in want]
        assert [round(s, 9) for _, _, s in sorted(got[q])] == [round(s, 9) for _, s in want]


def test_nearest_recall_on_the_table(spark):
    """Every query of the embeddings table against brute force."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = {}
    for r in ann.nearest(table, lambda i: i % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    rows = [(r.vec_id, r.embedding) for r in ann.usable(table).select("vec_id", F.col("v").alias("embedding")).collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for q in ids[ids % 50 == 0]:
        score = x @ x[ids == q][0]
        score[ids == q] = -9
        top = np.lexsort((ids, -np.round(score, 12)))[:5]
        hit += sum(ids[i] in got[q] for i in top)
        total += 5
        assert all(abs(got[q][ids[i]] - score[i]) < 1e-9 for i in top if ids[i] in got[q])
    assert total and hit >= 0.9 * total


def test_byte_bpe(docs, none):
    got = {r.doc_id: r for r in byte_bpe.decode(byte_bpe.encode(docs, size=50)).collect()}
    whole = {r.doc_id: r for r in byte_bpe.encode(docs).collect()}
    assert all(hashlib.sha256(got[k].ids).digest() == hashlib.sha256(whole[k].ids).digest() for k in got)
    assert got[1].decoded == LONG.encode() and got[4].ids == b"" and byte_bpe.encode(none).count() == 0
    codec, text = byte_bpe.codec(byte_bpe.RANKS), "it's  a   b\n\n c's 12ab é " * 40
    assert codec.encode(text, 7) == codec.encode(text, 1 << 20) and codec.decode(codec.encode(text, 9)) == text.encode()


def test_licences(spark, none):
    rows = [(k, f"some words about number {k} and more\nmany other words here {k * 7}") for k in range(60)]
    rows += [(100, "text\nLicensed under the Apache License, Version 2.0."), (101, "Released under the MIT License."), (102, None), (103, "")]
    got = {(r.doc_id, r.paragraph): r.family for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(100, 1): "Apache-2.0", (101, 0): "MIT"}
    assert licences.scan(none).count() == 0


def test_byte_bpe_against_the_library(spark):
    """Ids of 1500 random texts and a long one, cut at every safe place or not, are tiktoken's, and decode to the text."""
    import base64

    import tiktoken

    with open(byte_bpe.RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(11)
    parts = ["a", "The", " house", "'s", "12", "3456", "  ", "\n", "\n\n ", "\t", "é", "ß", "Ж", "漢字", "🙂", "e\u0301", "...", "#!", "_x", "<|endoftext|>", "\u00a0", "\r\n"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 60))) for _ in range(1500)] + ["ab cd\n" * 50_000, "x" * 3000, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (1, 17, 1 << 16):
        for r in byte_bpe.decode(byte_bpe.encode(rows, size=size)).collect():
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert ids == library.encode_ordinary(texts[r.doc_id]) and r.decoded.decode() == library.decode(ids) == texts[r.doc_id]


def test_mixture_against_plain_em():
    """Shares and likelihood are those of expectation-maximisation written over single n-grams; sets are nested by penalty."""
    rng = np.random.default_rng(3)
    p = langid.LangId()
    for many in (2, 4):
        prob = rng.dirichlet(np.full(50, 0.3), many) * 0.99 + 0.01 / 50
        n = rng.multinomial(400, 0.6 * prob[0] + 0.4 * prob[1]).astype(float)
        share = [1 / many] * many
        for _ in range(p.rounds):
            new = [0.0] * many
            for g in range(50):
                total = sum(share[k] * prob[k][g] for k in range(many))
                for k in range(many):
                    new[k] += n[g] * share[k] * prob[k][g] / total
            share = [x / sum(new) for x in new]
        like = sum(n[g] * math.log(sum(share[k] * prob[k][g] for k in range(many))) for g in range(50))
        got, likely = langid.mixture(prob, n, p.rounds)
        assert got == pytest.approx(share, abs=1e-12) and likely == pytest.approx(like)
        own, at = langid.language_set(prob, n, p)
        assert set(own) == {0, 1} and at.sum() == pytest.approx(1)
        pure = rng.multinomial(400, prob[1]).astype(float)
        assert langid.language_set(prob, pure, p)[0] == [1]


def test_language_accuracy_on_documents(spark):
    """Held-out documents; repeated rows, more columns and a long text give rows as they are."""
    docs = spark.read.parquet(os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.01") + "/documents.parquet").withColumn("held", langid.held_out("doc_id", 4))
    model = langid.fit(docs.where("not held"))
    found = langid.identify(docs.where("held"), model).join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'")
    right, all_rows = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert all_rows > 100 and right / all_rows >= 0.98
    text = docs.where("lang is not null and length(text) > 500").select("text").first().text
    rows = spark.createDataFrame([(1, text, 5.0), (1, text, 5.0), (2, text * 2000, 5.0), (None, text, 5.0)], "doc_id long, text string, score double")
    got = langid.identify(rows, model).collect()
    assert len(got) == 4 and len({r.lang_pred for r in got}) == 1 and all(0 < r.score <= 1 for r in got)


@pytest.fixture(scope="module")
def licence_model(spark):
    rows = [(k, f"some words about number {k} and more\nmany other words here {k * 7}") for k in range(60)]
    return licences.fit(spark.createDataFrame(rows, "doc_id long, text string"))


NOTICES = [
    ("Released under the MIT\nLicense.", {0: "MIT"}),
    ("x y z\n// SPDX-License-Identifier: MIT\nint main", {1: "MIT"}),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files", {0: "MIT"}),
    ("Permission to use, copy, modify, and distribute this software for any\n purpose with or without fee is hereby granted", {0: "ISC"}),
    ("The code is licensed under the GNU Affero General Public License, version 3", {0: "AGPL"}),
    ("one\n\nLicensed under the Zorblax License\n\ntwo", {2: "unknown"}),
    ("Licensed under CC BY-NC-SA 4.0.\nLicensed under CC BY 4.0.", {0: "CC-BY-NC-SA", 1: "CC-BY"}),
    ("Copyright 2011 Foo. All rights reserved.", {0: "proprietary"}),
    ("# License\nBSD-3-Clause", {0: "BSD"}),
    ("The driver lost his license last year.\nThey saw the apache helicopter.", {}),
]


def test_licence_notices(spark, licence_model):
    """Wrapped lines, tags, passages, other licences and prose; columns of clashing names are not looked at."""
    docs = spark.createDataFrame([(k, t, "x", 1.0) for k, (t, _) in enumerate(NOTICES)], "doc_id long, text string, family string, gram double")
    got = {(r.doc_id, r.paragraph): r.family for r in licences.scan(docs, model=licence_model).collect()}
    assert got == {(k, line): family for k, (_, found) in enumerate(NOTICES) for line, family in found.items()}


def test_licence_classifier(licence_model):
    """Held-out phrasings are found, in every family of which some are held out; weights are sparse."""
    families = {c: r for c, r in licence_model.recall.items() if c not in ("none", "unknown")}
    assert len(families) >= 25 and min(families.values()) >= 0.5 and sum(families.values()) / len(families) >= 0.9
    assert licence_model.recall["none"] >= 0.9 and licence_model.recall["unknown"] >= 0.9
    values = np.array(list(licence_model.weights.values()))
    assert (np.abs(values) < 1e-9).mean() > 0.5


def test_licence_scan_against_loop(spark, licence_model, tmp_path):
    """The bound leaves out no paragraph that a plain loop over all of them finds; a saved model finds the same."""
    m = licence_model
    path = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(list(enumerate((t for t, _ in NOTICES), 10**9)), "doc_id long, text string"))
    want, none = {}, m.classes.index("none")
    grams = lambda w: set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}
    split = lambda t: [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", t.lower()) if w]
    for r in licences.paragraphs(docs).collect():
        words = split(r.line)
        z = np.array(m.base) + sum((np.array(m.weights[g]) for g in grams(words) if g in m.weights), np.zeros(len(m.base)))
        k = int(z.argmax())
        if k != none:
            prob = 1 / np.exp(z - z[k]).sum()
            held = max((len(grams(t.split()) & grams(words)) / len(grams(t.split())) for t in licences.TEMPLATES.get(m.classes[k], [])), default=0)
            want[r.doc_id, r.paragraph] = m.classes[k] if prob >= m.least[k] and held >= 0.8 else "unknown"
    assert len(want) > 10 and {(r.doc_id, r.paragraph): r.family for r in licences.scan(docs, model=m).collect()} == want
    m.save(spark, str(tmp_path / "model"))
    again = licences.Model.load(spark, str(tmp_path / "model"))
    assert {(r.doc_id, r.paragraph): r.family for r in licences.scan(docs, model=again).collect()} == want


def test_licences_of_repeated_rows(spark):
    """Equal rows change no probability; null ids, more columns and a long text are carried along."""
    line = "Released under the MIT License."
    rows = [(k, f"some words about number {k} and more\nmany other words here {k * 7}") for k in range(40)] + [(100, line), (101, line), (None, line), (102, "many words here\n" * 20_000 + line)]
    once = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, probability double")
    p = licences.Scan(documents=1 << 20)
    key = lambda r: (r.doc_id or -1, r.paragraph, r.family, round(r.probability, 9))
    one, twice = (sorted(map(key, licences.scan(d, p).collect())) for d in (once, once.union(once.where("doc_id in (100, 101)"))))
    assert [r[:3] for r in one] == [(-1, 0, "MIT"), (100, 0, "MIT"), (101, 0, "MIT"), (102, 20_000, "MIT")]
    assert [r[:3] for r in twice] == [r[:3] for r in one] and all(abs(a[3] - b[3]) < 0.01 for a, b in zip(one, twice, strict=True))


def test_lm_score(docs, none):
    got = {r.doc_id: r for r in lm_score.score(docs, langid.held_out("doc_id", 7) == False).collect()}  # noqa: E712
    assert got[4].n_tokens == got[5].n_tokens == got[6].n_tokens == 1 and got[1].n_tokens == 401
    assert all(r.score < 0 and r.base_score < 0 and r.bits_per_byte > 0 for r in got.values()) and lm_score.score(none, langid.held_out("doc_id", 7)).count() == 0


def test_lm_base_score_by_brute_force(spark):
    """Counts of whole words with a Python dictionary, rare words through the join; repeated rows, null text, no training rows."""
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(rng.choice([*WORDS, "A", "a", "\u00c9", "\u00e9"], int(rng.integers(0, 50))))) for k in range(80)] + [(80, None), (81, ""), (82, " \t"), (3, "again again"), (3, "again again"), (None, "w1")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_tokens string")
    words_of = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
    for some, learn in ((F.col("doc_id") % 3 != 0, [r for r in rows if r[0] is not None and r[0] % 3]), (F.lit(False), [])):
        count = Counter(w for _, t in learn for w in words_of(t))
        n, v = sum(count.values()), len(count)
        want = sorted((d if d is not None else -1, len(words_of(t)), sum(count[w] > 0 for w in words_of(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words_of(t)), 6)) for d, t in rows)
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm_score.score(docs, some, lm_score.Mixer(frequent=100)).collect())
        assert [g[:4] for g in got] == [w[:4] for w in want] and all(abs(g[4] - w[4]) < 1e-5 for g, w in zip(got, want, strict=True))


def test_mixer_against_a_plain_loop():
    rng = np.random.default_rng(1)
    n, start = 4000, mixer.Start()
    start.weights += rng.normal(0, 0.01, start.weights.shape).astype(np.float32)
    bit, trust, match = rng.integers(0, 2, n), rng.integers(0, 4, n), rng.integers(-4, 5, n).astype(np.int8)
    raw = np.concatenate([rng.integers(-120, 120, (n, 3)), (bit + 2 * trust)[:, None]], axis=1).astype(np.int8)
    codes = raw.view(np.uint32)[:, 0].copy()
    mixer.flagged(codes, match)
    begin, size = np.array([0, 1001, 1701, 1701]), np.array([1001, 700, 2299, 0])
    got, _ = mixer.mixed(codes, begin, size, start, 0.004, 0.02)
    for lo, many, found in zip(begin, size, got, strict=True):
        w, table, total = start.weights.astype(float), start.map.astype(float), 0.0
        for a in range(lo, lo + many, mixer.STEP):
            k, step, new = trust[a] + mixer.TRUST * abs(int(match[a])), np.zeros(4), table.copy()
            for i in range(a, min(a + mixer.STEP, lo + many)):
                x = np.array([*(raw[i, :3] / mixer.SCALE), np.sign(match[i]) * mixer.SAYS[abs(match[i])]])
                z = np.clip(w[k] @ x, -7.9, 7.9)
                p, cell = 1 / (1 + np.exp(-z)), int(z * 2 + 16.5)
                step += 0.004 * (bit[i] - p) * x
                q = (p + table[cell]) / 2
                new[cell] = table[cell] + 0.02 * (bit[i] - table[cell])
                total += np.log(q if bit[i] else 1 - q)
            w[k] += step
            table = new
        assert found == pytest.approx(total, rel=1e-3)


def test_code_trees_are_complete():
    code = mixer.Code({0: {97: 5, 98: 1, 256: 2}, 98: {97: 3, 32: 9}})
    for tree, leaves in enumerate(code.leaf_at):
        assert sum(0.5 ** code.depth[k] for k in leaves[leaves >= 0]) == 1
        assert len({tuple(code.outcome[code.first[k] : code.first[k] + code.depth[k]]) for k in leaves[leaves >= 0]}) == (leaves >= 0).sum(), tree


def test_lengths_and_paths_of_a_code():
    code = mixer.Code({0: {97: 5, 98: 1, 256: 2}, 98: {97: 3, 32: 9}})
    tree, symbol = np.repeat(np.arange(3), 257), np.tile(np.arange(257), 3)
    size = code.sizes(*code.leaves(tree, symbol))
    assert (code.length[tree * 258 + symbol] == size).all() and [len(code.path(t, s)) for t, s in zip(tree, symbol, strict=True)] == size.tolist()


def test_sent_sums_are_whole_and_small():
    """What a task sends of its sums gives these again, in at most six bytes for each that isn't 0, most of them 0 themselves."""
    rng = np.random.default_rng(0)
    held = np.where(rng.random((2, 100_000)) < 0.1, rng.integers(1, 1 << 20, (2, 100_000)), 0).astype(np.float32)
    sent = [r for b in lm_score._sent(held) for r in b.to_pylist()]
    again = np.zeros((2, 1 << 17))
    for r in sent:
        for side, (k, x) in enumerate(zip(np.split(lm_score._numbers(r["slots"], 2), [r["zeros"]]), np.split(lm_score._numbers(r["n"], 4), [r["zeros"]]), strict=True)):
            again[side, (r["chunk"] << 15) + np.cumsum(k)] += x
    assert (again[:, :100_000] == held).all() and sum(len(r["slots"]) + len(r["n"]) for r in sent) <= 6 * (held > 0).sum()


def test_mixture_beats_its_predictors(spark):
    """Bits per byte of held-out texts, mixed, and by each context alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.held_out("doc_id", 7)
    counts = lm_score.word_counts(docs.where(~held))
    code = lm_score.fit_code(counts, lm_score.Mixer())
    tables = (*lm_score.context_tables(counts, 18, code), code)
    sample = docs.where(held).select(F.lower("text").alias("text")).limit(60).toArrow().column(0).combine_chunks()
    data, offsets = lm_score.text_buffers(sample)
    hashes, _, first, size = lm_score.word_places(data, offsets)
    cache = lm_score.Words(tables, np.zeros(0, np.uint64), np.zeros(0), 1 << 22)
    place, depth, _ = cache.places(hashes, first, size, data)
    codes = cache.codes[lm_score.steps(place, depth)]
    mixer.flagged(codes, np.zeros(len(codes), np.int8))
    lanes = np.arange(0, len(codes), 4096)
    whole = mixer.mixed(codes, lanes, np.minimum(4096, len(codes) - lanes), mixer.Start(), 0.002, 0.02)[0].sum()
    for k in range(mixer.CONTEXTS):
        alone = mixer.Start()
        alone.weights[:] = np.eye(mixer.INPUTS)[k]
        assert mixer.mixed(codes, lanes, np.minimum(4096, len(codes) - lanes), alone, 0, 0)[0].sum() < whole


def test_crossing_keys_by_a_plain_loop():
    """Keys of the words before, whether a text comes whole or in parts, among empty texts and words of one letter."""
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("abC\u00e9"), int(rng.integers(1, 5)))) for _ in range(int(n))) for n in (0, 1, 2, 40, 0, 700, 3)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    split = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w).encode() for w in t.split()] + [b""]
    history = [(*([None, None] + split(t))[k : k + 2][::-1],) for t in texts for k in range(len(split(t)))]
    contexts = [[a for a, _ in history], [(a and a[-2:], b and b[-2:]) for a, b in history]]
    for run in (1 << 20, 100):
        keys, carried = [], None
        for group in lm_score._groups(offsets, data, run):
            last = np.array([b == offsets[k + 1] for k, _, b in group])
            found = lm_score._tokens(data, np.array([group[0][1], *(b for _, _, b in group)]), last)
            got, after = lm_score._before(data, *found, carried)
            carried = None if last[-1] else after
            keys.append(got)
        keys = np.concatenate(keys, axis=1)
        for want, got in zip(contexts, keys.tolist(), strict=True):
            assert len(got) == len(want) and len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got)), run


def test_lm_score_beats_its_base(spark):
    """Held-out texts in sum, and nine of ten documents whose words are all known, are likelier than by the unigram base."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.held_out("doc_id", 7)
    got = lm_score.score(docs, ~held).join(docs.select("doc_id", held.alias("held")), "doc_id").toPandas()
    new, known = got[got.held], got[got.n_known == got.n_tokens]
    assert new.score.sum() > new.base_score.sum()
    for part in (known[known.held], known[~known.held]):
        assert (part.score > part.base_score).mean() >= 0.9


def test_lm_score_learns_from_no_sample(spark):
    """Scores are those of constants that learn in each text, by tables of all training words; no part of the documents sets first weights."""
    rng = np.random.default_rng(11)
    rows = [(k, " ".join("".join(rng.choice(list("abcdef"), int(rng.integers(1, 7)))) for _ in range(300))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    p, learn = lm_score.Mixer(), F.col("doc_id") % 3 != 0
    got = {r.doc_id: r.score for r in lm_score.score(docs, learn, p).collect()}
    counts = lm_score.word_counts(docs.where(learn))
    code, bits = lm_score.fit_code(counts, p), max(10, (4 * counts.count()).bit_length())
    tables = (*lm_score.context_tables(counts, bits, code), code)
    tables += (lm_score.crossing_tables(docs.where(learn), tables, p),)
    given = docs.select("doc_id", "text", learn.alias("learn"), F.lit(None).cast("array<struct<at:int,passage:binary>>").alias("found")).toArrow().combine_chunks().to_batches()
    want = {r["doc_id"]: r["score"] for b in lm_score.scored(iter(given), tables, np.zeros(0, np.uint64), np.zeros(0, np.int64), 1, p) for r in b.to_pylist()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)


def test_words_stay_laid_out_from_task_to_task(spark):
    """Known words are laid out once a worker, others whenever they are met; scores don't depend on what is there already."""
    rng = np.random.default_rng(12)
    rows = [(k, " ".join("".join(rng.choice(list("abcd"), int(rng.integers(1, 6)))) for _ in range(400))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts, p = lm_score.word_counts(docs), lm_score.Mixer()
    code = lm_score.fit_code(counts, p)
    tables = (*lm_score.context_tables(counts, 14, code), code)
    tables += (lm_score.crossing_tables(docs, tables, p),)
    often = np.sort(np.array([r.word for r in counts.where("n > 20").collect()], np.int64).view(np.uint64))
    worth = np.ones(len(often), np.int64)
    given = docs.select("doc_id", "text", F.lit(True).alias("learn"), F.lit(None).cast("array<struct<at:int,passage:binary>>").alias("found")).toArrow().combine_chunks().to_batches()
    score = lambda *cache: [(r["score"], r["top_known"], r["top_base"], r["rare"]) for b in lm_score.scored(iter(given), tables, often, worth, 9, p, *cache) for r in b.to_pylist()]
    cache = lm_score.Words(tables[:3], often, np.log10((worth + 1) / 9), p.kept)
    laid, lay = [], cache._lay
    cache._lay = lambda words: (laid.append(len(words)), lay(words))
    first, again = score(cache), score(cache)
    assert first == again == score() and 0 < len(often) < counts.count() and len(laid) == 2 and laid[0] - laid[1] == len(often)
    small = lm_score.Words(tables[:3], often, np.log10((worth + 1) / 9), 1)
    assert score(small) == score(small) == first


def test_word_hashes_by_a_plain_loop():
    """Sums of keys by powers, for words longer than what is hashed together, runs of blanks, and texts that end within a word."""
    rng = np.random.default_rng(4)
    texts = [b"", b"a" * 40_000 + b" Bc  d", b"e", b" " * 40_000 + b"fG", *(bytes(rng.choice(list(b"aB z\n\xc3\xa9"), int(n))) for n in rng.integers(0, 60, 200))]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    hashes, many, first, size = common.word_places(data, offsets)
    words = [[m for m in re.finditer(rb"[^ \t-\r]+", t)] for t in texts]
    assert many.tolist() == [len(w) for w in words] and size.tolist() == [len(m[0]) for w in words for m in w]
    assert first.tolist() == [int(o) + m.start() for o, w in zip(offsets, words, strict=False) for m in w]
    want = []
    for word in (m[0].lower() for w in words for m in w):
        total, power = len(word), 1
        for b in word:
            power = power * int(common.STEP) % 2**64
            total += int(common.BYTE_KEYS[b]) * power
        want.append(total % 2**64)
    assert (hashes == common.mix(np.array(want, np.uint64))).all()


def test_matches(spark):
    """A held-out copy follows its training copy; a training text alone never follows itself; partitions and parts don't matter."""
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcdefghijklmnop "), 6000)) for _ in range(8)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100, texts[0]), (101, texts[1][:3000] + " other words at the end"), (102, "".join(rng.choice(list("abcdefghijklmnop "), 6000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    p = lm_score.Mixer(every=4)
    got = {r.doc_id: (r.bits_per_byte, r.score) for r in lm_score.score(docs.repartition(1), F.col("doc_id") < 100, p).collect()}
    assert got[100][0] < 0.6 * min(got[k][0] for k in range(8)) and got[101][0] < 0.8 * got[102][0]
    again = {r.doc_id: (r.bits_per_byte, r.score) for r in lm_score.score(docs.repartition(7), F.col("doc_id") < 100, p).collect()}
    assert all(got[k][1] == pytest.approx(again[k][1], rel=1e-5) for k in got)
    parts = {r.doc_id: r.score for r in lm_score.score(docs, F.col("doc_id") < 100, lm_score.Mixer(every=4, run=2500)).collect()}
    # a match that a part's end cuts off starts again at the next anchor
    assert all(got[k][1] == pytest.approx(parts[k], rel=0.15) for k in got)


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "?"), (None, 0, "ann", "x"), (2, 0, "system", "alone")]
    got = chat.perspectives(spark.createDataFrame([(*r, "more") for r in rows], "conv_id long, turn long, role string, text string, start string")).collect()
    assert {(r.conv_id, r.perspective) for r in got} == {(1, "ann"), (1, "bob")}
    for who in ("ann", "bob"):
        own = sorted((r for r in got if r.perspective == who), key=lambda r: r.position)
        text = "".join(r.segment for r in own)
        assert [r.position for r in own] == list(range(5)) and all(text[r.start :].startswith(r.segment) for r in own)
        assert [text[r.mask_start : r.mask_end] for r in own if r.mask_start is not None] == (["hi<|im_end|>"] if who == "ann" else ["<|im_end|>"] * 2)
        assert {r.name for r in own} >= {"unknown"}
