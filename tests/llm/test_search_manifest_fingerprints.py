"""Ranked search, Merkle manifest and fingerprints against plain Python and SQL, with the edge cases of their tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessella.llm import lexical, merkle, spotsigs
from tessella.llm.common import NO_TERM, mix, word_places

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, idx long, range int, rows long, h int, terms string, score long"


def made(seed: int, n: int) -> list[tuple]:
    """Documents of Zipf words in two languages, with nulls, empty and blank texts, copies and a long text."""
    rng = np.random.default_rng(seed)
    names = [f"Wört{k}" if k % 7 == 0 else f"w{k}" for k in range(60)] + ["the", "of", "and", "der", "die", "und"] * 6
    text = lambda size: " ".join(rng.permutation(names)[: min(size, len(names))].tolist() + rng.choice(names, max(0, size - len(names))).tolist())
    rows = [(int(k), text(int(rng.integers(1, 120))), ["en", "de"][k % 2], f"s{k % 3}", int(k)) for k in rng.permutation(n * 3)[:n]]
    rows += [(10_000, None, "en", None, None), (10_001, "", None, "s", 0), (10_002, " \t\n!", "", "s", 3), (10_003, "The W1 w2. " * 4000, "en", "s", 1), (10_004, rows[0][1], "fr", "s", 1)]
    rows += [rows[1], rows[1], (rows[2][0], "another text of the id", "de", "s0", 9), (None, "no id and W1", "en", "s", 1), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return made(1, 150)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1, 1, 1, "x", 1) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def best_by_hand(rows, items, top):
    held = [(d, Counter(terms(t))) for d, t, *_ in rows if d is not None and terms(t)]
    n_docs, n_terms, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = set()
    for item in {i for i, _ in items if i is not None}:
        asked = {t for i, text in items if i == item for t in terms(text)}
        scored = []
        for d, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if c[t])
            scored += [(-s, d)] if s > 0 else []
        out |= {(item, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scored)[:top])}
    return out


ITEMS = [(1, "w1 the W2"), (1, "w3"), (2, "Wört7 of w7 w8 w9 w10 w11"), (3, None), (4, "nowhere !"), (5, "the of and"), (None, "w1"), (6, "w1 w1"), (6, "w1 w1"), (7, " ".join(f"w{k}" for k in range(3000)))]


@pytest.mark.parametrize("p", [lexical.Search(top=3), lexical.Search(top=50, block_terms=600, load=8), lexical.Search(top=7, rows_per_term=1, block_terms=2000)])
def test_search_is_that_of_all_documents(spark, docs, rows, p):
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, score long")
    got = [tuple(r) for r in lexical.search(docs, items, p).collect()]
    assert sorted(got) == sorted(best_by_hand(rows, ITEMS, p.top)) and len(got) > 10


def test_bounds_leave_documents_out(spark):
    """Far fewer documents are scored than there are, though the bound is never below a score."""
    texts = [(k, " ".join(f"w{(k * 7 + j * j) % 500}" for j in range(60)) + (" rare word" * (k % 40 == 0))) for k in range(4000)]
    docs, items = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), spark.createDataFrame([(1, "rare word w3")], "item_id long, text string")
    p = lexical.Search(top=5, block_terms=4000)
    blocks = lexical.index(docs, p)
    q = lexical._Queries([1], np.sort(np.concatenate([lexical.term_counts(*_buffers(x))[2] for x in ("rare", "word", "w3")])), [np.arange(3)], np.array([5, 7, 9]), 4000, 4000 * 60)
    looked = lexical._search(blocks, q, p).collect()
    assert len(looked) == 5 and looked[0].looked < 1000
    assert {r.doc_id for r in lexical.search(docs, items, p).collect()} == {d for _, _, d, _ in best_by_hand(texts, [(1, "rare word w3")], 5)}


def _buffers(word):
    return np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())])


def test_search_without_rows(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(none, items).count() == 0 and lexical.search(docs, items.where("false")).count() == 0


def in_sql(rows, sql, kinds="doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT"):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents ({kinds})")
    con.executemany(f"INSERT INTO documents VALUES ({', '.join('?' * len(rows[0]))})", rows)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", ITEMS)
    return con.sql(sql)


def test_search_sql(rows):
    assert {tuple(r) for r in in_sql(rows, lexical.search_sql(top=9)).fetchall()} == best_by_hand(rows, ITEMS, 9)


def field(v):
    s = None if v is None else str(v)
    return "-" if s is None else f"{len(s.encode())}:{s}"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_by_hand(nodes):
    """All levels from the leaves to the root, and for each leaf its run's others with its own place, level by level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    steps = [[(lv[j - j % 8 : j - j % 8 + 8], j % 8) for lv, j in ((lv, i // 8**x) for x, lv in enumerate(levels[:-1]))] for i in range(len(nodes))]
    return levels, steps


def manifest_by_hand(rows):
    order = lambda v: (v is not None, v or 0)
    leaf = lambda r, text: h(*(field(x) for x in (r[0], r[3], r[2], r[4], text)))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == lang), key=lambda r: (order(r[0]), leaf(r, r[1]))) for lang in langs]
    trees = [tree_by_hand([leaf(r, r[1]) for r in g]) for g in groups]
    top, ups = tree_by_hand([t[0][-1][0] for t in trees])
    out = []
    for k, g in enumerate(groups):
        for i, r in enumerate(g):
            steps = trees[k][1][i] + ups[k]
            node = leaf(r, r[1] and r[1].translate(UPPER)) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf(r, r[1])
            for run, j in steps:
                node = h(*run[:j], node, *run[j + 1 :])
            proof = h(*(x for run, j in steps for x in [*run[:j], *run[j + 1 :]]))
            out.append((r[0], leaf(r, r[1]), trees[k][0][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def keyed(found):
    return sorted(found, key=repr)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest(docs, rows, levels):
    """Also with builders of 8 and 64 leaves, so that the log takes several rounds."""
    got = merkle.manifest(docs, levels).collect()
    assert keyed(tuple(r)[:7] for r in got) == keyed(manifest_by_hand(rows))
    assert {r.verified for r in got} == {True, False}


def test_manifest_sql(rows):
    assert keyed(tuple(r)[:7] for r in in_sql(rows, merkle.manifest_sql()).fetchall()) == keyed(manifest_by_hand(rows))


def test_manifest_of_one_and_of_none(spark, none):
    one = spark.createDataFrame([(1, "A b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [tuple(r)[:7] for r in merkle.manifest(one).collect()] == manifest_by_hand([(1, "A b", "en", "s", 3)])
    assert merkle.manifest(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 73, 512, 513, 600])
def test_positions_are_those_of_a_builder(n):
    """A builder that takes leaf after leaf, closes runs as soon as they are full, and the others in the end."""
    log, open_runs = [], [[] for _ in range(merkle.height(n) + 1)]

    def put(level, idx):
        log.append((level, idx))
        if level < merkle.height(n):
            open_runs[level].append(idx)
            if len(open_runs[level]) == 8:
                open_runs[level] = []
                put(level + 1, idx // 8)

    for i in range(n):
        put(0, i)
    for level in range(merkle.height(n)):
        if open_runs[level]:
            idx, open_runs[level] = open_runs[level][0] // 8, []
            put(level + 1, idx)
    for level in range(merkle.height(n) + 1):
        idx = [i for lv, i in log if lv == level]
        assert merkle.positions(level, idx, n).tolist() == [log.index((level, i)) for i in idx]
    assert len(set(log)) == len(log)


def spots_by_hand(text, p):
    found, last, out = terms(text), -1, set()
    common, gap_hash = set(p.common), {}
    for i, w in enumerate(found):
        if w not in gap_hash:
            gap_hash[w] = int(mix(word_places(*_buffers(w), blank=NO_TERM)[0])[0]) % p.every == 0
        last = i if w in common else last
        chain = [x for x in found[i + 1 :] if x not in common][: p.chain]
        if (w in common or (i - last >= p.gap and gap_hash[w])) and len(chain) == p.chain:
            out.add((w, *chain))
    return out or ({tuple(found)} if found else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(docs, rows):
    p = spotsigs.Spots()
    got = spotsigs.edited_fingerprints(docs, p, 7).collect()
    last = lambda r: (r[0] is not None, r[0] or 0)
    ids = Counter(r[0] for r in rows)
    ordered = sorted(rows, key=last)
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_chars): r for r in got}
    for k, r in enumerate(ordered):
        text, following = r[1] or "", ordered[(k + 1) % len(ordered)]
        if ids[r[0]] > 1 or ids[following[0]] > 1:
            continue  # their order is that of a hash
        after, one = following[1] or "", by[r[0], len(text)]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert one.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, theirs = spots_by_hand(text, p), spots_by_hand(edited, p)
        assert one.n_signatures == len(own) == len(spotsigs.read(one.fingerprint))
        assert math.isclose(one.near_edited, jaccard(own, theirs)) and math.isclose(one.near_next, jaccard(own, spots_by_hand(after, p)))
    texts = {(r[0], len(r[1] or "")): r[1] or "" for r in rows}
    prints = {}
    for r in got:
        assert prints.setdefault(texts[r.doc_id, r.n_chars], r.fingerprint) == r.fingerprint


def test_fingerprints_of_one_and_of_none(spark, docs, rows, none):
    one = spotsigs.edited_fingerprints(spark.createDataFrame([(1, "äöü the end of it all")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(("äöü the end" + "äöü the en").encode()).hexdigest() and one.near_next == 1.0
    assert spotsigs.edited_fingerprints(none).count() == 0 and spotsigs.fingerprints(none).count() == 0
    plain = {(r.doc_id, r.fingerprint) for r in spotsigs.fingerprints(docs).collect()}
    assert plain == {(r.doc_id, r.fingerprint) for r in spotsigs.edited_fingerprints(docs).collect()} and len(plain) > 150


def test_an_edit_changes_the_signatures_around_it():
    words = [w for k in range(200) for w in (f"w{k}", f"x{k}", "the")]
    sets = [spotsigs._sets_of([" ".join(words)], spotsigs.Spots())[0], spotsigs._sets_of([" ".join([*words[:300], "edit", *words[301:]])], spotsigs.Spots())[0]]
    assert 0.95 < spotsigs.likeness(*sets) < 1
    other = spotsigs._sets_of([" ".join(f"y{k} the" for k in range(100))], spotsigs.Spots())[0]
    assert spotsigs.likeness(sets[0], other) == 0


def test_pruned_comparison_agrees(spark):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 48, int(rng.integers(0, 300)), dtype=np.uint64)) for _ in range(12)]
    sets += [np.unique(np.concatenate([s[: len(s) * 4 // 5], rng.integers(0, 1 << 48, 9, dtype=np.uint64)])) for s in sets]
    for a in sets:
        for b in sets:
            exact = spotsigs.likeness(a, b)
            assert math.isclose(exact, jaccard(set(a.tolist()), set(b.tolist())))
            for floor in (0.3, 0.75, 1.0):
                assert spotsigs.likeness(a, b, floor) == (exact if exact >= floor else 0.0)
    assert np.array_equal(spotsigs.read(spotsigs.written(sets[0])), sets[0])
    pairs = spark.createDataFrame([(spotsigs.written(sets[0]), spotsigs.written(sets[12])), ("", ""), (None, spotsigs.written(sets[1]))], "a string, b string")
    assert [round(r.likeness, 6) for r in spotsigs.compare(pairs).collect()] == [round(spotsigs.likeness(sets[0], sets[12]), 6), 1.0, float(not len(sets[1]))]
