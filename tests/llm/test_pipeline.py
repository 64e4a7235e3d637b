"""The corpus pipeline, stage by stage, against plain Python."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm import langid

LINE = "home news sports weather travel contact about imprint privacy terms"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_failed(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(words) < 50 or 100 * len(hit) > 50 * len(words)


def quality_kept(rows):
    lines = lambda text: [" ".join(w) .lower() for x in (text or "").split("\n") if (w := words_of(x))]
    held, texts = defaultdict(set), defaultdict(set)
    for _, text, _, source in rows:
        if own := lines(text):
            texts[source].add(text)
            for x in own:
                held[source, x].add(text)
    frequent = {k for k, t in held.items() if len(t) >= 20 and len(t) > 0.1 * len(texts[k[0]])}
    out = []
    for row in rows:
        words = words_of(row[1])
        gone = sum(len(x.split()) for x in lines(row[1]) if (row[3], x) in frequent)
        if not base_failed(words) and len(words) - gone >= 0.3 * len(words):
            out.append(row)
    return out


def dedup_kept(rows):
    sets = {}
    for d, text, *_ in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(text)]
        sets.setdefault(d, []).append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    ids, up = sorted(sets), {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return sorted({r for r in rows if find(r[0]) == r[0]})


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(20)
    vocabulary = {"xx": [f"{a}{b}{c}" for a in "bcd" for b in "aei" for c in "lmnr"], "yy": [f"{a}{b}{c}" for a in "kpt" for b in "ouy" for c in "szxv"]}
    out = []
    for k in range(240):
        lang = "xx" if k % 3 else "yy"
        text = "\n".join(" ".join(rng.choice(vocabulary[lang], 12)) for _ in range(int(rng.integers(3, 12))))
        if k % 6 == 0:
            text = LINE + "\n" + text
        out.append((k, text, lang, f"s{k % 2}"))
    for k in range(40):  # near and exact copies
        base = out[int(rng.integers(0, 100))]
        words = base[1].split(" ")
        if k % 2:
            words[len(words) // 2] = "edited"
        out.append((300 + k, " ".join(words), base[2], "s1"))
    depleted = LINE + "\n" + "\n".join([LINE + f" {i}" for i in range(2)])
    return [*out, out[5], out[5], (400, None, "xx", "s0"), (401, "", "xx", None), (402, "12 34 !", None, "s0"), (None, out[3][1], "xx", "s0"), (403, depleted, "xx", "s0"), (404, out[1][1] * 40, "xx", "s0")]


SCHEMA = "doc_id long, text string, lang string, source string"


def test_stages(spark, rows, tmp_path):
    """Language ID by the operator's own verdict (its accuracy has a test of its own), all else by brute force."""
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    model = langid.fit(docs.where(~langid.held_out("doc_id", 4)))
    said = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert sum(said[r[0]].lang_pred == r[2] for r in rows[:240]) >= 235
    want = [r for r in rows if r[0] is not None and said[r[0]].lang_pred != "und" and said[r[0]].score >= 0.5]
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:3], (lambda x: x, quality_kept, dedup_kept), strict=True):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source"], name
        want = brute(want)
        key = lambda r: (r[0], r[1], r[2] or "", r[3] or "")
        assert sorted(map(tuple, docs.collect()), key=key) == sorted(want, key=key), name
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, tokens = corpus_pipeline.run(spark, str(tmp_path)).collect(), Counter()
    for r in got:
        tokens[r.doc_id] += r.length
    assert tokens == {r[0]: len(library.encode(r[1], add_special_tokens=False).ids) + 1 for r in want}
    held = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 4096


def test_empty_table_and_more_columns(spark, rows, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([(*r, True, 1) for r in rows[:60]], SCHEMA + ", kept boolean, n_words int")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "kept", "n_words"], name
    assert docs.count() > 0
