"""Merkle dataset manifest: a tree of eight children over each language's documents, one more over the subroots.

The tree is kept as an append log in postorder, the order in which a builder that reads leaves one by one completes its
nodes: a node follows its last child at once, nodes whose last run isn't full end the log, lower levels first. So a
node's position follows from the sizes of the subtrees before it (``positions``), and builders that start at multiples
of 4096 leaves write their parts of the log independently. The next round's builders do the same over the nodes that
the last one ended with, until a tree has one node. A proof reads its siblings from the log at their positions: within
a block of 4096 leaves from the block's part, above it by the way of the block's own root, which all its leaves share.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import Tables, width

FAN = 8
LOG = "key string, n long, level int, idx long, pos long, digest string, top boolean"
WAY = "key string, block long, way array<struct<before:string,after:string>>, subroot string, root string"
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, lang string, leaf_index long, n_siblings int"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def positions(level: int, idx: np.ndarray, n: int) -> np.ndarray:
    """Places in the postorder log of ``n`` leaves of the nodes ``idx`` of ``level``.

    A full node is preceded by all nodes that end with its last leaf or before, but those above it that end with it; a
    node that isn't full by all full ones and by those of lower levels that aren't.
    """
    high, idx = height(n), np.asarray(idx, dtype=np.int64)
    end = (idx + 1) * FAN**level
    full = sum((end - (k > level)) // FAN**k for k in range(high + 1)) - 1
    cut = sum(n // FAN**k for k in range(high + 1)) + sum(n % FAN**k > 0 for k in range(1, level))
    return np.where(end <= n, full, cut)


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, key, leaf, tampered): the key is the language, null before all others, as text."""
    hashed = lambda text: F.sha2(F.concat(*[_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], _field(text)).cast("binary"), 256)
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    key = F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), hashed(F.col("text")).alias("leaf"), F.when(touched, hashed(F.translate("text", _UPPER, _LOWER))).alias("tampered"))


def numbered(tables: Tables, rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """``rows`` with ``idx``, their place (from 0) in the order of their key, and ``n``, the number of the key's rows.

    Rows are dealt in ranges of key and order, so a key that holds most rows is in many tasks; the ranges' counts for
    each key, at most as many as ranges and keys, are summed up.
    """
    rows = rows.repartitionByRange(width(rows.sparkSession), key, *order).sortWithinPartitions(key, *order)
    rows = tables.put(rows.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    sizes = rows.groupBy(key, "part").agg(F.count("*").alias("size"), F.min("at").alias("first"))
    before = F.sum("size").over(Window.partitionBy(key).orderBy("part")) - F.col("size")
    sizes = sizes.select(key, "part", "first", before.alias("before"), F.sum("size").over(Window.partitionBy(key)).alias("n"))
    return rows.join(sizes, [key, "part"]).withColumn("idx", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def _builder(base: int, levels: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("idx")
        n, first, nodes, out = int(block["n"].iloc[0]), int(block["idx"].iloc[0]), block["digest"].tolist(), []
        high = height(n)
        for level in range(base, min(base + levels, high) + 1):
            if level > base:
                nodes, first = [digest(nodes[k : k + FAN]) for k in range(0, len(nodes), FAN)], first // FAN
            if level > base or base == 0:
                idx = np.arange(first, first + len(nodes))
                out.append(pd.DataFrame({"key": block["key"].iloc[0], "n": n, "level": level, "idx": idx, "pos": positions(level, idx, n), "digest": nodes, "top": level == high}))
        return pd.concat(out).sort_values("pos")

    return run


def append_log(tables: Tables, nodes: DataFrame, levels: int) -> tuple[DataFrame, int]:
    """The log of each key's tree over ``nodes`` (key, idx, n, digest), and the rounds of builders of ``levels`` that it took."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    rounds, log = max(1, -(-height(most) // levels)), None
    for r in range(rounds):
        made = nodes.withColumn("block", F.floor(F.col("idx") / FAN**levels)).groupBy("key", "block").applyInPandas(_builder(r * levels, levels), LOG)
        made = tables.put(made)
        log = made if log is None else log.unionByName(made)
        nodes = made.where((F.col("level") == (r + 1) * levels) & ~F.col("top"))
    return log, rounds


def _ways(log: pd.DataFrame, base: int, levels: int) -> Callable[[int], list[tuple[str, str]]]:
    """From a block's part of the log: what stands before and after a node in its run, level by level up to the block's root."""
    n, first, at = int(log["n"].iloc[0]), int(log.loc[log["level"] == base, "idx"].min()), dict(zip(log["pos"], log["digest"], strict=True))
    runs: list[list[tuple[str, str]]] = []
    for level in range(base, min(base + levels, height(n))):
        start, count = first // FAN ** (level - base), -(-n // FAN**level)
        idx = np.arange(start, min(start + FAN ** (levels - level + base), count))
        found = [at[p] for p in positions(level, idx, n).tolist()]
        runs.append([("".join(found[k - k % FAN : k]), "".join(found[k + 1 : k - k % FAN + FAN])) for k in range(len(found))])
    return lambda idx: [own[(idx - first) // FAN**k] for k, own in enumerate(runs)]


def _parts(log: DataFrame, above: DataFrame, r: int, levels: int) -> DataFrame:
    """The log rows that the proofs of round ``r`` read, by block; a block's first node carries the way above the block."""
    base = r * levels
    rows = log.where(F.col("level").between(base, base + levels - 1) & ((F.col("n") > FAN**base) | F.lit(base == 0))).withColumn("block", F.floor(F.col("idx") / F.pow(F.lit(FAN), base + levels - F.col("level"))).cast("long"))
    rows = rows.withColumn("start", (F.col("level") == base) & (F.col("idx") == F.col("block") * FAN**levels))
    return rows.join(above.withColumn("start", F.lit(True)), ["key", "block", "start"], "left").select("key", "block", "n", "level", "idx", "pos", "digest", "way", "subroot", "root")


def _above(r: int, levels: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(log: pd.DataFrame) -> pd.DataFrame:
        carried = log[log["root"].notna()].iloc[0]
        way, rest = _ways(log, r * levels, levels), [(w["before"], w["after"]) for w in carried["way"]]
        idx = log.loc[log["level"] == r * levels, "idx"].tolist()
        return pd.DataFrame({"key": carried["key"], "block": idx, "way": [[{"before": b, "after": a} for b, a in [*way(i), *rest]] for i in idx], "subroot": carried["subroot"], "root": carried["root"]})

    return run


def ways(tables: Tables, log: DataFrame, tops: DataFrame, rounds: int, levels: int, down_to: int = 0) -> DataFrame:
    """``tops`` (way and roots of each key, with ``n``) carried down: a row for each block of the round below ``down_to``."""
    block = FAN**levels
    ends = lambda r: tops.where((F.col("n") <= block ** (r + 1)) & ((F.col("n") > block**r) | F.lit(r == 0))).select("key", F.lit(0).cast("long").alias("block"), "way", "subroot", "root")
    above = ends(rounds - 1)
    for r in range(rounds - 1, down_to - 1, -1):
        found = tables.put(_parts(log, above, r, levels).groupBy("key", "block").applyInPandas(_above(r, levels), WAY))
        above = found.unionByName(ends(r - 1)) if r else found
    return above


def _prove(levels: int, docs: pd.DataFrame, log: pd.DataFrame) -> pd.DataFrame:
    carried = log[log["root"].notna()].iloc[0]
    way, rest, root = _ways(log, 0, levels), [(w["before"], w["after"]) for w in carried["way"]], carried["root"]
    proofs, folded, siblings = [], [], []
    for idx, node in zip(docs["idx"], docs["tampered"].fillna(docs["leaf"]), strict=True):
        steps = [*way(idx), *rest]
        proofs.append(digest([x for step in steps for x in step]))
        siblings.append(sum(len(x) for step in steps for x in step) // 64)
        for before, after in steps:
            node = digest([before, node, after])
        folded.append(node)
    lang = None if carried["key"] == "0" else carried["key"][1:]
    return pd.DataFrame({
        "doc_id": docs["doc_id"], "leaf": docs["leaf"], "subroot": carried["subroot"], "root": root, "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded],
        "lang": lang, "leaf_index": docs["idx"], "n_siblings": siblings,
    })


def manifest(docs: DataFrame, levels: int = 4) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, source, lang, n_chars, text): its leaf, its language's subroot, the root,
    the hash of its proof's siblings, and the root folded from the tampered leaf (else the own) with these siblings.

    A null field is ``-``. Null languages are a tree of their own, the first. Leaves ascend by doc_id, null first, then
    by leaf; equal rows are leaves of their own. A row without doc_id is not tampered with, nor is a null text. A tree
    of one leaf has that as subroot, a single subroot is the root. Other columns are no part of a leaf; no rows give no
    rows. Texts are hashed where they are read; digests alone are dealt. A builder completes ``levels`` levels.
    """
    tables = Tables(docs.sparkSession)
    rows = tables.put(numbered(tables, leaves(docs), "key", F.col("doc_id").asc_nulls_first(), "leaf"))
    log, rounds = append_log(tables, rows.select("key", "idx", "n", F.col("leaf").alias("digest")), levels)
    subroots = log.where("top").select("key", "n", F.col("digest").alias("subroot"))
    named = tables.put(numbered(tables, subroots.select(F.lit("").alias("key"), F.col("key").alias("lang"), F.col("n").alias("size"), "subroot"), "key", "lang"))
    upper, steps = append_log(tables, named.select("key", "idx", "n", F.col("subroot").alias("digest")), levels)
    root = upper.where("top").select("key", "n", F.expr("cast(array() as array<struct<before:string,after:string>>)").alias("way"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    tops = named.join(ways(tables, upper, root, steps, levels).select(F.col("block").alias("idx"), "way", "root"), "idx")
    tops = tables.put(tops.select(F.col("lang").alias("key"), F.col("size").alias("n"), "way", "subroot", "root"))
    above = ways(tables, log, tops, rounds, levels, 1)
    parts = _parts(log, above, 0, levels)
    given = rows.select("key", F.floor(F.col("idx") / FAN**levels).alias("block"), "doc_id", "idx", "leaf", "tampered")
    return given.groupBy("key", "block").cogroup(parts.groupBy("key", "block")).applyInPandas(lambda docs, log: _prove(levels, docs, log), PROOF)


def manifest_sql(docs: str = "documents", levels: int = 7, tops: int = 3) -> str:
    """The same result in DuckDB SQL, for at most 8 ** ``levels`` documents of a language and 8 ** ``tops`` languages."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda t: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(t)]) + ")"
    step = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {step}))"
    out = [
        f"d AS (SELECT doc_id, lang, coalesce('1' || lang, '0') AS k, {leaf('text')} AS leaf, coalesce(CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {leaf(f'''translate(text, '{_UPPER}', '{_LOWER}')''')} END, {leaf('text')}) AS t FROM {docs})",
        "a0 AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, doc_id, t, lang FROM d)",
    ]

    def tree(a: str, depth: int) -> None:
        for x in range(depth):
            out.append(f"{a}c{x} AS (SELECT k, i, h, count(*) OVER (PARTITION BY k) AS c FROM {a}{x})")
            out.append(f"{a}r{x} AS (SELECT k, i // 8 AS p, any_value(c) AS c, list(h ORDER BY i) AS run FROM {a}c{x} GROUP BY 1, 2)")
            out.append(f"{a}{x + 1} AS (SELECT k, p AS i, CASE WHEN c > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h FROM {a}r{x})")

    tree("a", levels)
    out.append(f"b0 AS (SELECT 'x' AS k, row_number() OVER (ORDER BY k) - 1 AS i, h, k AS own FROM a{levels})")
    tree("b", tops)
    out.append("p0 AS (SELECT a0.*, b0.i AS j, b0.h AS subroot, t AS f, '' AS s FROM a0 JOIN b0 ON own = k)".replace("own = k", "b0.own = a0.k"))
    for x in range(levels + tops):
        a, y, i, on = ("a", x, "i", "r.k = p.k") if x < levels else ("b", x - levels, "j", "true")
        at = f"({i} // {8**y}) % 8"
        before, after = f"array_to_string(run[1:{at}], '')", f"array_to_string(run[{at} + 2:], '')"
        out.append(f"p{x + 1} AS (SELECT p.* EXCLUDE (f, s), CASE WHEN c > 1 THEN sha256({before} || f || {after}) ELSE f END AS f, s || {before} || {after} AS s FROM p{x} p JOIN {a}r{y} r ON {on} AND r.p = {i} // {8 ** (y + 1)})")
    last = f"p{levels + tops}"
    return f"WITH {', '.join(out)} SELECT doc_id, h AS leaf, subroot, root, sha256(s) AS proof_sha256, f AS folded_root, f = root AS verified, lang, i AS leaf_index, (strlen(s) // 64)::INTEGER AS n_siblings FROM {last}, (SELECT h AS root FROM b{tops})"
