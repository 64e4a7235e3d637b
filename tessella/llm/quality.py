"""Quality rules by cross-document line frequency, in DataFrame functions alone.

A line is normalised to its words, lower-cased and joined by single spaces. For each host (``source``) the lines are
counted by the distinct documents that hold them; exact copies of one document count once, as the hash of the whole text
stands for the document. A line above the limits is boilerplate and its words are
removed from the documents of that host; a document that keeps too small a share of its words is depleted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import checkpoint


@dataclass(frozen=True)
class LineLimits:
    """A line of a host is above the limits with ``min_docs`` documents and more than ``max_share`` of the host's."""

    min_docs: int = 20
    max_share: float = 0.10
    #: A document that keeps less than this share of its words is depleted.
    min_left: float = 0.3


#: White space between words, as a Java character class and as characters.
_SPLIT = r"'[\\x20\\x09-\\x0D]+'"
_BLANK = r"' \t\n\u000b\u000c\r'"


def document_statistics(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, text): counts of words, symbols, repeats, and its normalised lines with words."""
    base = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("raw", F.expr(rf"filter(split(text, '\n', -1), l -> btrim(l, {_BLANK}) <> '')"))
    base = base.withColumn("line_words", F.expr(f"transform(raw, l -> split(btrim(l, {_BLANK}), {_SPLIT}))"))
    base = base.withColumn("words", F.flatten("line_words"))
    base = base.withColumn("grams", F.expr("if(size(words) < 3, array(), transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])))"))
    # only a text with a repeated window is sorted; a window is repeated where a neighbour in hash order is equal
    base = base.withColumn("order", F.expr("if(size(array_distinct(grams)) = size(grams), array(), array_sort(transform(grams, (h, i) -> struct(h as h, i as i))))"))
    base = base.withColumn("found", F.expr("sort_array(transform(filter(order, (x, k) -> (k > 0 and order[k - 1].h = x.h) or (k < size(order) - 1 and order[k + 1].h = x.h)), x -> x.i))"))
    return base.select(
        "doc_id",
        "host",
        F.md5("text").alias("copy"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.expr("size(raw) - size(array_distinct(raw))").cast("long").alias("n_dup_lines"),
        F.expr("aggregate(found, struct(-3 as last, 0L as n), (a, i) -> struct(i as last, a.n + least(3, i - a.last) as n), a -> a.n)").alias("n_repeat_words"),
        F.expr("transform(line_words, w -> struct(md5(lower(array_join(w, ' '))) as line, size(w) as words))").alias("lines"),
    )


def frequent_lines(stats: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """(host, line, docs) of the lines above the limits of their host."""
    copy = F.unhex("copy").alias("copy")
    lines = stats.where(F.size("lines") > 0).select("host", copy, F.explode(F.array_distinct(F.transform("lines", lambda x: F.unhex(x["line"])))).alias("line"))
    held = lines.groupBy("host", "line", "copy").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") >= limits.min_docs)
    held = held.withColumn("line", F.lower(F.hex("line")))
    hosts = stats.where(F.size("lines") > 0).select("host", copy).distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    return held.join(hosts, "host").where(F.col("docs") > limits.max_share * F.col("host_docs")).select("host", "line", "docs")


def quality(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """One row per row of ``docs``: the statistics, base_failed, the words left without frequent lines, kept.

    ``kept`` is false if the base rules fail or the document is depleted. A null text has no words and fails; a null
    source is the host ''; equal rows give equal rows; further columns are not looked at; no rows give no rows.
    """
    stats = checkpoint(document_statistics(docs))
    key = ["doc_id", "host", "copy"]
    hits = stats.select(*key, F.explode("lines").alias("x")).groupBy(*key, F.col("x.line").alias("line")).agg(F.sum("x.words").alias("words"), F.count("*").alias("n"))
    rows = stats.groupBy(*key).agg(F.count("*").alias("rows"))
    hits = hits.join(frequent_lines(stats, limits), ["host", "line"]).groupBy(*key).agg(F.sum("words").alias("hit"))
    same = [rows[k].eqNullSafe(hits[k]) for k in key]
    removed = rows.join(hits, same[0] & same[1] & same[2], "left").select(*[rows[k].alias(f"r_{k}") for k in key], (F.coalesce("hit", F.lit(0)) / F.col("rows")).cast("long").alias("removed"))
    joined = stats.drop("lines").join(removed, F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("host") == F.col("r_host")) & (F.col("copy") == F.col("r_copy")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), left.alias("words_left"),
        (~failed & (left >= limits.min_left * F.col("n_words"))).alias("kept"),
    )


def quality_sql(limits: LineLimits = LineLimits(), docs: str = "documents") -> str:
    """The same result in DuckDB SQL over the table expression ``docs``."""
    ws, word = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)", r"'[^\x20\x09-\x0D]+'"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM {docs}),
w AS (SELECT r, doc_id, host, text, regexp_extract_all(text, {word}) AS words,
             list_filter(string_split(text, chr(10)), lambda x: trim(x, {ws}) <> '') AS raw FROM d),
pos AS (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3),
gram AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM pos),
hit AS (SELECT DISTINCT r, i + k AS p FROM gram, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1),
rep AS (SELECT r, count(*) AS n FROM hit GROUP BY r),
u AS (SELECT r, host, unnest(raw) AS l FROM w),
ln AS (SELECT r, host, md5(lower(array_to_string(regexp_extract_all(l, {word}), ' '))) AS line, len(regexp_extract_all(l, {word})) AS n FROM u),
cp AS (SELECT r, host, md5(text) AS copy FROM w WHERE len(raw) > 0),
hd AS (SELECT host, count(DISTINCT copy) AS host_docs FROM cp GROUP BY host),
fr AS (SELECT ln.host, line, count(DISTINCT copy) AS docs FROM ln JOIN cp USING (r) GROUP BY ln.host, line),
top AS (SELECT fr.host, line FROM fr JOIN hd USING (host) WHERE docs >= {limits.min_docs} AND docs > {limits.max_share}::DOUBLE * host_docs),
gone AS (SELECT r, sum(n) AS n FROM ln JOIN top USING (host, line) GROUP BY r),
b AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(raw) - len(list_distinct(raw)))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words, (len(words) - coalesce(gone.n, 0))::BIGINT AS words_left
      FROM w LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_left,
       NOT base_failed AND words_left >= {limits.min_left}::DOUBLE * n_words AS kept FROM f
"""
