"""Chat formatting: for each participant, the dialogue with that speaker as assistant and the others as named users."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import checkpoint, width


@dataclass(frozen=True)
class ChatFormat:
    """Marks around a turn; the speakers in ``narrators`` keep their own role and are no participants."""

    begin: str = "<|im_start|>"
    end: str = "<|im_end|>"
    named: str = " name="
    narrators: tuple[str, ...] = ("system",)
    nobody: str = "unknown"
    #: Turns that are numbered and measured together.
    block: int = 256


def perspectives(turns: DataFrame, f: ChatFormat = ChatFormat()) -> DataFrame:
    """One row per turn of ``turns`` (conv_id, turn, role, text, ...) and participant of its conversation.

    The columns are conv_id, perspective, position (from 0), role (assistant, user or a narrator's), name, segment (the
    turn as rendered), start (characters of the rendering before it), and mask_start and mask_end, the part to learn
    from: content and end mark of the perspective's own turns, null for others. Segments in the order of position are
    the whole rendering. Turns are ordered by turn (null first), role and text, so ties and repeated rows have an order.
    A null role speaks as ``nobody`` and is no participant, a null text is empty, a turn without conv_id is left out,
    and a conversation without participants gives no rows, as does an empty table. Other columns are not looked at.

    Positions and offsets are prefix sums in two steps, within blocks of turns and over blocks, so that a conversation
    that holds a large share of all turns is spread over tasks.
    """
    spark = turns.sparkSession
    order = ["conv_id", "turn", "role", "text"]
    turns = turns.where("conv_id is not null").select(*order).repartitionByRange(width(spark), *order).sortWithinPartitions(*order)
    turns = checkpoint(turns.withColumn("at", F.monotonically_increasing_id()))
    turns = turns.withColumn("block", F.floor(F.col("at") / f.block))
    people = turns.where(F.col("role").isNotNull() & ~F.col("role").isin(*f.narrators)).select("conv_id", F.col("role").alias("perspective")).distinct()
    own, narrator = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False)), F.coalesce(F.col("role").isin(*f.narrators), F.lit(False))
    name = F.when(~own & ~narrator, F.coalesce("role", F.lit(f.nobody)))
    shown = F.when(own, F.lit("assistant")).when(narrator, F.col("role")).otherwise(F.lit("user"))
    rows = turns.join(people, "conv_id").select("conv_id", "perspective", "at", "block", own.alias("own"), shown.alias("role"), name.alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(f.begin), "role", F.when(F.col("name").isNotNull(), F.concat(F.lit(f.named), "name")).otherwise(F.lit("")), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("segment", F.concat("head", "text", F.lit(f.end + "\n"))).withColumn("size", F.length("segment").cast("long"))

    key = ["conv_id", "perspective"]
    sums = rows.groupBy(*key, "block").agg(F.sum("size").alias("block_size"), F.count("*").alias("block_turns"))
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, "block", F.coalesce(F.sum("block_size").over(before), F.lit(0)).alias("size_before"), F.coalesce(F.sum("block_turns").over(before), F.lit(0)).alias("turns_before"))
    within = Window.partitionBy(*key, "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own_size", F.coalesce(F.sum("size").over(within), F.lit(0))).withColumn("own_turns", F.count("*").over(within))
    placed = rows.join(sums, [*key, "block"]).withColumn("start", F.col("size_before") + F.col("own_size"))
    learn = F.col("start") + F.length("head")
    return placed.select(
        *key, (F.col("turns_before") + F.col("own_turns")).alias("position"), "role", "name", "segment", "start",
        F.when(F.col("own"), learn).alias("mask_start"), F.when(F.col("own"), learn + F.length("text") + len(f.end)).alias("mask_end"),
    )


def perspectives_sql(f: ChatFormat = ChatFormat(), turns: str = "conversations") -> str:
    """The same result in DuckDB SQL over the table expression ``turns``."""
    narrators = ", ".join(f"'{x}'" for x in f.narrators)
    return f"""
WITH t AS (SELECT row_number() OVER (ORDER BY conv_id, turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos, conv_id, role, coalesce(text, '') AS text
           FROM {turns} WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role IS NOT NULL AND role NOT IN ({narrators})),
r AS (SELECT t.conv_id, perspective, pos, text, coalesce(role = perspective, false) AS own, role AS speaker,
             CASE WHEN coalesce(role = perspective, false) THEN 'assistant' WHEN role IN ({narrators}) THEN role ELSE 'user' END AS role
      FROM t JOIN p ON t.conv_id = p.conv_id),
n AS (SELECT *, CASE WHEN role = 'user' AND NOT own THEN coalesce(speaker, '{f.nobody}') END AS name FROM r),
h AS (SELECT *, '{f.begin}' || role || CASE WHEN name IS NULL THEN '' ELSE '{f.named}' || name END || chr(10) AS head FROM n),
s AS (SELECT *, head || text || '{f.end}' || chr(10) AS segment FROM h),
o AS (SELECT *, row_number() OVER w - 1 AS "position", coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "start"
      FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY pos))
SELECT conv_id, perspective, "position", role, name, segment, "start",
       CASE WHEN own THEN "start" + length(head) END AS mask_start, CASE WHEN own THEN "start" + length(head) + length(text) + {len(f.end)} END AS mask_end FROM o
"""
