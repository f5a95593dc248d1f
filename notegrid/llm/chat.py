"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

For every participant of a dialogue the whole dialogue is rendered with that speaker as the assistant and all
others as named users; system turns stay system turns. The mask lists the spans of the rendering that the
assistant said (to be learned); everything else is context.

A dialogue may be of any length: its turns get their rank from a range partitioning of all turns (two
levels: rank in the range, ranks of the ranges before), and renderings come in parts of `part_turns` turns
with the offset of each part in the whole. Offsets are summed up over the parts' lengths alone, in two levels
too, and then joined to the parts, so no row or task holds the text of a dialogue.

Defined results: turns go by (turn, role, text), nulls first; a null text counts as empty, a null or blank
role as `unknown`; rows without conv_id are one dialogue; repeated rows are turns of their own; marks inside a
text or name are broken up; very long texts are rendered whole; a dialogue of system turns only has no
rendering; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrid.llm.common import materialize

START, END = "<|im_start|>", "<|im_end|>"


def _clean(c: Column) -> Column:
    """Marks of the format that stand in a text lose their bar."""
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def ranked(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, speaker, body): pos counts the turns of a dialogue from 0."""
    name = F.trim(F.coalesce("role", F.lit("")))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(name == "", F.lit("unknown")).otherwise(_clean(name)).alias("speaker"), _clean(F.coalesce("text", F.lit(""))).alias("body"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    order = ["turn", "speaker", "body", "row"]
    parts = max(2, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the row number splits even a dialogue of equal turns
    dealt = rows.repartitionByRange(parts, "conv_id", *order).withColumn("range", F.spark_partition_id())
    dealt = materialize(dealt, "turns")
    within = dealt.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*[F.col(c).asc_nulls_first() for c in order])))
    sizes = dealt.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).select(F.col("conv_id").alias("c"), F.col("range").alias("r"), "before")
    joined = within.join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")))
    return joined.select("conv_id", (F.col("before") + F.col("n") - 1).alias("pos"), "speaker", "body")


def rotate(turns: DataFrame, part_turns: int = 256, system: str = "system") -> DataFrame:
    """Per dialogue, participant and part: conv_id, assistant, part, start (offset in the whole), n_turns, rendered, mask.

    mask: `from:to` spans of code points in the whole rendering, ends exclusive, comma-joined.
    """
    rows = materialize(ranked(turns).withColumn("part", F.floor(F.col("pos") / part_turns)), "ranked")
    people = rows.filter(F.col("speaker") != system).select(F.col("conv_id").alias("c"), F.col("speaker").alias("assistant")).distinct()
    heads = F.concat(F.lit(START), F.when(F.col("speaker") == system, F.lit("system")).when(F.col("speaker") == F.col("assistant"), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), F.col("speaker"))), F.lit("\n"))
    views = rows.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "assistant", "part", "pos", F.struct(F.col("pos"), heads.alias("head"), F.concat("body", F.lit(END)).alias("said"), (F.col("speaker") == F.col("assistant")).alias("own")).alias("t"))
    parts = views.groupBy("conv_id", "assistant", "part").agg(F.sort_array(F.collect_list("t")).alias("turns"))  # part_turns at most
    step = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["said"]) + 1).alias("at"),
            F.when(t["own"], F.array_append(acc["spans"], F.struct((acc["at"] + F.length(t["head"])).alias("a"), (acc["at"] + F.length(t["head"]) + F.length(t["said"])).alias("b")))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    whole = F.concat(F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["said"])), "\n"), F.lit("\n"))
    done = parts.select("conv_id", "assistant", "part", F.size("turns").cast("long").alias("n_turns"), whole.alias("rendered"), step.alias("s"))
    done = materialize(done.select("conv_id", "assistant", "part", "n_turns", "rendered", F.col("s.at").alias("size"), F.col("s.spans").alias("spans")), "parts")
    starts = offsets(done.select("conv_id", "assistant", "part", "size"))
    placed = done.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("assistant") == F.col("a")) & (F.col("part") == F.col("p")))
    spans = F.array_join(F.transform("spans", lambda x: F.concat((x["a"] + F.col("start")).cast("string"), F.lit(":"), (x["b"] + F.col("start")).cast("string"))), ",")
    return placed.select("conv_id", "assistant", "part", "start", "n_turns", "rendered", spans.alias("mask"))


def offsets(sizes: DataFrame, block: int = 1024) -> DataFrame:
    """Of sizes(conv_id, assistant, part, size): (c, a, p, start), the sum of the sizes before each part; by blocks of parts, then over the blocks."""
    rows = sizes.withColumn("block", F.floor(F.col("part") / block))
    up_to = lambda keys, order: F.coalesce(F.sum("size").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = rows.groupBy("conv_id", "assistant", "block").agg(F.sum("size").alias("size"))
    blocks = blocks.select(F.col("conv_id").alias("bc"), F.col("assistant").alias("ba"), F.col("block").alias("bb"), up_to(["conv_id", "assistant"], "block").alias("base"))
    inner = rows.select("conv_id", "assistant", "block", "part", up_to(["conv_id", "assistant", "block"], "part").alias("inner"))
    joined = inner.join(blocks, F.col("conv_id").eqNullSafe(F.col("bc")) & (F.col("assistant") == F.col("ba")) & (F.col("block") == F.col("bb")))
    return joined.select(F.col("conv_id").alias("c"), F.col("assistant").alias("a"), F.col("part").alias("p"), (F.col("base") + F.col("inner")).alias("start"))


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, CASE WHEN trim(coalesce(role, ''), ' ') = '' THEN 'unknown' ELSE replace(trim(role, ' '), '<|', '< |') END AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, body) - 1 AS pos FROM t),
p AS (SELECT DISTINCT conv_id, speaker AS assistant FROM r WHERE speaker <> 'system'),
v AS (
  SELECT r.conv_id, p.assistant, r.pos, r.pos // 256 AS part, r.speaker = p.assistant AS own,
         '<|im_start|>' || CASE WHEN r.speaker = 'system' THEN 'system' WHEN r.speaker = p.assistant THEN 'assistant' ELSE 'user name=' || r.speaker END || chr(10) AS head,
         r.body || '<|im_end|>' AS said
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(said) + 1) OVER (PARTITION BY conv_id, assistant ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM v)
SELECT conv_id, assistant, CAST(part AS BIGINT) AS part, CAST(min(off) AS BIGINT) AS start, count(*) AS n_turns,
       string_agg(head || said || chr(10), '' ORDER BY pos) AS rendered,
       coalesce(string_agg(CAST(off + length(head) AS BIGINT) || ':' || CAST(off + length(head) + length(said) AS BIGINT), ',' ORDER BY pos) FILTER (WHERE own), '') AS mask
FROM o GROUP BY conv_id, assistant, part
"""
