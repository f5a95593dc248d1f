"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Sources weigh by their order (by code point, null last) and share `share` of all words by weight. A target
stops at `most` times its source's words; the excess goes to the others by weight until none is above. That
is one level for all: target = least of most x size and weight x level, so the sources that stop are the
first ones in the order of most x size / weight, and the level follows from their running sums.

Every document of a source is expected target / source size times. The expected copies are summed up over
the source's documents, largest first, a random offset in [0, 1) is added, and a document is emitted once for
each whole number that its step crosses. As copies and size go by the same order, the taken words miss the
target by about one document at most. Sums are whole numbers of 1/2^24, so a step never depends on rounding.

Ranks and running sums come from a range partitioning (two levels: within the range, over the ranges), for
documents and sources alike, so no task holds a source and no window spans more than one range or the list of
ranges.

Defined results: a null text has size 0; documents of size 0 are expected like the others and take no words;
a source of size 0 has target 0 and a table without words takes nothing; equal rows are documents of their
own; rows of a null id count; very long texts are taken whole; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrid.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Parts that a copy is divided into.
UNIT = 1 << 24
SEED = "mix"


def ranges(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """df dealt by ranges of the order, written, with its range number."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return materialize(df.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), name)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """df with the sums over the rows before each one, in the order."""
    dealt = ranges(df, *order, name=name)
    totals = dealt.groupBy("range").agg(*[F.sum(c).alias(f"all_{k}") for k, c in sums.items()])
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = totals.select("range", *[F.coalesce(F.sum(f"all_{k}").over(earlier), F.lit(0)).alias(f"all_{k}") for k in sums])
    before = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumns({k: F.coalesce(F.sum(c).over(before), F.lit(0)) for k, c in sums.items()})
    return inner.join(totals, "range").withColumns({k: F.col(k) + F.col(f"all_{k}") for k in sums}).drop("range", *[f"all_{k}" for k in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Per source of sizes(source, size): source, source_size, target."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = running(sources, [F.col("source").asc_nulls_last()], {"place": F.lit(1)}, "sources")
    weighed = placed.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    weighed = materialize(weighed.withColumn("cap", F.col("source_size") * most), "weights")
    whole = weighed.agg((F.sum("source_size") * share).alias("wanted"), F.sum("weight").alias("weights"))
    stop = F.col("cap") / F.col("weight")
    summed = running(weighed, [stop.asc(), F.col("source").asc_nulls_last()], {"caps": F.col("cap"), "weights_before": F.col("weight")}, "levels").join(F.broadcast(whole))
    level = (F.col("wanted") - F.col("caps")) / (F.col("weights") - F.col("weights_before"))
    # the rows that don't stop all see the same level but for later caps; the first of them has it
    level = summed.filter(stop >= level).agg(F.min_by(level, F.struct(stop, F.col("source").isNull(), "source")).alias("level"))  # one row
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap").cast("double")))
    return weighed.join(F.broadcast(level)).select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size")), "sizes")
    goals = targets(sizes, weights, share, most)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}|"), F.coalesce("source", F.lit("")))), 1, 6), 16, 10).cast("long")
    step = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0)
    goals = goals.select("source", "source_size", "target", step.alias("step"), offset.alias("offset"))

    # rows alike in these are interchangeable; the row number splits even a source of equal rows
    rows = sizes.withColumn("row", F.monotonically_increasing_id())
    order = [F.col("size").desc(), F.col("doc_id").asc_nulls_first(), F.col("row")]
    dealt = ranges(rows, F.col("source").asc_nulls_last(), *order, name="dealt").withColumns({"named": F.col("source").isNotNull(), "source": F.coalesce("source", F.lit(""))})
    key = ["named", "source", "range"]
    counts = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("named", "source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    goals = goals.withColumns({"named": F.col("source").isNotNull(), "source": F.coalesce("source", F.lit(""))})
    known = counts.join(goals, ["named", "source"])
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) + F.col("before")
    crossed = lambda n: F.shiftright(n * F.col("step") + F.col("offset"), 24)
    joined = dealt.join(known, key).withColumn("nth", nth)
    return joined.withColumn("copies", crossed(F.col("nth")) - crossed(F.col("nth") - 1)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2 * source_size AS cap, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
r AS (SELECT *, cap::DOUBLE / weight AS stop, row_number() OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST) AS k FROM w),
c AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0)) AS level
      FROM r WINDOW b AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(level, k) AS level FROM c WHERE stop >= level),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(weight * (SELECT level FROM v), cap::DOUBLE)) AS target FROM w),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 16777216) AS BIGINT) ELSE 0 END AS step,
             CAST('0x' || substring(md5('mix|' || coalesce(source, '')), 1, 6) AS BIGINT) AS off FROM t),
n AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.step, g.off, row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id NULLS FIRST) AS nth
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (((nth * step + off) >> 24) - (((nth - 1) * step + off) >> 24)) * size AS taken,
       ((nth * step + off) >> 24) - (((nth - 1) * step + off) >> 24) AS copies FROM n
"""
