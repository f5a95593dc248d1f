"""Ordered operators: budgets, quotas, selections and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegrid.functions.text import token_estimate
from notegrid.operators.similarity import cosine
from notegrid.storage import materialize


def budget_prefix(ranked: DataFrame, group: str, budget: int) -> DataFrame:
    """ranked(group, rank, id, tokens): rows up to the first that doesn't fit."""
    spent = F.sum("tokens").over(Window.partitionBy(group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("spent", spent).filter(F.col("spent") <= budget)


def budget_greedy(ranked: DataFrame, group: str, budget: int, most: int = 200) -> DataFrame:
    """ranked(group, rank, id, tokens), at most `most` rows a group: every row that fits what is left, in order."""
    lists = ranked.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "tokens"))).alias("rows"))
    checked = F.when(F.size("rows") > most, F.raise_error(F.lit("cap the candidates of a group first"))).otherwise(F.col("rows"))
    fold = F.aggregate(
        checked,
        F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<string>").alias("kept")),
        lambda acc, r: F.struct(
            F.when(r["tokens"] <= acc["left"], acc["left"] - r["tokens"]).otherwise(acc["left"]).cast("long").alias("left"),
            F.when(r["tokens"] <= acc["left"], F.array_append(acc["kept"], r["id"])).otherwise(acc["kept"]).alias("kept"),
        ),
    )
    return lists.select(group, fold.alias("f")).select(group, F.posexplode("f.kept").alias("pos", "id"))


def importance_reserved(memories: DataFrame, least: int, limit: int) -> DataFrame:
    """The newest row of each level first, then by order, up to the limit."""
    order = [F.desc("importance"), F.desc("created"), F.desc("id")]
    rows = memories.filter(F.col("importance") >= least)
    heads = rows.groupBy("importance").agg(F.max(F.struct("created", "id")).alias("h")).select(F.col("h.id").alias("id"), F.lit(0).alias("reserved"))  # a row a level
    pool = rows.orderBy(*order).limit(limit).select("id", "importance", "created").unionByName(rows.join(F.broadcast(heads), "id", "left_semi").select("id", "importance", "created")).distinct()
    marked = pool.join(heads, "id", "left").withColumn("late", F.coalesce("reserved", F.lit(1)))
    return marked.orderBy("late", *order).limit(limit).select("id", "importance")


def canonical_rows(rows: DataFrame) -> DataFrame:
    """rows(id, path): the first of each id by path; blank ids all stay."""
    blank = F.trim(F.coalesce("id", F.lit(""))) == ""
    first = rows.filter(~blank).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("path"))).filter("n = 1").drop("n")
    return first.unionByName(rows.filter(blank))


def admit(requests: DataFrame, held: int, cap: int, soft: int) -> DataFrame:
    """requests(seq, id): admitted while the pool is below the cap, with a warning from the soft mark.

    Only the first cap - held requests can be admitted, so the numbering runs over that many rows.
    """
    room = max(0, cap - held)
    first = requests.orderBy("seq").limit(room).withColumn("n", F.row_number().over(Window.orderBy("seq")) + held).select("seq", "n") if room else requests.select("seq", F.lit(0).alias("n")).limit(0)
    out = requests.join(F.broadcast(first), "seq", "left")
    return out.select("seq", "id", F.col("n").isNotNull().alias("admitted"), (F.coalesce("n", F.lit(cap + 1)) > soft).alias("warned"))


def running_max(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """rows with `before`, the highest value of the group's earlier rows (null for the first).

    Within the ranges of one range partitioning, then over the ranges, so a group may be of any size.
    """
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialize(rows.repartitionByRange(parts, group, order).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = lambda keys, by: F.max(value).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    inner = dealt.withColumn("_inner", earlier([group, "_range"], order))
    tops = dealt.groupBy(group, "_range").agg(F.max(value).alias(value))
    tops = tops.select(group, "_range", earlier([group], "_range").alias("_outer"))
    return inner.join(tops, [group, "_range"]).withColumn("before", F.greatest("_inner", "_outer")).drop("_inner", "_outer", "_range")


def _steps(tokens: np.ndarray, target: int, big: int) -> list[tuple[int, int, int, int, bool]]:
    """What turns do to each number of tokens held before them: (lo, hi, exit, chunks begun, whether exit adds to what was held).

    target + 1 stands for a chunk that takes no more. From a turn that begins a chunk the next such turn follows from
    sums alone; the turns that can be the first are those within `target` tokens, and all are followed side by side.
    """
    m, full = len(tokens), target + 1
    upto = np.cumsum(tokens)
    large = np.flatnonzero(tokens > big)
    after = np.where(tokens > big, full, np.minimum(tokens, full))
    # the first turn behind each that doesn't fit, or is large
    free = np.searchsorted(upto, upto + (target - after), side="right")
    following = np.append(large, m)[np.searchsorted(large, np.arange(m), side="right")]
    following = np.maximum(np.minimum(free, following), np.arange(1, m + 1))
    # held tokens 0..full: the first turn at which each breaks (m: none)
    held = np.arange(full + 1)
    first = np.minimum(np.searchsorted(upto, target - held, side="right"), large[0] if len(large) else m)
    starts = np.unique(first[first < m])
    at, begun = starts.copy(), np.zeros(len(starts), np.int64)
    last, going = starts.copy(), np.arange(len(starts))
    while len(going):
        last[going], begun[going] = at[going], begun[going] + 1
        at[going] = following[at[going]]
        going = going[at[going] < m]
    exits = np.minimum(after[last] + upto[-1] - upto[last], full) if len(starts) else starts
    out = []
    passing = held[first == m]
    if len(passing):
        out.append((0, int(passing[-1]), int(upto[-1]), 0, True))
    for k, j in enumerate(starts):
        own = held[first == j]
        out.append((int(own[0]), int(own[-1]), int(exits[k]), int(begun[k]), False))
    return out


def chunk_turns(turns: DataFrame, target: int) -> DataFrame:
    """turns(conv_id, turn, tokens): number of the chunk of each turn.

    A turn over 1.5 times the target is a chunk of its own; others are packed in order up to the target. Null tokens
    count as none, null ids are one dialogue, null turns come first; equal turns go by tokens.

    The turns are dealt by ranges of (dialogue, turn), so a dialogue of any size fills many tasks. Of a range's first
    and last dialogue, which may go on in other ranges, one task each works out what the range does to every number of
    tokens held before it (at most target + 2 steps); a pass over these steps gives each range's own start, and the
    ranges are folded from there. The steps are a few rows for each range, and the ranges as many as
    spark.sql.shuffle.partitions says.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    big, full, kind = int(target * 1.5), target + 1, rows.schema["conv_id"].dataType
    order = ["_range", "conv_id", "turn", "tokens"]
    dealt = materialize(rows.repartitionByRange(parts, "conv_id", "turn", "tokens").withColumn("_range", F.spark_partition_id()), "turns")
    edge = F.struct("conv_id")
    edges = dealt.groupBy("_range").agg(F.min(edge).alias("low"), F.max(edge).alias("high"))  # a row a range
    open_ = dealt.join(F.broadcast(edges), "_range").filter(F.col("conv_id").eqNullSafe(F.col("low.conv_id")) | F.col("conv_id").eqNullSafe(F.col("high.conv_id"))).select(*order)
    steps_schema = T.StructType().add("_range", "integer").add("conv_id", kind).add("lo", "long").add("hi", "long").add("exit", "long").add("begun", "long").add("adds", "boolean")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(type of dialogues, range, dialogue, tokens) of ordered rows."""
        own, held, c_type = None, [], None
        for batch in batches:
            c_type = batch.schema.field("conv_id").type
            r, c, n = batch.column("_range").to_numpy(), batch.column("conv_id").to_pylist(), batch.column("tokens").to_numpy()
            cuts = [0, *(i for i in range(1, len(c)) if r[i] != r[i - 1] or c[i] != c[i - 1]), len(c)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                key = (int(r[x]), c[x])
                if key != own and held:
                    yield c_type, *own, np.concatenate(held)
                    held = []
                own = key
                held.append(n[x:y])
        if held:
            yield c_type, *own, np.concatenate(held)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c_type, r, c, tokens in pieces(batches):
            columns = list(zip(*[(r, c, *s) for s in _steps(tokens, target, big)], strict=True))
            types = [pa.int32(), c_type, *[pa.int64()] * 4, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=steps_schema.names)

    steps = open_.repartition("_range").sortWithinPartitions(*order).mapInArrow(sum_up, steps_schema)
    entry_schema = T.StructType().add("_range", "integer").add("conv_id", kind).add("held", "long").add("chunk", "long")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, held, chunk, at = None, True, full, -1, None
        for batch in batches:
            out = []
            for s in batch.to_pylist():
                if first or s["conv_id"] != own:
                    own, first, held, chunk, at = s["conv_id"], False, full, -1, None
                if s["_range"] != at and s["lo"] <= held <= s["hi"]:
                    out.append((s["_range"], own, held, chunk))
                    held, chunk, at = s["exit"] + (held if s["adds"] else 0), chunk + s["begun"], s["_range"]
            types = [pa.int32(), batch.schema.field("conv_id").type, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names=entry_schema.names)

    entries = materialize(steps.repartition("conv_id").sortWithinPartitions("conv_id", "_range", "lo").mapInArrow(follow, entry_schema), "entries")
    known = entries.select(F.col("_range").alias("_r"), F.col("conv_id").alias("_c"), "held", "chunk")  # two rows a range at most
    met = dealt.join(F.broadcast(known), (F.col("_range") == F.col("_r")) & F.col("conv_id").eqNullSafe(F.col("_c")), "left").select(*order, "held", "chunk")
    schema = rows.drop("tokens").schema.add("chunk", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, chunk = None, full, -1
        for batch in batches:
            out = []
            for r, conv, n, h, k in zip(*(batch.column(c).to_pylist() for c in ("_range", "conv_id", "tokens", "held", "chunk")), strict=True):
                if (r, conv) != own:
                    own, held, chunk = (r, conv), full if h is None else h, -1 if k is None else k
                fresh = n > big or held + n > target
                chunk, held = chunk + fresh, full if n > big else min(n if fresh else held + n, full)
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(out, pa.int32())], names=["conv_id", "turn", "chunk"])

    return met.repartition("_range").sortWithinPartitions(*order).mapInArrow(run, schema)


def chunks(turns: DataFrame, target: int, label: str = "user") -> DataFrame:
    """turns(conv_id, turn, role, content, ts string), turn unique in its dialogue: (conv_id, chunk, content, start, end, turn_count).

    Lines are "[who] content", the user's under `label`; a chunk holds 1.5 times the target at most. start is the first
    time that isn't blank, end that of the last turn, both '' if there is none.
    """
    who = F.when(F.lower("role").isin("user", "human"), F.lit(label)).otherwise("AI")
    lines = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.concat(F.lit("["), who, F.lit("] "), F.coalesce("content", F.lit(""))).alias("line"), F.coalesce("ts", F.lit("")).alias("ts"))
    numbered = chunk_turns(lines.select("conv_id", "turn", token_estimate(F.col("line")).alias("tokens")), target)
    met = lines.join(numbered.hint("merge"), lines["conv_id"].eqNullSafe(numbered["conv_id"]) & lines["turn"].eqNullSafe(numbered["turn"])).select(lines["conv_id"], lines["turn"], "line", "ts", "chunk")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    start = F.coalesce(F.min_by(F.when(F.col("ts") != "", F.col("ts")), F.when(F.col("ts") != "", F.col("turn"))), F.lit(""))
    return met.groupBy("conv_id", "chunk").agg(F.array_join(texts, "\n").alias("content"), start.alias("start"), F.max_by("ts", "turn").alias("end"), F.count(F.lit(1)).alias("turn_count"))


def daily_sources(rows: DataFrame, each: int, total: int) -> DataFrame:
    """rows(day, pos, id, content): texts of a day in order, cut to `each` and together to `total` characters."""
    size = F.least(F.length("content"), F.lit(each))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("day").orderBy("pos", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = rows.withColumn("size", size).withColumn("take", F.greatest(F.lit(0), F.least(F.col("size"), F.lit(total) - before)))
    return cut.filter("take > 0").select("day", "id", F.col("take").cast("long").alias("chars"))


def reflection(memories: DataFrame, shown: DataFrame, at: Column, n: int = 2) -> DataFrame:
    """Recent unresolved, undigested rows that weren't shown."""
    fresh = memories.filter(F.col("created").between(at - F.expr("INTERVAL 48 HOURS"), at) & ~F.col("resolved") & ~F.col("digested"))
    return fresh.join(shown.select("id"), "id", "left_anti").orderBy(F.desc("created"), "id").limit(n).select("id")


def pending_days(sources: DataFrame, done: DataFrame) -> DataFrame:
    """sources(day, id, revision): days whose sources differ from what was last worked on (done(day, signature))."""
    now = sources.groupBy("day").agg(F.bit_xor(F.xxhash64("id", "revision")).alias("signature"))
    return now.join(done, ["day", "signature"], "left_anti").select("day")


def diverse_pick(candidates: DataFrame, group: str, most: int = 3, most_low: int = 2, cap: int = 24) -> DataFrame:
    """candidates(group, rank, id, words, embedding or null, valence), at most `cap` a group: in order, skipping a row of
    the theme of one that is kept, and a third row of low valence.

    Of one theme are rows whose vectors have a cosine of 0.8, or that share two words and 0.6 of the smaller list.
    """
    fields = F.struct("rank", "id", "words", F.col("embedding").cast("array<double>").alias("embedding"), "valence")
    lists = candidates.groupBy(group).agg(F.array_sort(F.collect_list(fields)).alias("rows"))
    checked = F.when(F.size("rows") > cap, F.raise_error(F.lit("cap the candidates of a group first"))).otherwise(F.col("rows"))

    def alike(x, r):
        shared = F.size(F.array_intersect(x["words"], r["words"]))
        smaller = F.least(F.size(x["words"]), F.size(r["words"]))
        near = x["embedding"].isNotNull() & r["embedding"].isNotNull() & (cosine(x["embedding"], r["embedding"]) >= 0.8)
        return F.coalesce(near, F.lit(False)) | ((shared >= 2) & (shared >= 0.6 * smaller))

    def step(acc, r):
        low = (r["valence"] < 0.4).cast("int")
        take = (F.size(acc["kept"]) < most) & ~F.exists(acc["kept"], lambda x: alike(x, r)) & (acc["low"] + low <= most_low)
        return F.struct(F.when(take, F.array_append(acc["kept"], r)).otherwise(acc["kept"]).alias("kept"), F.when(take, acc["low"] + low).otherwise(acc["low"]).alias("low"))

    start = F.struct(F.slice(F.col("rows"), 1, 0).alias("kept"), F.lit(0).alias("low"))
    return lists.select(group, F.aggregate(checked, start, step).alias("f")).select(group, F.posexplode("f.kept").alias("pos", "r")).select(group, "pos", F.col("r.id").alias("id"))


def with_fallback(first: DataFrame, second: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """Rows of `first`, then of `second` (both with group and id), up to n a group without repeats."""
    both = first.select(group, "id", F.lit(0).alias("_p"), *[c.alias(f"_o{i}") for i, c in enumerate(order)]).unionByName(second.select(group, "id", F.lit(1).alias("_p"), *[c.alias(f"_o{i}") for i, c in enumerate(order)]))
    once = both.withColumn("_n", F.row_number().over(Window.partitionBy(group, "id").orderBy("_p"))).filter(F.col("_n") == 1)
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("_p", *[F.col(f"_o{i}") for i in range(len(order))], "id")).cast("long"))
    return ranked.filter(F.col("rank") <= n).select(group, "id", "rank")


def trim_tail(entries: DataFrame, budget: int) -> DataFrame:
    """entries(day, part, pos, tokens): whole entries go from the tail (part 3, then 2, then 1) until the rest fits."""
    order = Window.partitionBy("day").orderBy("part", "pos").rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("spent", F.sum("tokens").over(order)).filter(F.col("spent") <= budget).drop("spent")
