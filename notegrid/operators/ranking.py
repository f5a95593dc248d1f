"""Rankings, top lists and samples over memories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrid.functions import policy, scores


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows with their rank; the limit comes first, so the ranking sees n rows only."""
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def decay_top(memories: DataFrame, at: Column, n: int) -> DataFrame:
    scored = memories.filter(policy.allowed("spontaneous")).select("id", F.round(scores.decay_score(at) * F.when(F.col("resolved"), 0.3).otherwise(1.0), 4).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(n)


def gated_score(memories: DataFrame, features: list[tuple[Column, float]], gates: list[Column], mode: str) -> DataFrame:
    """Weighted sum of features times clamped gates; a row that the policy denies scores 0."""
    total = F.round(reduce(lambda a, b: a + b, [c * w for c, w in features]), 6)
    gate = reduce(lambda a, b: a * b, [F.least(F.lit(1.0), F.greatest(F.lit(0.0), g)) for g in gates])
    return memories.select("id", total.alias("candidate"), F.when(policy.allowed(mode), F.round(total * gate, 6)).otherwise(0.0).alias("surface"))


def surface_order(memories: DataFrame, at: Column, n: int, cold: int = 2) -> DataFrame:
    """Unresolved rows by score, recency, feeling and importance; up to `cold` never-used important rows first."""
    pool = memories.filter(policy.allowed("spontaneous") & ~F.col("resolved") & ~F.col("pinned")).withColumn("score", scores.decay_score(at))
    first = pool.filter((F.col("activation_count") == 0) & (F.col("importance") >= 8)).orderBy("id").limit(cold).select("id", F.lit(0).alias("early"))
    ranked = pool.join(F.broadcast(first), "id", "left").withColumn("later", F.coalesce("early", F.lit(1)))
    order = [F.col("later"), F.when(F.col("later") == 0, F.col("id")), F.desc("score"), F.desc("last_active"), F.desc(F.col("arousal") * F.col("valence")), F.desc("importance"), F.col("id")]
    return top_rows(ranked, order, n).select("rank", "id")


def letters_ranked(letters: DataFrame, queries: DataFrame, close: DataFrame, n: int = 50) -> DataFrame:
    """queries(query_id, query), close(query_id, id, semantic): the n best letters of each query by vector; for a query
    without any, those that hold its words, newest first."""
    plain = queries.join(close.select("query_id"), "query_id", "left_anti")
    held = letters.select("id", "created", F.lower("content").alias("t")).join(plain, F.contains("t", F.lower("query"))).select("query_id", "id", F.lit(None).cast("double").alias("score"), "created")
    both = close.select("query_id", "id", F.col("semantic").alias("score"), F.lit(None).cast("timestamp_ntz").alias("created")).unionByName(held)
    order = [F.desc(F.round("score", 6)), F.desc("created"), F.col("id")]
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long")).filter(F.col("rank") <= n).select("query_id", "id", "score", "rank")


def plans_ranked(memories: DataFrame, at: Column, stale_days: int, n: int) -> DataFrame:
    """Active plans, stale ones first, with the number of all of them."""
    plans = memories.filter((F.col("type") == "plan") & ~F.col("dont_surface") & ~F.col("resolved"))
    total = plans.agg(F.count(F.lit(1)).alias("total"))  # one row
    stale = F.col("created") + F.expr(f"INTERVAL {stale_days} DAYS") <= at
    return plans.orderBy(F.desc(stale), F.desc("importance"), "created", "id").limit(n).join(F.broadcast(total)).select("id", "total")


def weighted_sample(df: DataFrame, weight: str, n: int, temperature: float = 1.0, seed: int = 0, key: str = "id") -> DataFrame:
    """n rows without replacement, likelier by weight^(1/temperature): the n smallest -ln(u)/w, u by digest of seed and key."""
    w = F.pow(F.greatest(F.col(weight), F.lit(1e-9)), F.lit(1.0 / temperature))
    return df.withColumn("_k", -F.log(seeded(seed, key)) / w).orderBy("_k", key).limit(n).drop("_k")


def classify(docs: DataFrame, keywords: dict[str, list[str]], least: int = 2, most: int = 2) -> DataFrame:
    """Domains of which at least so many keywords stand in the text, most hits first (comma-joined; empty: none)."""
    low = F.lower("text")
    hits = [F.struct((-reduce(lambda a, b: a + b, [F.contains(low, F.lit(k)).cast("int") for k in ks])).alias("n"), F.lit(d).alias("d")) for d, ks in keywords.items()]
    ranked = F.slice(F.array_sort(F.filter(F.array(*hits), lambda x: x["n"] <= -least)), 1, most)
    return docs.select("doc_id", F.array_join(F.transform(ranked, lambda x: x["d"]), ",").alias("domains"))


def render_summary(js: Column) -> Column:
    """Structured summary JSON as lines; other text stays as it is."""
    s = F.from_json(js, "summary string, facts array<string>, todo string")
    return F.when(s["summary"].isNotNull(), F.concat_ws("\n", s["summary"], F.array_join(F.transform(s["facts"], lambda x: F.concat(F.lit("- "), x)), "\n"), F.concat(F.lit("Todo: "), s["todo"]))).otherwise(js)


def seeded(seed: Column | int, key: str = "id") -> Column:
    """A number in 0..1 from a seed and a key, the same on every run and in every engine: 13 hexadecimal digits of md5."""
    s = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    digits = F.substring(F.md5(F.concat_ws("|", s, F.col(key).cast("string"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


#: seeded() for DuckDB.
SEEDED_SQL = "((CAST('0x' || substring(md5('{0}|' || CAST({1} AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def shuffle_head(ranked: DataFrame, head: int, seed: int) -> DataFrame:
    """ranked(rank, id): rank 1 stays, ranks up to head are shuffled, the rest stays; the new order as pos."""
    part = F.when(F.col("rank") == 1, 0).when(F.col("rank") <= head, 1).otherwise(2)
    first = ranked.filter(F.col("rank") <= head).withColumn("pos", F.row_number().over(Window.orderBy(part, seeded(seed), "id")).cast("long"))  # head rows
    return first.select("pos", "id").unionByName(ranked.filter(F.col("rank") > head).select(F.col("rank").alias("pos"), "id"))


def random_rows(pool: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows of a pool by seeded hash order."""
    return pool.withColumn("_u", seeded(seed)).orderBy("_u", "id").limit(n).drop("_u")


def encounters(sessions: DataFrame, pool: DataFrame, chance: float, n: int, seed: int) -> DataFrame:
    """sessions(session): by chance, n random rows of a pool that is the same for all; each session draws its own.

    A session starts at its own place of the pool's hash order and takes the n rows that follow, so a session
    costs n rows, not the pool.
    """
    size = pool.agg(F.count(F.lit(1)).alias("size"))  # one row
    drawn = sessions.filter(seeded(seed, "session") < chance).join(F.broadcast(size)).filter("size > 0")
    start = F.floor(seeded(seed + 1, "session") * F.col("size"))
    picks = drawn.select("session", F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(n), F.col("size").cast("int")) - 1), lambda k: F.pmod(start + k, F.col("size")))).alias("slot"))
    slots = pool.select("id", "slot")
    return picks.join(slots, "slot").select("session", "id")


def startup_slots(memories: DataFrame, at: Column, seed: int = 0, exclude: str = "") -> DataFrame:
    """Slot 1: newest of the last day; 2 and 3: by importance; 4: one random neglected row of the first 20."""
    from notegrid.operators.predicates import neglected, startup_memories

    pool = startup_memories(memories)
    one = pool.filter(F.col("created").between(at - F.expr("INTERVAL 24 HOURS"), at)).orderBy(F.desc("created"), "id").limit(1).select(F.lit(1).alias("slot"), "id")
    rest = pool.join(F.broadcast(one.select("id")), "id", "left_anti")
    two = top_rows(rest, [F.desc("importance"), F.desc("created"), F.col("id")], 2).select((F.col("rank") + 1).cast("int").alias("slot"), "id")
    left = rest.join(F.broadcast(two.select("id")), "id", "left_anti").filter(neglected(at) & ~F.col("resolved") & (F.col("id") != exclude))
    four = random_rows(left.orderBy(F.desc("importance"), "id").limit(20), 1, seed).select(F.lit(4).alias("slot"), "id")
    return one.unionByName(two).unionByName(four)


def keyword_overlap(a: Column, b: Column, least: int = 2) -> Column:
    """Shared words over the smaller set; 0 with fewer than `least` shared."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((shared < least) | (F.least(F.size(a), F.size(b)) == 0), 0.0).otherwise(shared / F.least(F.size(a), F.size(b)))


def feel_relevance(feels: DataFrame, n: int = 5, threshold: float = 0.5) -> DataFrame:
    """feels(reference, id, cosine or null, overlap): 0.7 cosine + 0.3 overlap, or the overlap alone without a vector."""
    score = F.when(F.col("cosine").isNotNull(), 0.7 * F.col("cosine") + 0.3 * F.col("overlap")).otherwise(F.col("overlap"))
    rows = feels.withColumn("score", F.round(score, 6)).filter(F.col("score") >= threshold)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("reference").orderBy(F.desc("score"), "id")).cast("long")).filter(F.col("rank") <= n).select("reference", "id", "score", "rank")
