"""Filters and projections over memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrid.functions import policy, scores
from notegrid.storage import materialize


def surface_policy(memories: DataFrame, mode: str) -> DataFrame:
    """Per row: id, allowed, reasons (comma-joined)."""
    reasons = policy.denial_reasons(mode)
    return memories.select("id", (F.size(reasons) == 0).alias("allowed"), F.array_join(reasons, ",").alias("reasons"))


def domain_prefilter(memories: DataFrame, queries: DataFrame) -> DataFrame:
    """queries(query_id, domains): (query_id, id) of the rows of any asked domain.

    A query whose domains match nothing (or that asks for none) may use all rows; it has one row, with id null.
    """
    wanted = queries.select("query_id", F.explode("domains").alias("d")).select("query_id", F.lower("d").alias("d")).distinct()
    rows = memories.select("id", F.explode("domain").alias("d")).select("id", F.lower("d").alias("d"))
    hits = rows.join(wanted, "d").select("query_id", "id").distinct()
    without = queries.select("query_id").join(rows.select("d").distinct().join(wanted, "d").select("query_id"), "query_id", "left_anti")
    return hits.unionByName(without.select("query_id", F.lit(None).cast("string").alias("id")))


def tags_all(memories: DataFrame, tags: list[str]) -> DataFrame:
    return memories.filter(F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0)


def exact_ids(memories: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries whose text is a visible id give that row alone with score 1."""
    return queries.join(memories.filter(policy.allowed("search")).select("id"), F.trim("query") == F.col("id")).select("query_id", "id", F.lit(1.0).alias("score"))


def literal_matches(memories: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs where the lower-cased query stands in name, tags, domain or content.

    A text that holds a query holds its tokens (what blanks divide) but for the first and last as tokens of its own;
    the rarest of them anchors the query by an equi join, and only the pairs that meet there are looked at. A query
    of one or two tokens is anchored by the corpus's tokens that hold its longer one, which the rarest gram of that
    one finds among the distinct tokens in the same way.
    """
    text = F.lower(F.concat_ws(" ", "name", F.concat_ws(" ", "tags"), F.concat_ws(" ", "domain"), "content"))
    texts = memories.select("id", text.alias("t"))
    asked = materialize(queries.select("query_id", F.lower(F.trim("query")).alias("q")).filter("q <> ''"), "asked")
    tokens = texts.select("id", F.explode(F.array_distinct(F.split("t", " "))).alias("token")).filter("token <> ''")

    parts = F.split("q", " ")
    inner = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: x != "")
    whole = asked.select("query_id", F.explode(F.array_distinct(inner)).alias("token"))
    anchors = _rarest(whole, tokens, "token")
    short = asked.filter(F.size(inner) == 0)
    if short.limit(1).count():
        ends = F.array_sort(parts, lambda a, b: F.length(b) - F.length(a))
        piece = short.select("query_id", F.element_at(ends, 1).alias("piece"))
        sizes = [r["n"] for r in piece.select(F.least(F.length("piece"), F.lit(GRAM)).alias("n")).distinct().collect()]  # GRAM at most
        grams = lambda c: F.array_distinct(F.concat(*[_grams(c, n) for n in sizes]))
        held = tokens.select("token").distinct().select("token", F.explode(grams("token")).alias("gram"))
        own = piece.select("query_id", "piece", F.explode(grams("piece")).alias("gram")).filter(F.length("gram") == F.least(F.length("piece"), F.lit(GRAM)))
        near = _rarest(own.select("query_id", "gram"), held, "gram").join(piece, "query_id").join(held, "gram")
        anchors = anchors.unionByName(near.filter(F.contains("token", "piece")).select("query_id", "token"))
    met = tokens.join(materialize(anchors, "anchors"), "token").select("query_id", "id").distinct()
    return met.join(texts, "id").join(asked, "query_id").filter(F.contains("t", "q")).select("query_id", "id")


#: Length of the grams that a query without whole tokens is anchored by.
GRAM = 3


def _grams(c: str, n: int) -> Column:
    found = F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(F.col(c), i, F.lit(n)))
    return F.when(F.length(c) >= n, found).otherwise(F.array().cast("array<string>"))


def _rarest(wanted: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Of wanted(query_id, key): the key of each query that fewest rows of held have; none, if one of its keys isn't held at all."""
    seen = held.join(wanted.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    least = wanted.join(seen, key, "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), key)).alias("r"))
    return least.filter("r.n > 0").select("query_id", F.col(f"r.{key}").alias(key))


def startup_memories(memories: DataFrame, allow_digested: bool = False) -> DataFrame:
    reasons = policy.denial_reasons("spontaneous")
    ok = F.size(reasons) == 0
    if allow_digested:
        ok = ok | (F.size(F.array_except(reasons, F.array(F.lit("digested")))) == 0)
    return memories.filter(ok & ~F.col("type").isin(*policy.PRIVATE) & ~F.col("pinned"))


def neglected(at: Column, days: int = 7) -> Column:
    return ((F.col("activation_count") == 0) & (F.col("importance") >= 8)) | ((F.col("importance") >= 9) & (F.coalesce("last_active", "created") < at - F.expr(f"INTERVAL {days} DAYS")))


def recent(at: Column, hours: int = 48) -> Column:
    return F.col("created").between(at - F.expr(f"INTERVAL {hours} HOURS"), at)


def catalog(memories: DataFrame) -> DataFrame:
    """One line for each memory, in sections."""
    known = ["permanent", "feel", "plan", "letter", "i", "self", "dynamic"]
    section = F.when(F.col("type").isin(*known), F.col("type")).otherwise("dynamic")
    order = F.array_position(F.array(*map(F.lit, known)), section)
    line = F.concat(F.when(F.col("superseded_by").isNotNull(), "(old) ").otherwise(""), F.coalesce("name", "id"), F.lit(" ["), F.concat_ws("/", "domain"), F.lit("] "), F.col("importance").cast("string"))
    return memories.select("id", section.alias("section"), order.alias("section_order"), "importance", line.alias("line"))


def listing(memories: DataFrame, at: Column) -> DataFrame:
    """Overview rows: defaults filled, epoch milliseconds, score, 200-character preview."""
    return memories.select("id", "name", "type", "importance", F.unix_millis(F.col("created").cast("timestamp")).alias("created_ms"), scores.decay_score(at).alias("score"), F.substring("content", 1, 200).alias("preview"))


def active_plans(memories: DataFrame) -> DataFrame:
    return memories.filter((F.col("type") == "plan") & ~F.col("dont_surface") & ~F.col("resolved"))


def letters(memories: DataFrame, since: str, until: str, contains: str | None = None) -> DataFrame:
    """Letters by date; dates compare as text."""
    day = F.date_format("created", "yyyy-MM-dd")
    out = memories.filter((F.col("type") == "letter") & (day >= since) & (day <= until))
    return out.filter(F.contains(F.lower("content"), F.lit(contains.lower()))) if contains else out


def metric_allowlist(metrics: DataFrame, allowed: list[str], forbidden: list[str], bad_labels: list[str]) -> DataFrame:
    """metrics(name, labels map): forbidden_label, forbidden_name, unknown or allowed."""
    verdict = F.when(F.arrays_overlap(F.map_keys("labels"), F.array(*map(F.lit, bad_labels))), "forbidden_label").when(F.col("name").isin(*forbidden), "forbidden_name").when(~F.col("name").isin(*allowed), "unknown").otherwise("allowed")
    return metrics.select("*", verdict.alias("verdict"))


def first_in_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")
