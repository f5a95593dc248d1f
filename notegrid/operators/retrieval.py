"""Hybrid retrieval for many queries at once: BM25, fuzzy text, vectors and metadata, fused."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrid.functions import scores
from notegrid.storage import materialize

# fixed values of the fusion: weights of topic, emotion, time, importance, touch, semantic, BM25
W_TOPIC, W_EMOTION, W_TIME, W_IMPORTANCE, W_TOUCH, W_SEMANTIC, W_BM25 = 4.0, 2.0, 1.5, 1.0, 1.0, 2.5, 1.5
LITERAL_BONUS, TEXT_THRESHOLD, SEMANTIC_THRESHOLD, RESOLVED_FACTOR, SUPERSEDED_FACTOR = 25.0, 50.0, 0.55, 0.3, 0.12
K1, B, EPSILON = 1.5, 0.75, 0.25
TEXTS_A_TASK, BYTES_A_TASK, POSTINGS_A_TASK = 4096, 5_000_000, 200_000
#: Characters of a content that the search's BM25 reads, as the reference's does; BM25 of its own reads all.
SEARCHED = 1200


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def index_text(chars: int | None = None) -> Column:
    """The text that a row is found by, with the whole content or its first characters."""
    content = F.col("content") if chars is None else F.substring("content", 1, chars)
    return F.concat_ws(" ", "name", content, F.concat_ws(" ", "tags"), F.concat_ws(" ", "domain"))


def postings(memories: DataFrame, chars: int | None = None) -> DataFrame:
    """(id, dl, token, tf, first) of the indexed texts, written once; `first` marks one row of each text."""
    texts = memories.select("id", index_text(chars).alias("x"))
    held = texts.agg(F.count("x").alias("texts"), F.sum(F.octet_length("x")).alias("bytes")).first()
    parts = max(1, -(-held["texts"] // TEXTS_A_TASK), -(-(held["bytes"] or 0) // BYTES_A_TASK))
    docs = texts.repartition(parts, "id")  # texts move, not tokens, and a task's counts stay few
    docs = docs.select("id", tokens(F.col("x")).alias("t")).filter(F.size("t") > 0)
    each = docs.select("id", F.size("t").alias("dl"), F.posexplode("t").alias("pos", "token"))
    return materialize(each.groupBy("id", "dl", "token").agg(F.count(F.lit(1)).alias("tf"), (F.min("pos") == 0).alias("first")), "postings")


def _raw_scores(memories: DataFrame, queries: DataFrame, chars: int | None) -> DataFrame:
    """(query_id, id, raw): the BM25 sums, written.

    The corpus is cut into tokens once; document frequencies, the floor and the statistics come from the written
    postings, and only postings of terms that a query holds are joined.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
    post = postings(memories, chars)
    stats = post.filter("first").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))  # one row
    often = post.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = materialize(often.join(F.broadcast(stats)).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "idf")
    floor = idf.agg((F.avg("idf") * EPSILON).alias("floor"))  # one row
    weight = idf.join(F.broadcast(floor)).select("token", "avgdl", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"))
    terms = materialize(asked.join(weight, "token"), "terms")
    # all asked postings of a row in one task, so its scores are summed up there, in tasks of bounded size
    parts = max(1, -(-post.count() // POSTINGS_A_TASK))
    met = post.select("id", "dl", "token", "tf").join(terms.select("token").distinct(), "token", "left_semi")
    hit = terms.join(met.repartition(parts, "id"), "token")
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return materialize(hit.groupBy("query_id", "id").agg(F.sum(part).alias("raw")), "raw")


def bm25(memories: DataFrame, queries: DataFrame, chars: int | None = SEARCHED) -> DataFrame:
    """queries(query_id, query): (query_id, id, bm25), the best row of each query at 1, scores above 0 only; chars: None for whole contents."""
    raw = _raw_scores(memories, queries, chars)
    top = materialize(raw.groupBy("query_id").agg(F.max("raw").alias("top")), "top")  # written, so that its size is known and raw can stay where it is
    return raw.join(top, "query_id").filter((F.col("top") > 0) & (F.col("raw") > 0)).select("query_id", "id", (F.col("raw") / F.col("top")).alias("bm25"))


def first_by_bm25(memories: DataFrame, queries: DataFrame, most: int = 10, slices: int = 64) -> DataFrame:
    """(query_id, id, rank) of the first rows of each query, by whole contents; taken first in slices, as a query may hit every row.

    The best rows of the slices are rows of their own, so none of the first is below the `most`-th of them.
    """
    raw = _raw_scores(memories, queries, None).withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)))
    best = raw.groupBy("query_id", "slice").agg(F.max("raw").alias("raw")).groupBy("query_id").agg(F.sort_array(F.collect_list("raw"), asc=False).alias("best"))  # a value a slice
    least = F.coalesce(F.try_element_at("best", F.lit(most)), F.lit(0.0)) - 2e-9 * F.col("best")[0]  # scores have nine digits
    top = materialize(best.select("query_id", F.col("best")[0].alias("top"), least.alias("least")).filter("top > 0"), "top")
    found = raw.join(top, "query_id").filter("raw > 0 AND raw >= least").select("query_id", "id", F.round(F.col("raw") / F.col("top"), 9).alias("score"), "slice")
    for key in (["query_id", "slice"], ["query_id"]):
        found = found.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "id"))).filter(F.col("n") <= most)
    return found.select("query_id", "id", F.col("n").cast("long").alias("rank"))


def partial_ratio(a: str, b: str) -> float:
    """Best similarity, 0 to 100, of the shorter text with a window of the longer: 2 * LCS / (len + len)."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not a:
        return 0.0
    m = len(a)
    x = np.frombuffer(a.encode("utf-32-le"), "<u4")
    y = np.frombuffer(b.encode("utf-32-le"), "<u4")
    # windows of the length of a, and the shorter ones at either end (padded with a sign that never matches)
    pad = np.full(m - 1, 0xFFFFFFFF, np.uint32)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, y, pad]), m)
    row = np.zeros((len(windows), m + 1), np.int32)
    for c in x:
        same = windows == c
        new = np.maximum(row[:, 1:], np.where(same, row[:, :-1] + 1, 0))
        row[:, 1:] = np.maximum.accumulate(new, axis=1)
    size = (windows != 0xFFFFFFFF).sum(axis=1)
    return float((200.0 * row[:, -1] / (m + size)).max())


def partial_ratios(pairs: list[tuple[str, str]], most: int = 1 << 14) -> np.ndarray:
    """partial_ratio of many pairs, by semi-local alignment: one pass over the cells of two texts gives the LCS
    of the shorter with every window of the longer; pairs of near lengths are worked off side by side."""
    out = np.zeros(len(pairs))
    sized = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    order = sorted((k for k, (a, _) in enumerate(sized) if a), key=lambda k: (len(sized[k][0]), len(sized[k][1])))
    start = 0
    while start < len(order):
        step = max(1, most // (len(sized[order[start]][0]) + 1))
        part, start = order[start : start + step], start + step
        rows, cols = max(len(sized[k][0]) for k in part), max(len(sized[k][1]) for k in part)
        x, y = np.full((rows, len(part)), -1, np.int32), np.full((cols, len(part)), -2, np.int32)  # signs that never match
        for c, k in enumerate(part):
            a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in sized[k])
            x[rows - len(a) :, c], y[: len(b), c] = a[::-1], b
        # strands start at the left (from below) and at the top; two that meet cross once at most, or turn at a match
        h = np.repeat(np.arange(rows, dtype=np.int32)[:, None], len(part), 1)
        v = np.repeat(np.arange(rows, rows + cols, dtype=np.int32)[:, None], len(part), 1)
        for d in range(rows + cols - 1):
            lo, hi, off = max(0, d - rows + 1), min(cols - 1, d) + 1, rows - 1 - d
            left, top = h[lo + off : hi + off], v[lo:hi]
            turn = (x[lo + off : hi + off] == y[lo:hi]) | (left > top)
            new = np.where(turn, left, top)
            h[lo + off : hi + off] = np.where(turn, top, left)
            v[lo:hi] = new
        for c, k in enumerate(part):
            m, n = map(len, sized[k])
            s = v[:n, c] - rows
            r = np.flatnonzero(s >= 0)
            s = s[r]
            # LCS with [i, j) is j - i less the strands that start at i or later and end before j
            first = np.maximum(0, r - m + 1)
            w = first <= s
            inner = np.cumsum(np.bincount(first[w], minlength=n + 1) - np.bincount(s[w] + 1, minlength=n + 1))[: n - m + 1]
            best = ((m - inner) / m).max() * 100.0
            if m > 1:
                j = np.arange(1, m)
                head = np.cumsum(np.bincount(r, minlength=n))[: m - 1]
                tail = np.cumsum(np.bincount(s, minlength=n)[::-1])[: m - 1]
                best = max(best, (200.0 * (j - np.minimum(head, tail)) / (m + j)).max())
            out[k] = best
    return out


#: Weights of name, domain and tags in the topic score.
FIELDS = (("name", 3.0), ("domain", 2.5), ("tags", 2.0))
HELD = sum(w for _, w in FIELDS)


def _matched(rows: DataFrame, columns: list[str], score, name: str) -> DataFrame:
    """rows without the columns, with a score of them: score(query, values..., best) -> float; rows go by in batches."""
    kept = [c for c in rows.columns if c not in columns]
    schema = rows.select(*kept).schema.add(name, "double")

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at : at + 2048]
                texts = [[q or "", *[[x or "" for x in v] if isinstance(v, (list, np.ndarray)) else [v or ""] for v in vs]] for q, *vs in zip(*[part[c] for c in columns], strict=True)]
                need = list({(q, x) for q, *vs in texts for v in vs for x in v})
                ratio = dict(zip(need, partial_ratios(need), strict=True))
                best = lambda q, v: max((ratio[q, x] for x in v), default=0.0)
                yield part[kept].assign(**{name: [score([best(q, v) for v in vs]) for q, *vs in texts]})

    return rows.select(*kept, *columns).mapInPandas(run, schema)


def field_scores(pairs: DataFrame) -> DataFrame:
    """pairs(query, name, domain, tags, ...): the other columns with `fields`, the weighted match of the three, 0 to HELD."""
    lists = pairs.withColumns({c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("domain", "tags")})
    return _matched(lists, ["query", *[c for c, _ in FIELDS]], lambda best: sum(w * x for (_, w), x in zip(FIELDS, best, strict=True)) / 100, "fields")


def content_scores(pairs: DataFrame) -> DataFrame:
    """pairs(query, content, ...): the other columns with `body`, the match of the first 1,000 characters, 0 to 1."""
    return _matched(pairs.withColumn("content", F.substring("content", 1, 1000)), ["query", "content"], lambda best: best[0] / 100, "body")


def topic(content_weight: float = 1.0) -> Column:
    return (F.col("fields") + content_weight * F.col("body")) / (HELD + content_weight)


def topic_scores(pairs: DataFrame, content_weight: float = 1.0) -> DataFrame:
    """pairs(query_id, query, id, name, domain, tags, content): weighted fuzzy match of name, domain, tags and body, 0 to 1."""
    rows = field_scores(pairs.select("query_id", "id", "query", "name", "domain", "tags", F.col("query").alias("q"), "content"))
    return content_scores(rows.withColumnRenamed("q", "query")).select("query_id", "id", topic(content_weight).alias("topic"))


def raw_score(at: Column, topic: Column, valence: Column | None = None, arousal: Column | None = None) -> Column:
    """The fused score before penalties, 0 to 100, of rows with semantic (null: none), bm25 (null: 0), literal and any_bm25."""
    emotion = scores.emotion_score(valence, arousal) if valence is not None else F.lit(0.5)
    return fused_from(topic, emotion * W_EMOTION + scores.time_score(at) * W_TIME + scores.importance_score() * W_IMPORTANCE + scores.touch_score() * W_TOUCH)


def fused_from(topic: Column, base: Column) -> Column:
    """raw_score from the topic and the weighted sum of emotion, time, importance and touch."""
    total = topic * W_TOPIC + base + F.coalesce(F.col("semantic") * W_SEMANTIC, F.lit(0.0)) + F.when(F.col("any_bm25"), F.coalesce("bm25", F.lit(0.0)) * W_BM25).otherwise(0.0)
    weights = W_TOPIC + W_EMOTION + W_TIME + W_IMPORTANCE + W_TOUCH + F.when(F.col("semantic").isNotNull(), W_SEMANTIC).otherwise(0.0) + F.when(F.col("any_bm25"), W_BM25).otherwise(0.0)
    return F.least(F.lit(100.0), total / weights * 100 + F.when(F.col("literal"), LITERAL_BONUS).otherwise(0.0))


def semantic_hit() -> Column:
    return F.coalesce(F.col("semantic") >= SEMANTIC_THRESHOLD, F.lit(False))


def penalty() -> Column:
    return F.when(F.col("resolved"), RESOLVED_FACTOR).otherwise(1.0) * F.when(F.col("superseded_by").isNotNull(), SUPERSEDED_FACTOR).otherwise(1.0)


def fused(candidates: DataFrame, at: Column, valence: Column | None = None, arousal: Column | None = None) -> DataFrame:
    """candidates: memory columns with query_id, topic, semantic (null: none), bm25 (null: 0), literal, and any_bm25
    (whether the query has a BM25 score at all) where they aren't whole.

    Rows that pass a threshold before penalties, with score and vector_match.
    """
    any_bm25 = F.col("any_bm25") if "any_bm25" in candidates.columns else F.max(F.coalesce("bm25", F.lit(0.0))).over(Window.partitionBy("query_id")) > 0
    rows = candidates.withColumn("any_bm25", any_bm25).withColumn("raw", raw_score(at, F.col("topic"), valence, arousal))
    text_match = (F.col("raw") >= TEXT_THRESHOLD) | F.col("literal")
    return rows.filter(text_match | semantic_hit()).select("query_id", "id", F.round(F.col("raw") * penalty(), 2).alias("score"), (semantic_hit() & ~text_match).alias("vector_match"))


LIGHT = ("resolved", "superseded_by", "last_active", "created", "importance", "activation_count", "valence", "arousal")


def _near_fields(memories: DataFrame, queries: DataFrame, known: DataFrame, at: Column, rows: int, query_rows: int, k: int) -> DataFrame:
    """(query_id, id, fields, bm25, literal, semantic, most) of the pairs that could be among the k best, from blocks of queries against blocks of memories.

    queries(query_id, query, open, any_bm25, q_valence, q_arousal): where `open` is false only pairs with `own` count. known(query_id, id, bm25, literal, semantic, own)
    has what is known of a pair already and goes to the block with its memory. A pair is kept if it has a hit, or would
    pass the text threshold with a whole match of its content; names are only compared where it would with a whole match
    of the name as well, and where the score with whole matches (`most`, with the name known) reaches the least score
    that k rows of the query are sure of. Blocks hand on such sure scores first, a row for each of their k best.
    """
    blocks = lambda df, size: max(1, -(-df.count() // size))
    n, m = blocks(memories, rows), blocks(queries, query_rows)
    of = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    base = scores.time_score(at) * W_TIME + scores.importance_score() * W_IMPORTANCE + scores.touch_score() * W_TOUCH
    held = known.withColumn("q", of("query_id", m)).groupBy("id", "q").agg(F.collect_list(F.struct("query_id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), "literal", F.coalesce("semantic", F.lit(float("nan"))).alias("semantic"), "own")).alias("known"))
    held = held.select("id", "q", *[F.col(f"known.{c}").alias(f"known_{c}") for c in ("query_id", "bm25", "literal", "semantic", "own")])  # arrays side by side
    light = ["id", "name", "domain", "tags", base.cast("double").alias("base"), penalty().cast("double").alias("penalty"), F.col("valence").cast("double").alias("valence"), F.col("arousal").cast("double").alias("arousal")]
    texts = memories.select(*light, of("id", n).alias("block")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    facts = materialize(texts.join(held.hint("merge"), ["id", "q"], "left"), "facts")
    id_type = queries.schema["query_id"].dataType.simpleString()
    weight_of = W_TOPIC + W_EMOTION + W_TIME + W_IMPORTANCE + W_TOUCH

    def dealt(queries: DataFrame) -> DataFrame:
        return queries.withColumn("q", of("query_id", m)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    class Met:
        """What is known of every pair of two blocks, as tables of memories by queries."""

        def __init__(self, a: pd.DataFrame, b: pd.DataFrame):
            self.asked, self.names = [q or "" for q in b["query"]], [x or "" for x in a["name"]]
            size = (len(a), len(b))
            bm, self.lit, self.sem, self.able = np.zeros(size), np.zeros(size, bool), np.full(size, np.nan), np.tile(b["open"].to_numpy(bool), (len(a), 1))
            of_query = pd.Index(b["query_id"])
            for i, found in enumerate(a["known_query_id"]):
                if found is not None:
                    j, said = of_query.get_indexer(found), {c: np.asarray(a[f"known_{c}"].iloc[i]) for c in ("bm25", "literal", "semantic", "own")}
                    bm[i, j], self.lit[i, j], self.sem[i, j] = said["bm25"], said["literal"], said["semantic"]
                    self.able[i, j] |= said["own"].astype(bool)
            self.bm, on = bm, b["any_bm25"].to_numpy(bool)
            far = [b[f"q_{c}"].to_numpy(float)[None, :] - a[c].to_numpy(float)[:, None] for c in ("valence", "arousal")]
            feel = np.maximum(0.0, 1.0 - np.sqrt(far[0] ** 2 + far[1] ** 2) / 2.0**0.5)
            feel = np.where(np.isnan(feel), 0.5, feel) * W_EMOTION
            self.rest = feel + a["base"].to_numpy(float)[:, None] + np.nan_to_num(self.sem * W_SEMANTIC) + np.where(on, bm * W_BM25, 0.0)
            self.weights = weight_of + np.where(np.isnan(self.sem), 0.0, W_SEMANTIC) + np.where(on, W_BM25, 0.0)
            self.hit = self.lit | (np.nan_to_num(self.sem, nan=-1.0) >= SEMANTIC_THRESHOLD)
            self.penalty = a["penalty"].to_numpy(float)[:, None]
            self.lists = np.zeros(size)
            ratio: dict[str, np.ndarray] = {}  # of a tag or domain with every query of the block
            for c, w in FIELDS[1:]:
                for i, values in enumerate(a[c]):
                    values = [v or "" for v in (values if values is not None else ())]
                    for x in {*values} - ratio.keys():
                        ratio[x] = partial_ratios([(q, x) for q in self.asked])
                    if values:
                        self.lists[i] += w * np.max([ratio[x] for x in values], axis=0) / 100
                    ratio = ratio if len(ratio) < 4096 else {}

        def raw(self, fields: np.ndarray, body: float) -> np.ndarray:
            return np.minimum(100.0, ((fields + body) / (HELD + 1.0) * W_TOPIC + self.rest) / self.weights * 100 + np.where(self.lit, LITERAL_BONUS, 0.0))

        def passes(self, fields: np.ndarray) -> np.ndarray:
            bare = ((fields + 1.0) / (HELD + 1.0) * W_TOPIC + self.rest) / self.weights * 100
            return self.able & (self.hit | (bare >= TEXT_THRESHOLD - 1e-6))

        def most(self, fields: np.ndarray) -> np.ndarray:
            """The greatest score; a row without one (null facts) is never ruled out."""
            out = self.raw(fields, 1.0) * self.penalty
            return np.where(np.isnan(out), np.inf, out)

        def sure(self, fields: np.ndarray) -> np.ndarray:
            """The least score of the rows that pass whatever their texts; -inf for others."""
            low = self.raw(fields, 0.0)
            return np.where(self.able & (self.hit | (low >= TEXT_THRESHOLD + 1e-6)) & ~np.isnan(low), low * self.penalty, -np.inf)

        def compare(self, need: np.ndarray) -> np.ndarray:
            """The fields with the names of the pairs in need, a table of booleans; 0 for other names."""
            fields, (i, j) = self.lists.copy(), np.nonzero(need)
            for s in range(0, len(i), 4096):
                part = slice(s, s + 4096)
                fields[i[part], j[part]] += FIELDS[0][1] * partial_ratios([(self.asked[y], self.names[x]) for x, y in zip(i[part], j[part], strict=True)]) / 100
            return fields

    def best(low: np.ndarray) -> np.ndarray:
        """The k greatest of each column."""
        return np.sort(low, axis=0)[::-1][:k]

    def surest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": b["query_id"][:0], "low": pd.Series([], dtype=float)})
        met = Met(a, b)
        low = met.sure(met.lists)
        few = np.argsort(-np.where(met.passes(met.lists + FIELDS[0][1]), met.most(met.lists), -np.inf), axis=0, kind="stable")[: min(k, 16)]
        need = np.zeros(low.shape, bool)
        np.put_along_axis(need, few, True, axis=0)
        low = best(np.maximum(low, met.sure(met.compare(need))))
        j = np.tile(np.arange(len(b)), len(low))
        out = pd.DataFrame({"query_id": b["query_id"].to_numpy()[j], "low": low.ravel()})
        return out[np.isfinite(out["low"])]

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": b["query_id"][:0], "id": a["id"][:0], **dict.fromkeys(("fields", "bm25", "semantic", "most"), 0.0), "literal": False})
        met = Met(a, b)
        floor = b["floor"].to_numpy(float)
        floor = np.where(np.isnan(floor), -np.inf, floor - ROUNDED)
        whole = met.lists + FIELDS[0][1]
        fields = met.compare(met.passes(whole) & (met.most(whole) >= floor))
        most = met.most(fields)
        # names that weren't compared belong to pairs that are out by either bound
        i, j = np.nonzero(met.passes(whole) & (met.most(whole) >= floor) & met.passes(fields) & (most >= floor))
        return pd.DataFrame({"query_id": b["query_id"].to_numpy()[j], "id": a["id"].to_numpy()[i], "fields": fields[i, j], "bm25": met.bm[i, j], "literal": met.lit[i, j], "semantic": met.sem[i, j], "most": most[i, j]})

    some = "block % 4 = 0" if n >= 32 else "true"  # what some blocks are sure of bounds the rest as well
    lows = facts.filter(some).groupBy("q", "block").cogroup(dealt(queries).filter(some).groupBy("q", "block")).applyInPandas(surest, f"query_id {id_type}, low double")
    floors = materialize(least_of(lows, "low", k), "floors")
    right = dealt(queries.join(floors, "query_id", "left")).groupBy("q", "block")
    out = facts.groupBy("q", "block").cogroup(right).applyInPandas(meet, f"query_id {id_type}, id string, fields double, bm25 double, literal boolean, semantic double, most double")
    return out.withColumn("semantic", F.when(~F.isnan("semantic"), F.col("semantic")))


#: Scores are rounded to two digits; a row this much below another stays below it.
ROUNDED = 0.011


def least_of(found: DataFrame, score: str, k: int) -> DataFrame:
    """(query_id, floor): the k-th greatest score of each query that has so many."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score))
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).filter(F.col("n") == k).select("query_id", F.col(score).alias("floor"))


def search(memories: DataFrame, queries: DataFrame, semantic: DataFrame, at: Column, k: int = 10, fuzzy: int | None = None, rows: int = 2048, query_rows: int = 256) -> DataFrame:
    """The k best rows of each query; queries(query_id, query, and as they are wanted domains, q_valence, q_arousal), semantic(query_id, id, semantic).

    Every memory of the asked domains (all, if none of a query's is known) is scored for every query, as a row can
    pass the text threshold by any of its texts: blocks of queries meet blocks of memories. The comparison with the
    name, and the long one with the content, are left out only where the row couldn't pass even with a whole match,
    or not reach the least score that k rows of the query are known to have, so the result is exact. With `fuzzy`, only rows with a literal hit, a vector score or a BM25 rank up to it are
    scored; their scores are the same.
    """
    from notegrid.operators.predicates import domain_prefilter, exact_ids, literal_matches

    exact = exact_ids(memories, queries).select("query_id", "id", F.lit(100.0).alias("score"), F.lit(False).alias("vector_match"))
    rest = materialize(queries.join(exact.select("query_id"), "query_id", "left_anti"), "queries")
    felt = "q_valence" in queries.columns
    lexical = materialize(bm25(memories, rest), "lexical")
    literal = literal_matches(memories, rest).distinct()
    close = semantic.join(rest.select("query_id"), "query_id", "left_semi")
    fact = lambda df, **c: df.select("query_id", "id", *[c.get(x, F.lit(None)).cast(t).alias(x) for x, t in (("bm25", "double"), ("literal", "boolean"), ("semantic", "double"), ("own", "boolean"))])
    facts = fact(lexical, bm25=F.col("bm25")).unionByName(fact(literal, literal=F.lit(True))).unionByName(fact(close, semantic=F.col("semantic")))
    held = lexical.select("query_id").distinct().withColumn("any_bm25", F.lit(True))  # a row a query
    asked = rest.join(held, "query_id", "left").withColumn("any_bm25", F.coalesce("any_bm25", F.lit(False)))
    if "domains" in queries.columns:
        wanted = materialize(domain_prefilter(memories, rest), "domains")
        asked = asked.join(wanted.filter("id IS NULL").select("query_id", F.lit(True).alias("open")), "query_id", "left").withColumn("open", F.coalesce("open", F.lit(False)))
        facts = facts.unionByName(fact(wanted.filter("id IS NOT NULL"), own=F.lit(True)))
    else:
        asked = asked.withColumn("open", F.lit(True))
    known = facts.groupBy("query_id", "id").agg(F.max("bm25").alias("bm25"), F.coalesce(F.bool_or("literal"), F.lit(False)).alias("literal"), F.max("semantic").alias("semantic"), F.coalesce(F.bool_or("own"), F.lit(False)).alias("own"))
    if fuzzy is not None:
        ranked = lexical.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bm25"), "id"))).filter(F.col("r") <= fuzzy).select("query_id", "id", F.lit(True).alias("first"))
        few = known.join(ranked, ["query_id", "id"], "left").join(asked.select("query_id", "open"), "query_id").filter("first OR literal OR semantic IS NOT NULL")
        known = few.withColumn("own", F.col("own") | F.col("open")).drop("first", "open")
        asked = asked.withColumn("open", F.lit(False))
    asked = asked if felt else asked.withColumns({c: F.lit(None).cast("double") for c in ("q_valence", "q_arousal")})
    able = materialize(_near_fields(memories, asked, known, at, rows, query_rows, k), "able")
    texts = lambda pairs: pairs.join(memories.select("id", "content", *LIGHT), "id").join(asked.select("query_id", "query", "any_bm25", "q_valence", "q_arousal"), "query_id")
    scored = lambda pairs: fused(content_scores(texts(pairs)).withColumn("topic", topic()), at, F.col("q_valence"), F.col("q_arousal"))
    # the likeliest rows first; their scores say which others are worth a look
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "id"))
    likely = materialize(able.withColumn("n", turn).filter(F.col("n") <= 2 * k).drop("n"), "likely")
    first = materialize(scored(likely), "first")
    left = able.join(likely.select("query_id", "id"), ["query_id", "id"], "left_anti").join(F.broadcast(least_of(first, "score", k)), "query_id", "left")  # a row a query
    best = first.unionByName(scored(left.filter("floor IS NULL OR most >= floor - %s" % ROUNDED).drop("floor"))).unionByName(exact)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("long")).filter(F.col("rank") <= k)
