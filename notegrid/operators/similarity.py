"""Vector similarity: pairwise, top-k for stated queries, and pairs above a threshold.

Thresholds are worked off in pairs of blocks. Vectors are dealt into blocks by the direction they lie in, and bounds on
the angles between two blocks discard most pairs of blocks of clustered vectors before any vector is shipped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrid.storage import materialize

#: Bounds of what the deal is fitted on: rows of the sample, directions chosen from it, and those that blocks keep their angles to.
SAMPLE, DIRECTIONS, LANDMARKS = 8192, 1024, 128
#: How many ranges a deal has, while a range needn't hold more blocks than the second number.
RANGES, RANGE = 32, 8
#: Angles that rounding may blur.
SLACK = 1e-6


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for a zero vector or unequal sizes."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def _unit(column: pd.Series) -> np.ndarray:
    m = np.stack(column.to_numpy()).astype(np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _blocks(vectors: DataFrame, rows: int) -> tuple[DataFrame, int]:
    n = max(1, -(-vectors.count() // rows))
    return vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")), n


def directions(vectors: DataFrame, count: int) -> np.ndarray:
    """At most `count` unit vectors far from one another, from a sample of at most SAMPLE rows (those of lowest hash).

    They only say how rows are dealt: results don't depend on them. Vectors of another size than the sample's first
    are dealt by their size alone.
    """
    sample = vectors.filter("embedding IS NOT NULL AND size(embedding) > 0").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toPandas()["embedding"]
    if not len(sample):
        return np.zeros((0, 0))
    raw = np.stack(sample[sample.map(len) == len(sample.iloc[0])].to_numpy()).astype(np.float64)
    sample = sample[sample.map(len) == len(sample.iloc[0])][np.isfinite(raw).all(axis=1) & (raw != 0).any(axis=1)]
    unit = _unit(sample) if len(sample) else np.zeros((0, raw.shape[1]))
    chosen: list[int] = []
    near = np.full(len(unit), -2.0)  # cosine with the nearest chosen one
    while len(unit) and len(chosen) < min(count, DIRECTIONS) and near.min() < 1.0 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    if not chosen:
        return unit[chosen]
    left, path = unit[chosen], [0]
    free = np.ones(len(left), bool)
    free[0] = False
    while free.any():  # each is followed by the nearest one left, as small groups share blocks with the next
        path.append(int(np.where(free, left @ left[path[-1]], -2.0).argmax()))
        free[path[-1]] = False
    return left[path]


DEALT = "vec_id long, d int, pivot int, away double"
BLOCK = "block long, centre array<double>, radius double, low array<double>, high array<double>"


def arrange(vectors: DataFrame, toward: np.ndarray, rows: int, zeros: bool = False) -> DataFrame:
    """vectors(id, vec_id, embedding) in blocks of at most `rows` rows of one size, written once.

    A row goes by its nearest direction and its angle to it, and range partitions cut the order, so a direction that
    holds a third of all rows fills many blocks. One row of each block carries what bounds its angles: the mean
    direction, the widest angle to that, and the least and widest angle to each landmark. Null vectors, those with
    null or non-finite components and, without `zeros`, zero vectors are left out: none has a cosine above 0.
    """
    total = vectors.count()
    schema = vectors.select("id", "vec_id", "embedding").schema

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["embedding"].notna()]
            for d, part in pdf.groupby(pdf["embedding"].map(len)):
                if not d:
                    continue
                raw = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                part = part[np.isfinite(raw).all(axis=1) & (zeros | (raw != 0).any(axis=1))]
                if not len(part):
                    continue
                unit = _unit(part["embedding"])
                pivot, away = np.zeros(len(part), np.int32), np.zeros(len(part))
                if len(toward) and d == toward.shape[1]:
                    cos = unit @ toward.T
                    pivot = cos.argmax(axis=1).astype(np.int32)
                    away = _angle(cos.max(axis=1))
                yield part.assign(d=np.int32(d), pivot=pivot, away=away)

    dealt = vectors.select("id", "vec_id", "embedding").mapInPandas(deal, ", ".join([f"id {schema['id'].dataType.simpleString()}", f"embedding {schema['embedding'].dataType.simpleString()}", DEALT]))
    side = min(RANGE, max(1, -(-total // (RANGES * rows))))
    parts = max(1, -(-total // (side * rows)))
    order = ["d", "pivot", "away", "vec_id"]
    ranged = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("block", F.shiftleft(F.spark_partition_id().cast("long"), 32))

    def summed(part: pd.DataFrame, block: int) -> pd.DataFrame:
        unit = _unit(part["embedding"])
        mean = unit.sum(axis=0)
        size = np.linalg.norm(mean)
        centre = mean / size if size > 1e-9 else unit[0]
        marks = toward[:: -(-len(toward) // LANDMARKS)] if len(toward) and unit.shape[1] == toward.shape[1] else np.zeros((0, unit.shape[1]))
        seen = _angle(unit @ marks.T)
        head = {"centre": centre.tolist(), "radius": float(_angle(unit @ centre).max()), "low": seen.min(axis=0).tolist(), "high": seen.max(axis=0).tolist()}
        out = part[["id", "embedding", "vec_id", "d"]].assign(block=block)
        for name, value in head.items():
            out[name] = [value] + [None] * (len(part) - 1)
        return out

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, number = None, 0
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            while len(held):
                # a block ends where the size changes, when it is full, or at a new direction if it is a quarter full
                k = min(rows, len(held))
                other = np.flatnonzero(held["d"].to_numpy()[:k] != held["d"].iloc[0])
                turn = np.flatnonzero(np.diff(held["pivot"].to_numpy()[:k])) + 1
                turn = turn[turn >= max(1, rows // 4)]
                ends = [int(x[0]) for x in (other, turn) if len(x)]
                if not ends and len(held) < rows:
                    break
                k = min([k, *ends])
                yield summed(held.iloc[:k], int(held["block"].iloc[0]) + number)
                held, number = held.iloc[k:], number + 1
        if held is not None and len(held):
            yield summed(held, int(held["block"].iloc[0]) + number)

    return materialize(ranged.mapInPandas(cut, f"id {schema['id'].dataType.simpleString()}, embedding {schema['embedding'].dataType.simpleString()}, vec_id long, d int, {BLOCK}"), "blocks")


def near_blocks(left: DataFrame, right: DataFrame | None, least: float | None, heads: int = 1024) -> DataFrame:
    """(block, other): pairs of blocks that may hold a pair of rows with a cosine of `least` or more (None: all pairs of equal sizes).

    Two rows can't be nearer than their blocks' mean directions less both radii, nor than their angles to a common
    landmark differ; what is discarded by these has no such pair. Without `right` the blocks of left meet one
    another, each pair once. The heads meet in blocks of their own.
    """
    head = lambda df: materialize(df.filter("radius IS NOT NULL").select("block", "d", "centre", "radius", "low", "high"), "heads")
    mine = head(left)
    theirs = mine if right is None else head(right)
    sized = lambda df: max(1, -(-df.count() // heads))
    m, n = sized(mine), sized(theirs)
    place = lambda df, k: df.withColumn("s", F.pmod(F.xxhash64("block"), F.lit(k)).cast("int"))
    a = place(mine, m).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    b = place(theirs, n).withColumnRenamed("s", "t").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select(*a.columns)
    b = b.select(*[F.col(c).alias(c) for c in b.columns])
    widest = math.pi if least is None else math.acos(max(-1.0, min(1.0, least))) + SLACK
    once = right is None

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros((0, 2), np.int64)]
        for d in set(x["d"]) & set(y["d"]):
            p, q = x[x["d"] == d], y[y["d"] == d]
            far = _angle(np.stack(p["centre"].to_numpy()) @ np.stack(q["centre"].to_numpy()).T) - p["radius"].to_numpy()[:, None] - q["radius"].to_numpy()[None, :]
            pl, ph, ql, qh = (np.stack(c.to_numpy()) for c in (p["low"], p["high"], q["low"], q["high"]))
            for k in range(min(pl.shape[1], ql.shape[1])):
                far = np.maximum(far, np.maximum(pl[:, k][:, None] - qh[:, k][None, :], ql[:, k][None, :] - ph[:, k][:, None]))
            i, j = np.nonzero(far <= widest) if least is not None else np.nonzero(far == far)
            both = np.column_stack([p["block"].to_numpy()[i], q["block"].to_numpy()[j]])
            found.append(both[both[:, 0] <= both[:, 1]] if once else both)
        out = np.concatenate(found)
        return pd.DataFrame({"block": out[:, 0], "other": out[:, 1]})

    return materialize(a.groupBy("s", "t").cogroup(b.groupBy("s", "t")).applyInPandas(meet, "block long, other long"), "near")


def _met(left: DataFrame, right: DataFrame, pairs: DataFrame, task: Callable, schema: str) -> DataFrame:
    """task(a, b, cosines) over every pair of blocks that is left; only their rows are shipped.

    Blocks of one range of the deal go to tasks together, so a block is shipped once to each range that it meets. A
    task holds two ranges, and hands on what it finds in a pair of blocks before it takes up the next.
    """
    near = pairs.select("block", "other", F.shiftright("block", 32).alias("g"), F.shiftright("other", 32).alias("h"))
    tasks = max(1, near.select("g", "h").distinct().count())
    columns = ["g", "h", "side", F.col("id").cast("string").alias("id"), "vec_id", "embedding", "block", "other"]
    none = {"side": F.lit(2), "id": F.lit(""), "vec_id": F.lit(0).cast("long"), "embedding": F.lit(None).cast(left.schema["embedding"].dataType)}
    a = left.select("id", "vec_id", "embedding", "block").join(near.select("block", "g", "h").distinct().hint("merge"), "block").withColumns({"side": F.lit(0), "other": F.lit(-1).cast("long")})
    b = right.select("id", "vec_id", "embedding", "block").join(near.select(F.col("other").alias("block"), "g", "h").distinct().hint("merge"), "block").withColumns({"side": F.lit(1), "other": F.lit(-1).cast("long")})
    rows = a.select(*columns).union(b.select(*columns)).union(near.withColumns(none).select(*columns))
    types = [None if df.schema["id"].dataType.simpleString() == "string" else np.int64 for df in (left, right)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(batches), ignore_index=True)
        sides = []
        for k, kind in enumerate(types):
            own = held[held["side"] == k]
            own = own.astype({"id": kind}) if kind else own
            sides.append({n: (x, _unit(x["embedding"])) for n, x in own[["id", "vec_id", "embedding", "block"]].groupby("block")})
        for p, q in held.loc[held["side"] == 2, ["block", "other"]].itertuples(index=False, name=None):
            (x, u), (y, v) = sides[0][p], sides[1][q]
            yield task(x.assign(block=p, other=q), y.assign(block=p, other=q), u @ v.T)

    return rows.repartition(tasks, "g", "h").groupBy("g", "h").applyInPandas(run, schema)


def _themselves(vectors: DataFrame, threshold: float, rows: int) -> tuple[DataFrame, DataFrame]:
    toward = directions(vectors, max(16, 2 * vectors.count() // rows))
    blocks = arrange(vectors, toward, rows, threshold < 0)
    return blocks, near_blocks(blocks, None, None if threshold < 0 else threshold)


def block_share(vectors: DataFrame, threshold: float, rows: int = 2048) -> tuple[int, int]:
    """How many pairs of blocks the bounds leave for a threshold, of how many."""
    blocks, near = _themselves(vectors, threshold, rows)
    n = blocks.filter("radius IS NOT NULL").count()
    return near.count(), n * (n + 1) // 2


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, rows: int = 4096, query_rows: int = 1024, allowed: DataFrame | None = None) -> DataFrame:
    """Exact k nearest by cosine for a stated query set: blocks of queries against blocks of rows, ties by vec_id.

    Every pair of blocks keeps its own k best, so no task holds more than two blocks. Where vectors has a column
    `meaning`, a second vector (null: none), a row's score is the greater of its two cosines; a null embedding
    counts as none as well. With allowed(id) only those rows are ranked at all.
    """
    if allowed is not None:
        vectors = vectors.join(allowed.select("id").distinct(), "id", "left_semi")
    second = F.col("meaning") if "meaning" in vectors.columns else F.lit(None).cast(vectors.schema["embedding"].dataType)
    blocks, n = _blocks(vectors.select("id", "vec_id", "embedding", second.alias("meaning")).filter("embedding IS NOT NULL OR meaning IS NOT NULL"), rows)
    asked, m = _blocks(queries.select("id", "vec_id", "embedding").filter("embedding IS NOT NULL"), query_rows)
    left = blocks.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = asked.select(*[F.col(c).alias(c) for c in ("id", "vec_id", "embedding")], F.col("block").alias("q")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "qv": [], "id": [], "vec_id": [], "score": []})
        a = a.sort_values("vec_id")
        sim = np.full((len(b), len(a)), -np.inf)
        for c in ("embedding", "meaning"):
            for d, part in a[a[c].notna()].groupby(a[c].dropna().map(len)):
                to = np.flatnonzero(b["embedding"].map(len).to_numpy() == d)
                at = a.index.get_indexer(part.index)
                if len(to):
                    cos = _unit(b["embedding"].iloc[to]) @ _unit(part[c]).T
                    sim[np.ix_(to, at)] = np.fmax(sim[np.ix_(to, at)], cos)
        sim[~np.isfinite(sim)] = -np.inf
        sim[b["vec_id"].to_numpy()[:, None] == a["vec_id"].to_numpy()[None, :]] = -np.inf
        order = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        score = np.take_along_axis(sim, order, 1)
        out = pd.DataFrame({"query_id": np.repeat(b["id"].to_numpy(), order.shape[1]), "qv": np.repeat(b["vec_id"].to_numpy(), order.shape[1]), "id": a["id"].to_numpy()[order].ravel(), "vec_id": a["vec_id"].to_numpy()[order].ravel(), "score": score.ravel()})
        return out[np.isfinite(out["score"])]

    found = left.groupBy("q", "block").cogroup(right.groupBy("q", "block")).applyInPandas(best, "query_id string, qv long, id string, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qv").orderBy(F.desc("score"), "vec_id")).cast("long"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "id", "rank")


def vector_scores(queries: DataFrame, vectors: DataFrame, least: float, rows: int = 4096, query_rows: int = 1024, k: int | None = None) -> DataFrame:
    """queries(query_id, vec_id, embedding): (query_id, id, semantic) of cosines of at least `least`.

    With `k`, only each query's k best of every pair of blocks (by cosine rounded to six digits, then id) are handed on.
    """
    toward = directions(vectors, max(16, 2 * vectors.count() // rows))
    mine = arrange(queries.select(F.col("query_id").alias("id"), "vec_id", "embedding"), toward, query_rows, least <= 0)
    theirs = arrange(vectors, toward, rows, least <= 0)

    def near(b: pd.DataFrame, a: pd.DataFrame, sim: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero(sim >= least)
        out = pd.DataFrame({"query_id": b["id"].to_numpy()[i], "id": a["id"].to_numpy()[j], "semantic": sim[i, j]})
        if k is None:
            return out
        out = out.assign(r=-out["semantic"].round(6)).sort_values(["query_id", "r", "id"])
        return out.groupby("query_id").head(k)[["query_id", "id", "semantic"]]

    return _met(mine, theirs, near_blocks(mine, theirs, None if least <= 0 else least), near, "query_id long, id string, semantic double")


def best_pair(vectors: DataFrame, least: float, rows: int = 2048) -> DataFrame:
    """The most similar pair (a, b, weight) above `least`, ties by a and b; every pair of blocks hands on its best alone."""
    return similarity_edges(vectors, least, rows, best=True).orderBy(F.desc("weight"), "a", "b").limit(1)


def similarity_edges(vectors: DataFrame, threshold: float, rows: int = 2048, best: bool = False) -> DataFrame:
    """Pairs with cosine above the threshold, weight rounded to three digits: all of them, or with `best` those of the
    highest weight of each pair of blocks. Exact: only pairs of blocks whose bounds exclude such a pair are left out,
    so vectors in clusters cost about their clusters, and vectors without any structure the square of the table."""
    blocks, near = _themselves(vectors, threshold, rows)

    def pairs(a: pd.DataFrame, b: pd.DataFrame, sim: np.ndarray) -> pd.DataFrame:
        x, y = a["vec_id"].to_numpy()[:, None], b["vec_id"].to_numpy()[None, :]
        same = a["block"].iloc[0] == a["other"].iloc[0]
        i, j = np.nonzero((sim > threshold) & ((x < y) if same else (x != y)))
        if best and len(i):
            top = np.round(sim[i, j], 3)
            i, j = i[top == top.max()], j[top == top.max()]
        first = x[i, 0] < y[0, j]
        ia, jb = a["id"].to_numpy()[i], b["id"].to_numpy()[j]
        return pd.DataFrame({"a": np.where(first, ia, jb), "b": np.where(first, jb, ia), "weight": sim[i, j]})

    out = _met(blocks, blocks, near, pairs, "a string, b string, weight double")
    return out.select("a", "b", F.round("weight", 3).alias("weight"))


def nearest_other(vectors: DataFrame, threshold: float, rows: int = 2048) -> DataFrame:
    """(id, other, weight): each row's nearest other row above the threshold, ties to the greater id.

    Every pair of blocks hands on one row for each of its rows, so a group of copies doesn't become all its pairs.
    """
    blocks, near = _themselves(vectors, threshold, rows)

    def nearest(a: pd.DataFrame, b: pd.DataFrame, sim: np.ndarray) -> pd.DataFrame:
        sides = [(a, b, sim)] if a["block"].iloc[0] == a["other"].iloc[0] else [(a, b, sim), (b, a, sim.T)]
        found = []
        for p, q, s in sides:
            order = np.argsort(q["id"].to_numpy(), kind="stable")[::-1]
            w = np.where((s > threshold) & (p["vec_id"].to_numpy()[:, None] != q["vec_id"].to_numpy()[None, :]), np.round(s, 3), -2.0)[:, order]
            k = w.argmax(axis=1)
            top = w[np.arange(len(p)), k]
            found.append(pd.DataFrame({"id": p["id"].to_numpy(), "other": q["id"].to_numpy()[order[k]], "weight": top})[top > -2.0])
        return pd.concat(found)

    best = _met(blocks, blocks, near, nearest, "id string, other string, weight double")
    return best.groupBy("id").agg(F.max_by("other", F.struct("weight", "other")).alias("other"), F.round(F.max("weight"), 3).alias("weight"))


def similar_counts(vectors: DataFrame, threshold: float, rows: int = 2048) -> DataFrame:
    """(id, similar): how many other rows have a cosine above the threshold, of rows with any; counted within pairs of blocks."""
    blocks, near = _themselves(vectors, threshold, rows)

    def counted(a: pd.DataFrame, b: pd.DataFrame, sim: np.ndarray) -> pd.DataFrame:
        hit = (sim > threshold) & (a["vec_id"].to_numpy()[:, None] != b["vec_id"].to_numpy()[None, :])
        sides = [(a, hit.sum(axis=1))] if a["block"].iloc[0] == a["other"].iloc[0] else [(a, hit.sum(axis=1)), (b, hit.sum(axis=0))]
        out = pd.concat([pd.DataFrame({"id": p["id"].to_numpy(), "similar": n}) for p, n in sides])
        return out[out["similar"] > 0]

    return _met(blocks, blocks, near, counted, "id string, similar long").groupBy("id").agg(F.sum("similar").alias("similar"))


def leader_clusters(rows: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """rows(id, pos), edges(a, b): greedy clusters in the order of pos; (leader, id) of clusters of at least so many.

    A row is a leader if no earlier leader is its neighbour; others join their earliest leader. Every round
    settles all rows whose earlier neighbours are settled, so the result equals the sequential one.
    """
    order = rows.select("id", "pos")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    x, y = order.select(F.col("id").alias("a"), F.col("pos").alias("pa")), order.select(F.col("id").alias("b"), F.col("pos").alias("pb"))
    earlier = materialize(both.join(x, "a").join(y, "b").filter("pb < pa").select(F.col("a").alias("id"), F.col("b").alias("before")), "earlier")
    new = materialize(order.join(earlier.select("id").distinct(), "id", "left_anti").select("id", F.lit(True).alias("leads")), "state")  # nobody before them
    waiting, state = earlier, new
    while new.limit(1).count():
        # a row's edges go once it is settled, and edges to rows that don't lead go at once, so rounds grow smaller
        told = waiting.join(new.select(F.col("id").alias("before"), "leads"), "before", "left")
        seen = told.groupBy("id").agg(F.bool_or(F.coalesce("leads", F.lit(False))).alias("led"), F.bool_or(F.col("leads").isNull()).alias("waits"))
        new = materialize(seen.filter("led OR NOT waits").select("id", (~F.col("led")).alias("leads")), "settled")
        waiting = materialize(told.filter("leads IS NULL").select("id", "before").join(new.select("id"), "id", "left_anti"), "waiting")
        state = state.unionByName(new)
    leaders = state.filter("leads").select(F.col("id").alias("before"))
    first = earlier.join(leaders, "before").join(order.select(F.col("id").alias("before"), "pos"), "before").groupBy("id").agg(F.min_by("before", "pos").alias("leader"))
    members = first.select("leader", "id").unionByName(leaders.select(F.col("before").alias("leader"), F.col("before").alias("id")))
    big = members.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("leader")
    return members.join(big, "leader", "left_semi")


def crystallized(feels: DataFrame, threshold: float = 0.7, least: int = 2) -> DataFrame:
    """feels(id, vec_id, embedding, pinned, created): those that aren't pinned with at least so many others above the
    threshold, their number, and `hint` for the first of them (by created, then id)."""
    many = similar_counts(feels, threshold).filter(F.col("similar") >= least)
    found = materialize(feels.filter(~F.coalesce("pinned", F.lit(False))).select("id", "created").join(many, "id"), "crystallized")
    first = found.orderBy("created", "id").limit(1).select(F.col("id").alias("first"))  # one row
    return found.join(F.broadcast(first)).select("id", "similar", (F.col("id") == F.col("first")).alias("hint"))
