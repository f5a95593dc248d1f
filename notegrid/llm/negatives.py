"""Hard-negative mining by coordinate pruning in length buckets.

All rows are dealt into buckets of about bucket_rows rows by (label, length of the vector, longest first).
A bucket holds its unit vectors and, for each coordinate, the list of its values in order. A search asks for
the rows whose inner product with an anchor is at least a bound. In a bucket that bound is one on the cosine,
bound / (anchor length x greatest length): above 1 the whole bucket is passed over; otherwise the coordinates
where the anchor is largest are its focus, the bound gives the values that a row can have there, and the rows
in the ranges of all focus coordinates are multiplied out, exactly.

Anchors are searched three times: in the first bucket of their label, which gives each a bound; in the other
buckets of their label, for its positives; and in all buckets, for rows of another label whose score lies in
the band of a positive, from the lowest band's foot. An anchor is sent only to buckets whose greatest length
can reach its bound. Anchors are dealt in blocks, each of which meets the rows of a bucket, so tasks stay
bounded whatever the number of anchors and rows.

Vectors spread evenly over many dimensions leave little to prune (the README has figures); where the ranges
keep more than half of a bucket, it is multiplied out as a block.

Components are whole numbers (the scaled vectors' floor), and scores are exact: products are summed in double
precision while a hundred times all sums stays below 2^53, and as Python's numbers beyond.

Defined results: rows whose id, label or vector is null, whose vector holds a null or non-finite component or
has another than the most common size take no part; rows of one id count once, with the smallest label, then
vector; ties go to the smaller id; negative scores are scores like any other (a band over a negative score is
empty); an anchor without positives or without negatives gives no rows; an empty table gives none; other
columns are ignored. A score that doesn't fit into 64 bits ends the job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrid.llm.common import materialize

FOCUS = 4  # focus coordinates of an anchor
SLACK = 1e-9  # for the rounding of angles
EXACT = 1 << 53  # bands compare scores times 100


class Bucket:
    """Rows of one bucket: unit vectors and sorted coordinate lists."""

    def __init__(self, vectors: np.ndarray):
        self.v = vectors
        self.lengths = np.sqrt((vectors**2).sum(axis=1))
        self.longest = self.lengths.max(initial=0.0)
        units = vectors / np.maximum(self.lengths, 1e-300)[:, None]
        self.order = np.argsort(units, axis=0, kind="stable")
        self.sorted = np.take_along_axis(units, self.order, axis=0)
        self.rank = np.empty_like(self.order)
        np.put_along_axis(self.rank, self.order, np.arange(len(vectors))[:, None], axis=0)

    def candidates(self, anchors: np.ndarray, bounds: np.ndarray) -> list[np.ndarray | None]:
        """Per anchor: the rows that can reach its bound; None: all."""
        n, lengths = len(self.v), np.sqrt((anchors**2).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where((lengths > 0) & (self.longest > 0), bounds / (lengths * self.longest), np.where(bounds > 0, np.inf, -np.inf))
        out: list[np.ndarray | None] = [None] * len(anchors)
        for i in np.flatnonzero(least > 1 + SLACK):
            out[i] = np.zeros(0, np.int64)
        some = np.flatnonzero((least > 0) & (least <= 1 + SLACK))
        if not len(some):
            return out
        unit = anchors[some] / lengths[some, None]
        focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
        own = np.arccos(np.clip(np.take_along_axis(unit, focus, axis=1), -1, 1))
        wide = np.arccos(np.clip(least[some], -1, 1))[:, None] + 1e-7
        low = np.where(own + wide >= np.pi, -2.0, np.cos(np.minimum(own + wide, np.pi)) - SLACK)
        high = np.where(own - wide <= 0, 2.0, np.cos(np.maximum(own - wide, 0)) + SLACK)
        first, last = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
        for c in np.unique(focus):
            at = focus == c
            first[at] = np.searchsorted(self.sorted[:, c], low[at], side="left")
            last[at] = np.searchsorted(self.sorted[:, c], high[at], side="right")
        narrow = np.argmin(last - first, axis=1)
        for k, i in enumerate(some):
            c, a, b = focus[k, narrow[k]], first[k, narrow[k]], last[k, narrow[k]]
            if b - a > n // 2:
                continue
            rows = self.order[a:b, c]
            for j in range(focus.shape[1]):
                if j != narrow[k] and last[k, j] - first[k, j] < n:
                    at = self.rank[rows, focus[k, j]]
                    rows = rows[(at >= first[k, j]) & (at < last[k, j])]
            out[i] = rows
        return out

    def products(self, anchors: np.ndarray, bounds: np.ndarray):
        """(anchor number, row numbers, exact scores) for every anchor with candidates."""
        reach = float(np.abs(self.v).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * max(1, self.v.shape[1])
        whole, kind = (self.v, float) if 100 * reach < EXACT else (np.array([[int(x) for x in row] for row in self.v], dtype=object), object)
        asked = anchors if kind is float else np.array([[int(x) for x in row] for row in anchors], dtype=object)
        found = self.candidates(anchors, bounds)
        full = np.array([i for i, f in enumerate(found) if f is None], dtype=np.int64)
        for s in range(0, len(full), 256):
            scores = asked[full[s : s + 256]] @ whole.T
            for i, row in zip(full[s : s + 256], scores, strict=True):
                yield int(i), np.arange(len(self.v)), row
        for i, rows in enumerate(found):
            if rows is not None and len(rows):
                yield i, rows, whole[rows] @ asked[i]


def best(ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Positions of the first rows by score, descending, then id."""
    if len(scores) > 4 * most:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
        return keep[np.lexsort((ids[keep], -scores[keep]))[:most]]
    return np.lexsort((ids, -scores))[:most]


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def positives_in(rows: pd.DataFrame, asked: pd.DataFrame, most: int) -> pd.DataFrame:
    """The first rows of a bucket with the anchor's label: anchor, vid, score."""
    out = []
    for label, own in rows.groupby("label") if len(rows) and len(asked) else ():
        mine = asked[asked["label"] == label]
        if not len(mine):
            continue
        ids, anchors = own["vid"].to_numpy(), mine["anchor"].to_numpy()
        for i, at, scores in Bucket(stacked(own["v"])).products(stacked(mine["v"]), mine["bound"].to_numpy()):
            other = np.flatnonzero(ids[at] != anchors[i])
            keep = other[best(ids[at][other], scores[other], most)]
            out.append(pd.DataFrame({"anchor": anchors[i], "vid": ids[at][keep], "score": scores[keep].astype(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({"anchor": [], "vid": [], "score": []})


def negatives_in(rows: pd.DataFrame, asked: pd.DataFrame, most: int, percent: int) -> pd.DataFrame:
    """The first rows of a bucket of another label in the band of each positive score: anchor, positive_score, vid, score."""
    out = []
    if len(rows) and len(asked):
        ids, labels = rows["vid"].to_numpy(), rows["label"].to_numpy()
        own, bands, anchors = asked["label"].to_numpy(), asked["bands"].to_numpy(), asked["anchor"].to_numpy()
        for i, at, scores in Bucket(stacked(rows["v"])).products(stacked(asked["v"]), asked["bound"].to_numpy()):
            # a row of the band of any positive lies between the lowest foot and the highest top
            low, high = min(int(p) for p in bands[i]) * percent, max(int(p) for p in bands[i])
            at_band = np.flatnonzero((labels[at] != own[i]) & (100 * scores >= low) & (scores <= high))
            at, scores = at[at_band], scores[at_band]
            for p in map(int, bands[i]):
                inside = np.flatnonzero((100 * scores >= percent * p) & (scores <= p))
                keep = inside[best(ids[at][inside], scores[inside], most)]
                if len(keep):
                    out.append(pd.DataFrame({"anchor": anchors[i], "positive_score": p, "vid": ids[at][keep], "score": scores[keep].astype(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({"anchor": [], "positive_score": [], "vid": [], "score": []})


def usable(df: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(vid, label, v): one row an id, with whole components."""
    floor = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.expr(f"{scale}D") * x))
    rows = df.select(F.col(id_col).cast("long").alias("vid"), F.col(label_col).cast("long").alias("label"), floor.alias("v"))
    good = rows.filter("vid IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND abs(x) < double('inf'))")
    # floor() of a double is a long; beyond 2^53 a double is whole already
    good = good.withColumn("v", F.expr("transform(v, x -> CASE WHEN abs(x) < 4503599627370496D THEN cast(floor(x) AS double) ELSE x END)"))
    return good.groupBy("vid").agg(F.min(F.struct("label", "v")).alias("r")).select("vid", "r.label", "r.v")


def mine(df: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 5, percent: int = 80, bucket_rows: int = 4096, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """Per anchor (a row where is_anchor, a condition on vid, holds) and positive: its first negatives.

    anchor_id, positive_id, rank, negative_id, positive_score, negative_score; percent: the least share of the
    positive's score that a negative has.
    """
    spark = df.sparkSession
    rows = materialize(usable(df, scale, id_col, label_col, vector_col), "rows")
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.filter(F.size("v") == (common["n"] if common else 0))
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.expr("aggregate(v, 0D, (m, x) -> greatest(m, abs(x)))")).alias("most"), F.count(F.when(is_anchor, 1)).alias("anchors")).first()
    if not told["anchors"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    kind = "array<smallint>" if told["most"] < 1 << 15 else "array<int>" if told["most"] < 1 << 31 else "array<double>"
    length = F.sqrt(F.expr("aggregate(v, 0D, (s, x) -> s + x * x)"))
    ranges, blocks = -(-told["n"] // bucket_rows), -(-told["anchors"] // bucket_rows)
    lined = rows.withColumn("length", length).withColumn("v", F.col("v").cast(kind)).repartitionByRange(ranges, F.col("label"), F.col("length").desc(), F.col("vid"))
    index = materialize(lined.withColumn("bucket", F.spark_partition_id()), "index")

    # a label's buckets stand in a row, longest vectors first
    reach = index.groupBy("label", "bucket").agg(F.max("length").alias("longest"))
    spans = reach.groupBy("label").agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    reach = materialize(reach, "reach")
    longest = reach.groupBy("bucket").agg(F.max("longest").alias("longest"))
    anchors = index.filter(is_anchor).select(F.col("vid").alias("anchor"), "label", "v", "length", F.pmod(F.xxhash64("vid"), F.lit(blocks)).cast("int").alias("block"))  # of the type of dealt's: cogroup hashes int and long differently
    anchors = materialize(anchors.join(spans, "label"), "anchors")
    dealt = index.drop("length").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def met(asked: DataFrame, run, schema: str) -> DataFrame:
        return dealt.groupBy("bucket", "block").cogroup(asked.groupBy("bucket", "block")).applyInPandas(run, schema)

    near = "anchor long, vid long, score long"
    own = lambda rows, asked: positives_in(rows, asked, positives)
    head = materialize(met(anchors.withColumn("bound", F.lit(float("-inf"))).withColumn("bucket", F.col("first")).select("bucket", "block", "anchor", "label", "v", "bound"), own, near), "heads")
    bounds = head.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("bound")).filter(F.col("n") == positives).drop("n")
    rest = anchors.filter(F.col("last") > F.col("first")).join(bounds, "anchor", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    rest = rest.withColumn("bucket", F.explode(F.sequence(F.col("first") + 1, F.col("last")))).join(reach, ["label", "bucket"])
    rest = rest.filter(F.col("bound") <= F.col("longest") * F.col("length") * (1 + SLACK)).select("bucket", "block", "anchor", "label", "v", "bound")
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "vid")
    chosen = head.unionByName(met(rest, own, near)).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= positives).drop("n")
    chosen = materialize(chosen, "positives")

    # a band over a negative score is empty
    bands = chosen.filter("score >= 0").groupBy("anchor").agg(F.collect_set("score").alias("bands"))  # `positives` at most
    asked = anchors.join(bands, "anchor").withColumn("bound", F.array_min("bands").cast("double") * F.lit(percent) / 100.0)
    asked = asked.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)))).join(longest, "bucket")
    asked = asked.filter(F.col("bound") <= F.col("longest") * F.col("length") * (1 + SLACK)).select("bucket", "block", "anchor", "label", "v", "bound", "bands")
    found = met(asked, lambda rows, asked: negatives_in(rows, asked, negatives, percent), "anchor long, positive_score long, vid long, score long")
    by_score = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("score"), "vid")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= negatives)
    pairs = chosen.select(F.col("anchor"), F.col("vid").alias("positive_id"), F.col("score").alias("positive_score"))
    shown = pairs.join(ranked, ["anchor", "positive_score"])
    return shown.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("vid").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER w AS INT) AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.s <= 100 * n.s AND n.s <= p.s
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b)
QUALIFY row_number() OVER w <= 5
"""
