"""Approximate nearest neighbours by shifted space-filling curves.

Equal vectors are collapsed first (each keeps its smallest ids, as many as a result can show). Every curve
projects the vectors on a few random orthogonal directions, shifts them and takes the Hilbert order of the
cells. The order of each curve is cut at quantiles of its keys into ranges of about equal size; a query is
sent to the ranges of its own window, `share` of a curve's rows. Each range ranks its rows for its queries
(in blocks of about range_rows queries, so no task grows with the table) by block distances and hands on the
best with all that tie with the last of them; the windows of all curves are merged and reranked by the exact
Euclidean distance of the original vectors in double precision.

Vectors spread evenly over many dimensions have no useful order: there the share must be large for a recall
of 0.9 (the README has figures). On vectors of few inner dimensions a small share is enough.

Defined results: rows whose id or vector is null, whose vector is zero, holds a null or non-finite
component or has another than the most common size take no part; exact repeats of a row count once; ties go
to the smaller id; very long vectors are taken whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegrid.llm.common import materialize

BITS, SALT_BITS = 10, 12


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer cells (rows of at most 52 / bits dimensions)."""
    x = cells.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            set_ = (x[i] & q) > 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


class Curves:
    """Directions, scale and shift of each curve."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        size = sample.shape[1]
        self.dims = min(dims, size)
        self.turn = [np.linalg.qr(rng.standard_normal((size, size)))[0][:, : self.dims] for _ in range(curves)]
        self.shift = rng.uniform(-0.5, 0.5, (curves, self.dims))
        flat = [sample @ t for t in self.turn]
        self.mean = np.array([f.mean(axis=0) for f in flat])
        self.std = np.array([f.std(axis=0) + 1e-9 for f in flat])

    def keys(self, vectors: np.ndarray, ids: np.ndarray, curve: int) -> np.ndarray:
        """Hilbert keys; the lowest bits are a hash of the id, so equal cells are dealt evenly too."""
        y = (vectors @ self.turn[curve] - self.mean[curve]) / self.std[curve] + self.shift[curve]
        cells = np.clip((y + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SALT_BITS)
        return hilbert(cells, BITS) << SALT_BITS | salt.astype(np.int64)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part; single precision stays, as it holds the same values in half the room."""
    kind = "float" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    # -0.0 and 0.0 are one value
    good = good.withColumn("v", F.transform("v", lambda x: (x + F.lit(0.0)).cast(kind)))
    common = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.filter(F.size("v") == (common["n"] if common else 0)).dropDuplicates(["vec_id", "v"])


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def ranked(left: pd.DataFrame, right: pd.DataFrame, most: int) -> pd.DataFrame:
    """The `most` nearest rows of left(vid, v) for each of right(vid, v): qid, vid, score; ties by vid."""
    if not len(left) or not len(right):
        return pd.DataFrame({"qid": [], "vid": [], "score": []})
    a, b = stacked(left["v"]), stacked(right["v"])
    ids, qids = left["vid"].to_numpy(), right["vid"].to_numpy()
    squares, out, most = (a**2).sum(axis=1), [], min(len(a), most)
    for s in range(0, len(b), 256):
        q = b[s : s + 256]
        near = squares[None, :] - 2 * q @ a.T
        # all rows that may be as near as the last one wanted, for the rounding of the product
        slack = 1e-12 * (squares.max() + (q**2).sum(axis=1))
        limit = np.partition(near, most - 1, axis=1)[:, most - 1] + slack
        row, at = np.nonzero(near <= limit[:, None])
        exact = np.sqrt(((a[at] - q[row]) ** 2).sum(axis=1))
        order = np.lexsort((ids[at], exact, row))
        row, at, exact = row[order], at[order], exact[order]
        first = np.searchsorted(row, np.arange(len(q)))
        keep = np.arange(len(row)) - first[row] < most
        out.append(pd.DataFrame({"qid": qids[s : s + 256][row[keep]], "vid": ids[at[keep]], "score": exact[keep]}))
    return pd.concat(out)


def search(df: DataFrame, is_query, k: int = 10, curves: int = 8, dims: int = 4, share: float = 0.2, range_rows: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 4096) -> DataFrame:
    """k nearest found for each row for which is_query holds: query_id, rank, vec_id, score.

    sample: so many rows (by a hash of the id) set the scale of the projections; every row is indexed.
    """
    rows = usable(df, id_col, vector_col)
    first = Window.partitionBy("v").orderBy("vec_id")
    distinct = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("vid"), "ids", "v")
    distinct = materialize(distinct, "distinct")
    asked = materialize(rows.filter(is_query), "asked")
    kind = dict(distinct.dtypes)["v"]
    head = distinct.orderBy(F.xxhash64("vid"), "vid").limit(sample).select("v").toPandas()
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(head):
        return empty
    curve = Curves(stacked(head["v"]), curves, dims)
    count = distinct.count()
    ranges = max(1, min(64, count // 16), -(-count // range_rows))
    reach = int(np.ceil(share / 2 * ranges))
    held = df.sparkSession.sparkContext.broadcast(curve)

    def keyed(batches):
        for pdf in batches:
            if len(pdf):
                v, ids = stacked(pdf["v"]), pdf["vid"].to_numpy()
                for c in range(curves):
                    yield pd.DataFrame({"curve": c, "key": held.value.keys(v, ids, c)})

    cuts = distinct.select("vid", "v").mapInPandas(keyed, "curve int, key long").groupBy("curve").agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("cuts") if ranges > 1 else F.array().cast("array<long>").alias("cuts"))
    ends = {r["curve"]: np.array(r["cuts"], np.int64) for r in cuts.collect()}  # ranges - 1 numbers a curve

    def dealt(spread: int):
        def run(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                v, ids = stacked(pdf["v"]), pdf["vid"].to_numpy()
                for c in range(curves):
                    own = np.searchsorted(ends[c], held.value.keys(v, ids, c), side="right")
                    for d in range(-spread, spread + 1):
                        at = own + d
                        # windows at an end of the order reach further on the other side
                        at = np.where(at < 0, own + spread - at, np.where(at >= ranges, own - spread - (at - ranges + 1), at))
                        ok = (at >= 0) & (at < ranges)
                        if ok.any():
                            yield pd.DataFrame({"curve": c, "range": at[ok], "vid": ids[ok], "v": pdf["v"].to_numpy()[ok]})

        return run

    asked_vectors = asked.join(distinct, "v", "left_semi").select("v").distinct().join(distinct.select("v", "vid"), "v").select("vid", "v")
    schema = f"curve int, range int, vid long, v {kind}"
    index = distinct.select("vid", "v").mapInPandas(dealt(0), schema)
    probes = materialize(asked_vectors.mapInPandas(dealt(min(reach, ranges - 1)), schema).dropDuplicates(["curve", "range", "vid"]), "probes")
    # the queries of a range in blocks, each of which meets the range's rows
    blocks = materialize(probes.groupBy("curve", "range").agg(F.ceil(F.count(F.lit(1)) / range_rows).alias("blocks")), "blocks")
    probes = probes.join(blocks.hint("merge"), ["curve", "range"]).withColumn("block", F.pmod(F.xxhash64("vid"), F.col("blocks"))).drop("blocks")
    index = index.join(blocks, ["curve", "range"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    found = index.groupBy("curve", "range", "block").cogroup(probes.groupBy("curve", "range", "block")).applyInPandas(lambda a, b: ranked(a, b, k + 1), "qid long, vid long, score double")
    by_score = Window.partitionBy("qid").orderBy("score", "vid")
    best = found.dropDuplicates(["qid", "vid"]).withColumn("n", F.row_number().over(by_score)).filter(F.col("n") <= k + 1)
    by_id = Window.partitionBy("qid").orderBy("score", "vec_id")
    ids = best.join(distinct.select("vid", "ids"), "vid").select("qid", "score", F.explode("ids").alias("vec_id")).withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1)
    lists = ids.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))  # k + 1 at most
    mine = asked.withColumnRenamed("vec_id", "query_id").join(distinct.select("v", F.col("vid").alias("qid")), "v").select("query_id", "qid")
    shown = mine.join(lists, "qid").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return shown.select("query_id", F.posexplode("near").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
