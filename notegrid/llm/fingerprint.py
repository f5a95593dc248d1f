"""Document fingerprints: a quartile bucket digest.

Byte triplets of a text (adjacent, and two kinds with a gap) are hashed into buckets and counted. Each
bucket is encoded by the quartile its count falls in (two bits), the byte length by its logarithm (one
byte); the digest is their hex string. Two digests are compared by a bounded score: quartile steps, the
largest step counting double, plus the difference of lengths, cut at a bound; likeness is 1 - score / bound.

Defined results: a null text counts as empty; texts under three bytes have an all-zero bucket part; very long
texts are taken whole; equal texts have equal digests; null doc_ids come first in the order, ties of doc_id go
by text; repeated rows give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegrid.llm.common import map_text

BUCKETS = 256
#: Steps between quartiles to score; three steps count six.
STEPS = np.array([0, 1, 2, 6], np.int64)
#: Rows of a range of ids, about.
RANGE_ROWS = 20_000
#: Unlike texts of one language score about half of what unrelated bytes do; beyond the bound all are equally unlike.
BOUND = BUCKETS * 1.6


def bucket_counts(datas: list[bytes]) -> np.ndarray:
    """Counts of hashed triplets, a row of BUCKETS for each text."""
    n = len(datas)
    joined = np.frombuffer(b"".join(datas), np.uint8).astype(np.uint32)
    out = np.zeros((n, BUCKETS), np.int64)
    if len(joined) < 3:
        return out
    doc = np.repeat(np.arange(n, dtype=np.int64), [len(x) for x in datas])
    for salt, (i, j, k) in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 3)), 1):
        m = len(joined) - k
        if m <= 0:
            continue
        key = joined[i : i + m] << np.uint32(16) | joined[j : j + m] << np.uint32(8) | joined[k : k + m]
        slot = ((key + np.uint32(salt << 24)) * np.uint32(2654435761)) >> np.uint32(24)
        same = doc[:m] == doc[k:]
        out += np.bincount((doc[:m] * BUCKETS + slot)[same], minlength=n * BUCKETS).reshape(n, BUCKETS)
    return out


def digests(datas: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Quartile codes (rows of BUCKETS) and length codes."""
    counts = bucket_counts(datas)
    ordered = np.sort(counts, axis=1)
    cuts = ordered[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = sum((counts > cuts[:, [i]]).astype(np.uint8) for i in range(3))
    size = np.fromiter(map(len, datas), np.float64, len(datas))
    return codes, np.minimum(255, np.round(np.log1p(size) * 12)).astype(np.uint8)


def encode(codes: np.ndarray, length: np.ndarray) -> list[str]:
    packed = codes[:, 0::4] | codes[:, 1::4] << 2 | codes[:, 2::4] << 4 | codes[:, 3::4] << 6
    return [x.tobytes().hex() for x in np.hstack([length[:, None], packed.astype(np.uint8)])]


def decode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(texts)), np.uint8).reshape(len(texts), -1)
    return np.stack([raw[:, 1:] >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(texts), -1), raw[:, 0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 for equal digests, down to 0 at the bound."""
    steps = STEPS[np.abs(a[0].astype(np.int64) - b[0])].sum(axis=1)
    apart = np.abs(a[1].astype(np.int64) - b[1])
    return 1 - np.minimum(steps + np.minimum(apart, 32), BOUND) / BOUND


def fingerprint(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fingerprint."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fingerprint", T.StringType())])
    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda texts, part: {"doc_id": part.column("doc_id"), "fingerprint": encode(*digests([x.encode("utf-8", "surrogatepass") for x in texts]))}, schema)


def edited_text(text: str, following: str) -> str:
    """The last floor(n / 4) code points replaced by the first as many (or all) of the next document."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


EDITED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows (range, place, doc_id, text): every range of ids with, at place 1, the first rows of the next range.

    One shuffle of the texts; every range is a partition. The ranges' ends are approximate quantiles of the ids, for
    about RANGE_ROWS rows a range. Place 1 behind the last range holds the first rows of the first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ranges = ranges or max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // RANGE_ROWS))
    ends = sorted(set(rows.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []
    at = F.lit(0)
    if ends:
        # number of ends that are not above the id, by bisection: a tree of comparisons
        def tree(lo: int, hi: int):
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(F.col("doc_id") >= F.lit(int(ends[mid])), tree(mid + 1, hi)).otherwise(tree(lo, mid))

        at = F.coalesce(tree(0, len(ends)), F.lit(0))
    rows = rows.withColumn("range", at)
    low = rows.groupBy("range").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("nulls")).collect()  # a row a range
    first = sorted((r["range"], None if r["nulls"] else r["low"]) for r in low)
    low_id = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    before = {(-(2**63) if own is None else own): first[i - 1][0] for i, (_, own) in enumerate(first)}
    here = F.struct(F.col("range").alias("range"), F.lit(0).alias("place"))
    lead = F.array(here)
    if before:
        to = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[low_id]
        lead = F.when(to.isNull(), lead).otherwise(F.array(here, F.struct(to.alias("range"), F.lit(1).alias("place"))))
    placed = rows.select(F.explode(lead).alias("to"), "doc_id", "text").select("to.range", "to.place", "doc_id", "text")
    return placed.repartitionById(len(ends) + 1, "range").sortWithinPartitions("range", "place", F.col("doc_id").asc_nulls_first(), "text")


def near_copies(docs: DataFrame) -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and their likeness to it and to the next document's."""

    def close(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """rows: (doc_id, text) with the row that follows the last one at the end."""
        texts = [t.encode("utf-8", "surrogatepass") for _, t in rows]
        edits = [edited_text(a[1], b[1]).encode("utf-8", "surrogatepass") for a, b in zip(rows, rows[1:], strict=False)]
        own, new = digests(texts), digests(edits)
        mine, after = (own[0][:-1], own[1][:-1]), (own[0][1:], own[1][1:])
        cols = [[d for d, _ in rows[:-1]], [len(t) for _, t in rows[:-1]], [hashlib.sha256(x).hexdigest() for x in edits], encode(*mine), encode(*new), likeness(mine, new), likeness(mine, after)]
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(EDITED)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, here, over = 0, None, False
        for batch in batches:
            for rng, place, doc, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if rng != here:
                    held, size, here, over = [], 0, rng, False
                if over:
                    continue
                held.append((doc, text))
                size += len(text)
                if place == 1:  # the first one only closes the range
                    over = True
                if len(held) > 1 and (over or size > 2 << 20):
                    yield from close(held)
                    held, size = held[-1:], 0

    return with_next(docs).mapInArrow(run, EDITED)
