"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every text are computed once in Arrow batches. Trees are grown on binned statistics of the rows of
at most sample_rows labels (a hash of doc_id decides): each level sums gradients into
(node, statistic, bin) histograms with one bincount. All trees have one depth and are flattened into three
arrays, so a batch of documents walks every tree at once by numpy indexing.

Defined results: a null text counts as empty and is scored like one; very long texts are measured whole; labels
that are null or whose row has no document teach nothing; without labels every score is 0.5, with one class only
it is near that class; of equally good cuts the first is taken; repeated rows get equal scores; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegrid.llm.common import crc_fold, map_text, materialize

STATISTICS = ("log_chars", "upper", "lower", "digit", "space", "newline", "beyond_ascii", "exclamation", "symbol", "stop_mark", "word_length", "word_spread", "distinct_words", "top_word", "distinct_pairs", "symbol_ends", "upper_words", "title_words", "repeated_lines", "line_length", "short_words", "entropy", "digit_words")
# classes of bytes
_KIND = np.zeros(256, np.int64)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[32], _KIND[10], _KIND[128:] = 1, 2, 3, 4, 5, 6
_KIND[33] = 7
_KIND[[ord(c) for c in "#$%&*@^~|<>=_{}[]\\/+"]] = 8
_KIND[[ord(c) for c in ".,;:?"]] = 9
_SYMBOL = tuple("#$%&*!@^~|<>=_{}[]\\/+")


def statistics(texts: list[str]) -> np.ndarray:
    """A row of STATISTICS for each text."""
    n = len(texts)
    out = np.zeros((n, len(STATISTICS)), np.float32)
    datas = [x.encode("utf-8", "surrogatepass") for x in texts]
    size = np.fromiter(map(len, datas), np.int64, n)
    joined = np.frombuffer(b"".join(datas), np.uint8)
    counts = np.bincount(np.repeat(np.arange(n) * 256, size) + joined, minlength=n * 256).reshape(n, 256).astype(np.float64)
    total = np.maximum(size, 1)[:, None]
    share = counts / total
    kinds = np.stack([share[:, _KIND == k].sum(axis=1) for k in range(10)], axis=1)
    out[:, 0] = np.log1p(size)
    out[:, 1:10] = kinds[:, 1:10]
    with np.errstate(divide="ignore", invalid="ignore"):
        out[:, 21] = -np.where(share > 0, share * np.log2(share), 0).sum(axis=1)
    for i, text in enumerate(texts):
        words = text.split()
        m = len(words)
        if not m:
            continue
        lengths = np.fromiter(map(len, words), np.float64, m)
        seen = Counter(words)
        lines = [x for x in text.split("\n") if x]
        out[i, 10], out[i, 11] = lengths.mean(), lengths.std()
        out[i, 12] = len(seen) / m
        out[i, 13] = max(seen.values()) / m
        out[i, 14] = len(set(zip(words, words[1:], strict=False))) / max(1, m - 1)
        out[i, 15] = sum([c for w, c in seen.items() if w.endswith(_SYMBOL)]) / m
        out[i, 16] = sum([c for w, c in seen.items() if len(w) > 1 and w.isupper()]) / m
        out[i, 17] = sum([c for w, c in seen.items() if w.istitle()]) / m
        out[i, 18] = 1 - len(set(lines)) / len(lines) if lines else 0
        out[i, 19] = np.log1p(len(text) / max(1, len(lines)))
        out[i, 20] = (lengths <= 3).mean()
        out[i, 22] = sum([c for w, c in seen.items() if not w.isalpha() and any(map(str.isdigit, w))]) / m
    return out


class Trees:
    """Trees of one depth in arrays: statistic and bin of each inner node, value of each leaf."""

    def __init__(self, cuts: list[np.ndarray], base: float, statistic: np.ndarray, bin_: np.ndarray, leaf: np.ndarray):
        self.cuts, self.base, self.statistic, self.bin, self.leaf = cuts, base, statistic, bin_, leaf

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1).astype(np.int16) if len(x) else np.zeros(x.shape, np.int16)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        count = len(self.leaf)
        if not count:
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        b, rows, trees = self.binned(x), np.arange(len(x))[:, None], np.arange(count)[None, :]
        node = np.zeros((len(x), count), np.int64)
        inner = self.statistic.shape[1]
        while node[0, 0] < inner if len(x) else False:
            node = 2 * node + 1 + (b[rows, self.statistic[trees, node]] > self.bin[trees, node])
        return 1 / (1 + np.exp(-(self.base + self.leaf[trees, node - inner].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, ridge: float = 2.0) -> Trees:
    """Boost trees on the logistic loss."""
    if not len(y):
        return Trees([], 0.0, np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, 0)))
    p = np.clip(y.mean(), 0.01, 0.99)
    base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    model = Trees(cuts, base, np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), bins, np.int64), np.zeros((trees, 2**depth)))
    b = model.binned(x).astype(np.int64)
    n, m = b.shape
    flat = b + np.arange(m) * (bins + 1)
    total = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for d in range(depth):
            at = node - (2**d - 1)
            slot = (at[:, None] * (m * (bins + 1)) + flat).ravel()
            hist = [np.bincount(slot, np.repeat(v, m), minlength=2**d * m * (bins + 1)).reshape(2**d, m, bins + 1).cumsum(axis=2) for v in (g, h)]
            gl, hl = hist
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < 1) | (ht - hl < 1)] = 0
            best = gain.reshape(2**d, -1).argmax(axis=1)
            top = gain.reshape(2**d, -1).max(axis=1)
            own = np.arange(2**d) + 2**d - 1
            model.statistic[t, own] = best // (bins + 1)
            model.bin[t, own] = np.where(top > 1e-9, best % (bins + 1), bins)  # no gain: all go left
            node = 2 * node + 1 + (b[np.arange(n), model.statistic[t, node]] > model.bin[t, node])
        at = node - (2**depth - 1)
        model.leaf[t] = rate * np.bincount(at, g, minlength=2**depth) / (np.bincount(at, h, minlength=2**depth) + ridge)
        total += model.leaf[t][at]
    return model


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns with the statistics of the text."""
    source = docs.select(*keep, *([] if "text" in keep else ["text"]))
    schema = T.StructType([*[source.schema[c] for c in keep], T.StructField("statistics", T.ArrayType(T.FloatType()))])
    return map_text(source, lambda texts, part: {c: part.column(c) for c in keep} | {"statistics": list(statistics(texts))}, schema)


def sampled(labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """(doc_id, y) of the sample_rows usable labels(doc_id, quality) that come first by a hash of the doc_id."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("y"))
    return known.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id", "y").limit(sample_rows)


def fit(measured: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Trees:
    """Fit on measured(doc_id, statistics) and labels(doc_id, quality), of which sample_rows at most are taken."""
    return fit_sample(measured, sampled(labels, sample_rows))


def fit_sample(measured: DataFrame, sample: DataFrame) -> Trees:
    """Fit on measured(doc_id, statistics) and a sample(doc_id, y) of bounded size."""
    rows = measured.join(F.broadcast(sample), "doc_id").select("doc_id", "statistics", "y").toPandas()
    rows = rows.sort_values(["doc_id", "y"], kind="stable")
    x = np.stack(rows["statistics"].to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, len(STATISTICS)))
    return grow(x, rows["y"].to_numpy(np.float64))


def score(measured: DataFrame, model: Trees) -> DataFrame:
    """doc_id and score of each measured row."""
    held = measured.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array(batch.column("statistics").to_pylist(), np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held.value.score(x))], names=["doc_id", "score"])

    return measured.select(F.col("doc_id").cast("long").alias("doc_id"), "statistics").mapInArrow(run, schema)


def held_out_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """Learn from labels outside the held-out fold and score every document."""
    measured = materialize(measure(docs), "statistics")
    model = fit(measured, labels.filter(crc_fold("doc_id", folds) != held))
    return score(measured, model).select("doc_id", F.coalesce(crc_fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
