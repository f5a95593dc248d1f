"""Phrase collocation mining by multikey quicksort of suffix pointers.

Texts are cut into pieces and words, and every word of a piece starts a suffix of at most `longest` words. A
suffix goes to the task that its leading words name, so that task meets all occurrences of what starts with
them. There pointers to the suffixes are sorted by three-way partitioning on one word after another: the equal
part of a split holds the suffixes that share one word more, and its size is that phrase's count. Parts of
fewer than `least` occurrences are abandoned; no phrase under them can be frequent. All parts are split at
once, in arrays. Equal suffixes of one batch of texts travel as one, with their number.

Before that words are counted. Words under `least` end a suffix, as no frequent phrase has one; a filter of
fixed size tells them (what it lets through in error is only more work). Two leading words may start a third
of all suffixes, so prefixes that a share of the documents shows to be too common (`HOT` at most) are dealt by
one word more, and their own counts, partial in each task, are summed up by Spark. The estimate decides where
suffixes go, never what is counted.

Cuts are scored by joins of the frequent phrases with each other, in decimals of 38 digits. A phrase is
dropped if one that is a word longer and holds it is as frequent; that is enough, as a phrase between two of
equal counts has that count too.

Defined results: a null text has no words; a null lang is `und`; equal documents count each; very long texts
are taken whole, in batches of their own; words with any other white space or control character stay whole;
ties go by cut, then score, a, phrase; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegrid.llm.common import materialize

LONGEST = 5
#: Bits of the filter on frequent words.
FILTER_BITS = 1 << 26
#: Common prefixes that are dealt by one word more, at most.
HOT = 4096
#: Words that are named by number, at most, and their greatest length.
LISTED, LISTED_BYTES = 1 << 16, 32
#: Suffixes of one document in so many are looked at for common prefixes.
ESTIMATE = 16
#: Text of one batch, suffixes of one bucket (about).
BATCH_BYTES, BUCKET_WORDS = 5 << 20, 1 << 20
WORD_BITS = 21
MIX = np.uint64(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True


class Words:
    """The words of a batch of texts as codes of its own list: codes, piece numbers, document numbers."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        raw = [x.encode() if x else b"" for x in texts.to_pylist()]
        ends = np.cumsum([len(x) + 1 for x in raw])
        data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]  # a document ends a piece
        gap = _GAP[data]
        inside = np.concatenate(([False], ~gap, [False]))
        edge = np.diff(inside.view(np.int8))
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.concatenate(([0], np.cumsum(stops - starts))).astype(np.int64)
        kept = data[~gap].tobytes()
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
        coded = words.dictionary_encode()
        self.words: list[bytes] = coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy()
        self.piece = np.cumsum(_BREAK[data], dtype=np.int32)[starts]
        self.doc = np.searchsorted(ends, starts, side="right").astype(np.int32)


def batches_of(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    from notegrid.llm.common import slices

    return slices(batch, "text", most)


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches put together until they hold about `most` bytes of text."""
    held, size = [], 0
    for batch in batches:
        for part in batches_of(batch, most):
            n = part.column("text").nbytes
            if held and size + n > most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield pa.Table.from_batches(held)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words), np.uint64, len(words))


def filter_slot(lang: str, word: bytes) -> int:
    return zlib.crc32(lang.encode() + b" " + word) % FILTER_BITS


def mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a prefix and the hash of its next word."""
    h = (h ^ word) * MIX
    return h ^ (h >> np.uint64(29))


class Suffixes:
    """Distinct suffixes of a batch: matrix of codes + 1 (0: none), langs, counts."""

    def __init__(self, lang: np.ndarray, matrix: np.ndarray):
        col = lambda k: matrix[:, k].astype(np.int64)
        low, high = lang.astype(np.int64) << 2 * WORD_BITS | col(0) << WORD_BITS | col(1), col(2) << 2 * WORD_BITS | col(3) << WORD_BITS | col(4)
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        new = np.ones(len(order), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        first = np.flatnonzero(new)
        self.counts = np.diff(np.append(first, len(order)))
        self.matrix, self.lang = matrix[order[first]], lang[order[first]]


def suffix_matrix(codes: np.ndarray, piece: np.ndarray, lang: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lang, matrix) of all suffixes of two words or more; ok: per word, whether it can be in a phrase."""
    n = len(codes)
    matrix = np.zeros((n, LONGEST), np.int32)
    going = ok.copy()
    matrix[:, 0] = np.where(going, codes + 1, 0)
    for k in range(1, LONGEST):
        m = max(0, n - k)
        going[m:] = False
        going[:m] &= ok[k:] & (piece[k:] == piece[:m])
        matrix[:m, k] = np.where(going[:m], codes[k:] + 1, 0)
    keep = matrix[:, 1] > 0
    return lang[keep], matrix[keep]


def blob(matrix: np.ndarray, lang: np.ndarray, counts: np.ndarray, words: list[bytes], langs: list[str], listed: int) -> bytes:
    """Some suffixes. matrix: 0 none, 1 to listed a word of the common list, beyond that listed + 1 + number in words; the blob has its own list of these and of langs."""
    matrix, other = matrix.copy(), matrix > listed
    used, own = np.unique(matrix[other], return_inverse=True)
    matrix[other] = listed + 1 + own
    tongues, lang = np.unique(lang, return_inverse=True)
    bytes_of = lambda x, n: np.ascontiguousarray(np.moveaxis(np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(*x.shape, 4)[..., :n], -1, 0)).tobytes()
    parts = [b"\n".join(words[c - listed - 1] for c in used), json.dumps([langs[i] for i in tongues]).encode(), bytes_of(matrix.T, 3), bytes_of(lang, 3), bytes_of(counts, 4)]
    whole = struct.pack("<I", len(matrix)) + b"".join(struct.pack("<I", len(p)) + p for p in parts)
    return struct.pack("<I", len(whole)) + pa.compress(whole, codec="zstd", asbytes=True)


def unblob(data: bytes) -> tuple[list[bytes], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Own words, langs, matrix, lang numbers, counts."""
    whole = pa.decompress(data[4:], struct.unpack_from("<I", data)[0], codec="zstd", asbytes=True)
    (n,) = struct.unpack_from("<I", whole)
    at, parts = 4, []
    for _ in range(5):
        (size,) = struct.unpack_from("<I", whole, at)
        parts.append(whole[at + 4 : at + 4 + size])
        at += 4 + size

    def number(x: bytes, planes: int, size: int) -> np.ndarray:
        out = np.zeros((size, 4), np.uint8)
        out[:, :planes] = np.frombuffer(x, np.uint8).reshape(planes, size).T
        return out.view("<u4").ravel()

    matrix = number(parts[2], 3, n * LONGEST).reshape(LONGEST, n).T.astype(np.int32)
    return parts[0].split(b"\n") if parts[0] else [], json.loads(parts[1]), matrix, number(parts[3], 3, n), number(parts[4], 4, n).astype(np.int64)


def depths(hash_of: np.ndarray, lang_hash: np.ndarray, matrix: np.ndarray, lang: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per suffix: depth and hash of the words it is dealt by; shorter prefixes than the depth are common, and counted in parts. hash_of: by code, of words; hot: sorted hashes of common prefixes."""
    h = mixed(mixed(lang_hash[lang], hash_of[matrix[:, 0]]), hash_of[matrix[:, 1]])
    depth = np.full(len(matrix), 2)
    if len(hot):
        for k in range(2, LONGEST):
            at = np.flatnonzero((depth == k) & (matrix[:, k - 1] > 0))
            at = at[hot[np.minimum(np.searchsorted(hot, h[at]), len(hot) - 1)] == h[at]]
            depth[at] = k + 1
            at = at[matrix[at, k] > 0]  # what ends here has no further word
            h[at] = mixed(h[at], hash_of[matrix[at, k]])
    return depth, h


def quicksort_counts(matrix: np.ndarray, counts: np.ndarray, root: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(rows, length, counts): a row that starts with each phrase of at least `least` occurrences, for the phrases found in one round.

    matrix: codes, 0 after the end; counts: occurrences of each row; root: rows of different roots share no phrase.
    Three-way partitioning of all parts at once: a part is a run of pointers that share their root and `depth`
    words, and is split by the word after them into less, equal and greater than the word of its middle row.
    """
    pointer = np.argsort(root, kind="stable")
    bounds = np.flatnonzero(np.diff(root[pointer], prepend=-1))
    size, depth = np.diff(np.append(bounds, len(pointer))), np.zeros(len(bounds), np.int64)
    while len(size):
        start = np.cumsum(size) - size
        part = np.repeat(np.arange(len(size)), size)
        word = matrix[pointer, np.repeat(depth, size)]
        # the middle of three rows
        a, b, c = word[start], word[start + size // 2], word[start + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[part]
        side = np.where(word < pivot, 0, np.where(word == pivot, 1, 2))
        key = part * 3 + side
        order = np.argsort(key, kind="stable")
        pointer, key, word = pointer[order], key[order], word[order]
        sizes = np.bincount(key, minlength=3 * len(size))
        weights = np.bincount(key, weights=counts[pointer], minlength=3 * len(size)).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        below = np.repeat(depth, 3)
        equal = np.tile([False, True, False], len(size))
        some = sizes > 0
        ended = np.zeros(len(sizes), bool)
        ended[some & equal] = word[starts[some & equal]] == 0  # the suffixes end here
        alive = some & (weights >= least) & ~ended
        below = below + equal
        for k in range(2, LONGEST + 1):
            done = alive & equal & (below == k)
            if done.any():
                yield pointer[starts[done]], k, weights[done]
        alive &= below < LONGEST
        pointer = pointer[alive[key]]
        size, depth = sizes[alive], below[alive]


def phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, count) of all phrases of 1 to LONGEST words that occur `least` times, and (lang, n)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "lang string, phrase string, words int, count long"
    arrow = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("count", pa.int64())])

    def coded(part: pa.Table) -> tuple[Words, list[str], np.ndarray]:
        words = Words(part.column("text").combine_chunks())
        lang = part.column("lang").combine_chunks().dictionary_encode()
        return words, lang.dictionary.to_pylist(), lang.indices.to_numpy()[words.doc]

    def counted(batches):
        """Counts of words, and of prefixes of some documents (words: 2 and more)."""
        for part in gathered(batches, BATCH_BYTES):
            words, langs, lang = coded(part)
            if not len(words.codes):
                continue
            pair, n = np.unique(lang.astype(np.int64) * len(words.words) + words.codes, return_counts=True)
            at, code = np.divmod(pair, len(words.words))
            out = [([langs[i] for i in at], [words.words[c].decode() for c in code], np.ones(len(n), np.int32), n)]
            some = words.doc % ESTIMATE == 0
            s = Suffixes(*suffix_matrix(words.codes[some], words.piece[some], lang[some], np.ones(np.count_nonzero(some), bool)))
            for k in range(2, LONGEST):
                starts = np.flatnonzero((np.diff(s.matrix[:, :k], axis=0, prepend=-1) != 0).any(axis=1) | (np.diff(s.lang, prepend=-1) != 0)) if len(s.lang) else np.zeros(0, np.int64)
                if not len(starts):
                    continue
                sums = np.add.reduceat(s.counts, starts)
                top = np.argsort(-sums, kind="stable")[: HOT // 4]
                top = top[s.matrix[starts[top], k - 1] > 0]
                names = [b" ".join(words.words[c - 1] for c in s.matrix[r, :k]).decode() for r in starts[top]]
                out.append(([langs[i] for i in s.lang[starts[top]]], names, np.full(len(top), k, np.int32), sums[top]))
            for a, b, c, d in out:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int32()), pa.array(d, pa.int64())], schema=arrow)

    first = materialize(rows.mapInArrow(counted, schema).groupBy("lang", "phrase", "words").agg(F.sum("count").alias("count")), "words")
    words = first.filter("words = 1")
    totals = words.groupBy("lang").agg(F.sum("count").alias("n"))
    single = words.filter(F.col("count") >= least)
    slot = F.crc32(F.concat_ws(" ", "lang", "phrase").cast("binary")) % FILTER_BITS
    bits = single.select(slot.alias("slot")).select(F.expr("bitmap_bucket_number(slot + 1)").alias("b"), F.expr("bitmap_bit_position(slot + 1)").alias("p"))
    bits = bits.groupBy("b").agg(F.expr("bitmap_construct_agg(p)").alias("bits")).collect()  # FILTER_BITS in all
    held = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in bits:  # buckets of 4096 bytes, from 1
        held[(r["b"] - 1) << 12 : r["b"] << 12] = np.frombuffer(r["bits"], np.uint8)
    known = spark.sparkContext.broadcast(held)
    # words that suffixes name by number instead of by text; the rest is slower, not different
    usual = single.filter(f"octet_length(phrase) <= {LISTED_BYTES}").groupBy("phrase").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "phrase").limit(LISTED)
    listed = spark.sparkContext.broadcast([r["phrase"].encode() for r in usual.select("phrase").collect()])
    total = totals.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_WORDS))
    # prefixes that would fill a quarter of a bucket; there are at most 4 x buckets of each length, and the list holds the first HOT
    common = first.filter((F.col("words") > 1) & (F.col("count") * ESTIMATE >= max(least, BUCKET_WORDS // 4))).orderBy(F.desc("count"), "lang", "phrase").limit(HOT).collect()

    def prefix_hash(lang: str, phrase: str) -> int:
        h = hashes([lang.encode()])
        for w in phrase.split(" "):
            h = mixed(h, hashes([w.encode()]))
        return int(h[0])

    hot = np.array(sorted({prefix_hash(r["lang"], r["phrase"]) for r in common}), np.uint64)

    def dealt(batches):
        schema = pa.schema([("bucket", pa.int64()), ("data", pa.binary())])
        number, usual = {w: i + 1 for i, w in enumerate(listed.value)}, len(listed.value)
        for part in gathered(batches, BATCH_BYTES):
            w, langs, lang = coded(part)
            if not len(w.codes):
                continue
            pair, back = np.unique(lang.astype(np.int64) * len(w.words) + w.codes, return_inverse=True)
            slots = np.fromiter((filter_slot(langs[p // len(w.words)], w.words[p % len(w.words)]) for p in pair.tolist()), np.int64, len(pair))
            frequent = (known.value[slots >> 3] >> (slots & 7)) & 1 > 0
            s = Suffixes(*suffix_matrix(w.codes, w.piece, lang, frequent[back]))
            if not len(s.lang):
                continue
            hash_of = np.concatenate((np.zeros(1, np.uint64), hashes(w.words)))
            _, h = depths(hash_of, hashes([x.encode() for x in langs]), s.matrix, s.lang, hot)
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            named = np.fromiter((number.get(x, usual + 1 + i) for i, x in enumerate(w.words)), np.int32, len(w.words))
            matrix = np.concatenate((np.zeros(1, np.int32), named))[s.matrix]
            for rows in np.split(order, cuts[1:]):
                data = blob(matrix[rows], s.lang[rows], s.counts[rows], w.words, langs, usual)
                yield pa.RecordBatch.from_arrays([pa.array([bucket[rows[0]]], pa.int64()), pa.array([data], pa.binary())], schema=schema)

    def sorted_out(table):
        parts = [unblob(x) for x in table.column("data").to_pylist()]
        usual = len(listed.value)
        names = pa.array([w for p in parts for w in p[0]], pa.binary()).dictionary_encode()
        tongues = pa.array([w for p in parts for w in p[1]], pa.string()).dictionary_encode()
        name_of, tongue_of = [*listed.value, *names.dictionary.to_pylist()], tongues.dictionary.to_pylist()
        code, lang_code = names.indices.to_numpy(), tongues.indices.to_numpy()
        matrices, langs, at, lang_at = [], [], 0, 0
        for words, own, matrix, lang, _ in parts:
            matrices.append(np.concatenate((np.arange(usual + 1), code[at : at + len(words)] + usual + 1)).astype(np.int32)[matrix])
            langs.append(lang_code[lang_at : lang_at + len(own)][lang])
            at, lang_at = at + len(words), lang_at + len(own)
        matrix, lang, counts = np.concatenate(matrices), np.concatenate(langs).astype(np.int64), np.concatenate([p[4] for p in parts])
        del parts, matrices, langs
        depth, _ = depths(np.concatenate((np.zeros(1, np.uint64), hashes(name_of))), hashes([x.encode() for x in tongue_of]), matrix, lang, hot)
        out = []

        def add(rows, k, n):
            out.append(([tongue_of[i] for i in lang[rows]], [b" ".join(name_of[c - 1] for c in r).decode() for r in matrix[rows, :k]], np.full(len(rows), k, np.int32), n))

        for k in range(2, LONGEST):  # parts of the counts of common prefixes
            at = np.flatnonzero(depth > k)
            if len(at):
                _, one, back = np.unique(np.column_stack((lang[at], matrix[at, :k])), axis=0, return_index=True, return_inverse=True)
                add(at[one], k, np.bincount(back.ravel(), weights=counts[at]).astype(np.int64))
        for rows, k, n in quicksort_counts(matrix, counts, lang, least):
            own = depth[rows] <= k
            if own.any():
                add(rows[own], k, n[own])
        return pa.concat_tables([pa.table([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int32()), pa.array(d, pa.int64())], schema=arrow) for a, b, c, d in out]) if out else arrow.empty_table()

    blobs = rows.mapInArrow(dealt, "bucket long, data binary")
    found = blobs.groupBy("bucket").applyInArrow(sorted_out, schema)
    several = found.groupBy("lang", "phrase", "words").agg(F.sum("count").alias("count")).filter(F.col("count") >= least)
    return materialize(several.unionByName(single), "phrases"), totals


def scores(cuts: DataFrame) -> DataFrame:
    """score: floor(1000 * a * n / (l * r)), exact while 1000 * a * n has 38 digits at most."""
    return cuts.withColumn("score", F.expr("(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(16,0))) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"))


def mine(docs: DataFrame, least: int = 100, top: int = 2000, spread: int = 64) -> DataFrame:
    """The first `top` phrases of each lang: lang, rank, phrase, a, l, r, n, score."""
    known, totals = phrases(docs, least)
    several = known.filter("words > 1")
    cut = several.select("lang", "phrase", "words", F.col("count").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - words)")})
    side = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("count").alias(n))
    cut = materialize(cut.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]), "cuts")
    # what a phrase of one word more, that is as frequent, holds
    held = cut.filter("k = words - 1 AND l <= a").select("lang", F.col("left").alias("phrase")).unionByName(cut.filter("k = 1 AND r <= a").select("lang", F.col("right").alias("phrase")))
    lowest = scores(cut.join(totals, "lang")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("s")).select("lang", "phrase", "s.a", "s.l", "s.r", "s.n", "s.score")
    alone = lowest.join(held.distinct(), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = alone.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(spread))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top).drop("part")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS p FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.k, c.a, cut, l.a AS l, r.a AS r, n.n, CAST((1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
      FROM c JOIN n USING (lang) JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(p[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(p[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
h AS (SELECT lang, array_to_string(p[1:k - 1], ' ') AS phrase, a FROM c UNION SELECT lang, array_to_string(p[2:], ' '), a FROM c)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.lang = b.lang AND h.phrase = b.phrase AND h.a >= b.a)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
