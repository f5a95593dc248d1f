"""Packing token sequences: first-fit decreasing with a tournament tree, in randomised groups of documents.

Every document is tokenised once and cut at multiples of the sequence length; whole blocks are sequences
of their own. The rest pieces go, document by document, to random groups of bounded size; each group is
packed by first-fit decreasing, where a tournament tree over the free room of the bins finds the first bin
that holds a piece in log time. Groups see lengths only, never ids or texts.

Strings of `special` stand for one id each, wherever they are in a text, as the tokenizers library reads the
added tokens of its files (added_tokens() lists them); the text around them is tokenised apart.

Defined results: a null or empty text has its end id only; a very long text is tokenised whole and cut;
repeated rows are packed each; equal lengths keep their order; an empty table gives no rows; other columns are
ignored; a sequence that isn't a power of two long is padded up to the sequence length.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegrid.llm.bpe import chunks
from notegrid.llm.common import map_text, materialize

PIECE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType())])
#: Bytes of chunks and ids that a worker remembers, about; and the length of a chunk that isn't remembered.
REMEMBER, LONG = 64 << 20, 256
_encoders: dict = {}


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizers file, by their string."""
    with open(path, encoding="utf-8") as f:
        return {x["content"]: int(x["id"]) for x in json.load(f)["added_tokens"]}


class Encoder:
    """The vocabulary's ids of chunks as little-endian bytes, remembered per worker process."""

    def __init__(self, path: str, pattern: str, special: dict[str, int]):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.seen: dict[str, bytes] = {}
        self.held = 0
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def plain(self, text: str) -> bytes:
        if self.held > REMEMBER:
            self.seen, self.held = {}, 0
        seen, encode, out = self.seen, self.encode, []
        for c in chunks(text):
            got = seen.get(c)
            if got is None:
                got = np.array(encode(c), "<u4").tobytes()
                if len(c) <= LONG:
                    seen[c] = got
                    self.held += len(got) + len(c) + 200
            out.append(got)
        return b"".join(out)

    def ids(self, text: str) -> bytes:
        if self.cut is None:
            return self.plain(text)
        parts = self.cut.split(text)
        return b"".join([self.special[x] if i % 2 else self.plain(x) for i, x in enumerate(parts) if x])


def encoder(path: str, pattern: str, special: dict[str, int]) -> Encoder:
    key = path, pattern, tuple(sorted(special.items()))
    if key not in _encoders:
        _encoders[key] = Encoder(path, pattern, special)
    return _encoders[key]


class TournamentTree:
    """Free room of bins; each inner node holds the largest room below it."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.most = [room] * (2 * self.size)

    def first_fit(self, length: int) -> int:
        """Put length into the first bin that has room for it; the bin's number."""
        most, i = self.most, 1
        while i < self.size:
            i *= 2
            i += most[i] < length
        bin_ = i - self.size
        most[i] -= length
        while i > 1:
            i //= 2
            most[i] = max(most[2 * i], most[2 * i + 1])
        return bin_


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces by descending length, ties in the given order."""
    tree = TournamentTree(len(lengths), room)
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        b = tree.first_fit(n)
        bins[i], offsets[i] = b, used.get(b, 0)
        used[b] = offsets[i] + n
    return bins, offsets


def pieces(docs: DataFrame, path: str, pattern: str, special: dict[str, int], end_id: int, length: int) -> DataFrame:
    """Per document its pieces of at most length ids, with the CRC of their ids."""

    def run(texts: list[str], part) -> dict:
        enc = encoder(path, pattern, special)
        end = np.array([end_id], "<u4").tobytes()
        out: dict = {n: [] for n in PIECE.fieldNames()}
        for doc, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
            ids = enc.ids(text) + end
            n = len(ids) // 4
            for s in range(0, n, length):
                own = ids[4 * s : 4 * (s + length)]
                for k, v in (("doc_id", doc), ("start", s), ("length", len(own) // 4), ("ids_crc32", zlib.crc32(own)), ("doc_tokens", n)):
                    out[k].append(v)
        return out

    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECE)


def pack(docs: DataFrame, path: str, pattern: str, special: dict[str, int] | None = None, end_id: int = 1, length: int = 2048, group_pieces: int = 8192) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. group_pieces: about so many pieces are packed together."""
    cut = materialize(pieces(docs, path, pattern, special or {}, end_id, length).withColumn("row", F.monotonically_increasing_id()), "pieces")
    n = max(1, round(cut.filter(F.col("length") < length).count() / group_pieces))
    rest = cut.filter(F.col("length") < length).withColumn("grp", F.pmod(F.xxhash64(F.col("doc_id"), F.col("row")), F.lit(n)))
    schema = T.StructType([*PIECE.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(key, pdf):
        pdf = pdf.sort_values(["row"], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), length)
        return pdf.drop(columns=["row", "grp"]).assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    packed = rest.groupBy("grp").applyInPandas(run, schema)
    # whole blocks are sequences of their own; their numbers are negative, so they never meet a group's
    whole = cut.filter(F.col("length") == length).select(*PIECE.fieldNames(), (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)
