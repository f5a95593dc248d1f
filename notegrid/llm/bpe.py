"""Byte-level BPE encoding and decoding with length-bucketed padded numpy matrices.

Method. Every text is cut at single spaces into chunks whose ends are always ends of pattern matches;
the distinct chunks that a worker hasn't seen lately are cut by the pattern into pieces. Distinct pieces
are laid out by length class in padded matrices of ids. In each round every row merges its leftmost
pair of minimum rank: pair ranks come from an open-addressing hash table, the row is compacted, and rows
without a mergeable pair leave. Documented bound: pieces beyond the longest class (256 bytes) use the same
rule on a heap, as the matrix would cost the square of the length; the ids are the same either way.

Defined results: a null text counts as empty; an empty text has 0 tokens; a very long text is encoded whole,
chunk by chunk; of equal ranks the leftmost pair merges first; repeated rows give repeated rows; an empty
table gives no rows; other columns are ignored; special-token strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from notegrid.llm.common import map_text

NONE = np.int32(2**31 - 1)
CLASSES = (4, 8, 12, 16, 24, 32, 64, 128, 256)
#: Bytes of chunks and ids that a worker remembers, about; beyond that it starts afresh.
REMEMBER = 160 << 20
_DOUBLE = re.compile(r"\s\s")
_SAFE = re.compile(r"(?<=\S)(?= \S)")
_coders: dict = {}


def chunks(text: str) -> list[str]:
    """Cut a text where a space follows a non-space and precedes one: no match of the pattern spans such a place."""
    if _DOUBLE.search(text):
        return _SAFE.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


class PairTable:
    """(left id, right id) -> rank of the merged token, by multiplicative hashing with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        keys = (left << 32 | right).astype(np.uint64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.rank = np.full(1 << self.bits, NONE)
        at, todo, self.probes = self.slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = self.keys[at[todo]] == np.uint64(2**64 - 1)
            _, first = np.unique(at[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[at[won]], self.rank[at[won]] = keys[won], rank[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE where the pair doesn't merge; negative ids are padding."""
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF).astype(np.uint64)
        at = self.slot(keys)
        out = np.full(keys.shape, NONE)
        for _ in range(self.probes):
            hit = self.keys[at] == keys
            out[hit] = self.rank[at[hit]]
            at = (at + 1) & ((1 << self.bits) - 1)
        out[(left < 0) | (right < 0)] = NONE
        return out


class Coder:
    """Encoder and decoder for one file of ranks (lines of base64 token and rank)."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.pattern = regex.compile(pattern)
        self.table = PairTable(self.ranks)
        self.bytes_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.token = {r: t for t, r in self.ranks.items()}
        self.seen: dict[str, tuple[int, str, bytes]] = {}
        self.held = 0

    def merge_rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of at most width bytes, all rows at once."""
        n = len(pieces)
        lens = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, width + 1), -1, np.int32)
        ids[np.arange(width + 1)[None, :] < lens[:, None]] = self.bytes_id[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((n, width + 1), NONE)
        rank[:, :-1] = self.table.find(ids[:, :-1], ids[:, 1:])
        out: list = [None] * n
        row, cols = np.arange(n), np.arange(width + 1)[None, :]
        while n:
            best = rank.argmin(axis=1)
            r = np.arange(n)
            low = rank[r, best]
            done = low == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[row[i]] = ids[i, : lens[i]].copy()
                keep = ~done
                ids, rank, row, lens, best, low = ids[keep], rank[keep], row[keep], lens[keep], best[keep], low[keep]
                n = len(row)
                if not n:
                    break
                r = np.arange(n)
            # drop the right half of each merged pair: columns after it move one to the left
            take = np.minimum(cols + (cols > best[:, None]), ids.shape[1] - 1)
            ids, rank = np.take_along_axis(ids, take, 1), np.take_along_axis(rank, take, 1)
            ids[:, -1], rank[:, -1] = -1, NONE
            ids[r, best] = low
            lens = lens - 1
            rank[r, best] = self.table.find(low, ids[r, best + 1])
            has = best > 0
            rank[r[has], best[has] - 1] = self.table.find(ids[r[has], best[has] - 1], low[has])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same rule for one long piece: a heap of (rank, position) over a linked list."""
        ids = self.bytes_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.table.find(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        pair = self.token
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := self.ranks.get(pair[r] + pair[ids[k]])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            if (h := before[i]) >= 0 and (x := self.ranks.get(pair[ids[h]] + pair[r])) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of distinct pieces, by length class."""
        out: list = [None] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        kind = np.searchsorted(CLASSES, size)
        for k in np.unique(kind):
            own = np.flatnonzero(kind == k)
            if k == len(CLASSES):
                for i in own:
                    out[i] = self.merge_long(pieces[i])
                continue
            step = max(1, (1 << 19) // CLASSES[k])
            for s in range(0, len(own), step):
                part = own[s : s + step]
                for i, got in zip(part, self.merge_rows([pieces[i] for i in part], CLASSES[k]), strict=True):
                    out[i] = got
        return out

    def decode(self, ids) -> bytes:
        return b"".join([self.token[i] for i in ids])

    def learn(self, cuts: list[list[str]]) -> None:
        """Encode the chunks that aren't remembered."""
        if self.held > REMEMBER:
            self.seen, self.held = {}, 0
        new = {c for cut in cuts for c in cut if c not in self.seen}
        split = {c: self.pattern.findall(c) for c in new}
        pieces = list({p for s in split.values() for p in s})
        ids = dict(zip(pieces, (x.tolist() for x in self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in pieces])), strict=True))
        for c, s in split.items():
            got = [i for p in s for i in ids[p]]
            self.seen[c] = (len(got), ",".join(map(str, got)), self.decode(got))
            self.held += 8 * len(c) + 400

    def encode(self, text: str) -> list[int]:
        cut = chunks(text)
        self.learn([cut])
        return [int(i) for c in cut if self.seen[c][0] for i in self.seen[c][1].split(",")]


def coder(path: str, pattern: str) -> Coder:
    """One per worker process and file."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (where with_ids), and digests of the ids and of the bytes decoded from them."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(texts: list[str], part) -> dict:
        c = coder(path, pattern)
        cuts = [chunks(x) for x in texts]
        c.learn(cuts)
        out: dict = {"doc_id": part.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        for cut in cuts:
            got = [c.seen[x] for x in cut]
            joined = ",".join([x[1] for x in got if x[0]])
            out["n_tokens"].append(sum([x[0] for x in got]))
            out["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(b"".join([x[2] for x in got])).hexdigest())
            if with_ids:
                out["ids"].append([int(i) for i in joined.split(",")] if joined else [])
        return out

    return map_text(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")), run, schema)
