"""Personal data: base rules, and a character BiLSTM-CRF in numpy that adds spans.

The base rules find email, ip, card and phone spans exactly. The network reads overlapping windows of
characters and gives each a tag (O, or begin / inside of a kind); its CRF layer learns transitions. It is
trained here, from spans labelled by the rules in a bounded sample of rows and from the same passages with
values put in that no rule covers (national phone numbers, dotted cards, spaced addresses ...). A document's
windows are decoded together and reconciled as a whole: pieces cut by a window's edge are joined, then the
best set of spans that don't overlap is chosen by weighted interval scheduling. A span is added where it
meets its kind's check (digits, Luhn, parts) and no base span.

Every kind needs a digit or '@', so windows without either are O by definition and never reach the network.

Defined results: a null text counts as empty; texts without findings have '' for spans; offsets are code
points, ends exclusive; very long texts are read whole, in time linear in their length but for sorting; of
equally good sets of spans the one with the earlier ends is taken; repeated rows give equal results; an empty
table gives no rows, and a tagger trained on made values alone; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegrid.llm.common import map_text

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)
WIDTH, STRIDE, HIDDEN, EMBED = 96, 64, 12, 10
CLASSES, PAD = 134, 133

HINT = re.compile("[0-9@]")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match always begins a run of digits
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each '@' outwards in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    if not HINT.search(text):
        return []
    out = [(0, s, e) for s, e in emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        own = digits(m.group())
        if 16 <= len(own) <= 19 and luhn(own):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]
    return out


def holds(kind: int, text: str, start: int, end: int) -> bool:
    """Whether a span of the network meets its kind's check."""
    own, number = text[start:end], digits(text[start:end])
    if any("0" <= c <= "9" for c in (text[start - 1 : start] if start else "", text[end : end + 1]) if c) and kind:
        return False
    if kind == 0:
        head, _, tail = own.partition("@")
        return bool(head.strip()) and "." in tail and len(own) <= 254 and "\n" not in own
    if kind == 1:
        parts = re.findall("[0-9]+", own)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 16 <= len(number) <= 19 and luhn(number)
    return 10 <= len(number) <= 15 and not re.search(r"[A-Za-z]", own)


def text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def classes(text: str) -> np.ndarray:
    """Classes of characters: ASCII as itself, others by case, space or rest."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.minimum(code, 132).astype(np.int64)
    for i in np.flatnonzero(code >= 128):
        c = chr(code[i])
        out[i] = 128 if c.islower() else 129 if c.isupper() else 130 if c.isspace() else 131
    return out


class Tagger:
    """Weights of the network; forward pass, training step and decoding."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {"emb": g(CLASSES, EMBED) * 3, "out": g(2 * HIDDEN, TAGS), "outb": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.w |= {f"x{d}": g(EMBED, 4 * HIDDEN), f"h{d}": g(HIDDEN, 4 * HIDDEN), f"c{d}": np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)}
        # an inside tag only follows its own kind
        self.ban = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(KINDS)):
            own = [1 + 2 * k, 2 + 2 * k]
            self.ban[[t for t in range(TAGS) if t not in own], 2 + 2 * k] = -1e4

    def lstm(self, x: np.ndarray, d: str, keep: bool = False):
        """Hidden states (T, N, H) of one direction over classes x (N, T)."""
        w, n, steps = self.w, len(x), x.shape[1]
        table = w["emb"] @ w[f"x{d}"] + w[f"c{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, held = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = table[x[:, t]] + h @ w[f"h{d}"]
            # sigmoid by tanh for input, forget and output gates
            z[:, : 3 * HIDDEN] = 0.5 * np.tanh(0.5 * z[:, : 3 * HIDDEN]) + 0.5
            i, f, o = z[:, :HIDDEN], z[:, HIDDEN : 2 * HIDDEN], z[:, 2 * HIDDEN : 3 * HIDDEN]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, prev = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                held.append((t, i, f, o, g, before, tc, prev))
        return (out, held) if keep else out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.lstm(x, "f"), self.lstm(x, "b")], axis=2)
        return both @ self.w["out"] + self.w["outb"]

    def messages(self, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log messages (T, N, TAGS), and the log partition."""
        steps, trans = len(emit), self.w["trans"] + self.ban
        grow = np.exp(trans)
        a, b = np.empty_like(emit), np.empty_like(emit)
        a[0], b[-1] = emit[0], 0
        for t in range(1, steps):
            top = a[t - 1].max(axis=1, keepdims=True)
            a[t] = np.log(np.exp(a[t - 1] - top) @ grow + 1e-30) + top + emit[t]
        for t in range(steps - 2, -1, -1):
            v = b[t + 1] + emit[t + 1]
            top = v.max(axis=1, keepdims=True)
            b[t] = np.log(np.exp(v - top) @ grow.T + 1e-30) + top
        top = a[-1].max(axis=1, keepdims=True)
        return a, b, (np.log(np.exp(a[-1] - top).sum(axis=1, keepdims=True)) + top)

    def train_step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the negative log likelihood of tags y (N, T)."""
        w, (n, steps) = self.w, x.shape
        sides = {d: self.lstm(x, d, True) for d in "fb"}
        both = np.concatenate([sides["f"][0], sides["b"][0]], axis=2)
        emit = both @ w["out"] + w["outb"]
        a, b, z = self.messages(emit)
        de = np.exp(a + b - z)
        tags = y.T
        de[np.arange(steps)[:, None], np.arange(n)[None, :], tags] -= 1
        de /= n
        pair = np.exp(a[:-1, :, :, None] + (w["trans"] + self.ban)[None, None] + (emit[1:] + b[1:])[:, :, None, :] - z[None, :, :, None]).sum(axis=(0, 1))
        np.add.at(pair, (tags[:-1].ravel(), tags[1:].ravel()), -1)
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["trans"] = (pair / n).astype(np.float32)
        grad["out"], grad["outb"] = np.einsum("tnh,tnk->hk", both, de), de.sum(axis=(0, 1))
        back = de @ w["out"].T
        for k, d in enumerate("fb"):
            dh_out = back[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            dtable = np.zeros((CLASSES, 4 * HIDDEN), np.float32)
            for t, i, f, o, g, before, tc, prev in reversed(sides[d][1]):
                dh = dh + dh_out[t]
                dc = dc + dh * o * (1 - tc**2)
                dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                grad[f"h{d}"] += prev.T @ dz
                np.add.at(dtable, x[:, t], dz)
                dh, dc = dz @ w[f"h{d}"].T, dc * f
            grad[f"x{d}"], grad[f"c{d}"] = w["emb"].T @ dtable, dtable.sum(axis=0)
            grad["emb"] += dtable @ w[f"x{d}"].T
        return grad

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 64, rate: float = 0.015, seed: int = 11) -> Tagger:
        """Adam with a falling rate."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(u) for k, u in self.w.items()}
        for s in range(1, steps + 1):
            own = rng.integers(0, len(x), batch)
            for k, g in self.train_step(x[own], y[own]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                step = rate * min(1.0, 2 * (1 - s / steps) + 0.05)
                self.w[k] -= (step * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-8)).astype(np.float32)
        return self

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (N, T) by Viterbi, and the marginal of each."""
        emit = self.emissions(x)
        steps, n, trans = len(emit), len(x), self.w["trans"] + self.ban
        best, back = emit[0], np.zeros(emit.shape, np.int8)
        for t in range(1, steps):
            v = best[:, :, None] + trans[None]
            back[t] = v.argmax(axis=1)
            best = v.max(axis=1) + emit[t]
        tags = np.empty((steps, n), np.int64)
        tags[-1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t][np.arange(n), tags[t]]
        a, b, z = self.messages(emit)
        sure = np.exp(np.take_along_axis(a + b, tags[:, :, None], 2)[:, :, 0] - z[:, 0])
        return tags.T, sure.T


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or '@'; windows begin at multiples of STRIDE."""
    out: list[int] = []
    for m in HINT.finditer(text):
        p = m.start()
        for k in range(max(0, (p - WIDTH) // STRIDE + 1), p // STRIDE + 1):
            if not out or k > out[-1]:
                out.append(k)
    return [k * STRIDE for k in out]


def reconcile(found: list[tuple[int, int, int, float, bool]], text: str) -> list[tuple[int, int, int]]:
    """Join pieces cut by window edges, then choose the spans of most weight that don't overlap."""
    joined: list[list] = []
    for k, s, e, p, cut in sorted(found):
        if joined and joined[-1][0] == k and s <= joined[-1][2] and (cut or joined[-1][4]):
            last = joined[-1]
            last[2], last[3], last[4] = max(last[2], e), max(last[3], p), last[4] or cut
        else:
            joined.append([k, s, e, p, cut])
    spans = sorted({(e, s, k, p) for k, s, e, p, _ in joined if p >= 0.8 and holds(k, text, s, e)})
    best, take = [0.0], []
    ends = [e for e, *_ in spans]
    for i, (_, s, _, p) in enumerate(spans):
        j = bisect_right(ends, s, 0, i)
        with_it = best[j] + p * (spans[i][0] - s)
        take.append((with_it > best[i], j))
        best.append(max(best[i], with_it))
    out, i = [], len(spans)
    while i:
        taken, j = take[i - 1]
        if taken:
            e, s, k, _ = spans[i - 1]
            out.append((k, s, e))
            i = j
        else:
            i -= 1
    return out


def tag_texts(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans of the network in each whole text."""
    where = [(i, s) for i, t in enumerate(texts) for s in (window_starts(t) if HINT.search(t) else ())]
    found: dict[int, list] = {}
    for at in range(0, len(where), 2048):
        part = where[at : at + 2048]
        x = np.full((len(part), WIDTH), PAD, np.int64)
        for r, (i, s) in enumerate(part):
            own = classes(texts[i][s : s + WIDTH])
            x[r, : len(own)] = own
        tags, sure = tagger.decode(x)
        for r in np.flatnonzero((tags > 0).any(axis=1)):
            i, s = part[r]
            row, t, size = tags[r], 0, min(WIDTH, len(texts[i]) - s)
            while t < size:
                if row[t] % 2:
                    kind, e = (row[t] - 1) // 2, t + 1
                    while e < size and row[e] == row[t] + 1:
                        e += 1
                    cut = (t == 0 and s > 0) or (e == WIDTH and s + WIDTH < len(texts[i]))
                    found.setdefault(i, []).append((int(kind), s + t, s + e, float(sure[r, t:e].mean()), cut))
                    t = e
                else:
                    t += 1
    return [reconcile(found[i], texts[i]) if i in found else [] for i in range(len(texts))]


def made_value(rng: random.Random) -> tuple[int, str]:
    """A value of some kind, in a form that the base rules cover or not."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    kind = rng.randrange(4)
    if kind == 0:
        name = rng.choice([word(), f"{word()}.{word()}", f"{word()}{d(2)}", f"{word()}é{word()}"])
        at = rng.choice(["@", "@", "@", " @ "])
        return 0, f"{name}{at}{rng.choice([word(), word() + d(1)])}.{rng.choice(['com', 'org', 'net', 'example.com', 'de'])}"
    if kind == 1:
        return 1, rng.choice([".", ".", ".", ". "]).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        number = d(15)
        number += next(c for c in "0123456789" if luhn(number + c))
        sep = rng.choice(["", "", " ", "-", ".", "/"])
        return 2, sep.join(number[i : i + 4] for i in range(0, 16, 4))
    return 3, rng.choice([f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(4)} {d(3)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"00{d(2)} {d(3)} {d(7)}"])


def made_decoy(rng: random.Random) -> str:
    """Digits or '@' that are no personal data."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice([d(rng.randint(1, 8)), f"{d(1)}.{d(1)}.", f"{d(2)}.{d(2)}", f"{d(1)},{d(3)},{d(3)}", f"{d(4)}-{d(2)}-{d(2)}", f"v{d(1)}.{d(2)}.{d(1)}", f"${d(3)}.{d(2)}", f"{d(2)}:{d(2)}", "@", f"@user{d(2)}", hashlib.md5(d(9).encode()).hexdigest(), f"#{d(5)}", f"{d(24)}"])


def examples(texts: list[str], count: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows: passages around base spans, and passages with made values or decoys put in."""
    rng = random.Random(seed)
    xs, ys = np.full((count, WIDTH), PAD, np.int64), np.zeros((count, WIDTH), np.int64)
    texts = [t for t in texts if t] or ["a b c"]
    real = [(t, s) for t in texts for s in base_spans(t)]
    for r in range(count):
        if real and rng.random() < 0.4:
            text, (_, s, _) = rng.choice(real)
            start = max(0, s - rng.randint(0, WIDTH - 8))
            text = text[start : start + WIDTH]
            spans = base_spans(text)
        else:
            source = HINT.sub("", rng.choice(texts))
            start = rng.randrange(max(1, len(source) - WIDTH))
            words = source[start : start + WIDTH].split(" ")
            text, spans = "", []
            at = {rng.randrange(len(words)) for _ in range(rng.randint(1, 2))}
            for i, word in enumerate(words):
                if i in at:
                    text += rng.choice([" ", " ", " ", "\n", ".", ""]) if text else ""
                    if rng.random() < 0.65:
                        kind, value = made_value(rng)
                        spans.append((kind, len(text), len(text) + len(value)))
                    else:
                        value = made_decoy(rng)
                    text += value + rng.choice(["", "", "", ".", ",", "%%%", "!!"])
                text += (" " if text else "") + word
        own = classes(text[:WIDTH])
        xs[r, : len(own)] = own
        for kind, s, e in spans:
            if s < WIDTH:
                ys[r, s:e] = 2 + 2 * kind
                ys[r, s] = 1 + 2 * kind
    return xs, ys


def fit(docs: DataFrame, sample_rows: int = 400, windows: int = 6000, steps: int = 900) -> Tagger:
    """Train on windows of about sample_rows documents with a digit or '@', 4 * sample_rows distinct passages at
    most; hashes of the text decide, so the same documents give the same tagger however they are dealt."""
    rows = docs.filter(F.col("text").rlike("[0-9@]")).select("text")
    n = rows.count()
    share = min(1 << 20, -(-(sample_rows << 20) // max(1, n)))
    # passages around the first hits keep the sample small; the training set is bounded anyway
    own = F.xxhash64("text", F.lit("pii"))
    picked = rows.filter(F.pmod(own, F.lit(1 << 20)) < share).select(own.alias("h"), F.expr("substring(text, greatest(1, regexp_instr(text, '[0-9@]') - 400), 2000)").alias("text"))
    texts = sorted(r["text"] for r in picked.distinct().orderBy("h", "text").limit(4 * sample_rows).collect())
    return Tagger().fit(*examples(texts, windows), steps=steps)


FOUND = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType()), T.StructField("n_spans", T.LongType())])


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of overlapping spans as (start, end, kind of the first one), in order."""
    out: list[list[int]] = []
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, k])
    return [tuple(x) for x in out]


def all_spans(tagger: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """Per text its base spans and the spans that the network adds."""
    out = []
    for text, got in zip(texts, tag_texts(tagger, texts), strict=True):
        base = base_spans(text)
        taken = merged(base)
        ends = [e for _, e, _ in taken]
        free = []
        for k, s, e in got:
            i = bisect_right(ends, s)  # the first run that ends behind s
            if i == len(taken) or e <= taken[i][0]:
                free.append((k, s, e))
        out.append((base, free))
    return out


def scores_by_kind(tagger: Tagger, texts: list[str], count: int, seed: int) -> dict[str, tuple[int, int, int]]:
    """Of made values that no base rule covers, put in passages of texts: by kind how many were there, found exactly,
    and how many spans were added in all."""
    rng = random.Random(seed)
    there, found, added = ([0] * len(KINDS) for _ in range(3))
    passages, wanted = [], []
    for _ in range(count):
        source = HINT.sub("", rng.choice(texts))
        at = rng.randrange(max(1, len(source) - 2000))
        words = source[at : at + rng.randint(50, 2000)].split(" ")
        i = rng.randrange(len(words))
        kind, value = made_value(rng) if rng.random() < 0.65 else (None, made_decoy(rng))
        head = " ".join(words[:i])
        head += " " if head else ""
        passages.append(head + value + rng.choice([" ", ".", ", "]) + " ".join(words[i:]))
        wanted.append((kind, len(head), len(head) + len(value)))
    for (base, got), want in zip(all_spans(tagger, passages), wanted, strict=True):
        for k, *_ in got:
            added[k] += 1
        if want[0] is not None and all(want[2] <= s or e <= want[1] for _, s, e in base):
            there[want[0]] += 1
            found[want[0]] += want in got
    return {k: (there[i], found[i], added[i]) for i, k in enumerate(KINDS)}


def find(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """Per row: doc_id, counts of base spans by kind, their digest, all spans as text, numbers of added and of all ones."""
    held = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(texts: list[str], part) -> dict:
        got = all_spans(held.value, texts)
        out = {f"n_{k}": [sum(x[0] == i for x in base) for base, _ in got] for i, k in enumerate(KINDS)}
        return out | {"doc_id": part.column("doc_id"), "base_sha256": [hashlib.sha256(text_of(base).encode()).hexdigest() for base, _ in got], "spans": [text_of(base + added) for base, added in got], "n_added": [len(added) for _, added in got], "n_spans": [len(base) + len(added) for base, added in got]}

    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, FOUND)


def redact(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """The documents with every run of overlapping spans replaced by the kind of its first one in brackets, and n_chars
    set anew; null texts stay null."""
    held = docs.sparkSession.sparkContext.broadcast(tagger)
    schema = docs.schema

    def run(texts: list[str], part) -> dict:
        out = {c: part.column(c) for c in part.schema.names}
        new = []
        for text, (base, added), was in zip(texts, all_spans(held.value, texts), part.column("text"), strict=True):
            parts, at = [], 0
            for s, e, k in merged(base + added):
                parts += [text[at:s], f"[{KINDS[k].upper()}]"]
                at = e
            new.append("".join(parts) + text[at:] if was.is_valid else None)
        out["text"] = new
        if "n_chars" in out:
            out["n_chars"] = [None if x is None else len(x) for x in new]
        return out

    return map_text(docs, run, schema)
