"""Edge cases and brute force for the operators on documents."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# extra columns with names that the operators use themselves
EXTRA = SCHEMA + ", score double, row long, range int, digest string, n long, lang_pred string"
ODD = ["", None, "a", "ä b", " ", "\n\n", "x" * 3000, "word " * 4000, "The cat sat on the mat. 12.5%", "The cat sat on the mat. 12.5%", "emoji 😀 and <|endoftext|> 's", "tab\t\tand  two spaces ", "٣٤ ½ Ⅷ 漢字 \x1c\x85 end"]


def docs_of(spark, texts, extra=False, ids=None):
    rows = [(i, t, "en", "s", None if t is None else len(t)) + ((0.1, 5, 1, "x", 3, "zz") if extra else ()) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, EXTRA if extra else SCHEMA)


def tiktoken_of(name):
    import tiktoken

    with open(P.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def multi():
    from notegrid.llm.bpe import coder

    return coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), tiktoken_of("byte_bpe_multi_50k.tiktoken")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aab  \n\t.'sé"))))
def test_bpe_equals_library(multi, text):
    own, library = multi
    assert own.encode(text) == library.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def test_bpe_long_piece(multi):
    own, library = multi
    rng = random.Random(1)
    for text in ("ab" * 2000, "".join(rng.choice("abcdefg") for _ in range(3000)), "=" * 1500, "x" * 257):
        assert own.encode(text) == library.encode_ordinary(text)


def test_bpe_query(spark, multi):
    from notegrid.llm.bpe import encode_documents

    got = {r.doc_id: r for r in encode_documents(docs_of(spark, ODD, True), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, with_ids=True).collect()}
    for i, t in enumerate(ODD):
        ids = multi[1].encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert encode_documents(docs_of(spark, []), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_fingerprints(spark):
    from notegrid.llm.fingerprint import edited_text, near_copies

    for ids in (None, [None, None, 5, 5, *range(10, 10 + len(ODD) - 4)]):
        rows = near_copies(docs_of(spark, ODD, True, ids)).collect()
        order = sorted(zip(ids or range(len(ODD)), [t or "" for t in ODD], strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        want = sorted((d if d is not None else -1, len(t), hashlib.sha256(edited_text(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (d, t) in enumerate(order))
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_chars, r.edited_sha256) for r in rows) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    same = [r.fingerprint for r in near_copies(docs_of(spark, ODD)).filter("n_chars = 29").collect()]
    assert len(same) == 2 and same[0] == same[1]
    one = near_copies(docs_of(spark, ["abcdefgh"])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert near_copies(docs_of(spark, [])).count() == 0


def test_fingerprint_digest():
    from notegrid.llm import fingerprint as fp

    a, b = b"the quick brown fox jumps over the lazy dog " * 20, b"lorem ipsum dolor sit amet consectetur elit " * 20
    codes = fp.digests([a, b, b""])
    again = fp.decode(fp.encode(*codes))
    assert (again[0] == codes[0]).all() and (again[1] == codes[1]).all()
    assert fp.likeness(codes, codes).tolist() == [1, 1, 1]
    near = fp.digests([a[:-60] + b[:60]])
    assert fp.likeness((codes[0][:1], codes[1][:1]), near)[0] > fp.likeness((codes[0][1:2], codes[1][1:2]), near)[0]
    # brute-force counts
    want = np.zeros(fp.BUCKETS, int)
    for salt, gaps in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 3)), 1):
        for i in range(len(a) - gaps[2]):
            x, y, z = (a[i + g] for g in gaps)
            want[((((x << 16 | y << 8 | z) + (salt << 24)) * 2654435761) % 2**32) >> 24] += 1
    assert (fp.bucket_counts([b"zz", a])[1] == want).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_first_fit_decreasing(lengths):
    from notegrid.llm.packing import first_fit_decreasing

    bins, offsets = first_fit_decreasing(np.array(lengths, np.int64), 64)
    free: list[int] = []
    want = {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((k for k, room in enumerate(free) if room >= lengths[i]), len(free))
        if b == len(free):
            free.append(64)
        want[i] = (b, 64 - free[b])
        free[b] -= lengths[i]
    assert [(int(b), int(o)) for b, o in zip(bins, offsets, strict=True)] == [want[i] for i in range(len(lengths))]


@pytest.fixture(scope="module")
def named():
    from tokenizers import Tokenizer

    from notegrid.llm.packing import added_tokens, encoder

    special = added_tokens(P.path("byte_bpe_50k.json"))
    return Tokenizer.from_file(P.path("byte_bpe_50k.json")), encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, special), special


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=st.characters(codec="utf-8"), max_size=12), st.sampled_from(["<|endoftext|>", "<|endoftext", " ", "  ", "\n", "|>", "a's"])), max_size=8))
def test_packing_ids(named, parts):
    library, own, special = named
    assert special == {"<|endoftext|>": 50256}
    text = "".join(parts)
    assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing(spark, named):
    import zlib

    from notegrid.llm.packing import pack

    library = tiktoken_of("byte_bpe_50k.tiktoken")
    t, _, special = named
    rows = pack(docs_of(spark, ODD, True), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, special, group_pieces=4).toPandas()
    for i, text in enumerate(ODD):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert (ids[:-1] == library.encode_ordinary(text or "")) == ("<|endoftext|>" not in (text or ""))
        own = rows[rows.doc_id == i].sort_values("start")
        assert own.start.tolist() == np.cumsum([0, *own.length[:-1]]).tolist() and own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        for s, n, c in zip(own.start, own.length, own.ids_crc32, strict=True):
            assert c == zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.cumsum([0, *own.length[:-1]]).tolist() and own.length.sum() <= 2048
    assert pack(docs_of(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_language(spark, sf):
    from notegrid.llm import language

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.held_out_languages(docs).join(docs, "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95
    model = language.fit(docs)
    pred = {r.doc_id: r for r in language.identify(docs_of(spark, ODD, True), model).collect()}
    assert [pred[i].lang_pred == "und" for i in (0, 1, 4, 5)] == [True] * 4 and pred[0].score == 0
    assert pred[8].lang_pred in model.langs and 0 <= pred[8].score <= 1
    none = language.identify(docs_of(spark, ODD), language.fit(docs.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert language.held_out_languages(docs.limit(0)).count() == 0


def test_language_backoff():
    from notegrid.llm.language import Model

    m = Model(["x", "y"], {0: {"hello": np.array([5.0, 1.0]), "other": np.array([1.0, 5.0])}, 1: {"q": np.array([0.0, 9.0]), "a": np.array([3.0, 3.0])}, 2: {"<z": np.array([9.0, 0.0]), "b>": np.array([1.0, 1.0])}})
    assert m.word("hello")[0] > m.word("hello")[1]  # a known word by itself
    assert m.word("zq")[0] > m.word("zq")[1]  # the longer n-gram decides, not the letter q
    assert m.word("qq")[1] > m.word("qq")[0]  # single letters last
    assert m.word("---") is None


def test_quality(spark, sf):
    from notegrid.llm import quality

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.held_out_quality(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert ((held.score >= 0.7).astype(int) == held.quality).mean() > 0.9
    odd = quality.held_out_quality(docs_of(spark, ODD, True), labels.limit(0))
    assert {r.score for r in odd.collect()} == {0.5}
    one_class = quality.held_out_quality(docs, labels.filter("quality = 1").union(labels.selectExpr("doc_id", "null", "null").limit(3)))
    assert one_class.filter("score < 0.5").count() == 0
    assert quality.held_out_quality(docs.limit(0), labels).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abC1é .!#\n%X漢", max_size=60), min_size=1, max_size=6))
def test_statistics_equal_plain_ones(texts):
    import math
    from collections import Counter

    from notegrid.llm.quality import STATISTICS, statistics

    got = statistics(texts)
    for row, text in zip(got, texts, strict=True):
        own = dict(zip(STATISTICS, row, strict=True))
        data, words = text.encode(), text.split()
        share = lambda f: sum(map(f, data)) / max(1, len(data))
        want = {"log_chars": math.log1p(len(data)), "upper": share(lambda b: 65 <= b < 91), "lower": share(lambda b: 97 <= b < 123), "digit": share(lambda b: 48 <= b < 58), "space": share(lambda b: b == 32), "newline": share(lambda b: b == 10), "beyond_ascii": share(lambda b: b >= 128), "exclamation": share(lambda b: b == 33)}
        want["entropy"] = -sum(n / len(data) * math.log2(n / len(data)) for n in Counter(data).values()) if data else 0
        if words:
            lines = [x for x in text.split("\n") if x]
            want |= {"word_length": sum(map(len, words)) / len(words), "distinct_words": len(set(words)) / len(words), "top_word": max(Counter(words).values()) / len(words), "distinct_pairs": len(set(zip(words, words[1:]))) / max(1, len(words) - 1), "upper_words": sum(len(w) > 1 and w.isupper() for w in words) / len(words), "title_words": sum(w.istitle() for w in words) / len(words), "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0, "short_words": sum(len(w) <= 3 for w in words) / len(words)}
        for k, v in want.items():
            assert abs(own[k] - v) < 1e-4, k


def test_language_equals_plain_scoring():
    import math
    import re

    from notegrid.llm.language import EVIDENCE, LONGEST, Model, grams

    rng = random.Random(3)
    word = lambda n=4: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, n)))
    counts = {0: {word(): np.array([rng.randint(0, 9), rng.randint(0, 9)], float) for _ in range(30)}}
    for n in range(1, LONGEST + 1):
        counts[n] = {rng.choice(grams(word(), n) or ["<a"]): np.array([rng.randint(0, 9), rng.randint(0, 9)], float) for _ in range(8)}
    model = Model(["x", "y"], counts)
    logs = {k: dict(zip(own, np.log((np.array(list(own.values())) + 0.5) / (np.array(list(own.values())) + 0.5).sum(axis=0)), strict=True)) for k, own in counts.items()}

    def plain(text):
        total, used = np.zeros(2), 0
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            if w in logs[0]:
                total, used = total + logs[0][w], used + 1
                continue
            for n in range(LONGEST, 0, -1):
                if at := [logs[n][g] for g in grams(w, n) if g in logs[n]]:
                    total, used = total + sum(at) / len(at), used + 1
                    break
        if not re.search(r"[^\W\d_]", text):
            return "und", 0.0
        p = np.exp((total / used * min(used, EVIDENCE) if used else total) - 0)
        return ["x", "y"][int(p.argmax())], float(p.max() / p.sum())

    texts = [" ".join(rng.choice([word(6), word(), "12", "-a-b", "Éa"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    for t, lang, score in zip(texts, *model.predict(texts), strict=True):
        want = plain(t)
        assert (lang == want[0] or abs(want[1] - 0.5) < 1e-9) and math.isclose(score, want[1], abs_tol=1e-9), t


def test_trees_walk():
    from notegrid.llm.quality import grow

    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    m = grow(x, y, trees=30)
    p = m.score(x)
    assert ((p > 0.5) == y).mean() > 0.95
    b = m.binned(x)
    for i in range(0, 800, 97):  # one row at a time, tree by tree
        total = m.base
        for t in range(30):
            node = 0
            while node < m.statistic.shape[1]:
                node = 2 * node + 1 + (b[i, m.statistic[t, node]] > m.bin[t, node])
            total += m.leaf[t, node - m.statistic.shape[1]]
        assert abs(p[i] - 1 / (1 + np.exp(-total))) < 1e-9
