"""Language identification: words first, then shorter and shorter character n-grams.

A word that the model knows scores its log frequency in each language. An unseen word scores the mean log
frequency of its longest n-grams (length LONGEST down to 1) of which at least one is known; a word without
any known n-gram says nothing. A document's score is the posterior of the best language over its words
(uniform prior, evidence of at most EVIDENCE words).

The model is fitted on about sample_per_lang labelled rows of each language (a hash of doc_id decides) and
keeps the words_per_lang most frequent words and grams_per_lang n-grams of each.

Defined results: `und` and score 0 where the text is null or has no letter, or where nothing was learned;
a text of letters that the model has never seen gets the language with most labelled rows; of equally likely
languages the one with more labelled rows is taken; very long texts are read whole; repeated rows get equal
results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegrid.llm.common import crc_fold, map_text, materialize

LONGEST = 4
EVIDENCE = 20
#: Bytes (about) that a worker remembers of tokens it has scored.
REMEMBER = 24 << 20
WORD = re.compile(r"[^\W\d_]+")
COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("kind", T.IntegerType()), T.StructField("item", T.StringType()), T.StructField("n", T.LongType())])


def grams(word: str, n: int) -> list[str]:
    """n-grams of a word between marks of its ends; single letters stand without marks."""
    if n == 1:
        return list(word)
    held = f"<{word}>"
    return [held[i : i + n] for i in range(len(held) - n + 1)]


class Model:
    """langs, and per kind (0: words, n: n-grams) the items' rows in one matrix of log frequencies."""

    def __init__(self, langs: list[str], counts: dict[int, dict[str, np.ndarray]]):
        self.langs = langs
        self.rows: dict[int, dict[str, int]] = {}
        logs, base = [], 0
        for kind, items in counts.items():
            self.rows[kind] = {x: base + i for i, x in enumerate(items)}
            base += len(items)
            m = np.array(list(items.values()), np.float64).reshape(-1, len(langs)) + 0.5
            logs.append(np.log(m / m.sum(axis=0)))
        self.logs = np.concatenate(logs) if logs else np.zeros((0, len(langs)))
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.held = 0
        self.table = np.zeros((0, len(self.langs) + 1))
        self.letters = np.zeros(0, bool)

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("langs", "rows", "logs")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def items(self, word: str) -> list[int]:
        """Rows that a word is scored by: its own, or those of its longest n-grams of which one is known."""
        if (i := self.rows.get(0, {}).get(word)) is not None:
            return [i]
        for n in range(LONGEST, 0, -1):
            own = self.rows.get(n)
            if own and (at := [own[g] for g in grams(word, n) if g in own]):
                return at
        return []

    def word(self, word: str) -> np.ndarray | None:
        """Log frequencies of a word by language; None if neither it nor an n-gram of it is known."""
        at = self.items(word)
        return self.logs[at].mean(axis=0) if at else None

    def learn(self, tokens: list[str]) -> None:
        """Sums of log frequencies, number of telling words and presence of a letter for new tokens, all at once."""
        rows: list[int] = []
        count: list[int] = []  # rows of each telling word
        owner: list[int] = []  # token of each telling word
        letters = []
        for k, t in enumerate(tokens):
            plain = t.isalpha()
            words = (t,) if plain else WORD.findall(t)
            letters.append(plain or any(any(map(str.isalpha, w)) for w in words))
            for w in words:
                if at := self.items(w):
                    rows += at
                    count.append(len(at))
                    owner.append(k)
        new = np.zeros((len(tokens), len(self.langs) + 1))
        if rows:
            size = np.array(count)
            means = np.add.reduceat(self.logs[rows], np.cumsum(size) - size, axis=0) / size[:, None]
            for j in range(len(self.langs)):
                new[:, j] = np.bincount(owner, means[:, j], minlength=len(tokens))
            new[:, -1] = np.bincount(owner, minlength=len(tokens))
        base = len(self.seen)
        self.held += sum(map(len, tokens)) + len(tokens) * (200 + 8 * len(self.langs))
        self.seen.update(zip(tokens, range(base, base + len(tokens)), strict=True))
        self.table = np.concatenate([self.table, new])
        self.letters = np.concatenate([self.letters, np.array(letters, bool)])

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        if self.held > REMEMBER:
            self.forget()
        cuts = [x.lower().split() for x in texts]
        new = set()
        for c in cuts:
            new.update(c)
        self.learn(list(new.difference(self.seen)))
        table, letters, seen = self.table, self.letters, self.seen
        langs, scores = [], []
        for c in cuts:
            at = [seen[t] for t in c]
            if not at or not letters[at].any():
                langs.append("und")
                scores.append(0.0)
                continue
            s = table[at].sum(axis=0)
            n = s[-1]
            log = s[:-1] / n * min(n, EVIDENCE) if n else s[:-1]
            p = np.exp(log - log.max())
            langs.append(self.langs[int(p.argmax())])
            scores.append(float(p.max() / p.sum()))
        return langs, scores


def fit(docs: DataFrame, sample_per_lang: int = 800, words_per_lang: int = 20_000, grams_per_lang: int = 20_000) -> Model:
    """Fit on documents(doc_id, text, lang); rows without lang or text teach nothing.

    Of all words, and of all n-grams, the model holds as many as the parameters give for each language, those of
    largest count in any of them; so a language whose sample has more text may hold more than its share.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = sorted(((r["lang"], r["count"]) for r in rows.groupBy("lang").count().collect()), key=lambda x: (-x[1], x[0]))  # a row a language
    if not sizes:
        return Model([], {})
    langs = [x for x, _ in sizes]
    share = F.lit(0)
    for lang, n in sizes:
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 20, -(-(sample_per_lang << 20) // n)))).otherwise(share)
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) < share)

    def count(texts: list[str], part) -> dict:
        words: dict[str, Counter] = {}
        for lang, text in zip(part.column("lang").to_pylist(), texts, strict=True):
            words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
        out: dict = {n: [] for n in COUNTS.fieldNames()}
        for lang, own in words.items():
            found = Counter({(0, w): n for w, n in own.items()})
            for w, n in own.items():
                for k in range(1, LONGEST + 1):
                    for g in grams(w, k):
                        found[k, g] += n
            for (k, x), n in found.items():
                for col, v in (("lang", lang), ("kind", k), ("item", x), ("n", n)):
                    out[col].append(v)
        return out

    summed = map_text(sample, count, COUNTS, most_bytes=16 << 20).groupBy("kind", "item").agg(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)])
    most = F.greatest(*[F.col(f"n{i}") for i in range(len(langs))]) if len(langs) > 1 else F.col("n0")
    kept = materialize(summed.filter(most >= 2).withColumn("most", most), "counts")
    counts: dict[int, dict[str, np.ndarray]] = {}
    top = kept.filter(F.col("kind") == 0).orderBy(F.desc("most"), "item").limit(words_per_lang * len(langs))
    counts[0] = {r[1]: np.array(r[2 : 2 + len(langs)], np.float64) for r in top.collect()}
    top = kept.filter(F.col("kind") > 0).orderBy(F.desc("most"), "item").limit(grams_per_lang * len(langs))
    for r in top.collect():
        counts.setdefault(r[0], {})[r[1]] = np.array(r[2 : 2 + len(langs)], np.float64)
    return Model(langs, counts)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns with lang_pred and score."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fit's parameters
    source = docs.select(*keep, *([] if "text" in keep else ["text"]))
    schema = T.StructType([*[source.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(texts: list[str], part) -> dict:
        langs, scores = held.value.predict(texts)
        return {c: part.column(c) for c in keep} | {"lang_pred": langs, "score": scores}

    return map_text(source, run, schema)


def held_out_languages(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Fit on the rows outside fold 0 and predict every row: doc_id, held_out, lang_pred, score."""
    learn = docs.filter(crc_fold("doc_id", folds) != 0)
    return identify(docs, fit(learn)).select("doc_id", F.coalesce(crc_fold("doc_id", folds) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
