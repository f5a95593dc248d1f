"""Batch inference: a user's Python callable over a table, with failures kept as rows and results cached by hash."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.storage import materialize


def embed(rows: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """rows(id, content): (id, vector, content_hash, error); a batch that fails is tried row by row."""

    def run(batches):
        for pdf in batches:
            for s in range(0, len(pdf), batch):
                part = pdf.iloc[s : s + batch]
                texts = part["content"].fillna("").tolist()
                try:
                    vectors, errors = model(texts), [None] * len(texts)
                except Exception:
                    vectors, errors = [], []
                    for t in texts:
                        try:
                            vectors.append(model([t])[0])
                            errors.append(None)
                        except Exception as e:  # the row keeps its error
                            vectors.append(None)
                            errors.append(str(e)[:200])
                yield pd.DataFrame({"id": part["id"].to_numpy(), "vector": vectors, "content_hash": part["content_hash"].to_numpy(), "error": errors})

    return rows.select("id", "content", F.sha2("content", 256).alias("content_hash")).mapInPandas(run, "id string, vector array<double>, content_hash string, error string")


def annotate(rows: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """rows(id, content): JSON answers of the model, validated and clamped; neutral values where an answer is unusable."""
    schema = "domain array<string>, valence double, arousal double, tags array<string>, name string"

    def run(batches):
        for pdf in batches:
            answers = []
            for t in pdf["content"].fillna(""):
                try:
                    answers.append(first_json(model(t)))
                except Exception:
                    answers.append(None)
            yield pd.DataFrame({"id": pdf["id"], "answer": answers})

    a = F.from_json("answer", schema)
    unit = lambda c, d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(d))))
    return rows.select("id", "content").mapInPandas(run, "id string, answer string").select("id", F.slice(F.coalesce(a["domain"], F.array(F.lit("general"))), 1, 3).alias("domain"), unit(a["valence"], 0.5).alias("valence"), unit(a["arousal"], 0.3).alias("arousal"), F.coalesce(a["tags"], F.array().cast("array<string>")).alias("tags"), F.substring(a["name"], 1, 20).alias("name"))


_WS = re.compile(r"[ \t\n\r]*")
_STRING = re.compile(r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"')
_SCALAR = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity")


def first_json(text: str | None) -> str | None:
    """The first complete JSON object or array in a chatty answer, written anew; None if there is none.

    Brackets are tried from the left. What a failed try has learnt is kept: a bracket that was still open then fails
    as well, one that was closed is whole, so a text is read about twice at most. An array too deep to be loaded, or
    with a number too long for it, is returned as it stands.
    """
    text = text or ""
    whole: dict[int, int] = {}
    failed: set[int] = set()

    def end_of(start: int) -> int | None:
        open_, at, want = [], start, "value"
        while True:
            at = _WS.match(text, at).end()
            c = text[at : at + 1]
            closes = bool(open_) and c == ("]" if text[open_[-1]] == "[" else "}")
            if closes and want in ("first", "next"):
                at += 1
                whole[open_.pop()] = at
                if not open_:
                    return at
                want = "next"
            elif want == "next":
                if c != ",":
                    break
                at, want = at + 1, "value" if text[open_[-1]] == "[" else "key"
            elif want == "key" or (want == "first" and text[open_[-1]] == "{"):
                key = _STRING.match(text, at)
                colon = _WS.match(text, key.end()).end() if key else -1
                if not key or text[colon : colon + 1] != ":":
                    break
                at, want = colon + 1, "value"
            elif c and c in "{[":
                if at in failed:
                    break
                if at in whole:
                    at, want = whole[at], "next"
                else:
                    open_.append(at)
                    at, want = at + 1, "first"
            else:
                found = (_STRING if c == '"' else _SCALAR).match(text, at)
                if not found:
                    break
                at, want = found.end(), "next"
        failed.update(open_)
        return None

    for found in re.finditer(r"[{\[]", text):
        start = found.start()
        end = None if start in failed else whole.get(start) or end_of(start)
        if end:
            try:
                return json.dumps(json.loads(text[start:end]), ensure_ascii=False)
            except (ValueError, RecursionError):
                return text[start:end]
    return None


def reembed(rows: DataFrame, done: DataFrame, model: Callable[[list[str]], list[list[float]]], store, signature: str) -> DataFrame:
    """rows(id, content) for a model of another signature; done(id) has it already. (id, state, swapped): kept, made or failed.

    Results are staged as a table of their own; the store gets them as its new version only if no row failed.
    """
    made = materialize(embed(rows.join(done.select("id"), "id", "left_anti"), model), "staged")
    state = done.select("id", F.lit("kept").alias("state")).unionByName(made.select("id", F.when(F.col("error").isNull(), "made").otherwise("failed").alias("state")))
    whole = not made.filter("error IS NOT NULL").limit(1).count()
    if whole:
        store.write(state.select("id", F.lit(signature).alias("signature")))
    return state.withColumn("swapped", F.lit(whole))


def with_cache(rows: DataFrame, cache: DataFrame, version: str, run: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """rows(id, content), cache(key, result): all results, and the new ones to append; only misses reach run(id, content) -> (id, result)."""
    keyed = rows.select("id", "content", F.sha2(F.concat_ws("|", F.lit(version), "content"), 256).alias("key"))
    hits = keyed.join(cache, "key").select("id", "result")
    misses = keyed.join(cache.select("key"), "key", "left_anti")
    made = run(misses.select("id", "content"))
    new = misses.select("id", "key").join(made, "id").select("key", "result").dropDuplicates(["key"])
    return hits.unionByName(made.select("id", "result")), new


def split(rows: DataFrame, model: Callable[[str], list[str]]) -> DataFrame:
    """rows(id, content): (id, pos, item) of the parts that the model makes; a failure keeps the whole as one part."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, t in zip(pdf["id"], pdf["content"].fillna(""), strict=True):
                try:
                    parts = [p for p in model(t) if p.strip()] or [t]
                except Exception:
                    parts = [t]
                out += [(i, k, p) for k, p in enumerate(parts)]
            yield pd.DataFrame(out, columns=["id", "pos", "item"])

    return rows.select("id", "content").mapInPandas(run, "id string, pos long, item string")


def judge(pairs: DataFrame, model: Callable[[str, str], float], accept: float = 0.7) -> DataFrame:
    """pairs(plan_id, plan, event_id, event): pairs that the model holds for resolved with enough confidence."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"plan_id": pdf["plan_id"], "event_id": pdf["event_id"], "confidence": [min(1.0, max(0.0, float(model(a, b)))) for a, b in zip(pdf["plan"], pdf["event"], strict=True)]})

    return pairs.mapInPandas(run, "plan_id string, event_id string, confidence double").filter(F.col("confidence") >= accept)


def impressions(days: DataFrame, model: Callable[[str], tuple[str, list[str]]]) -> DataFrame:
    """days(day, text, known): an impression of each day with the cited ids that are among the known ones."""

    def run(batches):
        for pdf in batches:
            got = [model(t) for t in pdf["text"]]
            yield pd.DataFrame({"day": pdf["day"], "impression": [g[0] for g in got], "cited": [g[1] for g in got], "known": pdf["known"]})

    out = days.select("day", "text", "known").mapInPandas(run, "day date, impression string, cited array<string>, known array<string>")
    return out.select("day", "impression", F.array_sort(F.array_intersect("cited", "known")).alias("cited"))


def extract(chunks: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """chunks(id, content): memory items (id, pos, content, importance 1..10, is_pattern) of the model's JSON list; an unusable answer gives none."""

    def run(batches):
        for pdf in batches:
            answers = []
            for t in pdf["content"].fillna(""):
                try:
                    answers.append(first_json(model(t)))
                except Exception:
                    answers.append(None)
            yield pd.DataFrame({"id": pdf["id"], "answer": answers})

    schema = "array<struct<content:string,importance:int,is_pattern:boolean>>"
    each = chunks.select("id", "content").mapInPandas(run, "id string, answer string").select("id", F.posexplode(F.from_json("answer", schema)).alias("pos", "m"))
    return each.select("id", "pos", F.trim("m.content").alias("content"), F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce("m.importance", F.lit(5)))).alias("importance"), F.coalesce("m.is_pattern", F.lit(False)).alias("is_pattern")).filter("content <> ''")
