"""Whole imports: files to turns, chunks, extracted items and memories, in steps that can stop anywhere and go on."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notegrid.functions.text import token_estimate
from notegrid.operators.inference import first_json
from notegrid.operators.ordered import chunks as chunked
from notegrid.sources.files import detect_format, route
from notegrid.storage import AppendedTable, Conflict, VersionedTable, materialize

TERMINAL = ("archived", "tombstone")
#: Importance from which rows count against the quota, and what it becomes beyond it.
HIGH, BEYOND = 9, 8
CHUNKS = "source string, chunk int, content string, start string, end string, turn_count long"
ITEMS = "array<struct<content:string,importance:int,is_pattern:boolean>>"
EXTRACTED = f"source string, chunk int, items {ITEMS}, error string"
PROGRESS = "source string, chunk int, created long, deduplicated long, degraded long"


def source_hash(label: str, value: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(label), value), 256)


def extract_chunks(rows: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """rows(source, chunk, content): items of each chunk, or the error of its model; an answer without a list has no items."""

    def run(batches):
        for pdf in batches:
            answers, errors = [], []
            for text in pdf["content"]:
                try:
                    answers.append(first_json(model(text)))
                    errors.append(None)
                except Exception as error:  # noqa: BLE001  whatever a model raises is that chunk's result
                    answers.append(None)
                    errors.append(f"{type(error).__name__}: {error}"[:200])
            yield pd.DataFrame({"source": pdf["source"], "chunk": pdf["chunk"], "answer": answers, "error": errors}, columns=["source", "chunk", "answer", "error"])

    answered = rows.select("source", "chunk", "content").mapInPandas(run, "source string, chunk int, answer string, error string")
    items = F.coalesce(F.from_json("answer", ITEMS), F.array().cast(ITEMS))
    return answered.select("source", "chunk", F.when(F.col("error").isNull(), items).alias("items"), "error")


def preview(files: DataFrame, target: int = 10_000, label: str = "user") -> DataFrame:
    """files(path, value), path unique: what an import of each would meet; nothing is written but steps of the work.

    (path, format, turns, chunks, tokens, preview, samples, error): tokens over the chunks' texts, the first 600
    characters of the first chunk, the first three turns (role, 160 characters); error is empty_file or no_turns.
    A chunk is one call of a model.
    """
    kinds = detect_format(files).select("path", "format")
    turns = materialize(route(files), "turns")
    rows = chunked(turns.select(F.col("path").alias("conv_id"), "turn", "role", "content", F.lit("").alias("ts")), target, label)
    per = rows.groupBy(F.col("conv_id").alias("path")).agg(F.count(F.lit(1)).alias("chunks"), F.sum(token_estimate(F.col("content"))).alias("tokens"), F.substring(F.max(F.when(F.col("chunk") == 0, F.col("content"))), 1, 600).alias("preview"))
    counts = turns.groupBy("path").agg(F.count(F.lit(1)).alias("turns"))
    nth = F.row_number().over(Window.partitionBy("path").orderBy("turn"))
    heads = turns.withColumn("n", nth).filter("n <= 3").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "role", F.substring("content", 1, 160).alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("samples"))
    met = kinds.join(counts, "path", "left").join(per, "path", "left").join(heads, "path", "left")
    error = F.when(F.col("format") == "empty", "empty_file").when(F.col("turns").isNull(), "no_turns")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    none = F.array().cast("array<struct<role:string,content:string>>")
    return met.select("path", "format", zero("turns"), zero("chunks"), zero("tokens"), "preview", F.coalesce("samples", none).alias("samples"), error.alias("error"))


class ImportJob:
    """Import of export files into a versioned table of memories(id, type, importance, content, created, ...).

    Steps, each committed by itself in `path`: the chunks of sources not seen before; what the model makes of them, in
    `batches` parts; all items as one new version of the memories; the progress of their chunks. A job that was stopped
    anywhere is run again with the same files: what is committed stays, the rest is done. A source is its text under
    the user's label, so a file that comes twice, or under two names, is one. An item's id comes from its source, chunk and
    place, so a version that was written before its progress was is recognised.

    Items whose text a live memory or an earlier item has are deduplicated. Items of importance 9 or more take what is
    left of the quota in order; beyond it they become 8. A chunk whose model fails is tried again by the next run.
    `on_step` is called with the name of every step after its commit.
    """

    def __init__(self, spark: SparkSession, path: str, memories: VersionedTable, model: Callable[[str], str], at: Column, target: int = 10_000, quota: int = 24, label: str = "user", batches: int = 8, on_step: Callable[[str], None] | None = None):
        self.spark, self.memories, self.model, self.at = spark, memories, model, at
        self.target, self.quota, self.label, self.batches = target, quota, label, batches
        self.on_step = on_step or (lambda name: None)
        self.chunks = AppendedTable(spark, f"{path}/chunks", CHUNKS, ["source", "chunk"])
        self.extracted = AppendedTable(spark, f"{path}/extracted", EXTRACTED, ["source", "chunk"])
        self.done = AppendedTable(spark, f"{path}/progress", PROGRESS, ["source", "chunk"])

    def plan(self, files: DataFrame) -> None:
        sources = files.select(source_hash(self.label, F.col("value")).alias("source"), "value", "path")
        new = sources.join(self.chunks.read().select("source").distinct(), "source", "left_anti").groupBy("source").agg(F.min(F.struct("path", "value")).alias("f"))
        # the ending tells JSON that starts with neither bracket; the rest of the name is the source
        named = F.concat("source", F.when(F.lower("f.path").endswith(".json"), ".json").otherwise(""))
        turns = route(materialize(new.select(named.alias("path"), F.col("f.value").alias("value")), "sources"))
        rows = chunked(turns.select(F.substring("path", 1, 64).alias("conv_id"), "turn", "role", "content", F.lit("").alias("ts")), self.target, self.label)
        self.chunks.append(rows.filter(F.trim("content") != "").withColumnRenamed("conv_id", "source"))
        self.on_step("chunks")

    def extract(self) -> None:
        for part in range(self.batches):
            todo = self.chunks.read().filter(F.pmod(F.xxhash64("source", "chunk"), F.lit(self.batches)) == part)
            todo = todo.join(self._good().select("source", "chunk"), ["source", "chunk"], "left_anti")
            if not todo.isEmpty():
                self.extracted.append(extract_chunks(todo, self.model))
                self.on_step(f"extracted {part}")

    def _good(self) -> DataFrame:
        return self.extracted.read("error IS NULL")

    def _items(self) -> DataFrame:
        """Items of the chunks that have no progress yet."""
        open_ = self._good().join(self.done.read().select("source", "chunk"), ["source", "chunk"], "left_anti")
        each = open_.select("source", "chunk", F.posexplode("items").alias("pos", "m"))
        ident = F.concat(F.lit("i"), F.substring(F.sha2(F.concat_ws("|", "source", "chunk", "pos"), 256), 1, 24))
        asked = F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce("m.importance", F.lit(5))))
        return each.select("source", "chunk", "pos", ident.alias("id"), F.trim("m.content").alias("content"), asked.alias("importance")).filter("content <> ''")

    def write(self, tries: int = 20) -> None:
        items = materialize(self._items(), "items")
        for left in range(tries, 0, -1):
            base = self.memories.latest()
            old = self.memories.read(base)
            live = old.filter(~F.col("type").isin(*TERMINAL))
            todo = items.join(old.select("id"), "id", "left_anti").withColumn("h", F.sha2("content", 256)).withColumn("place", F.struct("source", "chunk", "pos"))
            firsts = todo.groupBy("h").agg(F.min("place").alias("first"))
            unknown = todo.join(live.select(F.sha2("content", 256).alias("h")), "h", "left_anti").join(firsts, "h").filter(F.col("place") == F.col("first"))
            new = materialize(unknown.select("id", "content", "importance", "place"), "new")
            if new.isEmpty():
                break
            room = max(0, self.quota - live.filter(F.col("importance") >= HIGH).count())
            kept = new.filter(F.col("importance") >= HIGH).orderBy("place").limit(room).select("id", F.lit(True).alias("kept"))  # the quota's rows at most
            given = F.when((F.col("importance") >= HIGH) & F.col("kept").isNull(), BEYOND).otherwise(F.col("importance"))
            rows = new.join(F.broadcast(kept), "id", "left").select("id", F.lit("dynamic").alias("type"), given.cast("int").alias("importance"), "content", self.at.alias("created"))
            try:
                self.memories.write(old.unionByName(rows, allowMissingColumns=True).select(*old.columns), base)
                break
            except Conflict:
                if left == 1:
                    raise
        self.on_step("written")

    def record(self) -> None:
        """Progress of the chunks whose items are in the memories; what became of each is read from there."""
        open_ = materialize(self._good().join(self.done.read().select("source", "chunk"), ["source", "chunk"], "left_anti").select("source", "chunk"), "open")
        if open_.isEmpty():
            return
        held = self.memories.read().select("id", F.col("importance").alias("given"))
        fate = self._items().join(held, "id", "left").groupBy("source", "chunk").agg(F.count("given").alias("created"), F.count_if(F.col("given").isNull()).alias("deduplicated"), F.count_if(F.col("given") < F.col("importance")).alias("degraded"))
        counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("created", "deduplicated", "degraded")]
        self.done.append(open_.join(fate, ["source", "chunk"], "left").select("source", "chunk", *counts))
        self.on_step("progress")

    def run(self, files: DataFrame) -> DataFrame:
        """files(path, value): imports what is new, finishes what was begun; the report."""
        self.plan(files)
        self.extract()
        self.write()
        self.record()
        return self.report()

    def report(self) -> DataFrame:
        """(source, chunks, done, created, deduplicated, degraded, status) of every source: completed, or incomplete."""
        all_ = self.chunks.read().select("source", "chunk").join(self.done.read(), ["source", "chunk"], "left")
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("created", "deduplicated", "degraded")]
        counted = all_.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.count("created").alias("done"), *sums)
        return counted.withColumn("status", F.when(F.col("done") == F.col("chunks"), "completed").otherwise("incomplete"))
