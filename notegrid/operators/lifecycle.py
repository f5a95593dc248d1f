"""Bulk updates of memories; each returns the changed rows or the new table, never edits in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrid.functions import scores
from notegrid.storage import Conflict, VersionedTable, materialize


def decay_cycle(memories: DataFrame, at: Column) -> DataFrame:
    """Per row that decays: auto_resolved, score with it, archive."""
    rows = memories.filter(~F.col("type").isin("permanent", "feel", "i", "plan", "letter") & ~F.col("pinned") & ~F.col("anchor"))
    idle = scores.days_since(F.coalesce("last_active", "created"), at, fallback=999.0)
    auto = ~F.col("resolved") & (F.col("importance") <= 4) & (idle > 30)
    score = scores.decay_score(at, F.col("resolved") | auto)
    return rows.select("id", auto.alias("auto_resolved"), score.alias("score"), (score < scores.ARCHIVE_BELOW).alias("archive"))


def apply_decay(store, at: Column) -> int:
    """One scheduled cycle over a versioned table of memories: its next version, with what the cycle resolves and archives."""
    rows = store.read()
    cycle = decay_cycle(rows.filter(F.col("type") != "archived"), at).select("id", "auto_resolved", "archive")
    now = rows.join(cycle, "id", "left")
    changed = {"resolved": F.col("resolved") | F.coalesce("auto_resolved", F.lit(False)), "type": F.when(F.col("archive"), "archived").otherwise(F.col("type"))}
    return store.write(now.withColumns(changed).select(*rows.columns))


def touch_many(memories: DataFrame, touches: DataFrame) -> DataFrame:
    """touches(id): whole old count plus the number of touches."""
    n = touches.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return memories.join(n, "id").select("id", (F.floor("activation_count") + F.col("n")).cast("double").alias("activation_count"))


def soft_delete(memories: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """The table with the rows of ids marked."""
    gone = ids.select("id", F.lit(True).alias("gone"))
    marked = memories.join(gone, "id", "left")
    return marked.select(*memories.columns, F.coalesce("gone", F.lit(False)).alias("tombstone"), F.when(F.col("gone"), at).alias("deleted_at"))


def exact_dedup(incoming: DataFrame, memories: DataFrame) -> DataFrame:
    """incoming(seq, content): created, or deduplicated against live rows and earlier incoming ones, with the row that stays."""
    live = memories.select(F.sha2("content", 256).alias("h"), "id").groupBy("h").agg(F.min("id").alias("live_id"))
    rows = incoming.select("seq", F.sha2("content", 256).alias("h"))
    first = rows.groupBy("h").agg(F.min("seq").alias("first_seq"))
    met = rows.join(first, "h").join(live, "h", "left")
    kind = F.when(F.col("live_id").isNotNull() | (F.col("seq") > F.col("first_seq")), "deduplicated").otherwise("created")
    return met.select("seq", kind.alias("disposition"), F.coalesce("live_id", F.concat(F.lit("new"), F.col("first_seq").cast("string"))).alias("id"))


def create(items: DataFrame, batch: str, at: Column) -> DataFrame:
    """items(seq, content, importance, type, pinned, valence): new rows with defaults and clamps; the id is a hash."""
    pinned = F.coalesce("pinned", F.lit(False))
    ident = F.concat(F.lit("b"), F.substring(F.sha2(F.concat_ws("|", F.lit(batch), F.col("seq").cast("string"), "content"), 256), 1, 12))
    return items.select(ident.alias("id"), F.when(pinned, "permanent").otherwise(F.coalesce("type", F.lit("dynamic"))).alias("type"), F.when(pinned, 10).otherwise(F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce("importance", F.lit(5))))).cast("int").alias("importance"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("valence", F.lit(0.5)))).alias("valence"), pinned.alias("pinned"), at.alias("created"))


def patch(memories: DataFrame, patches: DataFrame) -> DataFrame:
    """patches(id, importance, pinned): new values with the reason where a patch is turned down."""
    p = patches.select("id", F.col("importance").alias("new_importance"), F.col("pinned").alias("new_pinned"))
    rows = p.join(memories.select("id", "type", "importance", "pinned"), "id", "left")
    reason = F.when(F.col("type").isNull(), "not_found").when(F.col("type").isin("archived", "tombstone"), "terminal")
    pinned = F.coalesce("new_pinned", "pinned")
    return rows.select("id", reason.alias("reject_reason"), F.when(reason.isNull(), F.when(pinned, "permanent").when(F.col("pinned") & ~pinned & (F.col("type") == "permanent"), "dynamic").otherwise(F.col("type"))).alias("type"), F.when(reason.isNull(), F.when(pinned, 10).otherwise(F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce("new_importance", "importance"))))).cast("int").alias("importance"))


def fragment_patch(rows: DataFrame) -> DataFrame:
    """rows(id, content, old, new): replace a literal that stands exactly once (overlaps count)."""
    first = F.instr("content", F.col("old"))
    again = F.when(first > 0, F.expr("locate(old, content, instr(content, old) + 1)"))
    result = F.when(F.col("old") == "", "empty").when(first == 0, "not_found").when(again > 0, "ambiguous").when(F.col("old") == F.col("new"), "unchanged").otherwise("replaced")
    text = F.when(result == "replaced", F.concat(F.expr("substring(content, 1, instr(content, old) - 1)"), F.col("new"), F.expr("substring(content, instr(content, old) + length(old))"))).otherwise(F.col("content"))
    return rows.select("id", result.alias("result"), text.alias("content"))


def rename_term(memories: DataFrame, old: str, new: str) -> DataFrame:
    """Rows where a literal stands in content or name, with the number of replacements."""
    times = lambda c: ((F.length(c) - F.length(F.replace(c, F.lit(old), F.lit("")))) / len(old)).cast("long")
    n = times(F.col("content")) + times(F.col("name"))
    return memories.select("id", n.alias("replacements"), F.replace("content", F.lit(old), F.lit(new)).alias("content"), F.replace("name", F.lit(old), F.lit(new)).alias("name")).filter("replacements > 0")


def batch_actions(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(id, action): updated or missing."""
    return requests.join(memories.select("id", F.lit(True).alias("known")), "id", "left").select("id", "action", F.when(F.col("known"), "updated").otherwise("missing").alias("status"))


def versioned(notes: DataFrame) -> DataFrame:
    """notes(key, seq, content): revisions with their validity; a note equal to the one before makes none."""
    by = Window.partitionBy("key").orderBy("seq")
    h = notes.select("key", "seq", F.sha2("content", 256).alias("h"))
    changed = h.withColumn("was", F.lag("h").over(by)).filter(F.col("was").isNull() | (F.col("was") != F.col("h")))
    return changed.select("key", F.row_number().over(by).cast("long").alias("revision"), F.col("seq").alias("valid_from"), F.lead("seq").over(by).alias("valid_to"), "h")


def save_notes(store: VersionedTable, edits: DataFrame) -> DataFrame:
    """Save edits(key, day, content, expected_revision) into a table of notes(key, day, revision, content, h): one row of fate each.

    fate: created, updated, unchanged, conflict (an expected revision that isn't the current one; null expects
    nothing), bad_title (the first line doesn't name the day), empty, or superseded (another edit of the key in this
    batch is preferred: the one of highest expected revision, then greatest content). Only created and updated
    rows are written; a writer that comes between makes the edits be judged anew.
    """
    title = F.regexp_extract(F.substring_index(F.ltrim("content"), "\n", 1), r"(\d{4}-\d{2}-\d{2})", 1)
    bad = F.when(F.coalesce(F.trim("content"), F.lit("")) == "", "empty").when(title != F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("?")), "bad_title")
    asked = edits.select("key", "day", "content", F.col("expected_revision").alias("expected"), F.sha2("content", 256).alias("new_h"), bad.alias("bad"))
    nth = F.row_number().over(Window.partitionBy("key", F.col("bad").isNull()).orderBy(F.desc_nulls_last("expected"), F.desc("content")))
    asked = materialize(asked.withColumn("first", (nth == 1) & F.col("bad").isNull()), "edits")
    while True:
        base = store.latest()
        now = store.read(base).select("key", "revision", F.col("h").alias("old_h"))
        both = asked.join(now, "key", "left")
        fate = F.coalesce(F.col("bad"), F.when(F.col("expected").isNotNull() & (F.col("expected") != F.coalesce("revision", F.lit(0))), "conflict").when(~F.col("first"), "superseded").when(F.col("revision").isNull(), "created").when(F.col("old_h") == F.col("new_h"), "unchanged").otherwise("updated"))
        judged = materialize(both.select("key", "day", "content", "expected", "new_h", F.coalesce("revision", F.lit(0)).alias("was"), fate.alias("fate")), "judged")
        saved = judged.filter("fate IN ('created', 'updated')").select("key", "day", (F.col("was") + 1).cast("long").alias("revision"), "content", F.col("new_h").alias("h"))
        old = store.read(base)
        try:
            store.write(old.join(saved.select("key"), "key", "left_anti").select(*old.columns).unionByName(saved.select(*old.columns)), base)
        except Conflict:
            continue
        return judged.select("key", "expected", F.when(F.col("fate").isin("created", "updated"), F.col("was") + 1).otherwise(F.col("was")).cast("long").alias("revision"), "fate")


def quotes_union(rows: DataFrame, most: int = 3) -> DataFrame:
    """rows(id, existing, incoming) of quotes: existing first, distinct, at most so many; and how many were dropped."""
    both = F.array_distinct(F.concat("existing", "incoming"))
    return rows.select("id", F.slice(both, 1, most).alias("quotes"), F.greatest(F.lit(0), F.size(both) - most).cast("long").alias("dropped"))


def semantic_merge(incoming: DataFrame, targets: DataFrame, most_bytes: int = 4096) -> DataFrame:
    """incoming(seq, target, content, tags, valence, importance), targets(id, ...): merged rows; too long ones are created instead.

    Several rows for one target are folded in the order of seq.
    """
    folded = incoming.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("seq", "content", "tags", "valence", "importance"))).alias("new"))
    met = folded.join(targets.select(F.col("id").alias("target"), F.col("content").alias("old"), F.col("tags").alias("old_tags"), F.col("valence").alias("old_valence"), F.col("importance").alias("old_importance")), "target")
    start = F.struct(F.col("old").alias("content"), F.col("old_tags").alias("tags"), F.col("old_valence").alias("valence"), F.col("old_importance").alias("importance"), F.array().cast("array<bigint>").alias("created"))

    def step(acc, r):
        text = F.concat(acc["content"], F.lit("\n---\n"), r["content"])
        fits = F.octet_length(text) <= most_bytes
        return F.struct(
            F.when(fits, text).otherwise(acc["content"]).alias("content"),
            F.when(fits, F.array_sort(F.array_union(acc["tags"], r["tags"]))).otherwise(acc["tags"]).alias("tags"),
            F.when(fits, F.round((acc["valence"] + r["valence"]) / 2, 2)).otherwise(acc["valence"]).alias("valence"),
            F.when(fits, F.greatest(acc["importance"], r["importance"])).otherwise(acc["importance"]).cast("int").alias("importance"),
            F.when(fits, acc["created"]).otherwise(F.array_append(acc["created"], r["seq"].cast("bigint"))).alias("created"),
        )

    return met.select("target", F.aggregate("new", start, step).alias("m")).select("target", "m.*")


def review_decisions(decisions: DataFrame, memories: DataFrame) -> DataFrame:
    """decisions(id, decision): important, pin or noise applied; unknown ids and words are errors."""
    rows = decisions.join(memories.select("id", "importance", "pinned", "resolved"), "id", "left")
    d = F.col("decision")
    status = F.when(F.col("importance").isNull(), "missing").when(~d.isin("important", "pin", "noise"), "bad_decision").otherwise("applied")
    ok = status == "applied"
    return rows.select("id", status.alias("status"), F.when(ok & (d == "important"), 9).when(ok & (d == "pin"), 10).when(ok & (d == "noise"), 1).otherwise(F.col("importance")).cast("int").alias("importance"), F.when(ok & (d == "pin"), True).otherwise(F.col("pinned")).alias("pinned"), F.when(ok & (d == "noise"), True).otherwise(F.col("resolved")).alias("resolved"))


def plan_actions(plans: DataFrame, actions: DataFrame, at: Column) -> DataFrame:
    """actions(id, action): confirm, resolve, abandon or reopen; the new status and the log with one more entry."""
    a = F.col("action")
    status = F.when(a == "resolve", "resolved").when(a == "abandon", "abandoned").when(a == "reopen", "active").otherwise(F.col("status"))
    known = a.isin("confirm", "resolve", "abandon", "reopen")
    entry = F.struct(at.alias("ts"), a.alias("action"), F.col("status").alias("from"), status.alias("to"))
    rows = plans.join(actions.filter(known), "id")
    return rows.select("id", status.alias("status"), F.when(a.isin("confirm", "reopen"), at).otherwise(F.col("last_confirmed_at")).alias("last_confirmed_at"), F.array_append("change_log", entry).alias("change_log"))


def feel_ingest(feels: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """feels(seq, content, source, valence): the new rows, and the sources marked digested with the feel's valence."""
    new = feels.select(F.concat(F.lit("feel_"), F.col("seq").cast("string")).alias("id"), "content", F.array(F.lit("__feel__")).alias("tags"), F.lit("feel").alias("type"), F.col("source").alias("triggered_by"))
    last = feels.groupBy(F.col("source").alias("id")).agg(F.max_by("valence", "seq").alias("model_valence"))
    return new, memories.join(last, "id").select("id", F.lit(True).alias("digested"), "model_valence")


def split_batches(batches: DataFrame) -> DataFrame:
    """batches(batch, items): one row for each item that isn't blank."""
    each = batches.select("batch", F.posexplode("items").alias("pos", "item"))
    return each.select("batch", "pos", F.trim("item").alias("content")).filter("content <> ''")


def typed_ingest(rows: DataFrame, at: Column) -> DataFrame:
    """rows(seq, type, author, aspect): letters with a normalised author, self entries with their aspect as a tag and not to surface."""
    author = F.lower(F.trim("author"))
    return rows.select(F.concat(F.lit("l"), F.col("seq").cast("string")).alias("id"), "type", F.when(author.isin("assistant", "ai", "model"), "ai").otherwise(author).alias("author"), F.when(F.col("aspect").isNotNull(), F.concat(F.lit("aspect:"), F.lower("aspect"))).alias("tag"), (F.col("type") == "i").alias("dont_surface"), at.alias("created"))
