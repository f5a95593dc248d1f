"""Readers and writers: Markdown notes, event logs, vector text, transcripts, chat exports, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEDGER = "seq long, event_type string, trace_id string, trace_kind string, body_hash string, payload string, recorded_at string"


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files below a folder: (path, value) with the whole text of each."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), "value")


def parse_notes(notes: DataFrame, fields: list[str]) -> DataFrame:
    """(path, fields..., content, parse_error) of notes with front matter of `key: value` lines; a bad file keeps its error."""
    head = F.regexp_extract("value", r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\z", 1)
    body = F.regexp_extract("value", r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\z", 2)
    bad = ~F.rlike("value", F.lit(r"(?s)\A---\r?\n.*?\r?\n---"))
    value = lambda k: F.nullif(F.regexp_replace(F.trim(F.regexp_extract(F.concat(F.lit("\n"), head), rf"\n{k}:[ \t]*([^\n]*)", 1)), '^"(.*)"$', "$1"), F.lit(""))
    return notes.select("path", *[value(k).alias(k) for k in fields], F.when(bad, F.col("value")).otherwise(body).alias("content"), F.when(bad, "no_front_matter").alias("parse_error"))


def render_note(fields: dict[str, Column], content: Column) -> Column:
    """A note as Markdown text with front matter."""
    lines = [F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), content)


def number(c: Column) -> Column:
    """First number in a text such as `V0.9`."""
    return F.regexp_extract(c, r"[-+]?\d*\.?\d+", 0).try_cast("double")


def normalize(rows: DataFrame) -> DataFrame:
    """rows(id, importance, valence, arousal, domain, activation_count), all text: typed, clamped, with defaults."""
    unit = lambda c, d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number(F.col(c)), F.lit(d))))
    used = F.col("activation_count").try_cast("double")
    return rows.select("id", F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(number(F.col("importance")).cast("int"), F.lit(5)))).alias("importance"), unit("valence", 0.5).alias("valence"), unit("arousal", 0.3).alias("arousal"), F.filter(F.transform(F.split("domain", ","), lambda x: F.trim(x)), lambda x: x != "").alias("domain"), F.when(used.isNull() | F.isnan(used) | (used < 0) | (used == float("inf")), 0.0).otherwise(F.round(used, 3)).alias("activation_count"))


def snapshot_diff(previous: DataFrame, current: DataFrame, meta: list[str]) -> DataFrame:
    """(id, change): added, removed, content or metadata; equal rows are left out."""
    side = lambda df, p: df.select("id", F.sha2("content", 256).alias(f"{p}c"), F.xxhash64(*meta).alias(f"{p}m"))
    both = side(previous, "p").join(side(current, "c"), "id", "full_outer")
    change = F.when(F.col("pc").isNull(), "added").when(F.col("cc").isNull(), "removed").when(F.col("pc") != F.col("cc"), "content").when(F.col("pm") != F.col("cm"), "metadata")
    return both.select("id", change.alias("change")).filter("change IS NOT NULL")


def parse_ledger(lines: DataFrame) -> DataFrame:
    """lines(line_no, value): events, with `valid` false for what is no event."""
    e = F.from_json("value", LEDGER)
    ok = e.isNotNull() & e["seq"].isNotNull() & e["event_type"].isNotNull()
    return lines.filter(F.trim("value") != "").select("line_no", ok.alias("valid"), e.alias("e")).select("line_no", "valid", "e.*")


def ledger_integrity(lines: DataFrame) -> DataFrame:
    p = parse_ledger(lines)
    return p.agg(F.count_if("valid").alias("events"), F.count_if(~F.col("valid")).alias("invalid"), F.max(F.when(F.col("valid"), F.col("seq"))).alias("latest_seq"))


def append_events(changes: DataFrame, base: Column, order: list[str]) -> DataFrame:
    """changes with the next numbers in order: the rank in a range plus the sizes of the ranges before, not one window."""
    from notegrid.storage import materialize

    parts = max(2, int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialize(changes.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "append")
    within = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))  # a row a range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    return within.join(F.broadcast(before), "_range").withColumn("seq", base + F.col("_before") + F.col("_n")).drop("_range", "_n", "_before")


def verify_chain(rows: DataFrame) -> DataFrame:
    """rows(index, previous_checksum, checksum, payload): problems of a hash-chained log, by an equi join on the index."""
    before = rows.select((F.col("index") + 1).alias("index"), F.col("checksum").alias("_prev"))
    joined = rows.join(before, "index", "left")
    want = F.sha2(F.concat_ws("|", F.col("index").cast("string"), "previous_checksum", "payload"), 256)
    code = F.when((F.col("index") > 1) & F.col("_prev").isNull(), "gap").when(F.col("previous_checksum") != F.coalesce("_prev", F.lit("")), "broken_link").when(F.col("checksum") != want, "bad_checksum")
    return joined.select("index", code.alias("code")).filter("code IS NOT NULL")


def parse_vectors(rows: DataFrame, size: int) -> DataFrame:
    """rows(id, embedding as JSON text): (id, v, error)."""
    v = F.from_json("embedding", "array<double>")
    error = F.when(v.isNull(), "malformed").when(F.size(v) == 0, "empty").when(F.size(v) != size, "wrong_size")
    return rows.select("id", F.when(error.isNull(), v).alias("v"), error.alias("error"))


#: Names of the two sides at the start of a line, as fixed values.
ASSISTANTS = ("assistant", "claude", "ai", "gpt", "bot", "deepseek")
PEOPLE = ("human", "user", "你", "我")
ROLES = rf"^\s*(?i)({'|'.join((*PEOPLE, *ASSISTANTS, 'system'))})\s*[:：]\s*(.*)$"


def parse_transcripts(files: DataFrame) -> DataFrame:
    """files(path, value) of role-prefixed lines: (path, turn, role, content); a file without a prefix is one user turn."""
    lines = files.select("path", F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    role = F.lower(F.regexp_extract("line", ROLES, 1))
    marked = lines.withColumn("role", role).withColumn("said", F.when(role != "", F.regexp_extract("line", ROLES, 2)).otherwise(F.col("line")))
    numbered = marked.withColumn("turn", F.sum((F.col("role") != "").cast("int")).over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    name = F.when(F.max("role").isin(*ASSISTANTS), "assistant").when(F.max("role") == "system", "system").otherwise("user")
    turns = numbered.groupBy("path", "turn").agg(name.alias("role"), F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"]), "\n")).alias("content"))
    return turns.filter("content <> ''")


BLANK = " \\t\\n\\r\\u000b\\u000c"
_OBJECT = "schema_of_variant({}) LIKE 'OBJECT%'"
#: The conversations of a parsed file: the objects of a list, or the one object; a bare list of messages is one conversation.
_CONVERSATIONS = f"""CASE WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN
  CASE WHEN try_variant_get(v, '$[0].role', 'string') IS NOT NULL AND try_variant_get(v, '$[0].content', 'variant') IS NOT NULL THEN array(try_parse_json(concat('{{"messages":', to_json(v), '}}')))
  ELSE filter(try_variant_get(v, '$', 'array<variant>'), c -> {_OBJECT.format('c')}) END
  WHEN {_OBJECT.format('v')} THEN array(v) ELSE array() END"""


def _conversations(files: DataFrame) -> DataFrame:
    return files.select("path", F.try_parse_json("value").alias("v")).select("path", F.expr(_CONVERSATIONS).alias("convs"))


def _joined(parts: str) -> str:
    """SQL for the text of a list of variants, joined by a blank."""
    return f"btrim(array_join(filter(transform(coalesce({parts}, array()), p -> try_variant_get(p, '$', 'string')), s -> s IS NOT NULL AND s <> ''), ' '), '{BLANK}')"


def parse_chat_export(files: DataFrame) -> DataFrame:
    """files(path, value) of JSON exports with chat_messages or messages, one conversation or a list: (path, turn, role, content, at), blank messages dropped.

    A message's text is its `text`, else its `content`: a string or a list of parts with a text. Turns are counted over all conversations of the file.
    """
    messages = "flatten(transform(convs, c -> filter(coalesce(try_variant_get(c, '$.chat_messages', 'array<variant>'), try_variant_get(c, '$.messages', 'array<variant>'), array()), m -> schema_of_variant(m) LIKE 'OBJECT%')))"
    each = _conversations(files).select("path", F.posexplode(F.expr(messages)).alias("turn", "m"))
    each = each.withColumn("raw", F.expr("coalesce(try_variant_get(m, '$.text', 'variant'), try_variant_get(m, '$.content', 'variant'))"))
    parts = "transform(filter(try_variant_get(raw, '$', 'array<variant>'), p -> schema_of_variant(p) LIKE 'OBJECT%'), p -> coalesce(try_variant_get(p, '$.text', 'string'), ''))"
    said = F.expr(f"btrim(CASE WHEN schema_of_variant(raw) = 'STRING' THEN try_variant_get(raw, '$', 'string') WHEN schema_of_variant(raw) LIKE 'ARRAY%' THEN array_join({parts}, ' ') ELSE '' END, '{BLANK}')")
    name = F.expr("lower(coalesce(try_variant_get(m, '$.sender', 'string'), try_variant_get(m, '$.role', 'string')))")
    at = F.expr("coalesce(try_variant_get(m, '$.created_at', 'string'), try_variant_get(m, '$.timestamp', 'string'))")
    return each.select("path", F.col("turn").cast("long").alias("turn"), F.when(name.isin("assistant", "ai"), "assistant").otherwise("user").alias("role"), said.alias("content"), at.alias("at")).filter("content <> ''")


def manifest(files: DataFrame) -> DataFrame:
    """files(path, data): path, bytes and sha256 of each."""
    return files.select("path", F.octet_length("data").cast("long").alias("bytes"), F.sha2("data", 256).alias("sha256"))


def verify_manifest(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Differences of two manifests: missing, extra, size, hash, unsafe."""
    both = wanted.select("path", F.col("bytes").alias("b"), F.col("sha256").alias("h")).join(found.select("path", F.col("bytes").alias("fb"), F.col("sha256").alias("fh")), "path", "full_outer")
    code = F.when(F.rlike("path", F.lit(r"^/|(^|/)\.\.(/|$)")), "unsafe").when(F.col("fh").isNull(), "missing").when(F.col("h").isNull(), "extra").when(F.col("b") != F.col("fb"), "size").when(F.col("h") != F.col("fh"), "hash")
    return both.select("path", code.alias("code")).filter("code IS NOT NULL")


def to_events(memories: DataFrame, known: DataFrame) -> DataFrame:
    """Memories as immutable events with an id from their content; those known already are left out."""
    body = F.to_json(F.struct("id", "type", "importance"))
    ident = F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat_ws("|", "id", "content"), 256), 1, 32))
    return memories.select(ident.alias("event_id"), F.col("type").alias("memory_type"), F.greatest(F.lit(1), F.least(F.lit(10), F.col("importance"))).alias("importance"), body.alias("metadata")).join(known.select("event_id"), "event_id", "left_anti")


def parse_chat_tree(files: DataFrame) -> DataFrame:
    """files(path, value) of JSON exports with a mapping of messages, one conversation or a list: turns in the order of create_time.

    Nodes of one time go by their key. A conversation without a mapping has a flat list of messages, whose content is
    an object with parts or a string; its order stays.
    """
    node = f"""named_struct('at', coalesce(try_variant_get(e.value, '$.message.create_time', 'double'), 0D), 'key', e.key, 'role', try_variant_get(e.value, '$.message.author.role', 'string'), 'said', {_joined("try_variant_get(e.value, '$.message.content.parts', 'array<variant>')")})"""
    tree = f"array_sort(transform(filter(map_entries(mapping), e -> schema_of_variant(try_variant_get(e.value, '$.message', 'variant')) LIKE 'OBJECT%'), e -> {node}))"
    raw = "coalesce(try_variant_get(m, '$.content', 'variant'), try_variant_get(m, '$.text', 'variant'))"
    body = f"""CASE WHEN schema_of_variant({raw}) LIKE 'OBJECT%' THEN {_joined(f"try_variant_get({raw}, '$.parts', 'array<variant>')")} ELSE btrim(coalesce(try_variant_get({raw}, '$', 'string'), ''), '{BLANK}') END"""
    flat = f"transform(filter(coalesce(try_variant_get(c, '$.messages', 'array<variant>'), array()), m -> schema_of_variant(m) LIKE 'OBJECT%'), m -> named_struct('at', coalesce(try_variant_get(m, '$.timestamp', 'double'), try_variant_get(m, '$.create_time', 'double'), 0D), 'key', '', 'role', coalesce(nullif(try_variant_get(m, '$.role', 'string'), ''), try_variant_get(m, '$.author.role', 'string')), 'said', {body}))"
    mapped = F.expr("transform(convs, c -> named_struct('c', c, 'mapping', coalesce(try_variant_get(c, '$.mapping', 'map<string,variant>'), map())))")
    each = _conversations(files).select("path", F.posexplode(mapped).alias("conv", "x")).select("path", "conv", F.col("x.c").alias("c"), F.col("x.mapping").alias("mapping"))
    each = each.select("path", "conv", F.posexplode(F.expr(f"filter(CASE WHEN size(mapping) > 0 THEN {tree} ELSE {flat} END, n -> n.said <> '')")).alias("pos", "n"))
    role = F.when(F.col("n.role") == "assistant", "assistant").when(F.col("n.role") == "system", "system").otherwise("user")
    turn = F.row_number().over(Window.partitionBy("path").orderBy("conv", "pos")) - 1
    return each.select("path", turn.cast("long").alias("turn"), role.alias("role"), F.col("n.said").alias("content"), F.timestamp_seconds("n.at").alias("at"))


def detect_format(files: DataFrame) -> DataFrame:
    """files(path, value) with `format`: messages, tree, transcript or empty; JSON of no known form, or broken, is a transcript."""
    head = F.regexp_extract("value", r"\S", 0)
    v = F.when(F.lower("path").endswith(".json") | head.isin("{", "["), F.try_parse_json("value"))
    rows = files.withColumn("_v", v).withColumn("_s", F.expr("CASE WHEN schema_of_variant(_v) LIKE 'ARRAY%' THEN try_variant_get(_v, '$[0]', 'variant') ELSE _v END"))
    has = lambda name: F.expr(f"try_variant_get(_s, '$.{name}', 'variant') IS NOT NULL")
    parts = F.expr("coalesce(schema_of_variant(try_variant_get(_s, '$.messages[0].content', 'variant')) LIKE 'OBJECT%', false)")
    kind = F.when(F.coalesce(head, F.lit("")) == "", "empty").when(has("chat_messages"), "messages").when(has("mapping"), "tree").when(has("messages"), F.when(parts, "tree").otherwise("messages")).when(has("role") & has("content"), "messages").otherwise("transcript")
    return rows.withColumn("format", kind).drop("_v", "_s")


def route(files: DataFrame) -> DataFrame:
    """Turns of files of any format."""
    f = detect_format(files)
    cols = ["path", "turn", "role", "content"]
    parts = [parse_chat_export(f.filter("format = 'messages'")).select(*cols), parse_chat_tree(f.filter("format = 'tree'")).select(*cols), parse_transcripts(f.filter("format = 'transcript'")).select("path", F.col("turn").cast("long").alias("turn"), "role", "content")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def backup_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Two manifests: upload, unchanged or remove for each path."""
    both = local.select("path", F.col("sha256").alias("h")).join(remote.select("path", F.col("sha256").alias("r")), "path", "full_outer")
    return both.select("path", F.when(F.col("h").isNull(), "remove").when(F.col("r").isNull() | (F.col("r") != F.col("h")), "upload").otherwise("unchanged").alias("action"))


def catch_up(snapshot: DataFrame, log: DataFrame, current: int) -> DataFrame:
    """snapshot(index, payload), log(index, payload): entries above the current index; the first gap ends what can be applied."""
    last = snapshot.agg(F.coalesce(F.max("index"), F.lit(0)).alias("last"))  # one row
    new = snapshot.filter(F.col("index") > current).unionByName(log.join(F.broadcast(last)).filter((F.col("index") > F.col("last")) & (F.col("index") > current)).select("index", "payload"))
    before = new.select((F.col("index") + 1).alias("index"))
    heads = new.filter(F.col("index") != current + 1).join(before, "index", "left_anti").agg(F.min("index").alias("gap"))  # one row
    start = new.agg(F.bool_or(F.col("index") == current + 1).alias("starts"))  # one row
    return new.join(F.broadcast(heads)).join(F.broadcast(start)).filter(F.col("starts") & (F.col("gap").isNull() | (F.col("index") < F.col("gap")))).select("index", "payload")


def attachments(rows: DataFrame, most: int = 20) -> DataFrame:
    """rows(id, media array<struct<payload,type>>): decoded, named by content, one row a path, at most so many a memory."""
    each = rows.select("id", F.posexplode("media").alias("pos", "m")).select("id", "pos", F.unbase64("m.payload").alias("data"), F.col("m.type").alias("type"))
    named = each.withColumn("path", F.concat("id", F.lit("/"), F.substring(F.sha2("data", 256), 1, 16), F.lit("."), "type"))
    first = named.groupBy("id", "path").agg(F.min("pos").alias("pos"), F.first("data").alias("data"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).filter(F.col("n") <= most).select("id", "path", F.octet_length("data").cast("long").alias("bytes"))


def merge_vectors(own: DataFrame, other: DataFrame, id_map: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """other(id, embedding) through id_map(old_id, id): merged table, and the ids to embed anew."""
    moved = other.join(id_map, other["id"] == id_map["old_id"]).select(id_map["id"].alias("id"), "embedding")
    good = moved.filter((F.size("embedding") == size) & F.forall("embedding", lambda x: x.isNotNull())).dropDuplicates(["id"])
    merged = own.join(good.select("id"), "id", "left_anti").unionByName(good)
    return merged, id_map.select("id").join(good.select("id"), "id", "left_anti")


def eval_cases(raw: DataFrame) -> DataFrame:
    """raw(pos, query, expected): expected as text with commas or as JSON array -> array; an unusable case fails with its number."""
    ids = F.filter(F.transform(F.coalesce(F.from_json("expected", "array<string>"), F.split("expected", ",")), lambda x: F.trim(x)), lambda x: x != "")
    bad = (F.trim(F.coalesce("query", F.lit(""))) == "") | (F.size(ids) == 0)
    return raw.select("pos", F.when(bad, F.raise_error(F.concat(F.lit("unusable case "), F.col("pos").cast("string")))).otherwise(F.trim("query")).alias("query"), ids.alias("expected"))


def row_digests(rows: DataFrame) -> DataFrame:
    """rows(index, ...) as (index, h), h the digest of the columns in order."""
    return rows.select("index", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in rows.columns]), 256).alias("h"))


def tree_checksum(digests: DataFrame, fan: int = 1000, levels: int = 3) -> DataFrame:
    """One row `checksum` of digests(index, h): digests of `fan` neighbouring indexes are joined in order and hashed, level by level.

    No row holds more than fan digests (of fan^levels indexes); nothing is ordered as a whole.
    """
    out = digests
    for level in range(levels):
        group = F.lit(0).cast("long") if level == levels - 1 else F.floor(F.col("index") / fan)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "h"))), lambda x: x["h"]), "")
        out = out.groupBy(group.alias("g")).agg(F.sha2(joined, 256).alias("h")).select(F.col("g").alias("index"), "h")
    return out.select(F.col("h").alias("checksum"))


def snapshot_header(rows: DataFrame) -> DataFrame:
    """rows(index, event_type, ...): last_index, last_type, n, contiguous and checksum of a snapshot, in one row."""
    facts = rows.agg(F.max("index").alias("last_index"), F.max_by("event_type", "index").alias("last_type"), F.count(F.lit(1)).alias("n"), (F.max("index") - F.min("index") + 1 == F.countDistinct("index")).alias("contiguous"))
    return facts.join(F.broadcast(tree_checksum(row_digests(rows))))


def snapshot_problems(rows: DataFrame, header: DataFrame) -> DataFrame:
    """What a snapshot's rows and its header disagree in, comma-joined ('' if it may be loaded), in one row."""
    own = snapshot_header(rows).select(*[F.col(c).alias(f"own_{c}") for c in ("last_index", "last_type", "n", "contiguous", "checksum")])
    tests = [F.when(~F.col("own_contiguous"), "gap"), *[F.when(~F.col(f"own_{c}").eqNullSafe(F.col(c)), f"bad_{c}") for c in ("last_index", "last_type", "n", "checksum")]]
    return own.join(F.broadcast(header)).select(F.array_join(F.filter(F.array(*tests), lambda x: x.isNotNull()), ",").alias("problems"))


def archived_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the data files below an archive; paths are relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{path}/data")
    return files.select(F.regexp_extract("path", ".*/(data/.*)$", 1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_archive(path: str, tables: dict[str, DataFrame], version: str = "1") -> None:
    """Tables as Parquet below path/data, then the manifest of all files and its totals; the manifest comes last and commits the archive."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{path}/data/{name}")
    found = archived_files(spark, path)
    found.agg(F.count(F.lit(1)).alias("file_count"), F.sum("bytes").alias("total_bytes")).withColumn("version", F.lit(version)).write.json(f"{path}/totals")
    found.write.json(f"{path}/manifest")


def verify_archive(spark: SparkSession, path: str) -> DataFrame:
    """Differences between an archive's manifest and its files: (path, code); an archive without a manifest can't be read."""
    return verify_manifest(spark.read.schema("path string, bytes long, sha256 string").json(f"{path}/manifest"), archived_files(spark, path))


def read_archive(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data/{name}")
