"""Exports and state files of other programs: conversations, visits, posts, registries, ledgers."""

from __future__ import annotations

import json
import uuid
from functools import reduce

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybreak.functions.text import clean_title
from daybreak.functions.times import boundary_seconds, browser_seconds, iso, sort_seconds
from daybreak.operators.dedupe import last_value_first_place
from daybreak.sources import archives, arrays
from daybreak.tables import remove

_EDGES = r"^\s+|\s+$"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def _kind(v: Column) -> Column:
    """The type of a variant: STRING, BIGINT, OBJECT<...>, ARRAY<...>; null stays null."""
    return F.schema_of_variant(v)


def _string(v: Column, path: str = "$") -> Column:
    """A text at a path of a variant; anything else there is null."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(_kind(found) == "STRING", F.try_variant_get(found, "$", "string"))


def _number(v: Column, path: str) -> Column:
    found = F.try_variant_get(v, path, "variant")
    return F.when(_kind(found).rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(found, "$", "double"))


def message_text(content: Column) -> Column:
    """The text of a message's content: a text itself, its non-blank parts, its text, or its text's value; else empty."""
    parts = F.filter(F.transform(F.try_variant_get(content, "$.parts", "array<variant>"), lambda p: _stripped(_string(p))), lambda t: t != "")
    joined = F.when(F.size(parts) > 0, F.array_join(parts, "\n\n"))
    return F.coalesce(_stripped(_string(content)), joined, _stripped(_string(content, "$.text")), _stripped(_string(content, "$.text.value")), F.lit(""))


def conversation_lines(payload: Column) -> Column:
    """Lines `role: text` of a conversation's map of nodes, by time (those without one last), then by place in the map.

    A node counts if it has a message with a non-empty role and text; its time is the message's number, else its own.
    """
    nodes = F.map_entries(F.from_json(F.get_json_object(payload, "$.mapping"), "map<string,string>"))

    def row(entry: Column, place: Column) -> Column:
        node = F.try_parse_json(entry.value)
        when = F.coalesce(_number(node, "$.message.create_time"), _number(node, "$.create_time"), F.lit(float("inf")))
        return F.struct(when.alias("at"), place.alias("place"), F.lower(_string(node, "$.message.author.role")).alias("role"), message_text(F.try_variant_get(node, "$.message.content", "variant")).alias("text"))

    rows = F.filter(F.transform(nodes, row), lambda r: (F.coalesce(r.role, F.lit("")) != "") & (r.text != ""))
    return F.transform(F.array_sort(rows), lambda r: F.concat(r.role, F.lit(": "), r.text))


def timestamp_text(value: Column) -> Column:
    """A time given as a number of seconds or as text, as text."""
    number = value.try_cast("double")
    return F.when(number.isNotNull(), iso(F.floor(number).cast("long"))).otherwise(F.nullif(value, F.lit("")))


def conversation_export(rows: DataFrame) -> DataFrame:
    """(payload) one conversation as JSON a row: items with their lines; a row without an id is left out."""
    p = F.col("payload")
    lines = conversation_lines(p)
    item_id = F.coalesce(F.get_json_object(p, "$.conversation_id"), F.get_json_object(p, "$.id"))
    at = lambda name: timestamp_text(F.get_json_object(p, f"$.{name}"))
    out = rows.select(item_id.alias("id"), F.get_json_object(p, "$.title").alias("title"), F.nullif(F.array_join(F.coalesce(lines, F.array().cast("array<string>")), "\n\n"), F.lit("")).alias("body"), F.coalesce(F.size(lines), F.lit(0)).alias("message_count"), at("create_time").alias("created_at"), at("update_time").alias("updated_at"))
    return out.where(F.coalesce(F.col("id"), F.lit("")) != "")


#: Where an export's files are looked for below its folder, before any other place.
EXPORT_PLACES = ("", "extracted", "extracted/conversations", "conversations")


def find_export_file(spark: SparkSession, folder: str, name: str) -> str | None:
    """The path of a file of an export: in the known places first, then anywhere below."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for place in EXPORT_PLACES:
        path = jvm.org.apache.hadoop.fs.Path("/".join(filter(None, [folder.rstrip("/"), place, name])))
        if fs.exists(path):
            return path.toString()
    found = []
    files = fs.listFiles(jvm.org.apache.hadoop.fs.Path(folder), True)
    while files.hasNext():
        path = files.next().getPath()
        if path.getName() == name:
            found.append(path.toString())
    return min(found, default=None)


def _document(spark: SparkSession, path: str) -> object:
    """A small JSON file: a manifest or a user file."""
    rows = spark.read.text(path, wholetext=True).head(1)
    return json.loads(rows[0][0]) if rows else None


def _named(document: object, key: str) -> str | None:
    """The text under a key, if the document is an object and the text isn't empty."""
    value = document.get(key) if isinstance(document, dict) else None
    return value if isinstance(value, str) and value else None


def account(spark: SparkSession, folder: str) -> str | None:
    """The account that an export's manifest names, else the email of its user file; a manifest that isn't JSON names none."""
    path = find_export_file(spark, folder, "manifest.json")
    if path is not None:
        try:
            told = _named(_document(spark, path), "account")
        except json.JSONDecodeError:
            told = None
        if told is not None:
            return told
    path = find_export_file(spark, folder, "user.json")
    return _named(_document(spark, path), "email") if path is not None else None


def read_conversations(spark: SparkSession, folder: str, name: str = "conversations.json") -> DataFrame:
    """The items of an export's conversations file, a JSON array of any size, with their address and account."""
    path = find_export_file(spark, folder, name)
    if path is None:
        raise FileNotFoundError(f"{name} is not below {folder}")
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("ChatGPT conversation"))
    items = conversation_export(arrays.read_array(spark, path).select("payload")).withColumn("title", title)
    return items.withColumns({"url": F.concat(F.lit("https://chatgpt.com/c/"), "id"), "account": F.lit(account(spark, folder)).cast("string")})


def response_items(index: DataFrame, responses: DataFrame) -> DataFrame:
    """(payload) rows of an index LEFT JOIN (id, payload) response files: lines `sender: message` without blank ones; every response counts."""
    p = F.col("payload")
    named = index.select(F.coalesce(F.nullif(F.get_json_object(p, "$.conversationId"), F.lit("")), F.get_json_object(p, "$.id")).alias("id"), F.get_json_object(p, "$.title").alias("title"), F.get_json_object(p, "$.createTime").alias("created_at"), F.get_json_object(p, "$.modifyTime").alias("updated_at"))
    entries = F.from_json(F.get_json_object(p, "$.responses"), "array<struct<sender:string,message:string>>")
    kept = F.filter(F.transform(entries, lambda r: F.struct(F.lower(F.coalesce(F.nullif(r.sender, F.lit("")), F.lit("unknown"))).alias("sender"), _stripped(r.message).alias("message"))), lambda r: F.coalesce(r.message, F.lit("")) != "")
    bodies = responses.select("id", F.nullif(F.array_join(F.transform(kept, lambda r: F.concat(r.sender, F.lit(": "), r.message)), "\n\n"), F.lit("")).alias("body"), F.size(entries).alias("response_count"))
    return named.where(F.coalesce(F.col("id"), F.lit("")) != "").join(bodies, "id", "left").withColumn("response_count", F.greatest(F.coalesce("response_count", F.lit(0)), F.lit(0)))


def read_responses(spark: SparkSession, folder: str) -> DataFrame:
    """The items of an index file and one responses file for each conversation below `responses`."""
    root = folder.rstrip("/")
    index = spark.read.text(f"{root}/conversations.index.json", wholetext=True)
    index = index.select(F.explode(F.from_json(F.get_json_object("value", "$.conversations"), "array<string>")).alias("payload"))
    manifest = find_export_file(spark, root, "manifest.json")
    mode = F.lit("browser_automation_experimental")
    if manifest is not None:
        told = json.loads(spark.read.text(manifest, wholetext=True).first()[0]).get("acquisition_mode")
        mode = F.lit(told) if told else mode
    files = spark.read.option("pathGlobFilter", "*.responses.json").option("recursiveFileLookup", "true").text(root, wholetext=True)
    named = files.select(F.url_decode(F.regexp_extract(F.input_file_name(), r"([^/]+)\.responses\.json$", 1)).alias("id"), F.col("value").alias("payload"))
    return response_items(index, named).withColumn("acquisition_mode", mode)


def session_items(rows: DataFrame) -> DataFrame:
    """(payload) one session as a JSON object a row: its id, title, summary as body and times."""
    p = F.col("payload")
    text = lambda *names: F.coalesce(*(F.nullif(F.get_json_object(p, f"$.{n}"), F.lit("")) for n in names))
    return rows.select(text("id", "session_id").alias("id"), text("title").alias("title"), text("body", "summary").alias("body"), text("created_at").alias("created_at"), text("updated_at").alias("updated_at")).where("id is not null")


def visit_address(url: Column, site: str) -> Column:
    """struct<id, canonical, variant> of an address https://site/c/<id>; the variant keeps the query value `rid` only; null for others."""
    path = F.regexp_extract(url, rf"^https://{site.replace('.', chr(92) + '.')}(/[^?#]*)(?:[?#].*)?$", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    fits = (F.size(parts) == 2) & (F.try_element_at(parts, F.lit(1)) == "c")
    name = F.try_element_at(parts, F.lit(2))
    canonical = F.concat(F.lit(f"https://{site}/c/"), name)
    rid = F.regexp_extract(url, r"^[^#]*[?&]rid=([^&#]*)", 1)
    has = url.rlike(r"^[^#]*[?&]rid=")
    variant = F.when(has, F.concat(F.lit(f"https://{site}"), path, F.lit("?rid="), rid)).otherwise(canonical)
    return F.when(fits, F.struct(name.alias("id"), canonical.alias("canonical"), variant.alias("variant")))


def visit_conversations(visits: DataFrame, site: str = "grok.com", product: str = "Grok") -> DataFrame:
    """(id, url, title, last_visit_time, visit_count) rows of a browser's history: one row for each conversation on the site.

    Visits add up, the last time counts, variants are distinct and sorted; the title is the first usable one by descending time
    and id, and any other replaces the product's bare name.
    """
    rows = visits.where(F.col("url").startswith(f"https://{site}/")).withColumn("at", visit_address(F.col("url"), site)).where("at is not null")
    title = clean_title(F.col("title"), product)
    order = F.struct((title == product).alias("bare"), (-F.col("last_visit_time")).alias("later"), (-F.col("id")).alias("place"))
    out = rows.groupBy(F.col("at.id").alias("conversation_id")).agg(
        F.max("at.canonical").alias("canonical_url"),
        F.array_sort(F.collect_set("at.variant")).alias("url_variants"),
        F.sum(F.coalesce("visit_count", F.lit(0))).cast("long").alias("visit_count"),
        F.max("last_visit_time").alias("last"),
        F.min_by(F.when(title.isNotNull(), title), F.when(title.isNotNull(), order)).alias("title"),
    )
    return out.select("conversation_id", "canonical_url", "url_variants", "visit_count", iso(browser_seconds(F.col("last"))).alias("modified_at"), "title")


#: Post signals and the sources they make.
SIGNALS = {"bookmarks": "x_bookmarks", "likes": "x_likes", "home_timeline_reverse_chronological": "x_home_timeline_reverse_chronological"}
MOST_POSTS = 100


def signal_posts(payloads: dict[str, DataFrame]) -> DataFrame:
    """(payload) responses by signal: (source, pos, id, text, author_id, created_at, username), at most 100 posts a signal; an unknown signal is an error."""
    unknown = [s for s in payloads if s not in SIGNALS]
    if unknown:
        raise ValueError(f"unknown post signal: {unknown[0]}")
    shape = "struct<data:array<struct<id:string,text:string,author_id:string,created_at:string>>,includes:struct<users:array<struct<id:string,username:string>>>>"
    frames = []
    for signal, rows in payloads.items():
        v = rows.select(F.from_json("payload", shape).alias("v")).select(F.map_from_entries(F.transform("v.includes.users", lambda u: F.struct(u.id, u.username))).alias("users"), F.posexplode("v.data").alias("pos", "p")).where(F.col("pos") < MOST_POSTS)
        frames.append(v.select(F.lit(SIGNALS[signal]).alias("source"), "pos", "p.id", "p.text", "p.author_id", "p.created_at", F.try_element_at("users", F.col("p.author_id")).alias("username")))
    return reduce(DataFrame.unionByName, frames)


# ---- typed payloads and ledgers ---------------------------------------------------------------

TIMES = "struct<created_at:string,updated_at:string,start_at:string,end_at:string>"
INTENT = "struct<saved:boolean,liked:boolean,unread:boolean,unresolved:boolean>"
PROVENANCE = "struct<provider:string,acquisition_mode:string,authority_tier:string,primary_source_url:string,artifact_id:string,raw_record_id:string>"
PAYLOAD = f"struct<id:string,source:string,source_kind:string,title:string,excerpt:string,body:string,url:string,people:array<string>,topics:array<string>,place_refs:array<string>,timestamps:{TIMES},intent_signals:{INTENT},provenance:{PROVENANCE},citation_chain:array<struct<label:string,url:string,relation:string>>,metadata:map<string,string>,retrieved_at:string>"


def typed_items(rows: DataFrame) -> DataFrame:
    """(payload) items as JSON, typed: missing lists are empty, missing intent flags false where there are any; what isn't an item is left out."""
    v = rows.select(F.from_json("payload", PAYLOAD).alias("v")).where("v.id is not null and v.source is not null and v.source_kind is not null").select("v.*")
    none = F.array().cast("array<string>")
    flag = lambda name: F.coalesce(f"intent_signals.{name}", F.lit(False)).alias(name)
    intent = F.when(F.col("intent_signals").isNotNull(), F.struct(*map(flag, ("saved", "liked", "unread", "unresolved"))))
    lists = {name: F.coalesce(name, none) for name in ("people", "topics", "place_refs")}
    chain = F.filter(F.coalesce("citation_chain", F.array().cast("array<struct<label:string,url:string,relation:string>>")), lambda c: c.isNotNull())
    return v.withColumns({**lists, "intent_signals": intent, "citation_chain": chain, "metadata": F.coalesce("metadata", F.create_map().cast("map<string,string>"))})


def jsonl(record: Column) -> Column:
    """A record as one line, in which the Unicode line and paragraph separators are escaped."""
    text = F.to_json(record, {"ignoreNullFields": "false"})
    return F.replace(F.replace(text, F.lit("\u2028"), F.lit("\\u2028")), F.lit("\u2029"), F.lit("\\u2029"))


def write_ledger(items: DataFrame, folder: str) -> None:
    """Appends items as lines below the folder, by source."""
    lines = items.select("source", jsonl(F.struct(*(F.col(f"`{c}`") for c in items.columns))).alias("value"))
    lines.write.mode("append").partitionBy("source").option("lineSep", "\n").text(folder)


def ledger_items(lines: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """(value) lines of ledgers with retrieved_at in [start, end): blank and malformed lines and those without a time are skipped."""
    parsed = typed_items(lines.where(F.trim("value") != "").select(F.col("value").alias("payload"))).where("retrieved_at is not null")
    at = sort_seconds(F.col("retrieved_at"))
    kept = parsed.where(at.isNotNull())
    if start is not None:
        kept = kept.where(at >= boundary_seconds(start))
    if end is not None:
        kept = kept.where(at < boundary_seconds(end))
    return kept


def read_ledger(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The ledger's items in replay order: retrieved_at as text, source, id."""
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(folder)
    return ledger_items(lines, start, end).orderBy("retrieved_at", "source", "id")


# ---- registry ---------------------------------------------------------------------------------

ENTRY = "id string, title string, domain string, acquisition_mode string, authority_tier string, url string, category_hint string, topical_scopes array<string>, search_hints array<string>"


def registry_rows(sources: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Sources (id, pos, ...): each id at its first place with its last value; `only` (id, place) keeps its ids, in its order."""
    if only is not None:
        places = only.groupBy("id").agg(F.min("place").alias("place"))
        sources = sources.join(places, "id").withColumn("pos", F.struct("place", "pos")).drop("place")
    return last_value_first_place(sources, "id", "pos")


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """A YAML registry with one level of includes, as a frame in registry order; a registry is a few thousand lines at most."""
    root = path.rsplit("/", 1)[0]

    def read(name: str) -> dict:
        return yaml.safe_load(spark.read.text(name, wholetext=True).first()[0]) or {}

    payload = read(path)
    include = payload.get("include") or []
    entries = [e for name in ([include] if isinstance(include, str) else include) for e in read(f"{root}/{name}").get("sources", [])]
    entries += payload.get("sources", [])
    names = [f.split()[0] for f in ENTRY.split(", ")]
    rows = [(*(_sequence(e.get(n)) if n in ("topical_scopes", "search_hints") else e.get(n) for n in names), pos) for pos, e in enumerate(entries)]
    frame = spark.createDataFrame(rows, f"{ENTRY}, pos int")
    wanted = payload.get("only_ids") or []
    only = spark.createDataFrame([(x, k) for k, x in enumerate(wanted)], "id string, place int") if wanted else None
    return registry_rows(frame, only).orderBy("pos")


def _sequence(value: object) -> list[str]:
    """A text as a list of one, a sequence as a list of texts, anything else as none."""
    if isinstance(value, str):
        return [value]
    return [str(x) for x in value] if isinstance(value, (list, tuple)) else []


def category_metadata() -> Column:
    """A registry row's category hint and scopes as metadata; what isn't set is left out."""
    pairs = F.array(F.struct(F.lit("category_hint").alias("k"), F.nullif("category_hint", F.lit("")).alias("v")), F.struct(F.lit("topical_scopes").alias("k"), F.when(F.size("topical_scopes") > 0, F.array_join("topical_scopes", ",")).alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda p: p.v.isNotNull()))


# ---- export archives --------------------------------------------------------------------------

#: One of these stands in the name of an export archive.
EXPORT_MARKS = ("openai-export", "chatgpt", "conversations__")


def latest_export(files: DataFrame) -> DataFrame:
    """(path, modificationTime) of files: the newest export archive, by time, then name; no row without any."""
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    marked = reduce(lambda acc, m: acc | name.contains(m), EXPORT_MARKS, F.lit(False))
    return files.where(marked & name.endswith(".zip")).orderBy(F.desc("modificationTime"), F.desc(F.regexp_extract("path", r"([^/]+)$", 1))).limit(1)


#: Where an export's files are put below the folder it is prepared in.
EXTRACTED = "extracted/conversations"


def array_size(spark: SparkSession, path: str) -> int:
    """How many elements a file's JSON array has."""
    found = arrays.read_array(spark, path)
    n = found.count()
    remove(found)
    return n


def prepare_export(spark: SparkSession, folder: str, out: str, name: str = "conversations.json") -> dict:
    """Unpacks the newest export below a folder to `out`, with its user file and its own manifest. Returns the manifest it writes.

    Whatever was in `out` is replaced as a whole, but an empty export never replaces one that has conversations: it is noted in
    the manifest, of which all else stays. Members are copied by a task and counted by many.
    """
    newest = latest_export(spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").load(folder).select("path", "modificationTime")).first()
    if newest is None:
        raise FileNotFoundError(f"no export archive in {folder}")
    out = out.rstrip("/")
    staged = f"{out}.staged-{uuid.uuid4().hex[:12]}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def write_manifest(root: str, manifest: dict) -> None:
        stream = fs.create(path(f"{root}/manifest.json"), True)
        stream.write(bytearray(json.dumps(manifest, ensure_ascii=False, indent=2).encode()))
        stream.close()

    try:
        found = archives.unpacked(spark, newest.path, [name, "user.json", "export_manifest.json"], f"{staged}/{EXTRACTED}")
        if name not in found:
            raise FileNotFoundError(f"{name} is not in {newest.path}")
        count = array_size(spark, found[name])
        before = f"{out}/{EXTRACTED}/{name}"
        existing = array_size(spark, before) if fs.exists(path(before)) else 0
        latest = {"latest_export_conversation_count": count}
        if not count and existing:
            kept = (_document(spark, f"{out}/manifest.json") if fs.exists(path(f"{out}/manifest.json")) else None) or {}
            kept |= latest | {"latest_export_source_path": newest.path, "import_status": "skipped_empty_export"}
            write_manifest(out, kept)
            return kept | {"conversation_count": existing, "source_path": newest.path}
        account = _named(_document(spark, found["user.json"]), "email") if "user.json" in found else None
        manifest = {"provider": "chatgpt", "acquisition_mode": "official_export", "import_status": "prepared", "conversation_count": count, "account": account, "source_path": newest.path}
        manifest["export_manifest"] = _document(spark, found["export_manifest.json"]) if "export_manifest.json" in found else None
        write_manifest(staged, manifest)
        fs.delete(path(out), True)
        if not fs.rename(path(staged), path(out)):
            raise OSError(f"{staged} can't be moved to {out}")
        return manifest
    finally:
        fs.delete(path(staged), True)
