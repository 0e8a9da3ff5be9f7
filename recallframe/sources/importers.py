"""Readers of exports and documents, as DataFrames of (text, metadata JSON)."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WRAPPERS = ("items", "data", "messages", "memories", "records")
#: Characters after which ``listed`` begins another list.
LISTED = 4_000_000


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Raw objects, one per non-blank line, in the column ``raw``."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.col("value").alias("raw"))


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw records of whole-file JSON: a list, a wrapped list, or one object; a scalar is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    ok = F.rlike(kind, F.lit("^(ARRAY|OBJECT)"))
    checked = whole.withColumn("v", F.when(ok, F.col("v")).otherwise(F.raise_error(F.lit("a list or an object is needed"))))
    lists = [F.when(F.rlike(F.schema_of_variant(F.try_variant_get("v", f"$.{w}", "variant")), F.lit("^ARRAY")), F.try_variant_get("v", f"$.{w}", "variant")) for w in WRAPPERS]
    inner = F.when(F.rlike(F.schema_of_variant("v"), F.lit("^ARRAY")), F.col("v")).otherwise(F.coalesce(*lists))
    items = F.when(inner.isNotNull(), F.try_variant_get(inner, "$", "array<variant>")).otherwise(F.array("v"))
    return checked.select(F.explode(items).alias("r")).select(F.to_json("r").alias("raw"))


def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """JSON lists of successive JSON texts in ``value``, for ``mapInPandas``; each has the text with which it is full, and a part without texts has an empty one."""
    whole = lambda texts: pd.DataFrame({"value": ["[" + ",".join(texts) + "]"]})
    held, size, full = [], 0, False
    for batch in batches:
        for text in batch["value"]:
            held.append(text)
            size += len(text)
            if size >= LISTED:
                yield whole(held)
                held, size, full = [], 0, True
    if held or not full:
        yield whole(held)


def csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, as JSON objects in ``raw``."""
    return spark.read.option("header", True).csv(path).select(F.to_json(F.struct("*")).alias("raw"))


def _field(raw: Column, *names: str) -> Column:
    """The first of the fields that holds text."""
    return F.coalesce(*(F.when(F.trim(F.get_json_object(raw, f"$.{n}")) != "", F.get_json_object(raw, f"$.{n}")) for n in names))


def _objects(raw: Column) -> Column:
    return F.from_json(raw, "map<string,string>")


def records(rows: DataFrame, text_field: str = "text", fields: list[str] | None = None) -> DataFrame:
    """text (trimmed, never blank) and metadata: the named fields, or all others."""
    m = _objects(F.col("raw"))
    keep = F.map_filter(m, (lambda k, _: k.isin(*fields)) if fields else (lambda k, _: k != text_field))
    return rows.select(F.trim(F.get_json_object("raw", f"$.{text_field}")).alias("text"), F.to_json(keep).alias("metadata")).where("text <> ''")


def preset(rows: DataFrame, kind: str) -> DataFrame:
    """Records of a known export format: 'mem0', 'letta' or 'zep'."""
    raw, m = F.col("raw"), _objects(F.col("raw"))
    empty = F.create_map().cast("map<string,string>")
    inner = F.coalesce(F.from_json(F.get_json_object(raw, "$.metadata"), "map<string,string>"), empty)
    pick = lambda *names: F.map_filter(m, lambda k, _: k.isin(*names))
    over = lambda low, high: F.map_concat(F.map_filter(low, lambda k, _: ~F.array_contains(F.map_keys(high), k)), high)
    if kind == "mem0":
        text, meta = _field(raw, "memory", "text"), pick("user_id", "categories", "created_at", "id", "score")
    elif kind == "letta":
        text, meta = _field(raw, "text", "content", "value"), over(pick("created_at", "tags", "source", "id"), inner)
    elif kind == "zep":
        text, meta = _field(raw, "content", "text"), over(pick("role", "created_at"), inner)
    else:
        raise ValueError(f"unknown preset {kind}")
    named = over(F.create_map(F.lit("source"), F.lit(kind)), F.coalesce(meta, empty))
    return rows.select(F.trim(text).alias("text"), F.to_json(named).alias("metadata")).where("text <> ''")


def markdown_files(spark: SparkSession, *roots: str) -> DataFrame:
    """path, text of all Markdown files below some folders, each file once, in order of paths; files that are no UTF-8 are left out."""
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(list(roots))
    read = whole.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).where("text is not null")
    return read.dropDuplicates(["path"]).orderBy("path")


def locomo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Turns (sample_id, session, date_time, dia_id, speaker, text) and questions (sample_id, question, answer, evidence, category) of long dialogues.

    Sessions are fields named session_1, session_2, .. with a date beside them; an adversarial answer stands in for a missing one.
    """
    raw = json_records(spark, path).select("raw", F.get_json_object("raw", "$.sample_id").alias("sample_id"))
    parts = F.from_json(F.get_json_object("raw", "$.conversation"), "map<string,string>")
    each = raw.select("sample_id", F.explode(parts).alias("k", "v"))
    dates = each.where(F.rlike("k", F.lit("^session_[0-9]+_date_time$"))).select("sample_id", F.regexp_extract("k", "[0-9]+", 0).cast("int").alias("session"), F.col("v").alias("date_time"))
    sessions = each.where(F.rlike("k", F.lit("^session_[0-9]+$"))).select("sample_id", F.regexp_extract("k", "[0-9]+", 0).cast("int").alias("session"), F.from_json("v", "array<struct<speaker:string,dia_id:string,text:string>>").alias("turns"))
    turns = sessions.select("sample_id", "session", F.explode("turns").alias("t")).select("sample_id", "session", "t.*").join(dates, ["sample_id", "session"], "left").withColumn("date_time", F.coalesce("date_time", F.lit("")))
    asked = F.from_json(F.get_json_object("raw", "$.qa"), "array<struct<question:string,answer:string,adversarial_answer:string,evidence:array<string>,category:int>>")
    qa = raw.select("sample_id", F.explode(asked).alias("q")).select("sample_id", "q.question", F.coalesce("q.answer", "q.adversarial_answer", F.lit("")).alias("answer"), "q.evidence", "q.category")
    return turns, qa


def longmemeval(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Questions (question_id, question_type, question, answer, question_date, answer_session_ids) and their sessions' turns (question_id, place, session_id, date, turn, role, content)."""
    schema = "question_id string, question_type string, question string, answer string, question_date string, haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string>>>, answer_session_ids array<string>"
    r = json_records(spark, path).select(F.from_json("raw", schema).alias("r")).select("r.*")
    questions = r.select("question_id", "question_type", "question", "answer", F.coalesce("question_date", F.lit("")).alias("question_date"), F.coalesce("answer_session_ids", F.array().cast("array<string>")).alias("answer_session_ids"))
    zipped = F.arrays_zip(F.coalesce("haystack_session_ids", F.array().cast("array<string>")).alias("session_id"), F.coalesce("haystack_dates", F.array().cast("array<string>")).alias("date"), F.col("haystack_sessions").alias("turns"))
    sessions = r.select("question_id", F.posexplode(zipped).alias("place", "h")).select("question_id", "place", "h.session_id", "h.date", F.posexplode("h.turns").alias("turn", "t"))
    return questions, sessions.select("question_id", "place", "session_id", "date", "turn", "t.role", "t.content")


def scale_corpus(spark: SparkSession, n: int, topics: int = 100, words: tuple[str, ...] = ("river", "stone", "cloud", "maple", "copper", "harbour", "lantern", "meadow"), each: int = 5) -> DataFrame:
    """id, topic, text of ``n`` made documents ``doc 0000001 about topic_1: ..``, topics dealt evenly, words by the document's number."""
    some = F.array(*map(F.lit, words))
    picked = F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda i: F.get(some, F.pmod((F.col("id") + 1) * 7919 + (i + 1) * (F.col("id") % 13 + 1) * 31, F.lit(len(words))).cast("int")))
    text = F.format_string("doc %07d about topic_%d: %s", F.col("id"), F.col("id") % topics, F.array_join(picked, " "))
    return spark.range(n).select("id", (F.col("id") % topics).alias("topic"), text.alias("text"))


def templated(spark: SparkSession, templates: list[str], **slots: list[str]) -> DataFrame:
    """id, text of every template with every combination of the slots' values, each text once."""
    out = spark.createDataFrame([(t,) for t in templates], "text string")
    for name, values in slots.items():  # lists written by hand
        out = out.withColumn("_v", F.explode(F.array(*map(F.lit, values)))).withColumn("text", F.replace("text", F.lit("{" + name + "}"), F.col("_v"))).drop("_v")
    return out.distinct().select(F.xxhash64("text").alias("id"), "text")


def token_windows(ids: DataFrame, context: int, target: int, stride: int) -> DataFrame:
    """doc_id, start, context and target slices of a list of token ids."""
    last = F.size("ids") - context - target
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    each = ids.select("doc_id", "ids", F.explode(starts).alias("start"))
    return each.select("doc_id", "start", F.slice("ids", F.col("start") + 1, context).alias("context"), F.slice("ids", F.col("start") + context + 1, target).alias("target"))


def cached_embeddings(texts: DataFrame, cache: DataFrame, embed) -> DataFrame:
    """sha, vector for every distinct text: from the cache, else by ``embed(sha, text) -> (sha, vector)``."""
    keyed = texts.select(F.sha2("text", 256).alias("sha"), "text").dropDuplicates(["sha"])
    return keyed.join(cache, "sha", "left_semi").join(cache, "sha").select("sha", "vector").unionByName(embed(keyed.join(cache, "sha", "left_anti")))


def hashed_embedding(texts: DataFrame, dim: int = 32) -> DataFrame:
    """sha, vector of a deterministic bag-of-words embedding: signed counts by hash."""
    from recallframe.functions.text import tokens

    words = F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))
    at = lambda w: F.pmod(F.xxhash64(w), F.lit(dim))
    sign = lambda w: F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    slots = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(words, F.lit(0.0), lambda s, w: s + F.when(at(w) == i, sign(w)).otherwise(0.0)).cast("float"))
    return texts.select("sha", slots.alias("vector"))


def bundles(spark: SparkSession, root: str, depth: int = 3) -> DataFrame:
    """path, entries, ops_bytes of the stores below a local folder, newest first; folders are few, rows are counted by Spark."""
    found = []
    for base, folders, _ in os.walk(root):
        level = os.path.relpath(base, root).count(os.sep)
        folders[:] = [f for f in folders if not f.startswith(".")] if level < depth else []
        if "ops" in folders:
            files = [os.path.join(base, "ops", f) for f in os.listdir(os.path.join(base, "ops"))]
            found.append((base, sum(map(os.path.getsize, files)), max(map(os.path.getmtime, files), default=0.0)))
            folders[:] = []
    return spark.createDataFrame(sorted(found, key=lambda x: -x[2]), "path string, ops_bytes long, modified double")
