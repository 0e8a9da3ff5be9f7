"""Writing to conversations: scopes, extraction, reconciling, summaries, and forgetting with its cascade.

Everything that changes a memory comes out as a table of operations; an operation
names its entry, so a batch of any number of sessions is written in one append.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallframe.functions.text import word_set
from recallframe.functions.vector import jaccard
from recallframe.operators import bags
from recallframe.operators import conversation as cv
from recallframe.session import written

UNSET: Any = object()
RAW_FACTS = "array<struct<category:string,text:string,turn_index:int>>"


def scope(session_id: str, user_id: str | None = UNSET, own_user: str | None = None, kind: str | None = None, superseded: bool = False, where: dict | None = None) -> dict:
    """The filter of a conversation's reads: its session; its own user unless another is named (None: all); live entries; the caller's fields win."""
    user = own_user if user_id is UNSET else user_id
    out: dict = {"session_id": session_id}
    if user is not None:
        out["user_id"] = user
    if kind is not None:
        out["type"] = kind
    if not superseded:
        out["superseded_by"] = {"$eq": None}
    return {**out, **(where or {})}


# ------------------------------------------------------------------ extraction
def rule_extractor(texts: list[str]) -> str:
    """Facts without a model: sentences in which the speaker speaks of themselves."""
    found = []
    for i, text in enumerate(texts):
        for sentence in re.split(r"(?<=[.!?])\s+", text or ""):
            if re.match(r"(?i)(i|my|we|our)\b", sentence):
                kind = "preference" if re.search(r"(?i)\b(like|love|prefer|hate)\b", sentence) else "goal" if re.search(r"(?i)\b(want|plan|will)\b", sentence) else "biographical"
                found.append({"category": kind, "text": sentence, "turn_index": i})
    return json.dumps(found)


def batches(turns: DataFrame, size: int = 8) -> DataFrame:
    """session_id, batch, turn_ids, texts: up to ``size`` successive turns with text; 1 asks for each turn alone."""
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("turn_index"))
    kept = turns.where(F.trim("text") != "").withColumn("n", n).withColumn("batch", F.floor((F.col("n") - 1) / size))
    rows = F.array_sort(F.collect_list(F.struct("turn_index", "turn_id", "text")))  # ``size`` at most
    return kept.groupBy("session_id", "batch").agg(rows.alias("r")).select("session_id", "batch", F.col("r.turn_id").alias("turn_ids"), F.col("r.text").alias("texts"))


def parsed_batch(raw: Column, turn_ids: Column) -> Column:
    """Facts of a batch's JSON list with their turns; an index that names no turn means the last one."""
    items = F.coalesce(F.from_json(raw, RAW_FACTS), F.array().cast(RAW_FACTS))
    good = F.filter(items, lambda x: x["text"].isNotNull() & x["category"].isNotNull() & (F.trim(x["text"]) != ""))
    turn = lambda x: F.when((x["turn_index"] >= 0) & (x["turn_index"] < F.size(turn_ids)), F.get(turn_ids, x["turn_index"])).otherwise(F.element_at(turn_ids, -1))
    return F.transform(good, lambda x: F.struct(cv.category(x["category"]).alias("category"), F.trim(x["text"]).alias("text"), turn(x).alias("source_turn_id")))


def extract(turns: DataFrame, extractor: Callable[[list[str]], str] = rule_extractor, size: int = 8) -> DataFrame:
    """session_id, place, category, text, source_turn_id of the facts that the extractor (texts -> JSON list) names."""

    @F.pandas_udf("string")
    def ask(texts: pd.Series) -> pd.Series:
        return pd.Series([extractor(list(own)) for own in texts])

    raw = batches(turns, size).withColumn("raw", ask("texts"))
    facts = raw.select("session_id", "batch", F.posexplode(parsed_batch(F.col("raw"), F.col("turn_ids"))).alias("p", "f"))
    return facts.select("session_id", (F.col("batch") * 1000 + F.col("p")).alias("place"), "f.category", "f.text", "f.source_turn_id")


# ------------------------------------------------------------------ reconciling
def decided(best: DataFrame, replies: DataFrame, near: float = cv.NEAR, ambiguous: float = cv.AMBIGUOUS) -> DataFrame:
    """fact_id, op, target of ``best(fact_id, best)`` and a model's ``replies(fact_id, op, target, known)``.

    Only facts between the thresholds follow a reply; a missing or unknown op, and an
    UPDATE or SUPERSEDE of no known target, add the fact, so that none is lost.
    """
    asked = (F.col("best") >= ambiguous) & (F.col("best") < near)
    needs = F.col("op").isin("UPDATE", "SUPERSEDE")
    good = F.col("op").isin("ADD", "NOOP") | (needs & F.col("target").isNotNull() & F.coalesce("known", F.lit(False)))
    op = F.when(F.col("best") >= near, "NOOP").when(asked & good, F.col("op")).otherwise("ADD")
    return best.join(replies, "fact_id", "left").withColumn("op", op).select("fact_id", "op", F.when(F.col("op").isin("UPDATE", "SUPERSEDE"), F.col("target")).alias("target"))


def fact_writes(decisions: DataFrame) -> DataFrame:
    """fact_id, place, action, entry, field, value: the operations of each decision in order.

    UPDATE forgets its target before the new fact is stored; SUPERSEDE stores first and then marks the target.
    """
    none = F.lit(None).cast("long")
    row = lambda place, action, entry, field, value: F.struct(F.lit(place).alias("place"), F.lit(action).alias("action"), entry.cast("long").alias("entry"), F.lit(field).alias("field"), value.cast("long").alias("value"))
    new, old = F.col("fact_id"), F.col("target")
    plain = row(1, "store", new, "", none)
    linked = row(1, "store", new, "supersedes", old)
    ops = F.when(F.col("op") == "ADD", F.array(plain)).when(F.col("op") == "UPDATE", F.array(row(0, "forget", old, "", none), linked)).when(F.col("op") == "SUPERSEDE", F.array(linked, row(2, "update", old, "superseded_by", new)))
    return decisions.select("fact_id", F.explode(ops).alias("o")).select("fact_id", "o.*")


def owned(decisions: DataFrame, facts: DataFrame) -> DataFrame:
    """Decisions whose target belongs to the fact's own user; another's raises."""
    owner = facts.select("fact_id", F.col("user_id").alias("mine"))
    theirs = facts.select(F.col("fact_id").alias("target"), F.col("user_id").alias("theirs"))
    both = decisions.join(owner, "fact_id", "left").join(theirs, "target", "left")
    foreign = F.col("target").isNotNull() & F.col("mine").isNotNull() & F.col("theirs").isNotNull() & (F.col("mine") != F.col("theirs"))
    checked = F.when(foreign, F.raise_error(F.lit("the target belongs to another user"))).otherwise(F.col("op"))
    return both.select("fact_id", checked.cast("string").alias("op"), "target")


# ------------------------------------------------------------------ summaries
def joined_turns(role: str = "user") -> Column:
    """Summariser without a model, for a group of turns: its lines in order."""
    rows = F.array_sort(F.collect_list(F.struct("turn_index", "text")))
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit(f"{role}: "), F.coalesce(r["text"], F.lit("")))), "\n")


def summaries(turns: DataFrame, every: int = 20, again: int = 5, summarise: Column | None = None) -> DataFrame:
    """session_id, the range of turns and the summary's text at each full block."""
    blocks = cv.summary_blocks(turns, every, again)
    inside = blocks.join(turns.select("session_id", "turn_index", "text"), "session_id").where("turn_index between summarized_turn_start and summarized_turn_end")
    return inside.groupBy("session_id", "summarized_turn_start", "summarized_turn_end", "resummary").agg((joined_turns() if summarise is None else summarise).alias("text"))  # a block's turns


def add_messages(turns: DataFrame, extractor: Callable[[list[str]], str] = rule_extractor, size: int = 1, every: int = 20, again: int = 5) -> DataFrame:
    """session_id, kind, text, source_turn_id: what new turns write - themselves, their facts, the summaries that fall due. Blank turns write nothing."""
    said = turns.where(F.trim("text") != "")
    none = F.lit(None).cast("string")
    own = said.select("session_id", F.lit("turn").alias("kind"), "text", F.col("turn_id").alias("source_turn_id"))
    facts = extract(said, extractor, size).select("session_id", F.lit("fact").alias("kind"), "text", "source_turn_id")
    return own.unionByName(facts).unionByName(summaries(said, every, again).select("session_id", F.lit("summary").alias("kind"), "text", none.alias("source_turn_id")))


# ------------------------------------------------------------------ forgetting
class Forgotten(NamedTuple):
    ops: DataFrame  # place, kind, action, entry, text
    totals: DataFrame  # one row


def forget(turns: DataFrame, facts: DataFrame, summaries_: DataFrame, needle: str | None = None, user_id: str | None = None, subject: str | None = None, strategy: str = "regenerate", summarise: Column | None = None) -> Forgotten:
    """Operations that forget what the criteria name, in the order facts, turns, summaries, and their totals.

    Facts fall with their turn where a text is named, else by user and subject (both, if
    both are named).  A summary over a forgotten turn is deleted if its range is bad, no
    turn of it is left or ``strategy`` is 'drop'; else it is deleted and stored anew from
    the turns that are left, pointing back to the old one.  Stored anew is not deleted.
    An empty new text deletes only.  Facts: (fact_id, source_turn_id, user_id, subject).
    """
    if needle is None and user_id is None and subject is None:
        raise ValueError("nothing is named to forget")
    gone = cv.forget_turns(turns, needle, user_id)
    own = facts
    if user_id is not None:
        own = own.where(F.col("user_id") == user_id)
    if subject is not None:
        own = own.where(F.col("subject") == subject)
    dead_facts = cv.forget_facts(own, gone) if needle is not None else own
    fates = cv.forget_summaries(summaries_, turns, gone)
    name = F.concat_ws("/", "session_id", F.col("summarized_turn_start").cast("string"), F.col("summarized_turn_end").cast("string"))
    bad = summaries_.where("summarized_turn_start is null or summarized_turn_end is null or summarized_turn_start > summarized_turn_end").join(gone.select("session_id").distinct(), "session_id", "left_semi")
    bad = bad.select("session_id", "summarized_turn_start", "summarized_turn_end", F.lit("delete").alias("fate"))
    fates = fates.select("session_id", "summarized_turn_start", "summarized_turn_end", F.lit("delete").alias("fate") if strategy == "drop" else F.col("fate")).unionByName(bad)
    left = turns.join(gone.select("turn_id"), "turn_id", "left_anti").select("session_id", "turn_index", "text")
    anew = fates.where("fate = 'regenerate'").join(left, "session_id").where("turn_index between summarized_turn_start and summarized_turn_end").groupBy("session_id", "summarized_turn_start", "summarized_turn_end").agg((joined_turns() if summarise is None else summarise).alias("text"))
    none = F.lit(None).cast("string")
    row = lambda df, place, kind, action, entry, text=none: df.select(F.lit(place).alias("place"), F.lit(kind).alias("kind"), F.lit(action).alias("action"), entry.cast("string").alias("entry"), text.alias("text"))
    full = anew.where(F.trim("text") != "")
    empty = anew.where(F.trim("text") == "")
    parts = [
        row(dead_facts, 0, "fact", "delete", F.col("fact_id")), row(gone, 1, "turn", "delete", F.col("turn_id")),
        row(fates.where("fate = 'delete'"), 2, "summary", "delete", name), row(empty, 2, "summary", "delete", name), row(full, 2, "summary", "regenerate", name, F.col("text")),
    ]
    ops = parts[0]
    for part in parts[1:]:
        ops = ops.unionByName(part)
    count = lambda kind, action: F.count(F.when((F.col("kind") == kind) & (F.col("action") == action), 1))
    totals = ops.agg(count("turn", "delete").alias("deleted_turns"), count("fact", "delete").alias("deleted_facts"), count("summary", "delete").alias("deleted_summaries"), count("summary", "regenerate").alias("regenerated_summaries"), F.count(F.when(F.col("action") == "delete", 1)).alias("total_deleted"))
    return Forgotten(ops, totals)


def audit(totals: DataFrame, actor: str, target: str | None = None) -> DataFrame:
    """An audit's row: counts only, and the one forgotten only where that is another than the actor."""
    return totals.select(F.lit("forget").alias("event"), F.lit(actor).alias("actor"), F.lit(target if target != actor else None).cast("string").alias("target"), "*")


def cleared(entries: DataFrame, session_id: str, user_id: str | None = None, with_summaries: bool = False) -> DataFrame:
    """Operations that clear a session: all entries but summaries, which go only if asked; of one user if named."""
    own = entries.where(F.col("session_id") == session_id)
    if user_id is not None:
        own = own.where(F.col("user_id") == user_id)
    if not with_summaries:
        own = own.where(F.col("kind") != "summary")
    return own.select(F.lit("forget").alias("op"), "node_id", "kind")


def likest(queries: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """qid, id, score, rank of the k entries with the largest share of common words; without any common word the score is 0 and smaller ids come first.

    Scored are only pairs with a common word, none of which is a row; entries without one fill up what is left.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    q = queries.select("qid", word_set(F.col("text")).alias("ts"))
    asked, words = bags.asked(q)
    blocks = bags.inverted(entries.select("id", word_set(F.col("text")).alias("ts")), words)
    top = written(bags.best(asked, blocks, k, lambda word, n, sizes: 1.0, lambda both, n, sizes: both / (n + sizes - both)))
    short = q.select("qid").join(top.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < k)
    first = entries.select("id").orderBy("id").limit(2 * k)  # at most k of them can be scored already
    fill = short.crossJoin(F.broadcast(first)).join(top.select("qid", "id"), ["qid", "id"], "left_anti")  # 2 k rows
    at = F.row_number().over(Window.partitionBy("qid").orderBy("id")) + F.col("n")
    return top.select("qid", "id", "score", "rank").unionByName(fill.withColumn("rank", at).where(F.col("rank") <= k).select("qid", "id", F.lit(0.0).alias("score"), "rank"))


def overlap(a: Column, b: Column) -> Column:
    return jaccard(word_set(a), word_set(b))
