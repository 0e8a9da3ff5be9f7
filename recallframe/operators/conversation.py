"""Facts, summaries and forgetting in conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallframe.session import cut

#: Categories of a fact, and scores from which it is a repeat or in doubt.
CATEGORIES = ("preference", "goal", "biographical", "relationship", "event", "other")
NEAR, AMBIGUOUS = 0.92, 0.75


def category(raw: Column) -> Column:
    """A category of the vocabulary; anything else is 'other'."""
    low = F.lower(F.trim(raw))
    return F.when(low.isin(*CATEGORIES), low).otherwise("other")


def parsed_facts(raw: Column) -> Column:
    """Facts of an extractor's JSON list; blank texts drop out, other input gives none."""
    items = F.coalesce(F.from_json(raw, "array<struct<category:string,text:string>>"), F.array().cast("array<struct<category:string,text:string>>"))
    return F.transform(F.filter(items, lambda x: x["text"].isNotNull() & x["category"].isNotNull() & (F.trim(x["text"]) != "")), lambda x: F.struct(category(x["category"]).alias("category"), F.trim(x["text"]).alias("text")))


def decision(best: Column) -> Column:
    """What to do with a new fact, by the score of its best live candidate (null: there is none)."""
    return F.when(best.isNull() | (best < AMBIGUOUS), "add").when(best >= NEAR, "near_dup").otherwise("ambiguous")


def reconcile(candidates: DataFrame, facts: DataFrame, k: int = 5) -> DataFrame:
    """fact_id, best, decision.  Candidates: (fact_id, other_id, score, superseded); superseded ones drop out after the top k."""
    order = Window.partitionBy("fact_id").orderBy(F.desc("score"), "other_id")
    top = candidates.withColumn("r", F.row_number().over(order)).where((F.col("r") <= k) & ~F.col("superseded"))
    best = top.groupBy("fact_id").agg(F.max("score").alias("best"))
    return facts.select("fact_id").join(best, "fact_id", "left").withColumn("decision", decision(F.col("best")))


def summary_blocks(turns: DataFrame, every: int = 20, again: int = 5) -> DataFrame:
    """session_id, summarized_turn_start, summarized_turn_end, resummary at each full block of turns."""
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("turn_index"))
    ends = turns.withColumn("n", n).where(F.col("n") % every == 0)
    re = (F.col("n") / every) % again == 0
    start = F.when(re, F.col("n") - every * again + 1).otherwise(F.col("n") - every + 1)
    return ends.select("session_id", start.cast("long").alias("summarized_turn_start"), F.col("n").cast("long").alias("summarized_turn_end"), re.alias("resummary"))


def matching(text: Column, needle: str, case_sensitive: bool = False) -> Column:
    if case_sensitive:
        return F.coalesce(F.contains(text, F.lit(needle)), F.lit(False))
    return F.coalesce(F.contains(F.lower(text), F.lit(needle.lower())), F.lit(False))


def forget_turns(turns: DataFrame, needle: str | None = None, user_id: str | None = None) -> DataFrame:
    """Turns that the criteria name; without any criterion on turns there are none."""
    if needle is None and user_id is None:
        return turns.limit(0)
    keep = F.lit(True)
    if needle is not None:
        keep = keep & matching(F.col("text"), needle)
    if user_id is not None:
        keep = keep & (F.col("user_id") == user_id)
    return turns.where(F.coalesce(keep, F.lit(False)))


def forget_facts(facts: DataFrame, gone: DataFrame) -> DataFrame:
    """Facts drawn from deleted turns."""
    return facts.join(gone.select(F.col("turn_id").alias("source_turn_id")).distinct(), "source_turn_id", "left_semi")


def forget_summaries(summaries: DataFrame, turns: DataFrame, gone: DataFrame) -> DataFrame:
    """Summaries that cover a deleted turn, with the turns left and what becomes of them.

    The overlap is an equal join on the session with a range condition; blocks of
    turns keep the join's groups small.
    """
    bad = F.col("summarized_turn_start") > F.col("summarized_turn_end")
    inside = "turn_index >= summarized_turn_start and turn_index <= summarized_turn_end"
    dead = gone.select("session_id", "turn_index", F.lit(1).alias("dead"))
    covered = turns.select("session_id", "turn_index").join(dead, ["session_id", "turn_index"], "left")
    ranged = summaries.where(~bad).join(covered, "session_id").where(inside)
    counts = ranged.groupBy("session_id", "summarized_turn_start", "summarized_turn_end").agg(F.count("dead").alias("deleted"), (F.count("*") - F.count("dead")).alias("left"))
    return counts.where("deleted > 0").withColumn("fate", F.when(F.col("left") == 0, "delete").otherwise("regenerate"))


def supersession(facts: DataFrame, most: int = 64) -> DataFrame:
    """fact_id, newest: the end of each chain of replacements, by pointer doubling until nothing moves.

    Chains of up to 2^``most`` links end; what still moves then is a circle, and raises.
    """
    step = cut(facts.select("fact_id", F.coalesce("superseded_by", "fact_id").alias("newest")))
    for _ in range(most):
        nxt = step.select(F.col("fact_id").alias("newest"), F.col("newest").alias("further"))
        new = cut(step.join(nxt, "newest", "left").select("fact_id", F.coalesce("further", "newest").alias("newest"), (F.coalesce("further", "newest") != F.col("newest")).alias("moved")))
        step = new.select("fact_id", "newest")
        if new.where("moved").isEmpty():
            return step
        if not new.where("moved and fact_id = newest").isEmpty():
            break
    raise ValueError("replacements go in a circle")
