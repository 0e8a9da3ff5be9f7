"""Assembling a prompt's context under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Shares of the budget.
MIX = {"recency": 0.15, "relevant": 0.50, "task_state": 0.10, "decisions": 0.10, "preferences": 0.15}


def budgets(mix: dict[str, float] | None = None, max_tokens: int = 3800, chars_per_token: float = 4.0) -> dict[str, int]:
    """Characters of each slot; weights are brought to the sum 1, none at all if they sum to 0."""
    mix = MIX if mix is None else mix
    total = sum(mix.values())
    return {k: int(v / total * int(max_tokens * chars_per_token)) for k, v in mix.items()} if total > 0 else {}


def within_budget(lines: DataFrame, budget, group: list[str], order: str = "rank", line: str = "line") -> DataFrame:
    """Whole lines in order while they fit, a line break between two; nothing after the first that does not.

    Costs are positive, so the running sum passes the budget once and for all.
    """
    own = Window.partitionBy(*group).orderBy(order)
    cost = F.length(line) + F.when(F.row_number().over(own) > 1, 1).otherwise(0)
    upto = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("cost", cost).withColumn("used", F.sum("cost").over(upto)).where(F.col("used") <= budget).drop("cost")


def first_slot_wins(lines: DataFrame, group: list[str], node: str = "node_id", slot: str = "slot_no") -> DataFrame:
    """An entry that several slots name stays in the first."""
    own = Window.partitionBy(*group, node).orderBy(slot, "rank")
    return lines.withColumn("_r", F.row_number().over(own)).where("_r = 1").drop("_r")


def evidence(blocks: DataFrame, budget: int, group: str = "qid", slack: int = 80, least: int = 200) -> DataFrame:
    """Whole blocks while they fit; the next is cut if more than ``least`` characters are left."""
    upto = Window.partitionBy(group).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("text") + slack
    before = F.coalesce(F.sum(size).over(upto), F.lit(0))
    left = F.lit(budget) - F.col("before")
    marked = blocks.withColumn("before", before).withColumn("size", size)
    kept = F.when(F.col("size") <= left, F.col("text")).when(left > least, F.substring("text", F.lit(1), (left - slack).cast("int")))
    return marked.withColumn("kept", kept).where(F.col("kept").isNotNull()).drop("before", "size")


def citation(number, path, heading, source, node_id, text):
    """``[n] path; heading: h; source`` and the text on the next line; the id's start if nothing is known."""
    known = F.concat_ws("; ", path, F.when(heading != "", F.concat(F.lit("heading: "), heading)), source)
    label = F.when(known != "", known).otherwise(F.concat(F.lit("id="), F.substring(node_id, 1, 8)))
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), label, F.lit("\n    "), text)


def cite_line(number, path, heading, source, node_id, score):
    """``[n] source (heading)  score=0.123`` for display; the id's start if no source is known."""
    src = F.coalesce(F.when(path != "", path), F.when(source != "", source), F.substring(node_id, 1, 8))
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), src, F.when(heading != "", F.concat(F.lit(" ("), heading, F.lit(")"))).otherwise(F.lit("")), F.lit("  score="), F.format_string("%.3f", score.cast("double")))


def bench_context(hits: DataFrame, group: str = "qid", most: int = 10) -> DataFrame:
    """group, context: ``[n] text`` lines of the ``most`` best hits."""
    lines = F.array_sort(F.collect_list(F.struct("rank", "text")))
    each = F.transform(lines, lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["text"]))
    return hits.where(F.col("text").isNotNull() & (F.col("rank") <= most)).groupBy(group).agg(F.array_join(each, "\n").alias("context"))


def pack(slots: DataFrame, group: str = "qid", mix: dict[str, float] | None = None, max_tokens: int = 3800, chars_per_token: float = 4.0, shared: tuple[str, ...] = ("recency", "relevant")) -> DataFrame:
    """group, context of (group, slot, rank, node_id, line): each slot's lines within its share of the budget, slots in the mix's order.

    An entry stays in the first of the ``shared`` slots that names it; typed slots keep theirs.
    """
    room = budgets(mix, max_tokens, chars_per_token)
    order = list(room)
    known = slots.where(F.col("slot").isin(order)).withColumn("slot_no", F.array_position(F.array(*map(F.lit, order)), F.col("slot")))
    one = first_slot_wins(known.where(F.col("slot").isin(*shared)), [group]).unionByName(known.where(~F.col("slot").isin(*shared)))
    budget = F.element_at(F.create_map(*(x for k, v in room.items() for x in (F.lit(k), F.lit(v)))), F.col("slot"))
    kept = within_budget(one, budget, [group, "slot"])
    rows = F.array_sort(F.collect_list(F.struct("slot_no", "rank", "line")))  # bounded by the budget
    return kept.groupBy(group).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("context"), F.count("*").alias("lines"))


def ask(hits: DataFrame, questions: DataFrame, answer, template: str = "Context:\n{context}\n\nQuestion: {question}\nAnswer:", no_context: str = "Question: {question}\nAnswer:", most: int = 5) -> DataFrame:
    """qid, prompt, answer: the prompt of the best hits, or without context where there are none, through ``answer`` (prompt column -> column)."""
    ctx = bench_context(hits, most=most)
    q = F.col("question")
    fill = lambda t, c: F.replace(F.replace(F.lit(t), F.lit("{context}"), c), F.lit("{question}"), q)
    prompt = F.when(F.col("context").isNull(), fill(no_context, F.lit(""))).otherwise(fill(template, F.col("context")))
    return questions.join(ctx, "qid", "left").withColumn("prompt", prompt).select("qid", "prompt", answer(F.col("prompt")).alias("answer"))
