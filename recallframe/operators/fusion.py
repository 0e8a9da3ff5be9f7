"""Blends of rankings, reranking and expansion."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallframe.functions.text import bullets, word_set
from recallframe.functions.vector import cosine, jaccard


def pool_size(k: int, n: int | None = None) -> int:
    """How many of each side enter a blend."""
    size = max(3 * k, 20)
    return size if n is None else min(size, n)


def _by_best(score: str) -> Column:
    best = F.max(score).over(Window.partitionBy("qid"))
    return F.when(best > 0, F.col(score) / best).otherwise(F.lit(0.0))


def hybrid(vector: DataFrame, lexical: DataFrame, alpha: float, k: int) -> DataFrame:
    """qid, id, score, rank of two pools (qid, id, score), each divided by its best score."""
    a = vector.select("qid", "id", F.col("score").alias("s")).withColumn("a", _by_best("s")).drop("s")
    b = lexical.select("qid", "id", F.col("score").alias("s")).withColumn("b", _by_best("s")).drop("s")
    mixed = a.join(b, ["qid", "id"], "full").select("qid", "id", F.round(alpha * F.coalesce("a", F.lit(0.0)) + (1 - alpha) * F.coalesce("b", F.lit(0.0)), 6).alias("score"))
    return ranked(mixed, k)


def ranked(scored: DataFrame, k: int, score: str = "score", ties: str = "id") -> DataFrame:
    best = Window.partitionBy("qid").orderBy(F.desc(score), ties)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def reciprocal_ranks(lists: DataFrame, k: int, base: int = 60) -> DataFrame:
    """Merge of (qid, list, id, rank from 1); ties by first appearance, then id."""
    first = F.min(F.struct("list", "rank"))
    merged = lists.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (base + F.col("rank"))), 6).alias("score"), first.alias("first"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "first", "id")
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("first")


def rerank(hits: DataFrame, k: int, query: str = "query", text: str = "text") -> DataFrame:
    """Rerank by shared words; the former score is kept as ``before``."""
    score = F.round(jaccard(word_set(F.col(query)), word_set(F.col(text))), 6)
    return ranked(hits.withColumnRenamed("score", "before").drop("rank").withColumn("score", score), k)


def three_signals(scored: DataFrame, weights: tuple[float, float, float], k: int) -> DataFrame:
    """Blend of min-max normalised columns s1, s2, s3 of (qid, id)."""
    w = Window.partitionBy("qid")

    def scaled(c: str) -> Column:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi - lo < 1e-12, F.lit(0.0)).otherwise((F.col(c) - lo) / (hi - lo))

    parts = scored.select("qid", "id", *(scaled(c).alias(c) for c in ("s1", "s2", "s3")))
    return ranked(parts.select("qid", "id", F.round(weights[0] * F.col("s1") + weights[1] * F.col("s2") + weights[2] * F.col("s3"), 6).alias("score")), k)


def expand(seeds: DataFrame, neighbours: DataFrame, k: int, seeds_per_query: int = 5, fan: int = 3, decay: float = 0.5) -> DataFrame:
    """Best seeds and their nearest neighbours at a discount; the best score of each id stays."""
    start = seeds.where(F.col("rank") <= seeds_per_query).select("qid", "id", "score")
    hop = start.join(neighbours.where(F.col("rank") <= fan).select(F.col("qid").alias("id"), F.col("id").alias("next")), "id").select("qid", F.col("next").alias("id"), (F.col("score") * decay).alias("score"))
    return ranked(start.unionByName(hop).groupBy("qid", "id").agg(F.round(F.max("score"), 6).alias("score")), k)


def with_prior(hits: DataFrame, prior: DataFrame, k: int) -> DataFrame:
    """score * (1 + log(1 + prior)); a missing or negative prior is 0."""
    p = F.greatest(F.coalesce(F.col("prior"), F.lit(0.0)), F.lit(0.0))
    return ranked(hits.drop("rank").join(prior, "id", "left").select("qid", "id", F.round(F.col("score") * (1 + F.log1p(p)), 6).alias("score")), k)


def gated(embedding: DataFrame, fingerprint: DataFrame, weight: float, gate: float, k: int, adaptive: bool = False) -> DataFrame:
    """Blend only where the fingerprint's lead over its second is at least ``gate``; the score returned is the embedding's.

    ``adaptive``: the weight shrinks with the fingerprint's best score, held between 0 and 1.
    """
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    lead = fingerprint.withColumn("r", F.row_number().over(order)).where("r <= 2").groupBy("qid").agg(
        (F.max(F.when(F.col("r") == 1, F.col("score"))) - F.coalesce(F.max(F.when(F.col("r") == 2, F.col("score"))), F.lit(0.0))).alias("lead"), F.max("score").alias("first")
    )
    w = weight * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("first"))) if adaptive else F.lit(weight)
    both = embedding.select("qid", "id", "score").join(fingerprint.select("qid", "id", F.col("score").alias("fp")), ["qid", "id"], "left").join(lead, "qid", "left")
    mixed = F.when(F.col("lead") >= gate, (1 - w) * F.col("score") + w * F.coalesce("fp", F.lit(0.0))).otherwise(F.col("score"))
    best = Window.partitionBy("qid").orderBy(F.desc(F.round(mixed, 6)), "id")
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def activation_blend(hits: DataFrame, asked: DataFrame, stored: DataFrame, alpha: float, k: int) -> DataFrame:
    """(1 - alpha) * score + alpha * cosine of the activations of ``asked(qid, act)`` and ``stored(id, act)``; the score alone where one is missing."""
    both = hits.select("qid", "id", "score").join(asked.select("qid", F.col("act").alias("_q")), "qid", "left").join(stored.select("id", F.col("act").alias("_d")), "id", "left")
    mixed = F.when(F.col("_q").isNull() | F.col("_d").isNull(), F.col("score")).otherwise((1 - alpha) * F.col("score") + alpha * cosine(F.col("_q"), F.col("_d")))
    return ranked(both.select("qid", "id", F.round(mixed, 6).alias("score")), k)


def scored_rerank(hits: DataFrame, k: int, scorer: Callable[[list[str], list[str]], list[float]], batch: int = 32, query: str = "query", text: str = "text") -> DataFrame:
    """Rerank by a model over pairs of texts, ``batch`` at a time on the workers; the former score is kept as ``before``."""

    @F.pandas_udf("double")
    def score(qs: pd.Series, ts: pd.Series) -> pd.Series:
        out: list[float] = []
        for lo in range(0, len(qs), batch):
            out += list(scorer(qs.iloc[lo : lo + batch].fillna("").tolist(), ts.iloc[lo : lo + batch].fillna("").tolist()))
        return pd.Series(out, dtype=float)

    return ranked(hits.withColumnRenamed("score", "before").drop("rank").withColumn("score", F.round(score(query, text), 6)), k)


def variants(questions: DataFrame, n: int = 3, original: bool = True, raw: str = "raw", question: str = "question") -> DataFrame:
    """qid, list, text: the question itself (list 0) and the first ``n`` items of a model's bulleted reply; the question alone where there are none."""
    items = F.slice(F.coalesce(bullets(F.col(raw)), F.array().cast("array<string>")), 1, n) if n > 0 else F.array().cast("array<string>")
    own = F.array(F.col(question))
    every = F.concat(own, items) if original else F.when(F.size(items) > 0, items).otherwise(own)
    return questions.select("qid", F.posexplode(every).alias("list", "text"))


def alpha_grid(vector: DataFrame, lexical: DataFrame, alphas: list[float], gold: DataFrame, k: int = 5) -> DataFrame:
    """alpha, n, hit, rank1, mean_rank of blends of two pools (qid, id, score) at each alpha, against ``gold(qid, id)``."""
    a = vector.select("qid", "id", F.col("score").alias("s")).withColumn("a", _by_best("s")).drop("s")
    b = lexical.select("qid", "id", F.col("score").alias("s")).withColumn("b", _by_best("s")).drop("s")
    both = a.join(b, ["qid", "id"], "full").fillna(0.0, ["a", "b"]).withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    mixed = both.select("alpha", "qid", "id", F.round(F.col("alpha") * F.col("a") + (1 - F.col("alpha")) * F.col("b"), 6).alias("score"))
    best = Window.partitionBy("alpha", "qid").orderBy(F.desc("score"), "id")
    top = mixed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    found = top.join(gold.select("qid", "id"), ["qid", "id"], "left_semi").groupBy("alpha", "qid").agg(F.min("rank").alias("rank"))
    asked = gold.select("qid").distinct().withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    own = asked.join(found, ["alpha", "qid"], "left")
    share = lambda t: F.round(F.avg(F.when(t, 1.0).otherwise(0.0)), 6)
    return own.groupBy("alpha").agg(F.count("*").alias("n"), share(F.col("rank").isNotNull()).alias("hit"), share(F.col("rank") == 1).alias("rank1"), F.round(F.avg("rank"), 6).alias("mean_rank"))
