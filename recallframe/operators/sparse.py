"""Sparse codes: sets of active dimensions."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallframe.functions.vector import jaccard
from recallframe.session import spread


def winners(values: Column, k: int) -> Column:
    """Indices (from 0) of the k largest values, ascending; ties go to the lower index."""
    pairs = F.transform(values, lambda v, i: F.struct((-v.cast("double")).alias("v"), i.alias("i")))
    return F.array_sort(F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["i"]))


def project_winners(vectors: DataFrame, k: int, dim: int, seed: int = 0, projection: np.ndarray | None = None) -> DataFrame:
    """id, code: winners of a (given or seeded normal) projection."""
    width = projection.shape[1] if projection is not None else None

    def run(batches):
        for pdf in batches:
            codes = []
            if len(pdf):
                v = np.array(pdf["vector"].tolist(), dtype=float)
                w = projection if projection is not None else np.random.default_rng(seed).normal(size=(dim, v.shape[1]))
                codes = [np.sort(np.argsort(-x, kind="stable")[:k]).astype("int32") for x in v @ w.T]
            yield pdf[["id"]].assign(code=codes)

    assert width is None or width > 0
    return spread(vectors.select("id", "vector")).mapInPandas(run, "id long, code array<int>")


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two codes; two empty codes are alike."""
    return jaccard(a, b, both_empty=1.0)


def _give_up(strength: float):
    def give_up(own: Column, other: Column) -> Column:
        shared = F.array_sort(F.array_intersect(own, other))
        n = F.floor(F.lit(strength) * F.size(shared)).cast("int")
        return F.when(n > 0, F.array_except(own, F.slice(shared, 1, n))).otherwise(own)

    return give_up


def separate(codes: Column, strength: float = 0.3) -> Column:
    """Each code in order gives up the first part of what it shares with each later one.

    Only codes already passed change, so the fold of one code over the later ones is exact.
    """

    def one(code: Column, i: Column) -> Column:
        later = F.slice(codes, i + 2, F.greatest(F.size(codes) - i - 1, F.lit(0)))
        return F.aggregate(later, code, _give_up(strength))

    return F.transform(codes, one)


def separate_rows(codes: DataFrame, strength: float = 0.3) -> DataFrame:
    """``separate`` over whole groups of ``g, place, code`` (ascending codes), without gathering a group.

    A code gives up nothing to one with which it shares fewer than ``least`` dimensions,
    so it folds over the later codes of its group that have an equal part of that size.
    """
    if strength <= 0:
        return codes
    least = next(n for n in range(1, 1 << 16) if int(strength * n) > 0)

    def parts(batches):
        for pdf in batches:
            keys = [[",".join(map(str, c)) for c in combinations(sorted(code), least)] for code in pdf["code"]]
            yield pdf.assign(part=keys).explode("part").dropna(subset=["part"])

    keyed = codes.mapInPandas(parts, "g long, place long, code array<int>, part string").where("part is not null")
    later = keyed.select("g", "part", F.col("place").alias("at"), F.col("code").alias("other"))
    pairs = keyed.select("g", "part", "place").join(later, ["g", "part"]).where("at > place").select("g", "place", "at", "other").distinct()
    met = pairs.groupBy("g", "place").agg(F.array_sort(F.collect_list(F.struct("at", "other"))).alias("later"))
    others = F.coalesce(F.transform("later", lambda x: x["other"]), F.array().cast("array<array<int>>"))
    return codes.join(met, ["g", "place"], "left").select("g", "place", F.aggregate(others, F.col("code"), _give_up(strength)).alias("code"))


def topology(queries: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """qid, id, score, rank: share of the query's active dimensions (qid, code) that an entry (id, code) shares, over a dimension index."""
    asked = queries.select("qid", F.size("code").alias("n"), F.explode("code").alias("dim"))
    index = stored.select("id", F.explode("code").alias("dim"))
    scored = asked.join(index, "dim").groupBy("qid", "id").agg(F.round(F.count("*") / F.first("n"), 6).alias("score"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def separation(asked: DataFrame, stored: DataFrame, block: int = 4096) -> DataFrame:
    """within, between, ratio: mean similarity of codes (id, label, code) of equal and of different labels, asked against stored.

    Blocks meet blocks as binary matrices; a task gives back four sums.
    """
    nq, ns = (max(1, -(-df.count() // block)) for df in (asked, stored))
    deal = lambda df, own, n, other, m: df.select(F.col("id").alias("i"), F.col("label").alias("l"), F.col("code").alias("c"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(own)).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    q, c = deal(asked, "bq", nq, "bc", ns), deal(stored, "bc", ns, "bq", nq)

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"ws": [], "wn": [], "bs": [], "bn": []})
        codes = [[np.asarray(x, dtype=np.int64) for x in side["c"]] for side in (left, right)]
        width = 1 + max((int(x.max()) for own in codes for x in own if len(x)), default=0)
        binary = lambda own: np.array([np.bincount(x, minlength=width) for x in own], dtype=np.float32)
        a, b = map(binary, codes)
        both = a @ b.T
        union = a.sum(1)[:, None] + b.sum(1)[None] - both
        sim = np.where(union > 0, both / np.maximum(union, 1), 1.0)
        other = left["i"].to_numpy()[:, None] != right["i"].to_numpy()[None]
        same = (left["l"].to_numpy()[:, None] == right["l"].to_numpy()[None]) & other
        apart = ~same & other
        return pd.DataFrame({"ws": [float(sim[same].sum())], "wn": [int(same.sum())], "bs": [float(sim[apart].sum())], "bn": [int(apart.sum())]})

    met = q.groupBy("bq", "bc").cogroup(c.groupBy("bq", "bc")).applyInPandas(sums, "ws double, wn long, bs double, bn long")
    mean = lambda s, n: F.sum(s) / F.sum(n)
    out = met.agg(mean("ws", "wn").alias("within"), mean("bs", "bn").alias("between"))
    return out.withColumn("ratio", F.when(F.col("between") > 0, F.col("within") / F.col("between")))
