"""Problem 3: the k most similar vectors of every vector by a forest of projection trees.

*Fit.* ``TREES`` binary trees over a sample of at most ``SAMPLE`` vectors; a node
projects on the difference of two random members and splits at the median.
*Index.* Every usable vector lies in one leaf of each tree.
*Search.* All trees share one priority queue per query: the branch with the least
margin over all trees is opened next, until ``PROBES`` leaves are visited.
*Rerank.* Queries and members meet per leaf in one matrix product; exact cosines
decide.  A leaf is cut into blocks of about ``BLOCK`` members, so no task holds
more than that, whatever the size of the collection.

Exact copies are one class with its smallest ids as members; they take part in
the search once, so a class that holds a third of all rows costs nothing there.
Ties go by smaller id.  Vectors of another length, with nulls, NaN or infinities
and all-zero vectors take no part; an id delivered twice counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallframe.session import cut, spread

DIM, K = 128, 5
TREES, PROBES, LEAF, SAMPLE, BLOCK, SEED = 6, 16, 128, 32_768, 2_048, 20


def usable(vector: str = "vector", dim: int = DIM):
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0)


class Forest:
    """Trees of equal depth in heap order: children of node i are 2i + 1 and 2i + 2."""

    def __init__(self, sample: np.ndarray, total: int, trees: int = TREES, leaf: int = LEAF, seed: int = SEED):
        most = max(1, len(sample) // 4)  # a leaf is backed by four sample rows at least
        self.depth = max(0, min(int(np.ceil(np.log2(max(1, total / leaf)))), int(np.log2(most))))
        self.trees, self.leaves = trees, 1 << self.depth
        inner, dim = self.leaves - 1, sample.shape[1] if len(sample) else DIM
        self.normal = np.zeros((trees, inner, dim), dtype=np.float32)
        self.at = np.zeros((trees, inner), dtype=np.float32)
        rng = np.random.default_rng(seed)
        for t in range(trees):
            members = {0: np.arange(len(sample))}
            for node in range(inner):
                own = members.pop(node)
                a, b = sample[rng.choice(own, 2, replace=len(own) < 2)] if len(own) else rng.normal(size=(2, dim))
                w = (a - b).astype(np.float32)
                if not (norm := float(np.linalg.norm(w))):
                    w = rng.normal(size=dim).astype(np.float32)
                    norm = float(np.linalg.norm(w))
                self.normal[t, node] = w / norm
                p = sample[own] @ self.normal[t, node]
                self.at[t, node] = np.median(p) if len(own) else 0.0
                right = p > self.at[t, node]
                members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]

    def search(self, q: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaves (tree * leaves + leaf) of each query, best first, and whether the leaf is its own."""
        n, rows = len(q), np.arange(len(q))
        size = self.trees + probes * (self.depth + 1)
        prio = np.full((n, size), -np.inf, dtype=np.float32)
        where = np.zeros((n, size), dtype=np.int64)
        home = np.zeros((n, size), dtype=bool)
        inner = self.leaves - 1
        for t in range(self.trees):
            prio[:, t], where[:, t], home[:, t] = np.inf, t * (2 * self.leaves), True
        free, out, own = self.trees, np.full((n, probes), -1, dtype=np.int64), np.zeros((n, probes), dtype=bool)
        for step in range(probes):
            best = prio.argmax(axis=1)
            p, node, mine = prio[rows, best], where[rows, best], home[rows, best]
            prio[rows, best] = -np.inf
            tree, node = node // (2 * self.leaves), node % (2 * self.leaves)
            live = p > -np.inf
            if not live.any():
                break
            for _ in range(self.depth):
                move = live & (node < inner)
                if not move.any():
                    break
                i = np.where(move, node, 0)
                margin = np.einsum("ij,ij->i", q, self.normal[tree, i]) - self.at[tree, i]
                near, far = np.where(margin > 0, 2 * i + 2, 2 * i + 1), np.where(margin > 0, 2 * i + 1, 2 * i + 2)
                prio[:, free] = np.where(move, np.minimum(p, -np.abs(margin)), -np.inf)
                where[:, free] = tree * (2 * self.leaves) + far
                free += 1
                node = np.where(move, near, node)
            out[live, step] = (tree * self.leaves + node - inner)[live]
            own[:, step] = mine & live
        return out, own


def _classes(vectors: DataFrame, id_col: str, dim: int) -> DataFrame:
    """id, two hashes that name the class of exact copies, vector; one row per id."""
    good = vectors.where(usable(dim=dim)).select(F.col(id_col).alias("id"), "vector").dropDuplicates(["id"])
    plus_zero = F.transform("vector", lambda x: x + F.lit(0.0).cast("float"))  # -0.0 and 0.0 are the same number
    return good.withColumn("vector", plus_zero).withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.hash("vector"))


def nearest(vectors: DataFrame, id_col: str = "vec_id", k: int = K, dim: int = DIM, probes: int = PROBES, trees: int = TREES) -> DataFrame:
    """``id_a, id_b, cosine``: id_b is among the k most similar to id_a."""
    spark = vectors.sparkSession
    rows = cut(_classes(vectors, id_col, dim))
    by_class = Window.partitionBy("h1", "h2").orderBy("id")
    first = cut(rows.withColumn("rn", F.row_number().over(by_class)).where(F.col("rn") <= k + 1))
    reps = first.where("rn = 1").select("id", "vector")
    total = reps.count()

    take = reps if total <= SAMPLE else reps.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(-(-total // SAMPLE))) == 0)
    sample = take.orderBy("id").limit(2 * SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
    unit = np.array(sample.flatten(), dtype=np.float32).reshape(-1, dim)
    if len(unit):
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    forest = spark.sparkContext.broadcast(Forest(unit, total, trees))
    blocks = max(1, -(-total // (forest.value.leaves * BLOCK)))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = forest.value
        for pdf in batches:
            for lo in range(0, len(pdf), 2000):
                part = pdf.iloc[lo : lo + 2000]
                ids = part["id"].to_numpy()
                v = np.array(part["vector"].tolist(), dtype=np.float32).reshape(-1, dim)
                length = np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
                leaf, own = f.search((v / length).astype(np.float32), probes)
                i, j = np.nonzero(leaf >= 0)
                raw = [x.tobytes() for x in v]
                out = pd.DataFrame({"leaf": leaf[i, j], "id": ids[i], "member": own[i, j], "v": [raw[x] for x in i]})
                if blocks > 1:  # a member lies in one block of its leaf, a query goes to all of them
                    out = out.assign(block=[list(range(blocks))] * len(out)).explode("block")
                    out["member"] &= out["id"] % blocks == out["block"]
                    out["block"] = out["block"].astype("int32")
                else:
                    out["block"] = np.int32(0)
                yield out

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, member = pdf["id"].to_numpy(), pdf["member"].to_numpy()
        v = np.frombuffer(b"".join(pdf["v"]), dtype=np.float32).reshape(-1, dim).astype(np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        base, names = v[member], ids[member]
        out = []
        for lo in range(0, len(ids) if len(names) else 0, 1024):
            s = v[lo : lo + 1024] @ base.T
            s[ids[lo : lo + 1024, None] == names[None, :]] = -9
            m = min(k, len(names))
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            out.append(pd.DataFrame({"a": np.repeat(ids[lo : lo + 1024], m), "b": names[top].ravel(), "cosine": np.take_along_axis(s, top, 1).ravel()}))
        all_ = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "cosine": []}).astype({"a": "int64", "b": "int64"})
        return all_[all_["cosine"] > -5]

    met = (
        spread(reps).mapInPandas(visit, "leaf long, id long, member boolean, v binary, block int")
        .groupBy("leaf", "block").applyInPandas(rank, "a long, b long, cosine double")
        .groupBy("a", "b").agg(F.round(F.max("cosine"), 12).alias("cosine"))
    )
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    exact = met.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")

    # classes of copies: their smallest k + 1 ids
    ids = first.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # k + 1 at most
    ids = cut(ids.withColumn("rep", F.element_at("ids", 1)))
    sizes = rows.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1")
    hot_from = max(1000, rows.count() // 1000)
    hot = ids.join(sizes.where(F.col("c") > hot_from), ["h1", "h2"], "left_semi")  # more than a thousandth of all rows each: under 1,000 classes
    some = ids.join(sizes.where(F.col("c") <= hot_from), ["h1", "h2"], "left_semi")
    member = rows.select("id", "h1", "h2")
    of_hot = member.join(F.broadcast(hot), ["h1", "h2"])
    of_some = member.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti").join(some, ["h1", "h2"])
    inside = (
        of_hot.unionByName(of_some)
        .select(F.col("id").alias("a"), F.explode(F.slice(F.array_except("ids", F.array("id")), 1, k)).alias("b"))
        .select("a", "b", F.lit(1.0).alias("cosine"))
    )
    # neighbours from other classes fill what a class of under k + 1 ids leaves open
    short = ids.where(F.size("ids") <= k)
    outside = (
        short.select(F.col("rep").alias("a"), F.col("ids").alias("mine"))
        .join(exact, "a")
        .join(ids.select(F.col("rep").alias("b"), F.col("ids").alias("theirs")), "b")
        .select("a", "mine", "cosine", F.explode(F.slice("theirs", 1, k)).alias("other"))
        .withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "other")))
        .where(F.col("r") <= F.lit(k + 1) - F.size("mine"))
        .select(F.explode("mine").alias("a"), F.col("other").alias("b"), "cosine")
    )
    return inside.unionByName(outside).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "cosine")


def neighbour_pairs(vectors: DataFrame, id_col: str = "vec_id", **how) -> DataFrame:
    """``id_a, id_b``, smaller first: one of the two is among the k most similar to the other."""
    links = nearest(vectors, id_col, **how)
    return links.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
