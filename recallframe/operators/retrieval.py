"""Vector retrieval: exact top-k in blocks, neighbours, subsets, and approximate indexes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallframe.session import cut, spread

BLOCK = 4096
#: Share of the true neighbours that approximate searches set their probes for.
WANTED = 0.95


def _matrix(arrays: pd.Series) -> np.ndarray:
    return np.array(arrays.tolist(), dtype=np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)


def _kernel(k: int, same: bool, measure: str, digits: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Scores one block (qid, v) against another (id, v) by a matrix product and keeps k per query, ties by smaller id."""

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qid": [], "id": [], "score": []}).astype({"qid": "int64", "id": "int64", "score": "float64"})
        right = right.sort_values("id")
        b, ids, found = _matrix(right["v"]), right["id"].to_numpy(), []
        b = _unit(b) if measure == "cosine" else b
        for lo in range(0, len(left), 512):  # a strip of scores at a time
            part = left.iloc[lo : lo + 512]
            a, qids = _matrix(part["v"]), part["qid"].to_numpy()
            s = _unit(a) @ b.T if measure == "cosine" else -np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))
            s = np.round(s, digits)
            if same:
                s[qids[:, None] == ids[None]] = -np.inf
            if s.shape[1] > 4 * k:  # the k-th best, and all that ties with it, before anything is sorted
                least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                row, col = np.nonzero(s >= least[:, None])
            else:
                row, col = np.divmod(np.arange(s.size), s.shape[1])
            value = s[row, col]
            order = np.lexsort((col, -value, row))
            row, col, value = row[order], col[order], value[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            keep = (place < k) & np.isfinite(value)
            found.append(pd.DataFrame({"qid": qids[row[keep]], "id": ids[col[keep]], "score": value[keep]}))
        return pd.concat(found)

    return score


def top_k(queries: DataFrame, corpus: DataFrame, k: int, same: bool = False, measure: str = "cosine", digits: int = 6) -> DataFrame:
    """qid, id, score, rank: the k best of ``corpus(id, vector)`` for each of ``queries(qid, vector)``.

    Both sides are dealt into blocks; a task scores one block against one block by
    a matrix product and keeps k per query, so neither side is ever broadcast or
    collected.  ``same``: a row is not its own neighbour.  Scores are rounded
    before ranking, ties go by smaller id.
    """
    if k <= 0:
        return corpus.limit(0).select(F.lit(0).cast("long").alias("qid"), F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    nq, nc = (max(1, -(-df.count() // BLOCK)) for df in (queries, corpus))
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("qid", F.col("vector").alias("v"), F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int").alias("bq")).withColumn("bc", blocks(nc))
    c = corpus.select("id", F.col("vector").alias("v"), F.pmod(F.xxhash64("id"), F.lit(nc)).cast("int").alias("bc")).withColumn("bq", blocks(nq))

    score = _kernel(k, same, measure, digits)
    met = q.groupBy("bq", "bc").cogroup(c.groupBy("bq", "bc")).applyInPandas(score, "qid long, id long, score double")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def related(ids: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Neighbours of stored rows; ids that are not stored have none."""
    return top_k(corpus.join(ids, "id", "left_semi").select(F.col("id").alias("qid"), "vector"), corpus, k, same=True)


def _learnt(corpus: DataFrame, k: int, reach: Callable[[np.ndarray, np.ndarray], np.ndarray], wanted: float, sample: int = 200) -> int:
    """Probes by which the share ``wanted`` of true neighbours is reached.

    ``sample`` stored rows ask for their k nearest exactly; ``reach`` gives the probe
    at which each neighbour is met, of the asking rows' and the neighbours' vectors.
    """
    v = corpus.select("id", "vector")
    asking = cut(v.orderBy(F.xxhash64("id"), "id").limit(sample))
    pairs = top_k(asking.select(F.col("id").alias("qid"), "vector"), v, k, same=True).select("qid", "id")
    both = pairs.join(asking.select(F.col("id").alias("qid"), F.col("vector").alias("vq")), "qid").join(v, "id").select("vq", "vector").toPandas()
    return int(np.quantile(reach(_unit(_matrix(both["vq"])), _unit(_matrix(both["vector"]))), wanted, method="higher")) if len(both) else 1


def _signatures(planes: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row x table: the signature, and row x table x bit: the distance to the plane."""
    d = np.einsum("tbd,nd->ntb", planes, v)
    return ((d > 0) * (1 << np.arange(planes.shape[1]))).sum(axis=2), np.abs(d)


def _flips(margins: np.ndarray) -> np.ndarray:
    """Row x table x probe: the bits to flip, by the sum of their margins; the own signature first."""
    bits = margins.shape[2]
    masks = (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1
    return np.argsort(margins @ masks.T, axis=2, kind="stable")


def hyperplane_index(corpus: DataFrame, dim: int, tables: int = 8, bits: int = 8, seed: int = 5) -> tuple[DataFrame, np.ndarray]:
    """id, vector, keys (one signature key per table), and the planes."""
    planes = np.random.default_rng(seed).normal(size=(tables, bits, dim))

    def run(batches):
        for pdf in batches:
            v = _unit(_matrix(pdf["vector"])) if len(pdf) else np.zeros((0, dim))
            keys = _signatures(planes, v)[0] + np.arange(tables) * (1 << bits)
            yield pdf.assign(keys=list(keys.astype("int64")))

    return cut(spread(corpus.select("id", "vector")).mapInPandas(run, "id long, vector array<float>, keys array<long>")), planes


def hyperplane_probes(index: DataFrame, planes: np.ndarray, k: int, wanted: float = WANTED) -> int:
    """Signatures to probe per table, learnt on stored rows."""

    def reach(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        own, margins = _signatures(planes, a)
        differ = own ^ _signatures(planes, b)[0]
        return (_flips(margins) == differ[:, :, None]).argmax(axis=2).min(axis=1) + 1

    return _learnt(index, k, reach, wanted)


def hyperplane_search(index: DataFrame, planes: np.ndarray, queries: DataFrame, k: int) -> DataFrame:
    """Approximate top-k: candidates lie in a probed bucket of some table, exact cosine ranks them.

    Probed are the own signature and those that differ from it in the bits of least
    margin, as many as the learnt share of true neighbours needs.
    """
    from recallframe.functions.vector import cosine

    probes, (tables, bits, dim) = hyperplane_probes(index, planes, k), planes.shape

    def near(batches):
        for pdf in batches:
            own, margins = _signatures(planes, _unit(_matrix(pdf["vector"])) if len(pdf) else np.zeros((0, dim)))
            keys = (own[:, :, None] ^ _flips(margins)[:, :, :probes]) + (np.arange(tables) * (1 << bits))[:, None]
            yield pdf[["qid"]].assign(keys=list(keys.reshape(len(pdf), tables * keys.shape[2]).astype("int64")))

    members = index.select("id", F.explode("keys").alias("key"))
    probed = queries.select("qid", "vector").mapInPandas(near, "qid long, keys array<long>")
    pairs = probed.select("qid", F.explode("keys").alias("key")).join(members, "key").where("qid <> id").select("qid", "id").distinct()
    vq, vc = queries.select("qid", F.col("vector").alias("vq")), index.select("id", "vector")
    scored = pairs.join(vq, "qid").join(vc, "id").select("qid", "id", F.round(cosine(F.col("vq"), F.col("vector")), 6).alias("score"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def cell_index(corpus: DataFrame, cells: int = 16, sample: int = 20_000, rounds: int = 8, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """Inverted cells: k-means centres of a bounded sample, and each row's cell."""
    n = corpus.count()
    take = corpus if n <= sample else corpus.where(F.pmod(F.xxhash64("id"), F.lit(-(-n // sample))) == 0)
    x = _unit(_matrix(take.orderBy("id").limit(2 * sample).toPandas()["vector"]))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        centres = _unit(np.array([x[own == i].mean(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))]))

    def run(batches):
        for pdf in batches:
            yield pdf.assign(cell=(_unit(_matrix(pdf["vector"])) @ centres.T).argmax(axis=1).astype("int32") if len(pdf) else [])

    return cut(spread(corpus.select("id", "vector")).mapInPandas(run, "id long, vector array<float>, cell int")), centres


def cell_search(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int = 4, wanted: float = WANTED) -> DataFrame:
    """Approximate top-k in the nearest cells: ``probes``, or more where the learnt share of true neighbours needs them.

    A cell's queries meet its rows as matrices.
    """

    def reach(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        own = (b @ centres.T).argmax(axis=1)
        return (np.argsort(-(a @ centres.T), axis=1) == own[:, None]).argmax(axis=1) + 1

    probes = min(len(centres), max(probes, _learnt(index, k, reach, wanted)))

    def near(batches):
        for pdf in batches:
            order = np.argsort(-(_unit(_matrix(pdf["vector"])) @ centres.T), axis=1)[:, :probes] if len(pdf) else np.zeros((0, probes))
            yield pdf.assign(cells=list(order.astype("int32")))

    asked = queries.select("qid", "vector").mapInPandas(near, "qid long, vector array<float>, cells array<int>")
    # a cell of many rows is dealt into blocks; cells are as few as centres
    blocks = {r["cell"]: -(-r["n"] // BLOCK) for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    if not blocks:
        return index.limit(0).select(F.col("id").alias("qid"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    many = F.create_map(*(F.lit(int(x)) for kv in blocks.items() for x in kv))
    members = index.select("id", F.col("vector").alias("v"), "cell", F.pmod(F.xxhash64("id"), many[F.col("cell")]).cast("int").alias("block"))
    probing = asked.select("qid", F.col("vector").alias("v"), F.explode("cells").alias("cell")).where(many[F.col("cell")].isNotNull())
    probing = probing.withColumn("block", F.explode(F.sequence(F.lit(0), many[F.col("cell")].cast("int") - 1)))
    met = probing.groupBy("cell", "block").cogroup(members.groupBy("cell", "block")).applyInPandas(_kernel(k, True, "cosine", 6), "qid long, id long, score double")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Mean share of the exact neighbours that were found."""
    hit = exact.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hit.groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r")).agg(F.avg("r").alias("recall"), F.count("*").alias("queries"))


def knn_graph(corpus: DataFrame, k: int, asked: DataFrame | None = None) -> DataFrame:
    """a, b, score with a < b: edges between rows of which one is among the k nearest of the other; ``asked`` (ids) limits who asks."""
    near = related(corpus.select("id") if asked is None else asked, corpus, k)
    return near.groupBy(F.least("qid", "id").alias("a"), F.greatest("qid", "id").alias("b")).agg(F.max("score").alias("score"))


def get_vectors(ids: DataFrame, corpus: DataFrame) -> DataFrame:
    """pos, id, vector of ``ids(pos, id)``; an id that is not stored raises."""
    found = ids.join(corpus.select("id", "vector", F.lit(True).alias("_held")), "id", "left")
    known = F.when(F.col("_held"), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("no vector with id "), F.col("id").cast("string"))))
    return found.select("pos", known.cast("long").alias("id"), "vector")


def bounded_cells(n: int) -> int:
    """Cells that grow with the square root of the rows, so that a search reads about as many centres as members."""
    return max(16, int(np.sqrt(max(0, n))) // 4)
