"""One plan for a batch of queries, from the options of a retrieval call."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallframe.functions.where import compile_where
from recallframe.operators import fusion, lexical, retrieval


class Retriever:
    """Entries (id, text, metadata JSON, vector), their inverted index, and how to answer queries.

    Scoring touches ids and vectors or postings only; texts join the k winners.
    """

    def __init__(self, entries: DataFrame):
        self.entries = entries
        self.index = lexical.build(entries, "id", "text")

    def retrieve(
        self, queries: DataFrame, k: int = 5, where: dict[str, Any] | None = None, alpha: float | None = None, rerank_top: int | None = None
    ) -> DataFrame:
        """qid, id, score, rank, text for ``queries`` (qid, text, vector).

        A filter applies before ranking; word statistics stay those of all entries.
        With a filter the vector side enters a blend with its k best, the lexical
        side uncapped; without one both enter with their pools.
        """
        if k <= 0:
            raise ValueError("k must be positive")
        if alpha is not None and not 0 <= alpha <= 1:
            raise ValueError("alpha must lie between 0 and 1")
        wanted = max(k, rerank_top or 0)
        eligible = self.entries.where(compile_where(where, F.col("metadata"))) if where else self.entries
        vectors = eligible.where(F.col("vector").isNotNull()).select("id", "vector")
        asked = queries.where(F.col("vector").isNotNull()).select("qid", "vector")
        if alpha is None:
            found = retrieval.top_k(asked, vectors, wanted)
        else:
            pool = wanted if where else fusion.pool_size(wanted)
            words = lexical.scores(self.index, queries).where("bm25 > 0").select("qid", F.col("doc").alias("id"), F.col("bm25").alias("score"))
            words = words.join(eligible.select("id"), "id", "left_semi") if where else fusion.ranked(words, pool)
            found = fusion.hybrid(retrieval.top_k(asked, vectors, pool), words, alpha, wanted)
        out = found.join(self.entries.select("id", "text"), "id")
        if rerank_top:
            named = out.join(queries.select("qid", F.col("text").alias("query")), "qid")
            return fusion.rerank(named, k).select("qid", "id", "score", "rank", "text")
        return out.where(F.col("rank") <= k).select("qid", "id", "score", "rank", "text")
