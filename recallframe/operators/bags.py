"""Exact best matches between bags of words: texts are inverted block by block, and a block answers all questions at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallframe.session import written

#: Texts and different questions of a block.
BLOCK, ASKING = 32_768, 131_072
#: A word in more than this share of a block's texts is added as a whole vector.
DENSE = 1 / 8


def _lists(offsets: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, pa.int32())) for v in values]


def _numbers(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a column of lists."""
    one = lists.combine_chunks()
    return one.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(one).to_numpy(zero_copy_only=False)


def _coded(own: DataFrame, words: list[str]) -> DataFrame:
    """key, n, t, f of ``own(key, ts)``: how many words there are, and the numbers and counts of those that are in ``words``."""

    def run(batches):
        known = pa.array(words, pa.string())
        for b in batches:
            ts = b.column("ts")
            n = pc.fill_null(pc.list_value_length(ts), 0).to_numpy(zero_copy_only=False)
            t = pc.index_in(ts.flatten(), value_set=known)
            row = np.repeat(np.arange(len(n)), n)[pc.is_valid(t).to_numpy(zero_copy_only=False)]
            each, f = np.unique(row * max(1, len(words)) + t.drop_null().to_numpy(zero_copy_only=False), return_counts=True)
            row, t = np.divmod(each, max(1, len(words)))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n, pa.int32()), *_lists(np.searchsorted(row, np.arange(len(n) + 1)), t, f)], ["key", "n", "t", "f"])

    return own.select("key", "ts").mapInArrow(run, f"key {own.schema['key'].dataType.simpleString()}, n int, t array<int>, f array<int>")


def asked(queries: DataFrame) -> tuple[DataFrame, list[str]]:
    """qid, lead, t, f of ``queries(qid, ts)``, and the questions' words; ``lead`` is the first of those that ask with the same words.

    A question without words is left out; of a repeated one all words count.
    """
    own = queries.groupBy(F.col("qid").alias("key")).agg(F.flatten(F.collect_list("ts")).alias("ts"))  # deliveries of a question
    words = sorted(r["w"] for r in own.select(F.explode("ts").alias("w")).distinct().collect())  # a vocabulary
    coded = _coded(own, words).where(F.size("t") > 0).select(F.col("key").alias("qid"), "t", "f")
    return written(coded.withColumn("lead", F.min("qid").over(Window.partitionBy("t", "f")))), words


def inverted(texts: DataFrame, words: list[str]) -> DataFrame:
    """One row a block of ``texts(id, ts)``: ids in order, sizes, and for each of ``words`` that occurs how many texts, which and how often.

    ``texts`` and ``total`` count rows and their words, of a repeated id each; its words are counted together.
    """
    n, cores = texts.count(), texts.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // BLOCK), min(cores, n // 1024))
    kind = texts.schema["id"].dataType

    def invert(block: pa.Table) -> pa.Table:
        coded = block.column("key").combine_chunks().dictionary_encode(null_encoding="encode")
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at, size = place[coded.indices.to_numpy(zero_copy_only=False)], block.column("n").to_numpy()
        sizes = np.full(len(order), np.iinfo(np.int32).max)
        np.minimum.at(sizes, at, size)
        (t, held), f = _numbers(block.column("t")), _numbers(block.column("f"))[0]
        each, own = np.unique(t.astype(np.int64) * len(order) + np.repeat(at, held), return_inverse=True)
        t, p = np.divmod(each, len(order))
        t, df = np.unique(t, return_counts=True)
        row = [block.column("bc")[:1].combine_chunks(), pa.array([block.num_rows], pa.int64()), pa.array([size.sum()], pa.int64())]
        ids = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), coded.dictionary.take(pa.array(order)))
        lists = [_lists(np.array([0, len(v)]), v)[0] for v in (sizes, t, df, p, np.bincount(own, f, len(each)))]
        return pa.Table.from_arrays([*row, ids, *lists], ["bc", "texts", "total", "ids", "sizes", "t", "df", "p", "f"])

    coded = _coded(texts.select(F.col("id").alias("key"), "ts"), words).withColumn("bc", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    return written(coded.groupBy("bc").applyInArrow(invert, f"bc int, texts long, total long, ids array<{kind.simpleString()}>, sizes array<int>, t array<int>, df array<int>, p array<int>, f array<int>"))


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Halves go up, as in SQL."""
    return np.floor(x * 10**digits + 0.5) / 10**digits


def _first(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and rounded scores of the k largest above 0; ties by place. ``s`` is a multiple of 256 long."""
    parts = s.reshape(256, -1).max(axis=0)  # the k-th best part bounds the k-th best score from below
    least = np.partition(parts, len(parts) - k)[len(parts) - k] - 1e-6 if len(parts) >= k else 0.0
    at = np.flatnonzero(s >= least) if least > 0 else np.flatnonzero(s > 0)
    value = rounded(s[at])
    at, value = at[value > 0], value[value > 0]
    order = np.lexsort((at, -value))[:k]
    return at[order], value[order]


def best(
    questions: DataFrame,
    blocks: DataFrame,
    k: int,
    value: Callable[[int, np.ndarray, np.ndarray], np.ndarray | float],
    score: Callable[[np.ndarray, int, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """qid, id, score, rank of the k best texts of ``blocks`` above 0 for each of ``questions``; rounded to six digits, ties by smaller id.

    A pair's score is the sum of ``value(word, counts, sizes)`` over the question's words, times
    how often it asks for them; or of that sum, the question's number of words and the
    texts' sizes what ``score`` makes of them. No pair is ever a row: of a block only its
    k best leave it.
    """
    ids, lead = blocks.schema["ids"].dataType.elementType, questions.schema["lead"].dataType
    schema = f"lead {lead.simpleString()}, id {ids.simpleString()}, score double"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for one in range(right.num_rows if left.num_rows else 0):  # one
            name, sizes, t, df, p, f = (right.column(c)[one].values for c in ("ids", "sizes", "t", "df", "p", "f"))
            sizes, t, df, p, f = (x.to_numpy() for x in (sizes, t, df, p, f))
            wide = -(-len(sizes) // 256) * 256
            size = np.ones(wide, np.int64)
            size[: len(sizes)] = sizes
            ends = np.cumsum(df)
            held: dict[int, tuple[np.ndarray | None, np.ndarray]] = {}
            for w, lo, hi in zip(t.tolist(), (ends - df).tolist(), ends.tolist()):
                at, v = p[lo:hi], np.broadcast_to(value(w, f[lo:hi], sizes[p[lo:hi]]), hi - lo)
                if hi - lo > DENSE * wide:
                    every = np.zeros(wide)
                    every[at] = v
                    at, v = None, every
                held[w] = at, v
            (asks, n), often = _numbers(left.column("t")), _numbers(left.column("f"))[0]
            asks, often, stops, s = asks.tolist(), often.tolist(), np.cumsum(n).tolist(), np.zeros(wide)
            for q, (count, stop) in enumerate(zip(n.tolist(), stops)):
                s[:] = 0.0
                for w, times in zip(asks[stop - count : stop], often[stop - count : stop]):
                    at, v = held.get(w, (None, None))
                    if v is None:
                        continue
                    v = v if times == 1 else v * times
                    if at is None:
                        s += v
                    else:
                        s[at] += v
                at, v = _first(s if score is None else score(s, count, size), k)
                if len(at):
                    found.append((np.full(len(at), q), at, v))
            if found:
                q, at, v = (np.concatenate(x) for x in zip(*found))
                return pa.Table.from_arrays([left.column("lead").take(pa.array(q)), name.take(pa.array(at)), pa.array(v)], ["lead", "id", "score"])
        kinds = left.schema.field("lead").type, right.schema.field("ids").type.value_type
        return pa.Table.from_arrays([pa.array([], kinds[0]), pa.array([], kinds[1]), pa.array([], pa.float64())], ["lead", "id", "score"])

    named = [r["bc"] for r in blocks.select("bc").collect()]
    many = max(1, -(-questions.count() // ASKING))
    every = lambda xs: F.explode(F.array(*map(F.lit, xs)).cast("array<int>"))
    left = questions.where(F.col("qid").eqNullSafe(F.col("lead"))).select("lead", "t", "f", F.pmod(F.xxhash64("lead"), F.lit(many)).cast("int").alias("bq"), every(named).alias("bc"))
    right = blocks.select("bc", "ids", "sizes", "t", "df", "p", "f", every(range(many)).alias("bq"))
    met = left.groupBy("bq", "bc").cogroup(right.groupBy("bq", "bc")).applyInArrow(meet, schema)
    first = Window.partitionBy("lead").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    top = met.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).withColumnRenamed("lead", "_lead")
    return questions.select("qid", "lead").join(top, F.col("lead").eqNullSafe(F.col("_lead"))).select("qid", "id", "score", "rank")
