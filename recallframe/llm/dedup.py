"""Problem 2: new batches against all history with a pivot-distance table.

A text is the set of its distinct words.  The metric is the size of the symmetric
difference; with sizes a and b a Jaccard similarity of 0.8 means a distance of at
most ``a + b - 2 * ceil(4 (a + b) / 9)``.  The pivots are fixed: the empty set
(distance = size) and the ``PIVOTS`` classes into which a hash divides all words.
The table stores every accepted or seen text with its distances, and by the
triangle inequality two texts whose distances to any pivot differ by more than
the bound are no match.  The join is partitioned by ranges of the distance to the
empty set: sizes of one range match sizes of the same and the two next ranges only.

Distances to fixed pivots concentrate: sentences of one mould differ in two words
and lie equally far from every pivot.  Inside a range the join therefore also needs
an equal key, one of the rarest words of both sets: with least overlap o two sets of
sizes a and b share one of their a - o + 1 and b - o + 1 rarest words, two among one
word more, and so on up to o, which is four at least, so no match is lost.  Keys that
many texts hold are split by a second, a third and a fourth word.  Whatever remains is verified by the
true distance.  ``head`` in the table holds these rarest words, so keys are made
once, when a text is described, and by the JVM from then on.

A text is a case if an accepted earlier text is a match; texts with the same word
set as an earlier one always are.  Null, blank and wordless texts are no cases
and are not stored.  Rows delivered again under the same id count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallframe.llm.words import words
from recallframe.session import cut, spread, written

PIVOTS, HOT_FROM, SMALLEST = 32, 64, 4  # two different sets of fewer than four words are never a match
#: A word's place in the order of rarity comes from its count where it is in this share of the texts, else from its hash.
COMMON_SHARE, COMMON_FROM = 1 / 100_000, 50
BUCKETS = 16
TABLE = "src string, item_id long, pos long, n int, h1 long, h2 long, dist0 long, dist1 long, dist2 long, dist3 long, words array<long>"
DISTS = ["dist0", "dist1", "dist2", "dist3"]
LEVELS = (2, 3, 4)
KEY = ["src", "item_id", "pos"]
BAND = "cast(floor(ln(n + 0.5) / ln(1.25)) as int)"  # two sizes that may match lie in the same or in neighbouring ranges

TEXT_BUCKET = f"cast(pmod(xxhash64(h1), {BUCKETS}) as int)"


def _bucket(word):
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def least_overlap(a, b):
    return -(-4 * (a + b) // 9)


def describe(texts: DataFrame) -> DataFrame:
    """The table's rows of ``src, item_id, pos, text``: word set and pivot distances."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for src, item, pos, text in zip(pdf["src"], pdf["item_id"], pdf["pos"], pdf["text"]):
                found = set(words(text))
                if not found:
                    continue
                own = np.sort(np.array([xxhash.xxh64_intdigest(w) for w in found], dtype=np.uint64))
                # a distance is so many bits of seven, so differences are counted as bits; capping keeps them a lower bound
                counts = np.minimum(np.bincount((own >> np.uint64(59)).astype(np.int64), minlength=PIVOTS), 7)
                packed = ((1 << counts) - 1).astype(np.uint8).tobytes()
                dists = [int.from_bytes(packed[i : i + 8], "little", signed=True) for i in (0, 8, 16, 24)]
                name = xxhash.xxh3_128_digest(own.tobytes())
                h1, h2 = (int.from_bytes(name[i : i + 8], "little", signed=True) for i in (0, 8))
                out.append((src, item, pos, len(own), h1, h2, *dists, own.view(np.int64)))
            yield pd.DataFrame(out, columns=["src", "item_id", "pos", "n", "h1", "h2", *DISTS, "words"])

    return spread(texts.select("src", "item_id", "pos", "text")).mapInPandas(run, TABLE)


def word_order(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words in a fixed share of all texts, sorted, with their counts; any order keeps the join exact, this one keeps it short."""
    total = table.count()
    counts = table.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("c")).where(F.col("c") >= max(COMMON_FROM, int(total * COMMON_SHARE))).toPandas()
    w = counts["w"].to_numpy(dtype=np.int64)
    order = np.argsort(w)
    return w[order], counts["c"].to_numpy(dtype=np.int64)[order]


def with_heads(table: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The table with ``band``, ``reach`` (words of which a match shares one) and ``head``, these and the three next rarest."""
    shared = table.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = shared.value
        for pdf in batches:
            size = pdf["n"].to_numpy(dtype=np.int64)
            flat = np.concatenate(pdf["words"].to_list()) if len(pdf) else np.zeros(0, dtype=np.int64)
            row = np.repeat(np.arange(len(pdf)), size)
            at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
            often = np.where(known[at] == flat, counts[at], 0) if len(known) else np.zeros(len(flat), dtype=np.int64)
            flat = flat[np.lexsort((flat, often, row))]
            first = np.cumsum(size) - size
            reach = size - least_overlap(size, -(-4 * size // 5)) + 1
            heads = [flat[i : i + k + LEVELS[-1] - 1] for i, k in zip(first, np.minimum(reach, size))]
            yield pdf.assign(reach=reach.astype("int32"), head=heads)

    kept = table.where(f"n >= {SMALLEST}")
    return kept.mapInPandas(run, f"{TABLE}, reach int, head array<long>").withColumn("band", F.expr(BAND))


def keys_of(table: DataFrame) -> DataFrame:
    """``key`` (a hash of the source and the key's words), ``at`` (the place of its last word in the order of rarity), ``level`` (its words) and the row's id, size and distances, once per key of the row."""
    own = table.select(*KEY, "n", *DISTS, F.expr(TEXT_BUCKET).alias("tb"), "band", "reach", "head", F.posexplode(F.slice("head", F.lit(1), F.col("reach"))).alias("at", "w"))
    return own.withColumn("key", F.xxhash64("w", "src")).withColumn("level", F.lit(1)).drop("w")


def split(keys: DataFrame, hot: DataFrame, level: int) -> DataFrame:
    """Rows of the keys in ``hot`` once per further rare word, all others as they are.

    Words join in the order of rarity only: the words that two texts share come in that
    order too, so the key of the first of them is among both texts' keys, without doubles.
    """
    last = F.least(F.size("head"), F.col("reach") + (level - 1)) - 1
    places = F.when(F.col("hot").isNull(), F.array(F.lit(-1))).when(last > F.col("at"), F.sequence(F.col("at") + 1, last)).otherwise(F.array().cast("array<int>"))
    met = keys.join(hot.select("key", F.lit(True).alias("hot")), "key", "left").withColumn("next", F.explode(places))
    longer = F.col("next") >= 0
    met = met.withColumn("key", F.when(longer, F.xxhash64("key", F.get("head", F.col("next")))).otherwise(F.col("key")))
    return met.withColumn("at", F.greatest("at", "next")).withColumn("level", F.when(longer, F.lit(level)).otherwise(F.col("level"))).drop("hot", "next")


def refined(*sides: DataFrame) -> list[DataFrame]:
    """The sides' keys, those that more than ``HOT_FROM`` rows of one range hold split on all sides alike.

    The hot keys are a written table, so that the planner broadcasts them only if their size allows.
    """
    for level in LEVELS:
        every = sides[0].select("key", "band")
        for side in sides[1:]:
            every = every.unionByName(side.select("key", "band"))
        hot = written(every.groupBy("key", "band").agg(F.count("*").alias("c")).where(F.col("c") > HOT_FROM).select("key").distinct())
        if hot.isEmpty():
            break
        sides = tuple(split(side, hot, level) for side in sides)
    return list(sides)


def nearby(keys: DataFrame) -> DataFrame:
    """The rows in their own range and in the two next to it."""
    return keys.withColumn("band", F.explode(F.array(*(F.col("band") + i for i in (-1, 0, 1)))))


def joined(old: DataFrame, new: DataFrame, ordered: bool) -> DataFrame:
    """``src, a, b`` and the ranges of pairs with an equal key whose distances to no pivot rule a match out."""
    side = lambda df, x: df.select("key", "band", *(["src", "tb"] if x == "a" else []), F.col("level").alias(f"level_{x}"), F.col("at").alias(f"at_{x}"), F.struct("item_id", "pos").alias(x), F.col("n").alias(f"n_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in DISTS))
    pivots = " + ".join(f"bit_count({c}_a ^ {c}_b)" for c in DISTS)
    overlap = "((4 * (n_a + n_b) + 8) div 9)"
    placed = f"at_a <= n_a - {overlap} + level_a - 1 and at_b <= n_b - {overlap} + level_a - 1"  # the key lies among the words of which this pair must share as many
    bound = f"n_a + n_b - 2 * {overlap}"
    order = "a < b and " if ordered else ""
    met = side(old, "a").join(side(nearby(new), "b"), ["key", "band"])
    return met.where(f"{order}5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b) and {placed} and {pivots} <= {bound}").select("src", "a", "b", F.col("band").alias("band_a"), F.col("tb").alias("tb_a")).distinct()


def verified(pairs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs whose true distance makes them a match."""
    sets = lambda df, n: df.select("src", F.struct("item_id", "pos").alias(n), F.col("words").alias(f"w_{n}"))
    both = pairs.select("src", "a", "b").join(sets(old, "a"), ["src", "a"]).join(sets(new, "b"), ["src", "b"])
    return both.where("9 * size(array_intersect(w_a, w_b)) >= 4 * (size(w_a) + size(w_b))").select("src", "a", "b")


def matches(table: DataFrame) -> DataFrame:
    """``src, a, b``: (item_id, pos) of an earlier and a later text of similarity 0.8 or more, of a table with heads."""
    keys = written(refined(keys_of(table))[0].drop("reach", "head"))
    return verified(joined(keys, keys, True), table, table)


def settle(links: DataFrame) -> DataFrame:
    """``src, b`` of the links' later ends that are cases: greedy acceptance in order of arrival.

    Each round accepts what has no open earlier end, makes its later ends cases and
    drops the links that are thereby decided.
    """
    open_, cases = cut(links), None
    while not open_.isEmpty():
        later = open_.select("src", F.col("b").alias("a")).distinct()
        accepted = open_.select("src", "a").distinct().join(later, ["src", "a"], "left_anti")
        new = cut(open_.join(accepted, ["src", "a"], "left_semi").select("src", "b").distinct())
        cases = new if cases is None else cases.unionByName(new)
        left = open_.join(new, ["src", "b"], "left_anti").join(new.select("src", F.col("b").alias("a")), ["src", "a"], "left_anti")
        open_ = cut(left)
    return cases if cases is not None else links.select("src", "b").limit(0)


def repeats(texts: DataFrame) -> DataFrame:
    """``src, item_id, pos`` of every case among ``src, item_id, pos, text`` (unique keys)."""
    table = cut(describe(texts))
    o = F.struct("item_id", "pos")
    first = cut(table.groupBy("src", "h1", "h2").agg(F.min(o).alias("o")).select("src", "o.item_id", "o.pos"))
    copies = table.select(*KEY).join(first, KEY, "left_anti")
    distinct = table.join(first, KEY, "left_semi")
    near = settle(matches(written(with_heads(distinct, word_order(distinct))))).select("src", "b.item_id", "b.pos")
    return copies.unionByName(near)


class History:
    """The stored table of accepted texts for batch-wise work: check, then append.

    Under ``path`` lie the order of words (frozen with the first batch, so that stored
    keys stay valid), the accepted texts, and their keys, both by range of the distance
    to the empty set and by bucket of the key (or id).  A batch reads the keys of its
    own ranges and buckets, and the texts of the buckets in which candidates lie; stored
    keys are never made again.  Keys stay words; one that grows hot is split while it is
    joined, from the stored heads.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def _exists(self, part: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _order(self, new: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        if not self._exists("order"):
            w, c = word_order(new)
            self.spark.createDataFrame(pd.DataFrame({"w": w, "c": c}), "w long, c long").write.parquet(f"{self.path}/order")
            return w, c
        held = self.spark.read.parquet(f"{self.path}/order").orderBy("w").toPandas()
        return held["w"].to_numpy(dtype=np.int64), held["c"].to_numpy(dtype=np.int64)

    def _read(self, part: str, schema: str, places: DataFrame) -> DataFrame:
        """Stored rows of some (band, bucket); the places are as few as there are ranges and buckets."""
        wanted = places.distinct().groupBy("band").agg(F.collect_list("bucket").alias("buckets")).collect()
        if not wanted or not self._exists(part):
            return self.spark.createDataFrame([], schema)
        held = self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        some = F.lit(False)
        for r in wanted:
            some = some | ((F.col("band") == r["band"]) & F.col("bucket").isin(sorted(r["buckets"])))
        return held.where(some)

    _KEYS = "src string, item_id long, pos long, n int, dist0 long, dist1 long, dist2 long, dist3 long, tb int, reach int, head array<long>, at int, key long, band int, bucket int"
    _TEXTS = f"{TABLE}, band int, bucket int"

    def check_and_append(self, batch: DataFrame) -> DataFrame:
        """Cases of the batch; all others are appended to the table."""
        described = cut(describe(batch))
        order = self._order(described)
        first = described.groupBy("src", "h1", "h2").agg(F.min(F.struct("item_id", "pos")).alias("o")).select("src", "o.item_id", "o.pos")
        once = cut(described.join(first, KEY, "left_semi").withColumn("band", F.expr(BAND)).withColumn("bucket", F.expr(TEXT_BUCKET)))
        # equal word sets of the history, of any size, then near ones
        same = self._read("texts", self._TEXTS, once.select("band", "bucket")).select("src", "h1", "h2").distinct()
        copies = cut(once.join(same, ["src", "h1", "h2"], "left_semi").select(*KEY))
        fresh = written(with_heads(once.drop("band", "bucket").join(copies, KEY, "left_anti"), order))
        new_keys = keys_of(fresh)
        stored = self._read("keys", self._KEYS, nearby(new_keys).select("band", _bucket(F.col("key")).alias("bucket")))
        old_keys = cut(stored.join(new_keys.select("key").distinct(), "key", "left_semi").withColumn("level", F.lit(1)).drop("bucket"))
        old_keys, new_keys = refined(old_keys, new_keys)
        pairs = cut(joined(old_keys, new_keys, False))
        texts = self._read("texts", self._TEXTS, pairs.select(F.col("band_a").alias("band"), F.col("tb_a").alias("bucket")))
        known = cut(verified(pairs, texts, fresh).select("src", "b.item_id", "b.pos").distinct())
        left = written(fresh.join(known, KEY, "left_anti"))
        inside = settle(matches(left)).select("src", "b.item_id", "b.pos")
        small = once.where(f"n < {SMALLEST}").join(copies, KEY, "left_anti").select(*KEY)
        accepted = cut(left.select(*KEY).join(inside, KEY, "left_anti").unionByName(small))
        self._append("texts", once.join(accepted, KEY, "left_semi"))
        keys = keys_of(left.join(accepted, KEY, "left_semi")).drop("level")
        self._append("keys", keys.withColumn("bucket", _bucket(F.col("key"))))
        return described.select(*KEY).join(accepted, KEY, "left_anti")

    def _append(self, part: str, rows: DataFrame) -> None:
        rows.repartition("band", "bucket").write.mode("append").partitionBy("band", "bucket").parquet(f"{self.path}/{part}")
