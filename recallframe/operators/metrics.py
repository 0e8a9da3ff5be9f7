"""Metrics of retrieval, of answers and of whole runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallframe.functions.text import answer_tokens, ngrams, normal_answer
from recallframe.session import cut


def at_k(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """qid, recall, mrr, ndcg, hit, gold_rank of hits (qid, id, rank) against relevant (qid, id)."""
    wanted = relevant.select("qid", "id").distinct()
    n = wanted.groupBy("qid").agg(F.count("*").alias("n"))
    found = hits.where(F.col("rank") <= k).join(wanted, ["qid", "id"], "left_semi")
    own = found.groupBy("qid").agg(F.count("*").alias("got"), F.min("rank").alias("first"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return n.join(own, "qid", "left").select(
        "qid", zero(F.col("got") / F.col("n")).alias("recall"), zero(1.0 / F.col("first")).alias("mrr"), zero(F.col("dcg") / ideal).alias("ndcg"),
        F.when(F.col("got") > 0, 1).otherwise(0).alias("hit"), F.coalesce(F.col("first"), F.lit(0)).alias("gold_rank"),
    )


def _overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda xs, w: F.size(F.filter(xs, lambda y: y == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(count(a, w), count(b, w)))


def _f(a: Column, b: Column) -> Column:
    same = _overlap(a, b)
    p, r = same / F.size(a), same / F.size(b)
    return F.when(same == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def token_f1(prediction: Column, reference: Column) -> Column:
    a, b = answer_tokens(prediction), answer_tokens(reference)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(_f(a, b))


def exact_match(prediction: Column, reference: Column) -> Column:
    return (normal_answer(prediction) == normal_answer(reference)).cast("int")


def rouge_n(prediction: Column, reference: Column, n: int) -> Column:
    """A reference of under n words counts by equality, a prediction of under n words as 0."""
    a, b = answer_tokens(prediction), answer_tokens(reference)
    return F.when(F.size(b) < n, (a == b).cast("double")).when(F.size(a) < n, F.lit(0.0)).otherwise(_f(ngrams(a, n), ngrams(b, n)))


def rouge_l(prediction: Column, reference: Column) -> Column:
    from recallframe.functions.text import longest_common_subsequence

    a, b = answer_tokens(prediction), answer_tokens(reference)
    common = longest_common_subsequence(a, b)
    p, r = common / F.size(a), common / F.size(b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0) | (common == 0), F.lit(0.0)).otherwise(2 * p * r / (p + r))


def with_total(df: DataFrame, by: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates per value of ``by`` and over all ('ALL'), in one pass."""
    return df.groupingSets([[by], []], by).agg(F.grouping(by).alias("_g"), *aggregates).withColumn(by, F.when(F.col("_g") == 1, "ALL").otherwise(F.col(by))).drop("_g")


def regressions(golden: DataFrame, current: DataFrame, lower_is_better: float = 0.20, higher_is_better: float = 0.05) -> DataFrame:
    """system, metric, golden, current, status of two tables (system, metric, value)."""
    both = golden.select("system", "metric", F.col("value").alias("golden")).join(current.select("system", "metric", F.col("value").alias("current")), ["system", "metric"], "full")
    cost = F.rlike("metric", F.lit("(_ms|_s|_mb|_bytes)$"))
    worse = F.when(cost, F.col("current") > F.col("golden") * (1 + lower_is_better)).otherwise(F.col("current") < F.col("golden") * (1 - higher_is_better))
    return both.withColumn("status", F.when(F.col("golden").isNull(), "new").when(F.col("current").isNull(), "missing").when(worse, "regression").otherwise("pass"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """rho, n: rank correlation with average ranks; null under 5 rows, 0 without variance.

    Ranks come from counts per value, so ties need no large window.
    """
    good = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)

    def ranks(c: str) -> DataFrame:
        # values are ranked over ranges, so that no task holds all of them
        own = good.groupBy(c).agg(F.count("*").alias("n"))
        return running(own, c, "n").select(c, (F.col("upto") - (F.col("n") - 1) / 2.0).alias(f"rank_{c}"))

    both = good.join(ranks(a), a).join(ranks(b), b)
    rho = F.corr(f"rank_{a}", f"rank_{b}")
    return both.agg(F.count("*").alias("n"), rho.alias("rho")).select("n", F.when(F.col("n") < 5, F.lit(None).cast("double")).otherwise(F.coalesce(F.nanvl("rho", F.lit(0.0)), F.lit(0.0))).alias("rho"))


def running(df: DataFrame, order: str, value: str) -> DataFrame:
    """``upto``: sum of a column up to each row in order, by ranges and the sums of the ranges before."""
    ranged = cut(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    sums = ranged.groupBy("_p").agg(F.sum(value).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per partition
    inside = F.sum(value).over(Window.partitionBy("_p").orderBy(order))
    return ranged.join(F.broadcast(sums.select("_p", before.alias("_o"))), "_p").withColumn("upto", F.col("_o") + inside).drop("_p", "_o")


def transfer(acc: DataFrame) -> DataFrame:
    """ACC, BWT and FWT of (train_task, test_task, acc) with tasks from 0."""
    last = acc.agg(F.max("train_task").alias("last"))
    own = acc.where("train_task = test_task").select("test_task", F.col("acc").alias("own"))
    joined = acc.join(own, "test_task").crossJoin(F.broadcast(last))  # one row
    return joined.agg(
        F.avg(F.when(F.col("train_task") == F.col("last"), F.col("acc"))).alias("acc"),
        F.avg(F.when((F.col("train_task") == F.col("last")) & (F.col("test_task") < F.col("last")), F.col("acc") - F.col("own"))).alias("bwt"),
        F.avg(F.when((F.col("test_task") == F.col("train_task") + 1), F.col("acc"))).alias("fwt"),
    )


def any_evidence(hits: DataFrame, evidence: DataFrame, samples: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """qid, k, found: whether one of the evidence (qid, id) is among the k best hits (qid, id, sample, rank) of the question's own sample (qid, sample).

    Hits of other samples drop out first, so the places behind them move up.
    """
    own = hits.join(samples, ["qid", "sample"], "left_semi")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    first = own.withColumn("place", place).join(evidence.select("qid", "id").distinct(), ["qid", "id"], "left_semi").groupBy("qid").agg(F.min("place").alias("place"))
    asked = samples.select("qid").distinct().withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return asked.join(first, "qid", "left").select("qid", "k", F.coalesce((F.col("place") <= F.col("k")).cast("int"), F.lit(0)).alias("found"))


def substring_recall(hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """qid, found: whether a text (qid, expected) occurs in one of the k best hits (qid, rank, text), whatever the case."""
    met = expected.join(hits.where(F.col("rank") <= k).select("qid", "text"), "qid", "left")
    return met.groupBy("qid").agg(F.max(F.coalesce(F.contains(F.lower("text"), F.lower("expected")), F.lit(False)).cast("int")).alias("found"))


def histogram(df: DataFrame, label: str, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """label, le, n: for each label how many values are at most each bound; the last bound is infinite."""
    good = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    counts = good.groupBy(label).agg(*(F.count(F.when(F.col(value) <= b, 1)).alias(f"b{i}") for i, b in enumerate(bounds)), F.count("*").alias(f"b{len(bounds)}"))
    each = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate((*bounds, float("inf")))))
    return counts.select(label, F.explode(each).alias("x")).select(label, "x.le", "x.n")


def batch_bucket(n: Column) -> Column:
    """Label of a batch's size by powers of ten."""
    return F.when(n <= 1, "1").when(n <= 10, "10").when(n <= 100, "100").when(n <= 1000, "1000").otherwise("1000+")


def over_seeds(df: DataFrame, by: list[str]) -> DataFrame:
    """Runs (completion, accuracy, steps, peak) averaged over seeds: all completed, mean, mean rounded half to even, maximum."""
    return df.groupBy(*by).agg(F.bool_and("completion").alias("completion"), F.avg("accuracy").alias("accuracy"), F.bround(F.avg("steps")).cast("long").alias("steps"), F.max("peak").alias("peak"))


def best_per_call(df: DataFrame, by: str, name: str) -> DataFrame:
    """by, name, per_call: the row of highest quality per call of (quality, calls); rows without calls or quality do not count, ties go by name."""
    good = df.where((F.col("calls") > 0) & F.col("quality").isNotNull() & ~F.isnan("quality")).withColumn("per_call", F.col("quality") / F.greatest(F.lit(1), F.col("calls")))
    first = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("per_call"), name))
    return good.withColumn("_r", first).where("_r = 1").select(by, name, "per_call")


def judge_lift(a: DataFrame, b: DataFrame) -> DataFrame:
    """question_type ('ALL' over all), n, means of f1 and judge of two runs (question_id, question_type, f1, judge) on their common questions, and the lifts in percent."""
    both = a.join(b.select("question_id", F.col("f1").alias("b_f1"), F.col("judge").alias("b_judge")), "question_id")
    rows = with_total(both, "question_type", [F.count("*").alias("n"), F.avg("f1").alias("a_f1"), F.avg("b_f1").alias("b_f1"), F.avg("judge").alias("a_judge"), F.avg("b_judge").alias("b_judge")])
    lift = lambda x, y: F.when(F.col(x) > 0, (F.col(y) / F.col(x) - 1) * 100)
    return rows.withColumn("f1_lift", lift("a_f1", "b_f1")).withColumn("judge_lift", lift("a_judge", "b_judge"))
