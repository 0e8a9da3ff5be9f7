"""Ordered folds: moving averages, triggers, learning progress, token buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rolling(value: str, n: int, by: list[str], order: list[str], how=F.avg) -> Column:
    return how(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0))


def ratio_trigger(df: DataFrame, value: str, by: list[str], order: list[str], recent: int = 100, base: int = 1000, factor: float = 1.2) -> DataFrame:
    """recent mean, baseline mean and whether their ratio passes ``factor``."""
    out = df.withColumn("recent", rolling(value, recent, by, order)).withColumn("baseline", rolling(value, base, by, order))
    return out.withColumn("triggered", F.coalesce(F.col("recent") / F.col("baseline") > factor, F.lit(False)))


def blocks(df: DataFrame, by: list[str], order: str, block: Column) -> Column:
    """All values of a group in order; meant for groups of bounded length, such as a key's block of time."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, block.alias("v")))), lambda s: s["v"])


def exponential_mean(values: Column, alpha: float) -> Column:
    """Last value of e = (1 - alpha) * e + alpha * x, started at the first x, as an ordered fold."""
    first = F.element_at(values, 1).cast("double")
    return F.aggregate(values, first, lambda e, x: (1 - alpha) * e + alpha * x.cast("double"))


def learning_progress(df: DataFrame, loss: str, by: list[str], order: list[str], window: int = 50) -> DataFrame:
    """How much lower the recent losses are than the older ones, between 0 and 1; 1 while there are too few."""
    w = Window.partitionBy(*by).orderBy(*order)
    recent = F.avg(loss).over(w.rowsBetween(-(window // 10) + 1, 0))
    older = F.avg(loss).over(w.rowsBetween(-(window // 2) + 1, -(window // 10)))
    n = F.row_number().over(w)
    gain = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (older - recent) / F.greatest(F.abs(older), F.lit(1e-8))))
    return df.withColumn("progress", F.when(n < window, F.lit(1.0)).otherwise(F.coalesce(gain, F.lit(0.0))))


def token_bucket(times: Column, rate: float, burst: float) -> Column:
    """For ordered times in seconds: struct(allowed, denied) of a bucket that starts full."""
    start = F.struct(F.lit(float(burst)).alias("tokens"), F.lit(None).cast("double").alias("last"), F.lit(0).alias("allowed"), F.lit(0).alias("denied"))

    def step(s: Column, t: Column) -> Column:
        now = F.least(F.lit(float(burst)), s["tokens"] + F.coalesce(t - s["last"], F.lit(0.0)) * rate)
        ok = now >= 1.0
        return F.struct(F.when(ok, now - 1.0).otherwise(now).alias("tokens"), t.alias("last"), F.when(ok, s["allowed"] + 1).otherwise(s["allowed"]).alias("allowed"), F.when(ok, s["denied"]).otherwise(s["denied"] + 1).alias("denied"))

    return F.aggregate(times, start, step, lambda s: F.struct(s["allowed"].alias("allowed"), s["denied"].alias("denied")))


def spike_multiplier(losses: Column, spike: float = 2.0, cut_: float = 0.5, recover: float = 1.05, alpha: float = 0.1) -> Column:
    """Learning-rate multiplier after a sequence of losses: halved at a spike above the moving mean, recovering to 1."""
    start = F.struct(F.lit(None).cast("double").alias("mean"), F.lit(1.0).alias("m"))

    def step(s: Column, x: Column) -> Column:
        x = x.cast("double")
        hit = s["mean"].isNotNull() & (x > spike * s["mean"])
        return F.struct(F.coalesce((1 - alpha) * s["mean"] + alpha * x, x).alias("mean"), F.when(hit, s["m"] * cut_).otherwise(F.least(F.lit(1.0), s["m"] * recover)).alias("m"))

    return F.aggregate(losses, start, step, lambda s: s["m"])


def loss_statistics(values: Column, keep: float = 0.99) -> Column:
    """struct(mean, variance): moving mean of an ordered sequence and of its squared deviations from the mean before, both from 0."""
    start = F.struct(F.lit(0.0).alias("mean"), F.lit(0.0).alias("variance"))

    def step(s: Column, x: Column) -> Column:
        x = x.cast("double")
        return F.struct((keep * s["mean"] + (1 - keep) * x).alias("mean"), (keep * s["variance"] + (1 - keep) * (x - s["mean"]) * (x - s["mean"])).alias("variance"))

    return F.aggregate(values, start, step)


def pair_average(deltas: Column, alpha: float = 0.9) -> Column:
    """Last value of e = alpha * e + (1 - alpha) * delta, started at 0."""
    return F.aggregate(deltas, F.lit(0.0), lambda e, x: alpha * e + (1 - alpha) * x.cast("double"))


def by_step(step: Column, windows: list[tuple[int, int, dict[str, float]]]) -> Column:
    """Weights (name -> share of the sum) of the window that holds the step, start included and end not; null outside of all."""
    out = F.lit(None).cast("map<string,double>")
    for start, end, weights in reversed(windows):
        total = sum(weights.values())
        out = F.when((step >= start) & (step < end), F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(v / total))))).otherwise(out)
    return out


def regime(step: Column, durations: list[int]) -> Column:
    """Number of the regime at a step, of regimes that follow one another; the last one holds on."""
    out, end = F.lit(len(durations) - 1), sum(durations)
    for i in range(len(durations) - 2, -1, -1):
        end -= durations[i + 1]
        out = F.when(step < end, F.lit(i)).otherwise(out)
    return out


def last_of(df: DataFrame, by: str, order: str, value: str, n: int) -> DataFrame:
    """by, mean, low, high, last, n over the last ``n`` values of each series."""
    own = df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_r") <= n)
    return own.groupBy(by).agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.max_by(value, order).alias("last"), F.count("*").alias("n"))


def live_revocations(log: DataFrame, now: int) -> DataFrame:
    """jti, exp of what is revoked at a time: entries (raw JSON lines) whose end lies ahead; torn lines are passed over."""
    parsed = log.select(F.from_json("raw", "jti string, exp long").alias("r")).select("r.jti", "r.exp").where("jti is not null and exp is not null")
    return parsed.where(F.col("exp") > now).groupBy("jti").agg(F.max("exp").alias("exp"))
