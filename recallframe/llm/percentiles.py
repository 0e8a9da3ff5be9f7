"""Problem 4: exact percentiles per group by bisection of value intervals.

A non-negative double and its bit pattern as a long have the same order, so an
interval of values is an interval of longs.  Every (group, percentile) keeps one
such interval and the number of rows below it.  A pass over the values counts the
rows between the interval's midpoints (``FAN`` - 1 of them at once, so one pass
does the work of ten halvings) and keeps the part that holds the target rank,
drawn in to the least and the greatest value found in it.  Percentiles of a group
that still share an interval share its counts.  Counting is a map-side aggregate: a
hot group costs each task a fixed number of counters.  Passes end when every
interval is one value, for groups of any size; the error bound is 0.

Counts of separate partitions or days add up, so combined groups are treated
like any other: a row counts for its fine group and for its combined group.

Null, NaN, negative and infinite measures are left out; a group of none gives no
row.  The percentile p of n values is the value of rank ceil(p * n / 100).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallframe.session import cut, written

PERCENTS = (50, 90, 95, 99)
FAN_BITS = 10
SMALL_GROUPS = 50_000  # intervals are broadcast up to so many groups, else joined by shuffle, a hot group's rows over SALTS tasks
SALTS = 32


def bits(value: Column) -> Column:
    """The order-preserving long of a non-negative double: exponent and mantissa."""
    scale = F.greatest(F.least(F.floor(F.log2(value)), F.lit(1022)), F.lit(-1022)).cast("int")
    # floor(log2) may miss by one next to powers of two: put right by comparison
    scale = F.when(value >= F.pow(F.lit(2.0), scale + 1), scale + 1).when(value < F.pow(F.lit(2.0), scale), scale - 1).otherwise(scale)
    mantissa = (value / F.pow(F.lit(2.0), scale) - 1.0) * F.lit(float(1 << 52))
    return F.when(value < F.lit(2.0**-1000), F.lit(0)).otherwise((scale + 1023).cast("long") * (1 << 52) + mantissa.cast("long"))


def bisect(values: DataFrame, percents: tuple[int, ...] = PERCENTS, held: bool = False) -> DataFrame:
    """``gid, percent, rank, n, value, passes`` for a table of (gids, value).

    ``gids`` is the array of the row's groups (longs); ``value`` its usable measure.
    ``held``: the values come from a written table, which the passes may scan again.
    """
    kept = values if held else written(values.select("gids", "value"))
    rows = kept.select("gids", F.col("value").cast("double").alias("v")).withColumn("b", bits(F.col("v"))).select(F.explode("gids").alias("gid"), "b", "v")
    sizes = rows.groupBy("gid").agg(F.count("*").alias("n"), F.min("b").alias("lo"), (F.max("b") + 1).alias("hi"), F.min("v").alias("value"))
    state = cut(
        sizes.withColumn("percent", F.explode(F.array(*map(F.lit, percents))))
        .withColumn("rank", F.greatest(F.lit(1), F.expr("(percent * n + 99) div 100")).cast("long"))
        .select("gid", "percent", "n", "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), "value", F.lit(0).alias("passes"))
    )
    many = state.count() > SMALL_GROUPS * len(percents)

    def meet(todo: DataFrame) -> DataFrame:
        if not many:
            return rows.join(F.broadcast(todo), "gid")
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("v", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
        return salted.join(todo.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["gid", "salt"])

    for passes in range(1, 9):  # 63 bits at FAN_BITS a pass
        open_ = state.where(F.col("hi") - F.col("lo") > 1)
        if open_.isEmpty():
            break
        step = F.greatest(F.lit(1), F.expr(f"(hi - lo + {1 << FAN_BITS} - 1) div {1 << FAN_BITS}"))
        todo = open_.select("gid", "lo", "hi", step.alias("step")).distinct().groupBy("gid").agg(F.collect_list(F.struct("lo", "hi", "step")).alias("todo"))
        counted = (
            meet(todo)
            .select("gid", "b", "v", F.explode("todo").alias("t"))
            .where((F.col("b") >= F.col("t.lo")) & (F.col("b") < F.col("t.hi")))
            .groupBy("gid", F.col("t.lo").alias("lo"), F.col("t.hi").alias("hi"), F.expr("(b - t.lo) div t.step").alias("part"))
            .agg(F.count("*").alias("c"), F.min("b").alias("least"), F.max("b").alias("most"), F.min("v").alias("first"))
        )
        upto = Window.partitionBy("gid", "lo", "hi").orderBy("part")  # at most 2^FAN_BITS rows each
        narrowed = (
            open_.drop("value", "passes").join(counted.withColumn("upto", F.sum("c").over(upto)), ["gid", "lo", "hi"])
            .where((F.col("below") + F.col("upto") >= F.col("rank")) & (F.col("below") + F.col("upto") - F.col("c") < F.col("rank")))
            .select("gid", "percent", "n", "rank", F.col("least").alias("lo"), (F.col("most") + 1).alias("hi"), (F.col("below") + F.col("upto") - F.col("c")).alias("below"), F.col("first").alias("value"), F.lit(passes).alias("passes"))
        )
        state = cut(state.where(F.col("hi") - F.col("lo") <= 1).unionByName(narrowed))
    return state.select("gid", "percent", "rank", "n", "value", "passes")


def usable(value: Column) -> Column:
    """Neither null, NaN, negative nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < F.lit(float("inf")))


def canonical_type(question_type: Column) -> Column:
    """One spelling for each question type; null becomes 'unknown'."""
    flat = F.regexp_replace(F.lower(F.trim(question_type)), "[^a-z0-9]+", "-")
    return F.when(flat.isNull() | (flat == ""), F.lit("unknown")).otherwise(flat)
