"""Problem 8: filling windows of fixed capacity by linear grouping.

1. An item above the capacity is cut into full windows and a rest.
2. Items above ``SMALL`` of the capacity are ordered by size and divided into
   ``GROUPS`` groups of equal cardinality; each is rounded up to its group's
   largest size.
3. The problem of few sizes is optimised over configurations (which sizes share
   a window): its linear relaxation by column generation, rounded down, the rest
   by first fit decreasing.
4. The items of each group take the places of their group in the configurations.
5. Small items go best-fit into the room that is left, the larger first, window
   by window group; what fits nowhere opens further windows.

Only the histogram of sizes (at most ``capacity`` rows) and the configurations
reach the driver; ranks come from per-bucket counts, so an item size shared by a
third of all rows is never one task.  Null and empty texts have size 0 and lie in
some window, too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallframe.session import cut

GROUPS, SMALL, BUCKET_ROWS, WINDOWS_PER_BUCKET = 48, 0.1, 20_000, 3_000


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """(items of each size in a window, number of such windows) that hold all counts."""
    k = len(sizes)
    if not k:
        return []
    s, n = np.array(sizes), np.array(counts, dtype=float)
    columns = [np.eye(k, dtype=int)[i] * max(1, min(capacity // s[i], counts[i])) for i in range(k)]
    basis = np.array(columns, dtype=float).T
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x, y = inverse @ n, np.ones(k) @ inverse
        pattern, value = _knapsack(s, y, capacity)
        if value <= 1 + 1e-7:
            break
        d = inverse @ pattern
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = pattern
    x = np.linalg.inv(basis) @ n
    plan = [(basis[:, i].astype(int), int(np.floor(x[i] + 1e-9))) for i in range(k) if x[i] >= 1 - 1e-9]
    left = n.astype(int) - sum((p * c for p, c in plan), np.zeros(k, dtype=int))
    while (over := np.flatnonzero(left < 0)).size:  # rounding noise: take back one window of a kind that holds too many
        i = next(i for i, (p, c) in enumerate(plan) if c and p[over[0]])
        plan[i] = (plan[i][0], plan[i][1] - 1)
        left += plan[i][0]
    while left.any():  # first fit decreasing, a whole window at a time
        room, pattern = capacity, np.zeros(k, dtype=int)
        for i in np.argsort(-s, kind="stable"):
            pattern[i] = min(left[i], room // max(1, s[i]))
            room -= pattern[i] * s[i]
        times = int(min(left[i] // pattern[i] for i in np.flatnonzero(pattern)))
        plan.append((pattern, times))
        left -= pattern * times
    return [(p, c) for p, c in plan if c]


def _knapsack(s: np.ndarray, y: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The window of greatest dual value."""
    use = np.flatnonzero(y > 1e-12)
    use = use[np.argsort(s[use])]
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    if not len(use):
        return np.zeros(len(s), dtype=int), 0.0
    su, yu = s[use], y[use]
    for c in range(int(su[0]), capacity + 1):
        m = int(np.searchsorted(su, c, side="right"))
        v = best[c - su[:m]] + yu[:m]
        i = int(v.argmax())
        if v[i] > best[c - 1] + 1e-12:
            best[c], last[c] = v[i], i
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(s), dtype=int), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
            continue
        pattern[use[last[c]]] += 1
        c -= int(su[last[c]])
    return pattern, float(best[capacity])


def _numbered(df: DataFrame, major: list[Column], names: list[str], total: int) -> DataFrame:
    """``place`` (0-based) of each row within its ``major``, by counts of hash buckets."""
    buckets = max(1, -(-total // BUCKET_ROWS))
    keyed = df.withColumn("_b", F.pmod(F.xxhash64("item", "piece"), F.lit(buckets)))
    for name, column in zip(names, major):
        keyed = keyed.withColumn(name, column)
    counts = keyed.groupBy(*names, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*names, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    own = Window.partitionBy(*names, "_b").orderBy("item", "piece")
    return keyed.join(offsets, [*names, "_b"]).withColumn("place", F.col("_o") + F.row_number().over(own) - 1).drop("_o", "_b")


def _fill(capacity: int):
    """Best fit of a bucket's small items (``room`` null) into its windows (``item`` null)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        windows, items = pdf[pdf["item"].isna()], pdf[pdf["item"].notna()]
        rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
        mask = 0
        for number, room in zip(windows["window_no"].astype("int64"), windows["room"].astype("int64")):
            rooms[room].append(number)
            mask |= 1 << room
        out, opened = [], 0
        items = items.sort_values(["size", "item", "piece"], ascending=[False, True, True])
        for item, piece, size in zip(items["item"].astype("int64"), items["piece"].astype("int64"), items["size"].astype("int64")):
            fits = mask >> size
            if fits:
                room = size + ((fits & -fits).bit_length() - 1)
                number = rooms[room].pop()
                if not rooms[room]:
                    mask &= ~(1 << room)
            else:
                opened += 1
                room, number = capacity, -opened
            out.append((bucket, number, item, piece, size))
            rooms[room - size].append(number)
            mask |= 1 << (room - size)
        return pd.DataFrame(out, columns=["bucket", "window_no", "item", "piece", "size"])

    return run


def pack(sizes: DataFrame, capacity: int, groups: int = GROUPS, small: float = SMALL) -> DataFrame:
    """``window_no`` (from 1), ``item``, ``piece`` (null if whole), ``size`` for ``item, size``."""
    spark = sizes.sparkSession
    pieces = F.greatest(F.lit(1), F.expr(f"(size + {capacity - 1}) div {capacity}")).cast("long")
    base = cut(sizes.select(F.col("item").cast("long"), F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size")).withColumn("pieces", pieces))
    total = base.count()
    full = base.where("pieces > 1").select("item", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pieces") - 1)).alias("piece"), F.lit(capacity).cast("long").alias("size"))
    rest = base.select("item", F.when(F.col("pieces") > 1, F.col("pieces")).otherwise(0).alias("piece"), (F.col("size") - (F.col("pieces") - 1) * capacity).alias("size"))

    floor = int(capacity * small)
    histogram = rest.where(F.col("size") > floor).groupBy("size").agg(F.count("*").alias("c")).orderBy(F.desc("size")).collect()  # at most capacity rows
    above, number = 0, {}
    for row in histogram:
        number[row["size"]] = above
        above += row["c"]
    step, few = max(1, -(-above // groups)), len(histogram) <= groups
    if few:  # few sizes as they are
        kinds = [(row["size"], row["c"], number[row["size"]]) for row in histogram]
    else:
        kinds = []
        for lo in range(0, above, step):
            largest = next(row["size"] for row in histogram if number[row["size"]] + row["c"] > lo)
            kinds.append((largest, min(step, above - lo), lo))
    plan = configurations([k[0] for k in kinds], [k[1] for k in kinds], capacity)
    taken, window, slots = [0] * len(kinds), 0, []
    for pattern, times in plan:
        for g in np.flatnonzero(pattern):
            a = int(pattern[g])
            lo = kinds[g][2] + taken[g]
            slots.append((int(g), lo, lo + a * times, a, window))
            taken[g] += a * times
        window += times
    starts = spark.createDataFrame(slots or [(-1, 0, 0, 1, 0)], "g long, lo long, hi long, per long, first long")  # under groups * (groups + rest) rows
    # at most capacity rows; with few sizes each is its own group, else groups are ranges of ranks
    places = spark.createDataFrame([(int(s), int(n), i) for i, (s, n) in enumerate(number.items())] or [(-1, 0, 0)], "size long, above long, own long")
    large = _numbered(rest.where(F.col("size") > floor), [F.col("size")], ["size"], total)
    large = (
        large.join(F.broadcast(places), "size").withColumn("at", F.col("above") + F.col("place"))
        .withColumn("g", F.col("own") if few else F.expr(f"at div {step}"))
        .join(F.broadcast(starts), "g").where("at >= lo and at < hi")
        .select((F.col("first") + F.expr("(at - lo) div per")).alias("window_no"), "item", "piece", "size")
    )
    large = cut(large)
    buckets = max(1, -(-window // WINDOWS_PER_BUCKET), -(-total // (WINDOWS_PER_BUCKET * 10)))
    rooms = large.groupBy("window_no").agg((F.lit(capacity) - F.sum("size")).alias("room"))
    null = lambda t: F.lit(None).cast(t)
    sides = rooms.select(F.pmod("window_no", F.lit(buckets)).alias("bucket"), "window_no", "room", null("long").alias("item"), null("long").alias("piece"), null("long").alias("size")).unionByName(
        rest.where(F.col("size") <= floor).select(F.pmod(F.xxhash64("item", "piece"), F.lit(buckets)).alias("bucket"), null("long").alias("window_no"), null("long").alias("room"), "item", "piece", "size")
    )
    filled = cut(sides.groupBy("bucket").applyInPandas(_fill(capacity), "bucket long, window_no long, item long, piece long, size long"))
    opened = filled.where("window_no < 0").groupBy("bucket").agg((-F.min("window_no")).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(opened.select("bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o")))  # one row per bucket
    new = offsets.agg(F.sum("n")).first()[0] or 0
    filled = filled.join(F.broadcast(offsets.select("bucket", "o")), "bucket", "left").withColumn(
        "window_no", F.when(F.col("window_no") >= 0, F.col("window_no")).otherwise(window + F.col("o") - F.col("window_no") - 1)
    )
    whole = _numbered(full, [F.lit(0)], ["_all"], max(total, 1)).select((F.lit(window + new) + F.col("place")).alias("window_no"), "item", "piece", "size")
    out = large.unionByName(filled.select("window_no", "item", "piece", "size")).unionByName(whole)
    return out.select((F.col("window_no") + 1).alias("window_no"), "item", F.when(F.col("piece") > 0, F.col("piece")).cast("int").alias("piece"), "size")
