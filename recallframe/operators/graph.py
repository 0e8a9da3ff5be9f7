"""Maintenance rules of a weighted directed graph given as nodes and edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallframe.functions.vector import distance, dot
from recallframe.session import cut, spread


def weak(step: int, grace: int = 2000, strength: float = 0.001, idle: int = 5000) -> Column:
    """Old, weak and idle edges."""
    return (F.lit(step) - F.col("creation_step") >= grace) & (F.col("strength") < strength) & (F.lit(step) - F.col("last_active_step") > idle)


def prune(edges: DataFrame, step: int, **how) -> DataFrame:
    return edges.where(~weak(step, **how))


def isolated(nodes: DataFrame, edges: DataFrame, boundary: tuple[str, ...] = ("sensor", "output")) -> DataFrame:
    """Inner nodes without any edge."""
    ends = edges.select(F.col("source_id").alias("id")).unionByName(edges.select(F.col("target_id").alias("id"))).distinct()
    return nodes.where(~F.col("node_type").isin(*boundary)).join(ends, "id", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """id, outs, ins."""
    outs = edges.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("outs"))
    ins = edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("ins"))
    return outs.join(ins, "id", "full").select("id", F.coalesce("outs", F.lit(0)).alias("outs"), F.coalesce("ins", F.lit(0)).alias("ins"))


def smallest(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The n first rows in order, without gathering them: ranks from the counts of range partitions."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "_p").withColumn("_r", F.col("_o") + place).where(F.col("_r") <= n).drop("_p", "_o", "_r")


def excess(edges: DataFrame, nodes: int, step: int, most: float = 20.0, grace: int = 2000) -> DataFrame:
    """The weakest edges beyond an average degree of ``most``, among those past the grace period; all edges count."""
    n = max(0, edges.count() - int(most * nodes))
    return smallest(edges.where(F.lit(step) - F.col("creation_step") >= grace), n, "strength", "source_id", "target_id")


def chains(edges: DataFrame, longest: int = 4) -> DataFrame:
    """start, nodes of linear chains of 2 to ``longest`` nodes with one way in and out; a few bounded joins."""
    one = cut(degrees(edges).where("ins = 1 and outs = 1").select("id"))
    inner = edges.join(one.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(one.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id")
    starts = one.join(inner.select(F.col("target_id").alias("id")), "id", "left_anti")
    path = starts.select(F.col("id").alias("start"), F.array("id").alias("nodes"), F.col("id").alias("tail"))
    for _ in range(longest - 1):
        nxt = inner.select(F.col("source_id").alias("tail"), F.col("target_id").alias("n"))
        path = path.join(nxt, "tail", "left").select("start", F.when(F.col("n").isNotNull(), F.array_append("nodes", F.col("n"))).otherwise(F.col("nodes")).alias("nodes"), F.coalesce("n", F.lit(None)).alias("tail"))
    return path.where(F.size("nodes") >= 2).select("start", "nodes")


def birth_probability(distance: Column, coactivation: Column, locality: float, rate: float) -> Column:
    """Chance of a new edge between two active nodes."""
    return F.least(F.lit(1.0), coactivation * F.exp(-distance / locality) * rate)


def hebbian(edges: DataFrame, activity: DataFrame, rate: float = 0.01, decay: float = 0.001, bound: float = 5.0, threshold: float = 0.0, keep: float = 0.999) -> DataFrame:
    """Weights after decay and growth by both ends' magnitudes, and the moving mean of the source's (``strength``).

    Only edges whose ends are both active take part: above the threshold the weight decays
    and grows, and in any case it is held within the bound; all others stay as they are.
    """
    side = lambda end, name: activity.select(F.col("id").alias(end), F.abs("activation").alias(name))
    both = edges.join(side("source_id", "pre"), "source_id", "left").join(side("target_id", "post"), "target_id", "left")
    takes_part = F.col("pre").isNotNull() & F.col("post").isNotNull()
    grown = F.when((F.col("pre") > threshold) & (F.col("post") > threshold), F.col("weight") * (1 - decay) + rate * F.col("pre") * F.col("post")).otherwise(F.col("weight"))
    weight = F.when(takes_part, F.greatest(F.lit(-bound), F.least(F.lit(bound), grown))).otherwise(F.col("weight"))
    strength = F.when(takes_part, keep * F.col("strength") + (1 - keep) * F.col("pre")).otherwise(F.col("strength"))
    return both.withColumn("weight", weight).withColumn("strength", strength)


def gain(ema: Column, target: Column, value: Column) -> Column:
    """Homeostatic gain: down when far too active, up when far too quiet."""
    return F.when(ema > 1.2 * target, value * 0.999).when(ema < 0.8 * target, value * 1.001).otherwise(value)


def replay_priority(surprise: Column, age: Column, valid: Column, peak: float = 1000.0, width: float = 2000.0) -> Column:
    return surprise * F.exp(-F.pow((age - peak) / width, F.lit(2.0))) * valid.cast("double")


def sample_without_replacement(df: DataFrame, weight: str, n: int, key: str) -> DataFrame:
    """Weighted sample: the n largest log(u) / w with u from a hash of the key."""
    u = (F.pmod(F.xxhash64(key), F.lit(1 << 31)) + 1) / F.lit(float((1 << 31) + 1))
    return df.where(F.col(weight) > 0).withColumn("_k", F.log(u) / F.col(weight)).orderBy(F.desc("_k"), key).limit(n).drop("_k")


def critical_period(step: Column, start: Column, peak: Column, end: Column, most: Column) -> Column:
    """Triangular envelope that starts and ends at 1."""
    up, down = (step - start) / (peak - start), (end - step) / (end - peak)
    return F.when((step < start) | (step > end), F.lit(1.0)).otherwise(1.0 + (most - 1.0) * F.when(step <= peak, up).otherwise(down))


def _coloured(pdf: pd.DataFrame) -> tuple[list, list[tuple]]:
    """Nodes in topological order and the edges that lead back into the open path."""
    out_of = {a: sorted(own) for a, own in pdf.groupby("source_id")["target_id"]}
    closed: dict = {}
    order: list = []
    back: list[tuple] = []
    for root in sorted({*pdf["source_id"], *pdf["target_id"]}):
        todo = [(root, False)]
        while todo:
            node, leaving = todo.pop()
            if leaving:
                closed[node] = True
                order.append(node)
            elif node not in closed:
                closed[node] = False  # on the open path
                todo.append((node, True))
                fresh = []
                for other in out_of.get(node, ()):
                    if other not in closed:
                        fresh.append((other, False))
                    elif not closed[other]:
                        back.append((node, other))
                todo += reversed(fresh)
    return order[::-1], back


def topological_order(edges: DataFrame, component: str = "component") -> DataFrame:
    """component, id, place of each node, edges back left aside; one component is one task by nature."""
    kind = dict(edges.dtypes)

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        done, _ = _coloured(pdf)
        return pd.DataFrame({"component": pdf[component].iloc[0], "id": done, "place": range(len(done))})

    return edges.groupBy(component).applyInPandas(order, f"component {kind[component]}, id {kind['source_id']}, place long")


def back_edges(edges: DataFrame, component: str = "component") -> DataFrame:
    """component, source_id, target_id of the edges that close a circle, by depth first from the smallest ids."""
    kind = dict(edges.dtypes)

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        _, back = _coloured(pdf)
        return pd.DataFrame({"component": pdf[component].iloc[0], "source_id": [a for a, _ in back], "target_id": [b for _, b in back]})

    return edges.groupBy(component).applyInPandas(find, f"component {kind[component]}, source_id {kind['source_id']}, target_id {kind['target_id']}")


def waves(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """id, wave: longest path from a source over acyclic edges, by relaxation until nothing moves; a circle raises."""
    ids = edges.select(F.col("source_id").alias("id")).unionByName(edges.select(F.col("target_id").alias("id"))).distinct()
    level = cut(ids.withColumn("wave", F.lit(0)))
    nodes = None
    for turn in range(most):
        up = edges.join(level.select(F.col("id").alias("source_id"), "wave"), "source_id").groupBy(F.col("target_id").alias("id")).agg((F.max("wave") + 1).alias("up"))
        new = cut(level.join(up, "id", "left").select("id", F.greatest("wave", F.coalesce("up", F.lit(0))).alias("wave"), (F.coalesce("up", F.lit(0)) > F.col("wave")).alias("moved")))
        level = new.select("id", "wave")
        if new.where("moved").isEmpty():
            return level
        nodes = level.count() if nodes is None else nodes
        if turn > nodes:
            break
    raise ValueError("the edges form a circle")


def attention(keys: DataFrame, query: list[float], beta: float = 1.0) -> DataFrame:
    """Softmax-weighted mean of the stored patterns (one step of modern associative recall): pos, value."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = keys.withColumn("e", F.exp(beta * dot(F.col("vector"), q)))
    each = scored.select("e", F.posexplode("vector").alias("pos", "x"))
    return each.groupBy("pos").agg((F.sum(F.col("e") * F.col("x").cast("double")) / F.sum("e")).alias("value"))


def active(rows: DataFrame, step: int, lookback: int) -> DataFrame:
    """Nodes or edges last active within the lookback."""
    return rows.where(F.col("last_active_step") >= step - lookback)


def shapes(nodes: DataFrame, *sizes: str) -> DataFrame:
    """Nodes of equal shape, to be computed together."""
    return nodes.groupBy(*sizes).agg(F.count("*").alias("nodes"))


def births(nodes: DataFrame, edges: DataFrame, locality: float, rate: float, most: float, threshold: float = 0.0, blocked: DataFrame | None = None) -> DataFrame:
    """source_id, target_id, p: chance of a new edge between any two active nodes (id, x, y, magnitude) no further apart than ``most``.

    Both directions, no loops, no edge that exists, none of ``blocked`` (a, b with a < b: pairs without
    the evidence asked for).  Nodes meet in squares as wide as ``most`` and the eight around, so far pairs never meet.
    """
    live = nodes.where(F.col("magnitude") > threshold)
    cell = lambda c: F.floor(F.col(c) / most).cast("long")
    around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    a = live.select(F.col("id").alias("source_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("magnitude").alias("am"), cell("x").alias("cx"), cell("y").alias("cy"))
    b = live.select(F.col("id").alias("target_id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("magnitude").alias("bm"), cell("x").alias("gx"), cell("y").alias("gy"), F.explode(around).alias("dx")).withColumn("dy", F.explode(around))
    b = b.select("target_id", "bx", "by", "bm", (F.col("gx") + F.col("dx")).alias("cx"), (F.col("gy") + F.col("dy")).alias("cy"))
    far = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    pairs = a.join(b, ["cx", "cy"]).where("source_id <> target_id").withColumn("d", far).where(F.col("d") <= most)
    pairs = pairs.join(edges.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")
    if blocked is not None:
        pairs = pairs.withColumn("a", F.least("source_id", "target_id")).withColumn("b", F.greatest("source_id", "target_id")).join(blocked.select("a", "b"), ["a", "b"], "left_anti")
    p = birth_probability(F.col("d"), F.col("am") * F.col("bm"), locality, rate)
    return pairs.select("source_id", "target_id", p.alias("p")).where("p > 0")


def admitted(candidates: DataFrame, seed: int = 0, cap: int | None = None) -> DataFrame:
    """Births drawn with their chance by a hash of both ends; at most ``cap``, in the order of another hash."""
    u = (F.pmod(F.xxhash64("source_id", "target_id", F.lit(seed)), F.lit(1 << 31)) + 0.5) / F.lit(float(1 << 31))
    drawn = candidates.where(u < F.col("p"))
    return drawn if not cap else drawn.orderBy(F.xxhash64("source_id", "target_id", F.lit(seed + 1)), "source_id", "target_id").limit(cap)


def newcomer(nodes: DataFrame, new_id: int, busiest: int = 10, near: int = 5) -> DataFrame:
    """source_id, target_id: edges both ways between a new node in the middle of the busiest ones (id, vector, ema) and its nearest."""
    top = nodes.orderBy(F.desc("ema"), "id").limit(busiest)
    means = top.select(F.posexplode("vector").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centre"))  # one row
    far = F.round(distance(F.col("vector"), F.col("centre")), 9)
    ids = nodes.crossJoin(F.broadcast(centre)).withColumn("d", far).orderBy("d", "id").limit(near).select("id")
    new = F.lit(new_id).cast("long")
    return ids.select(F.col("id").alias("source_id"), new.alias("target_id")).unionByName(ids.select(new.alias("source_id"), F.col("id").alias("target_id")))


def ripe(edges: DataFrame, found: DataFrame, step: int, strength: float = 0.5, age: int = 10_000) -> DataFrame:
    """start, nodes of the chains whose inner edges are all strong and old."""
    inner = found.select("start", "nodes", F.explode(F.arrays_zip(F.slice("nodes", F.lit(1), F.size("nodes") - 1).alias("a"), F.slice("nodes", F.lit(2), F.size("nodes") - 1).alias("b"))).alias("e"))
    known = inner.select("start", "nodes", F.col("e.a").alias("source_id"), F.col("e.b").alias("target_id")).join(edges.select("source_id", "target_id", "strength", "creation_step"), ["source_id", "target_id"])
    good = (F.col("strength") > strength) & (F.lit(step) - F.col("creation_step") > age)
    return known.groupBy("start", "nodes").agg(F.bool_and(good).alias("ok")).where("ok").select("start", "nodes")


def compressed(edges: DataFrame, chains_: DataFrame) -> DataFrame:
    """source_id, target_id after each chain became one node, named as its first: edges into its first and out of its last are led to it, all inner ones go."""
    place = chains_.select("start", F.posexplode("nodes").alias("at", "node"), F.size("nodes").alias("n"))
    src = place.select(F.col("node").alias("source_id"), F.col("start").alias("s_start"), (F.col("at") == F.col("n") - 1).alias("s_last"))
    dst = place.select(F.col("node").alias("target_id"), F.col("start").alias("t_start"), (F.col("at") == 0).alias("t_first"))
    both = edges.select("source_id", "target_id").join(src, "source_id", "left").join(dst, "target_id", "left")
    inner = F.col("s_start").isNotNull() & F.col("s_start").eqNullSafe(F.col("t_start"))
    led = both.where(~inner & (F.col("s_start").isNull() | F.col("s_last")) & (F.col("t_start").isNull() | F.col("t_first")))
    return led.select(F.coalesce("s_start", "source_id").alias("source_id"), F.coalesce("t_start", "target_id").alias("target_id")).distinct()


def messages(edges: DataFrame, activity: DataFrame) -> DataFrame:
    """id, pos, total: what each node receives, the weighted sum of its sources' vectors; nodes without input receive nothing."""
    sent = edges.select("source_id", "target_id", "weight").join(activity.select(F.col("id").alias("source_id"), "vector"), "source_id")
    each = sent.select(F.col("target_id").alias("id"), "weight", F.posexplode("vector").alias("pos", "x"))
    return each.groupBy("id", "pos").agg(F.sum(F.col("weight") * F.col("x").cast("double")).alias("total"))


def propagate(edges: DataFrame, activity: DataFrame, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray, gain_: float = 1.0) -> DataFrame:
    """id, vector after a step: two layers with GELU over the received sums, times the gain, plus the sums where sizes agree; nodes without input stay silent."""
    from math import erf

    inputs = messages(edges, activity).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "total"))), lambda s: s["total"]).alias("x"))  # one vector's dimensions
    gelu = np.vectorize(lambda x: 0.5 * x * (1 + erf(x / 2**0.5)), otypes=[float])

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array(pdf["x"].tolist(), dtype=float)
            y = (gelu(x @ w1.T + b1) @ w2.T + b2) * gain_
            y = y + x if y.shape == x.shape else y
            yield pd.DataFrame({"id": pdf["id"], "vector": list(y)})

    return inputs.mapInPandas(run, "id long, vector array<double>")


def old_episodes(episodes: DataFrame, step: int, age: int = 100_000, replays: int = 5) -> DataFrame:
    """Episodes that are old and have been replayed often enough to go."""
    return episodes.where((F.lit(step) - F.col("step") > age) & (F.col("replays") >= replays))


def read_slots(slots: DataFrame, query: list[float]) -> DataFrame:
    """pos, value: attention over the slots (slot, vector) by scaled inner products."""
    return attention(slots.select("vector"), query, 1.0 / float(len(query)) ** 0.5)


def write_slot(slots: DataFrame, content: list[float], admit: bool) -> DataFrame:
    """The slots (slot, vector, usage, age) after a gated write to the least used one (ties: the smallest number)."""
    if not admit:
        return slots
    least = slots.agg(F.min_by("slot", F.struct("usage", "slot")).alias("least"))  # one row
    own = F.col("slot") == F.col("least")
    new = F.array(*(F.lit(float(x)) for x in content))
    met = slots.crossJoin(F.broadcast(least))
    return met.select("slot", F.when(own, new).otherwise(F.col("vector").cast("array<double>")).alias("vector"), F.when(own, F.lit(1.0)).otherwise(F.col("usage")).alias("usage"), F.when(own, F.lit(0)).otherwise(F.col("age")).alias("age"))


def step_slots(slots: DataFrame, decay: float = 0.99, threshold: float = 0.1, fade: float = 0.1) -> DataFrame:
    """One step: usage decays, age grows, contents of slots below the threshold fade."""
    usage = F.col("usage") * decay
    scale = F.when(usage < threshold, F.lit(1.0 - fade)).otherwise(F.lit(1.0))
    return slots.select("slot", F.transform("vector", lambda x: x.cast("double") * scale).alias("vector"), usage.alias("usage"), (F.col("age") + 1).alias("age"))


def occupancy(slots: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Share of the slots in use."""
    return slots.agg(F.avg((F.col("usage") >= threshold).cast("double")).alias("occupancy"))


def modern_recall(keys: DataFrame, probe: list[float], beta: float = 10.0, rounds: int = 5) -> DataFrame:
    """pos, value after some rounds of softmax attention over the stored patterns."""
    out = None
    for _ in range(rounds):
        out = cut(attention(keys, probe, beta))
        probe = [r["value"] for r in out.orderBy("pos").collect()]  # one vector
    return out


def classical_recall(patterns: DataFrame, probes: DataFrame, most: int = 100) -> DataFrame:
    """id, vector of probes (id, vector of -1, 0, 1) driven to a fixed point of the stored patterns' weights.

    The weights are a matrix of the dimension, added up over batches; unknown places (0) start at 1.
    """

    def sums(batches):
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["vector"].tolist(), dtype=float)
                yield pd.DataFrame({"w": [(x.T @ x).ravel()], "n": [len(x)]})

    parts = patterns.select("vector").mapInPandas(sums, "w array<double>, n long").select("n", F.posexplode("w").alias("pos", "w"))
    total = parts.groupBy("pos").agg((F.sum("w") / F.sum("n")).alias("w")).orderBy("pos").toPandas()["w"].to_numpy()  # dimension squared
    dim = int(round(len(total) ** 0.5))
    w = total.reshape(dim, dim).copy()
    np.fill_diagonal(w, 0.0)

    def settle(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array(pdf["vector"].tolist(), dtype=float)
            x[x == 0] = 1.0
            for _ in range(most):
                y = np.sign(x @ w.T)
                y[y == 0] = x[y == 0]
                if (y == x).all():
                    break
                x = y
            yield pd.DataFrame({"id": pdf["id"], "vector": list(x)})

    return spread(probes.select("id", "vector")).mapInPandas(settle, "id long, vector array<double>")


def inhibited(activations: DataFrame, group: list[str], share: float = 0.1, least: int = 3, value: str = "value", key: str = "id") -> DataFrame:
    """The strongest ``share`` of each group (``least`` at least); all others are silenced."""
    w = Window.partitionBy(*group)
    r = F.row_number().over(w.orderBy(F.desc(value), key))
    return activations.withColumn("_r", r).withColumn("_n", F.count("*").over(w)).where(F.col("_r") <= F.greatest(F.lit(least), F.floor(F.col("_n") * share))).drop("_r", "_n")


def journal(**kinds: DataFrame) -> DataFrame:
    """step, kind, entry of growth events, each given as (step, entry)."""
    out = None
    for kind, rows in kinds.items():
        own = rows.select(F.col("step").cast("long").alias("step"), F.lit(kind).alias("kind"), F.col("entry").cast("string").alias("entry"))
        out = own if out is None else out.unionByName(own)
    return out


def consolidated(nodes: DataFrame, edges: DataFrame, episodes: DataFrame, step: int, replay: int = 32, **how) -> dict[str, DataFrame]:
    """One cycle of upkeep: episodes to replay, edges that stay, chains that become one, the edges afterwards, nodes left alone, episodes that go."""
    age = (F.lit(step) - F.col("step")).cast("double")
    due = sample_without_replacement(episodes.withColumn("w", replay_priority(F.col("surprise"), age, F.lit(True))), "w", replay, "id")
    kept = cut(prune(edges, step, **how))
    merged_ = cut(ripe(kept, chains(kept), step))
    after = compressed(kept, merged_)
    return {"replayed": due, "kept": kept, "merged": merged_, "edges": after, "isolated": isolated(nodes, kept), "gone": old_episodes(episodes, step)}
