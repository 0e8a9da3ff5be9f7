"""Queries that once did less than their whole job."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from recallframe.operators import graph, retrieval, sparse
from recallframe.plans import memory_queries as mq
from recallframe.plans import retrieval_queries as rq
from tests.oracle import differences


# ---------------------------------------------------------------- reconcile_tristate
def plain_reconcile(folder):
    """fact_id -> best, decision, from every earlier fact of the session and user."""
    facts = {r["fact_id"]: r for r in pq.read_table(f"{folder}/extracted_facts.parquet").to_pylist()}
    before, out = {}, {}
    for f in sorted(facts):
        session, user, text = (facts[f][c] for c in ("session_id", "user_id", "text"))
        if text is None or session is None:
            continue
        own, found = set(text.lower().split()), []
        for other, whose, ws in before.setdefault(session, []):
            if user is None or user == whose:
                found.append((-len(own & ws) / max(1, len(own | ws)), other))
        live = [-score for score, other in sorted(found)[:5] if other % 7]
        best = max(live) if live else None
        out[f] = (None if best is None else round(best, 6), "add" if best is None or best < 0.75 else "near_dup" if best >= 0.92 else "ambiguous")
        before[session].append((f, user, own))
    return out


def reconciled(spark, folder):
    return {r["fact_id"]: (r["best"], r["decision"]) for r in mq.reconcile_tristate(spark, folder).collect()}


def test_a_fact_meets_all_earlier_facts_of_its_session_and_user(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mq, "FACTS", 4)  # several blocks
    texts = ["i like green tea"] + [f"number {i} is another thing" for i in range(2, 22)] + ["I like green tea", "i like green tea", "i like green tea"]
    users = ["u"] * 22 + ["v", None]
    rows = [(i, "s", user, text) for i, (user, text) in enumerate(zip(users, texts), 1)]
    spark.createDataFrame(rows, "fact_id long, session_id string, user_id string, text string").write.parquet(f"{tmp_path}/extracted_facts.parquet")
    found = reconciled(spark, str(tmp_path))
    assert len(found) == 24 and found[22] == (1.0, "near_dup")  # 21 places back
    assert found[23] == (None, "add") and found[24] == (1.0, "near_dup")  # another user's; without a user, everyone's
    assert found == plain_reconcile(tmp_path)


def test_reconcile_agrees_with_the_plain_model(spark):
    folder = "/root/testdata/sf0.01"
    assert reconciled(spark, folder) == plain_reconcile(folder)


# ---------------------------------------------------------------- approximate searches
def recall_of(spark, folder, found):
    v = rq._vectors(spark, folder)
    exact = retrieval.top_k(rq._asked(v), v.select("id", "vector"), 10, same=True)
    return retrieval.recall(found, exact).first()["recall"]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_hyperplanes_find_nine_of_ten_neighbours(spark, sf):
    folder = f"/root/testdata/{sf}"
    share = recall_of(spark, folder, rq.ann_hyperplanes(spark, folder))
    print(sf, "ann_hyperplanes", share)
    assert share >= 0.9


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_cells_find_nine_of_ten_neighbours(spark, sf):
    folder = f"/root/testdata/{sf}"
    share = rq.ann_recall(spark, folder).first()["recall"]
    print(sf, "ann_recall", share)
    assert share >= 0.9
    assert recall_of(spark, folder, rq.ann_cells(spark, folder)) >= 0.9


# ---------------------------------------------------------------- excess_edges
def test_excess_spares_young_edges_but_counts_them(spark):
    rows = [(1, 2, 0.1, 90), (1, 3, 0.2, 10), (2, 3, 0.3, 10), (3, 1, 0.4, 10), (2, 1, 0.5, 95)]
    edges = spark.createDataFrame(rows, "source_id long, target_id long, strength double, creation_step long")
    found = graph.excess(edges, 3, 100, most=1.0, grace=20).collect()
    assert sorted((r["source_id"], r["target_id"]) for r in found) == [(1, 3), (2, 3)]


def test_excess_edges_agree_with_sql(spark):
    folder = "/root/testdata/sf0.1"
    left, right = differences(spark, "excess_edges", mq.excess_edges, mq.SQL["excess_edges"], folder)
    assert not left and not right, (list(left)[:3], list(right)[:3])
    assert mq.excess_edges(spark, folder).count() == 45165


# ---------------------------------------------------------------- pattern_separate
def test_patterns_are_separated_over_whole_labels(spark):
    folder = "/root/testdata/sf0.01"
    own = spark.read.parquet(f"{folder}/embeddings.parquet").select("label", "vec_id", sparse.winners(F.col("embedding"), 8).alias("code"))
    whole = own.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "code"))), lambda x: x["code"]).alias("codes"))
    want = {(r["label"], i): code for r in whole.select("label", sparse.separate(F.col("codes")).alias("codes")).collect() for i, code in enumerate(r["codes"])}
    found = {(r["g"], r["place"]): r["code"] for r in rq.pattern_separate(spark, folder).collect()}
    assert found == want and len(found) == own.count()
    assert sum(len(code) for code in found.values()) < 8 * len(found)
