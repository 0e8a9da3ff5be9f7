"""Writes to conversations, forgetting, graph rules and metrics on small fixtures with nulls, ties and empty tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallframe.functions import text as tx
from recallframe.operators import conversation as cv
from recallframe.operators import fusion, metrics, packing, retrieval, sequences, store
from recallframe.operators import graph as gr
from recallframe.operators import sessions as se

TURNS = "session_id string, turn_index long, turn_id string, user_id string, text string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def _turns(spark, n=8):
    return spark.createDataFrame([("s", i, f"t{i}", "u" if i % 2 else None, None if i == 5 else "a secret" if i in (2, 6) else f"turn {i}") for i in range(1, n + 1)], TURNS)


def test_scope():
    assert se.scope("s", own_user="u") == {"session_id": "s", "user_id": "u", "superseded_by": {"$eq": None}}
    assert "user_id" not in se.scope("s", None, "u") and "superseded_by" not in se.scope("s", superseded=True)
    assert se.scope("s", own_user="u", where={"user_id": "v"})["user_id"] == "v"


def test_extraction(spark):
    turns = spark.createDataFrame([("s", 1, "t1", "u", "I like tea. The sky is grey."), ("s", 2, "t2", "u", None), ("s", 3, "t3", "u", "We will move. My cat ran off.")], TURNS)
    got = rows(se.extract(turns, size=8), "category", "text", "source_turn_id")
    assert got == [("biographical", "My cat ran off.", "t3"), ("goal", "We will move.", "t3"), ("preference", "I like tea.", "t1")]
    assert rows(se.extract(turns, size=1), "source_turn_id") == [("t1",), ("t3",), ("t3",)]
    broken = spark.createDataFrame([("no json", ["a", "b"]), ('[{"category": "odd", "text": " x ", "turn_index": 9}, {"text": "y"}, {"category": "goal", "text": " "}]', ["a", "b"]), (None, ["a"])], "raw string, ids array<string>")
    assert [r[0] for r in broken.select(se.parsed_batch(F.col("raw"), F.col("ids"))).collect()] == [[], [("other", "x", "b")], []]
    assert se.extract(turns.limit(0)).count() == 0


def test_decisions(spark):
    best = spark.createDataFrame([(1, None), (2, 0.95), (3, 0.8), (4, 0.8), (5, 0.8), (6, 0.5), (7, 0.8)], "fact_id long, best double")
    replies = spark.createDataFrame([(3, "UPDATE", 1, True), (4, "SUPERSEDE", 2, True), (5, "UPDATE", None, None), (6, "NOOP", None, None), (7, "MERGE", 1, True)], "fact_id long, op string, target long, known boolean")
    d = se.decided(best, replies)
    assert rows(d, "fact_id", "op") == [(1, "ADD"), (2, "NOOP"), (3, "UPDATE"), (4, "SUPERSEDE"), (5, "ADD"), (6, "ADD"), (7, "ADD")]
    writes = [(r["fact_id"], r["place"], r["action"], r["entry"], r["value"]) for r in se.fact_writes(d).orderBy("fact_id", "place").collect() if r["fact_id"] in (3, 4)]
    assert writes == [(3, 0, "forget", 1, None), (3, 1, "store", 3, 1), (4, 1, "store", 4, 2), (4, 2, "update", 2, 4)]
    users = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a")], "fact_id long, user_id string")
    assert se.owned(d.where("fact_id = 3"), users).count() == 1
    with pytest.raises(Exception, match="another user"):
        se.owned(d.where("fact_id = 4"), users).collect()


def test_forget_cascade(spark):
    turns = _turns(spark)
    facts = spark.createDataFrame([(1, "t2", "u", "tea"), (2, "t3", "u", "tea"), (3, None, "u", "cat"), (4, "t6", None, "tea")], "fact_id long, source_turn_id string, user_id string, subject string")
    held = spark.createDataFrame([("s", 1, 4), ("s", 2, 2), ("s", 6, 5), ("s", 7, 8)], "session_id string, summarized_turn_start long, summarized_turn_end long")
    done = se.forget(turns, facts, held, needle="SECRET")
    assert rows(done.ops, "kind", "action", "entry") == [("fact", "delete", "1"), ("fact", "delete", "4"), ("summary", "delete", "s/2/2"), ("summary", "delete", "s/6/5"), ("summary", "regenerate", "s/1/4"), ("turn", "delete", "t2"), ("turn", "delete", "t6")]
    assert done.ops.where("action = 'regenerate'").first()["text"] == "user: turn 1\nuser: turn 3\nuser: turn 4"
    assert done.totals.first().asDict() == {"deleted_turns": 2, "deleted_facts": 2, "deleted_summaries": 2, "regenerated_summaries": 1, "total_deleted": 6}
    assert rows(se.forget(turns, facts, held, user_id="u", subject="tea").ops.where("kind = 'fact'"), "entry") == [("1",), ("2",)]
    assert se.forget(turns, facts, held, needle="secret", strategy="drop").totals.first()["deleted_summaries"] == 3
    assert se.forget(turns.limit(0), facts.limit(0), held, needle="x").totals.first()["total_deleted"] == 0
    with pytest.raises(ValueError):
        se.forget(turns, facts, held)
    assert se.audit(done.totals, "a", "a").first()["target"] is None and se.audit(done.totals, "a", "b").first()["target"] == "b"


def test_audit_never_raises(spark, tmp_path):
    row = spark.range(1)
    assert store.append_lines(row, str(tmp_path / "audit")) and not store.append_lines(row, "/proc/none/audit")


def test_supersession(spark):
    chain = spark.createDataFrame([(i, i + 1 if i < 40 else None) for i in range(1, 41)], "fact_id long, superseded_by long")
    assert {r["newest"] for r in cv.supersession(chain).collect()} == {40}
    with pytest.raises(ValueError):
        cv.supersession(spark.createDataFrame([(1, 2), (2, 1)], "fact_id long, superseded_by long"))
    assert cv.supersession(chain.limit(0)).count() == 0


def test_summaries_and_messages(spark):
    out = se.add_messages(_turns(spark), every=4)
    assert out.where("kind = 'turn'").count() == 7 and [r["text"].count("\n") for r in out.where("kind = 'summary'").collect()] == [3]


def test_likest_fills_up_with_zeros(spark):
    e = spark.createDataFrame([(1, "a b"), (2, None), (3, "b"), (4, "z")], "id long, text string")
    q = spark.createDataFrame([(9, "b"), (8, None)], "qid long, text string")
    assert rows(se.likest(q, e, 3), "qid", "rank", "id") == [(8, 1, 1), (8, 2, 2), (8, 3, 3), (9, 1, 3), (9, 2, 1), (9, 3, 2)]


def test_prompts(spark):
    hits = spark.createDataFrame([(1, 2, "two"), (1, 1, "one"), (1, 3, None)], "qid long, rank int, text string")
    questions = spark.createDataFrame([(1, "why?"), (2, "who?")], "qid long, question string")
    got = {r["qid"]: r["prompt"] for r in packing.ask(hits, questions, lambda p: F.lit("x")).collect()}
    assert got == {1: "Context:\n[1] one\n[2] two\n\nQuestion: why?\nAnswer:", 2: "Question: who?\nAnswer:"}
    slots = spark.createDataFrame([(1, "recency", 1, "a", "xx"), (1, "relevant", 1, "a", "yy"), (1, "relevant", 2, "b", "zz"), (1, "decisions", 1, "a", "dd"), (1, "odd", 1, "c", "cc")], "qid long, slot string, rank int, node_id string, line string")
    assert packing.pack(slots).first()["context"] == "xx\nzz\ndd"


def test_rerankers_and_grids(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, "q", "long text"), (1, 2, 0.8, "q", None), (1, 3, 0.7, None, "t")], "qid long, id long, score double, query string, text string")
    got = fusion.scored_rerank(hits, 2, lambda qs, ts: [-len(t) for t in ts], batch=2).orderBy("rank").collect()
    assert [(r["id"], r["before"]) for r in got] == [(2, 0.8), (3, 0.7)]
    q = spark.createDataFrame([(1, "q", None), (2, "q", "- a\n- b\n- c\n- d")], "qid long, question string, raw string")
    assert rows(fusion.variants(q), "qid", "list", "text") == [(1, 0, "q"), (2, 0, "q"), (2, 1, "a"), (2, 2, "b"), (2, 3, "c")]
    assert rows(fusion.variants(q, original=False), "qid", "text") == [(1, "q"), (2, "a"), (2, "b"), (2, "c")]


def test_vectors_that_are_not_stored_raise(spark):
    corpus = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, vector array<float>")
    assert rows(retrieval.get_vectors(spark.createDataFrame([(0, 2), (1, 1)], "pos long, id long"), corpus), "pos", "id") == [(0, 2), (1, 1)]
    with pytest.raises(Exception, match="no vector with id 7"):
        retrieval.get_vectors(spark.createDataFrame([(0, 7)], "pos long, id long"), corpus).collect()


def test_cells_equal_exact_search_when_all_are_probed(spark):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)] + [(200, [1.0] * 6), (201, [1.0] * 6)], "id long, vector array<float>")
    index, centres = retrieval.cell_index(v, 16)
    asked = v.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    assert rows(retrieval.cell_search(index, centres, asked, 5, probes=16), "qid", "rank", "id") == rows(retrieval.top_k(asked, v, 5, same=True), "qid", "rank", "id")


def test_longest_common_subsequence():
    def plain(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (list(rng.choice(list("abcd"), rng.integers(0, 9))) for _ in "xy")
        assert tx._common_length(a, b) == plain(a, b)


def test_metrics_of_runs(spark):
    hits = spark.createDataFrame([(1, "x", 1, 1, "The Cat"), (1, "y", 2, 2, None), (1, "z", 1, 3, "dog")], "qid long, id string, sample int, rank int, text string")
    evidence = spark.createDataFrame([(1, "z")], "qid long, id string")
    samples = spark.createDataFrame([(1, 1), (2, 1)], "qid long, sample int")
    assert rows(metrics.any_evidence(hits, evidence, samples, (1, 2)), "qid", "k", "found") == [(1, 1, 0), (1, 2, 1), (2, 1, 0), (2, 2, 0)]
    wanted = spark.createDataFrame([(1, "cat"), (2, "cat")], "qid long, expected string")
    assert rows(metrics.substring_recall(hits, wanted, 1), "qid", "found") == [(1, 1), (2, 0)]
    many = spark.range(2000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).alias("b"))
    assert abs(metrics.spearman(many.withColumn("c", F.col("a") * 2), "a", "c").first()["rho"] - 1) < 1e-9 and metrics.spearman(many.limit(3), "a", "b").first()["rho"] is None


# ---------------------------------------------------------------- graphs
def test_circles(spark):
    ring = spark.createDataFrame([("c", 1, 2), ("c", 2, 3), ("c", 3, 1), ("c", 3, 4), ("d", 7, 7)], "component string, source_id long, target_id long")
    assert rows(gr.back_edges(ring), "component", "source_id", "target_id") == [("c", 3, 1), ("d", 7, 7)]
    assert [r["id"] for r in gr.topological_order(ring).where("component = 'c'").orderBy("place").collect()] == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        gr.waves(ring.select("source_id", "target_id"))


def test_messages_and_layers(spark):
    edges = spark.createDataFrame([(1, 3, 2.0), (2, 3, 1.0)], "source_id long, target_id long, weight double")
    act = spark.createDataFrame([(1, [1.0, -1.0]), (2, [0.5, 2.0])], "id long, vector array<double>")
    x = np.array([2.5, 0.0])
    w1, b1, w2, b2 = np.eye(2), np.array([0.0, 1.0]), np.array([[1.0, 2.0], [0.0, 1.0]]), np.array([0.5, 0.0])
    gelu = np.array([0.5 * v * (1 + math.erf(v / 2**0.5)) for v in x + b1])
    got = gr.propagate(edges, act, w1, b1, w2, b2, 2.0).collect()
    assert len(got) == 1 and np.allclose(got[0]["vector"], (gelu @ w2.T + b2) * 2.0 + x)


def test_recall_of_patterns(spark):
    rng = np.random.default_rng(3)
    p = np.sign(rng.normal(size=(3, 40)))
    stored = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(p)], "id long, vector array<double>")
    noisy = p[1].copy()
    noisy[:3] *= -1
    probes = spark.createDataFrame([(9, [float(x) for x in noisy])], "id long, vector array<double>")
    assert gr.classical_recall(stored, probes).first()["vector"] == list(p[1])
    out = [r["value"] for r in gr.modern_recall(stored.select("vector"), list(noisy), 1.0, 3).orderBy("pos").collect()]
    assert np.allclose(out, p[1], atol=1e-6)


def test_births_and_compression(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 0.5, 0.0, 1.0), (3, 5.0, 5.0, 1.0), (4, 0.2, 0.1, 0.0)], "id long, x double, y double, magnitude double")
    edges = spark.createDataFrame([(2, 1)], "source_id long, target_id long")
    assert rows(gr.births(nodes, edges, 1.0, 1.0, 1.0, 0.1), "source_id", "target_id") == [(1, 2)]
    assert gr.admitted(gr.births(nodes, edges, 1.0, 100.0, 1.0, 0.1), cap=5).count() == 1
    e = spark.createDataFrame([(0, 1, 1.0, 0), (1, 2, 1.0, 0), (2, 3, 1.0, 0), (3, 4, 1.0, 0), (9, 4, 0.1, 0)], "source_id long, target_id long, strength double, creation_step long")
    found = gr.ripe(e, gr.chains(e), 20_000)
    assert rows(found, "start", "nodes") == [(1, [1, 2, 3])]
    assert rows(gr.compressed(e, found), "source_id", "target_id") == [(0, 1), (1, 4), (9, 4)]


def test_slots(spark):
    slots = spark.createDataFrame([(0, [1.0, 0.0], 0.5, 3), (1, [0.0, 1.0], 0.05, 4)], "slot long, vector array<double>, usage double, age int")
    out = rows(gr.step_slots(gr.write_slot(slots, [2.0, 2.0], False)), "slot", "vector", "age")
    assert out == [(0, [1.0, 0.0], 4), (1, [0.0, 0.9], 5)]
    assert rows(gr.write_slot(slots, [2.0, 2.0], True), "slot", "vector", "usage") == [(0, [1.0, 0.0], 0.5), (1, [2.0, 2.0], 1.0)]
    assert gr.occupancy(slots).first()[0] == 0.5


def test_schedules(spark):
    steps = spark.createDataFrame([(0,), (5,), (10,), (99,)], "step long")
    assert [r[0] for r in steps.select(sequences.regime(F.col("step"), [5, 5, 5])).collect()] == [0, 1, 2, 2]
    shares = [r[0] for r in steps.select(sequences.by_step(F.col("step"), [(0, 6, {"a": 1.0, "b": 3.0})])).collect()]
    assert shares[0] == {"a": 0.25, "b": 0.75} and shares[2] is None


def test_empty_tables(spark):
    none = spark.createDataFrame([], "qid long, id long, score double, rank int, text string")
    assert fusion.scored_rerank(none.withColumn("query", F.lit("")), 3, lambda q, t: []).count() == 0
    assert packing.bench_context(none).count() == 0 and metrics.histogram(none, "qid", "score", (1.0,)).count() == 0
    edges = spark.createDataFrame([], "source_id long, target_id long, strength double, creation_step long")
    assert gr.compressed(edges, gr.ripe(edges, gr.chains(edges), 1)).count() == 0 and gr.waves(edges).count() == 0
