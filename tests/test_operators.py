"""Edge cases of the core operators on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from recallframe.functions import text as tx
from recallframe.functions import where as wh
from recallframe.operators import conversation as cv
from recallframe.operators import fusion, graph, lexical, metrics, packing, retrieval, sequences, sparse, store
from recallframe.plans.planner import Retriever
from recallframe.sources import chunker, importers, schemas


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ---------------------------------------------------------------- filters against a plain model
METADATA = [{}, {"x": None}, {"x": 1}, {"x": 1.0}, {"x": 2.5}, {"x": True}, {"x": False}, {"x": "1"}, {"x": "abc"}, {"x": ""}, {"x": [1]}, {"x": {"y": 1}}]
VALUES = [None, 1, 1.0, 2, True, False, "1", "abc", ""]


def plain(meta, op, value):
    actual = meta.get("x")
    if op == "$in":
        return actual in value
    if op == "$nin":
        return actual not in value
    if op == "$eq":
        return actual is None if value is None else actual is not None and actual == value
    if op == "$ne":
        return actual is not None and (value is None or actual != value)
    if value is None:
        return True
    if actual is None:
        return False
    try:
        return {"$gt": actual > value, "$gte": actual >= value, "$lt": actual < value, "$lte": actual <= value}[op]
    except TypeError:
        return False


def test_where_agrees_with_the_plain_model(spark):
    df = spark.createDataFrame([(i, json.dumps(m)) for i, m in enumerate(METADATA)], "i int, metadata string")
    cases = [(op, v) for op in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte") for v in VALUES] + [(op, v) for op in ("$in", "$nin") for v in ([], [None], [1, "abc"], [True])]
    tests = [wh.compile_where({"x": {op: v}}, F.col("metadata")).alias(f"c{n}") for n, (op, v) in enumerate(cases)]
    for r in df.select("i", *tests).collect():
        for n, (op, v) in enumerate(cases):
            assert r[f"c{n}"] == plain(METADATA[r["i"]], op, v), (METADATA[r["i"]], op, v)


def test_where_rejects_unknown_operators(spark):
    with pytest.raises(ValueError):
        wh.compile_where({"x": {"$like": "a"}}, F.lit("{}"))
    with pytest.raises(ValueError):
        wh.compile_where({"x": {"$in": "a"}}, F.lit("{}"))


def test_globs(spark):
    df = spark.createDataFrame([("agent.task_state",), ("conv.fact",), (None,)], "t string")
    assert [r[0] for r in df.select(wh.type_glob(F.col("t"), ["agent.*"])).collect()] == [True, False, False]


# ---------------------------------------------------------------- words and vectors
def test_bm25(spark):
    docs = spark.createDataFrame([(0, "the quick brown fox"), (1, "the lazy dog"), (2, ""), (3, None)], "doc_id int, text string")
    index = lexical.build(docs)
    asked = lambda q: spark.createDataFrame([(1, q)], "qid int, text string")
    assert [r["doc"] for r in lexical.search(index, asked("fox"), 5).collect()] == [0]
    assert lexical.search(index, asked(""), 5).count() == 0
    assert lexical.search(index, asked("unknown"), 5).count() == 0
    assert lexical.search(index, asked("dog"), 0).count() == 0
    one, two = (lexical.search(index, asked(q), 1).first()["bm25"] for q in ("dog", "dog dog"))
    assert two == pytest.approx(2 * one, abs=1e-5)


def test_top_k_and_subsets(spark):
    corpus = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "id long, vector array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, vector array<float>")
    assert rows(retrieval.top_k(q, corpus, 2), "id", "rank") == [(0, 1), (2, 2)]
    assert retrieval.top_k(q, corpus, 99).count() == 4
    assert retrieval.top_k(q, corpus, 0).count() == 0
    assert rows(retrieval.related(spark.createDataFrame([(0,), (77,)], "id long"), corpus, 1), "qid", "id") == [(0, 2)]
    assert retrieval.top_k(q, corpus.limit(0), 3).count() == 0


def test_retriever(spark):
    entries = spark.createDataFrame([(0, "red fox", '{"lang": "en"}', [1.0, 0.0]), (1, "blue dog", '{"lang": "de"}', [0.0, 1.0]), (2, "red dog", "{}", None)], "id long, text string, metadata string, vector array<float>")
    q = spark.createDataFrame([(9, "dog", [1.0, 0.0])], "qid long, text string, vector array<float>")
    r = Retriever(entries)
    assert r.retrieve(q, 1, alpha=1.0).first()["id"] == 0
    assert r.retrieve(q, 1, alpha=0.0).first()["id"] in (1, 2)
    assert [x["id"] for x in r.retrieve(q, 5, where={"lang": "de"}, alpha=0.5).collect()] == [1]
    with pytest.raises(ValueError):
        r.retrieve(q, 0)
    with pytest.raises(ValueError):
        r.retrieve(q, 1, alpha=2)


def test_reciprocal_ranks(spark):
    lists = spark.createDataFrame([(1, 0, 10, 1), (1, 0, 11, 2), (1, 1, 11, 1)], "qid int, list int, id int, rank int")
    assert [r["id"] for r in fusion.reciprocal_ranks(lists, 5).orderBy("rank").collect()] == [11, 10]


def test_sparse_codes(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.9],)], "v array<float>")
    assert df.select(sparse.winners(F.col("v"), 2)).first()[0] == [1, 2]
    both = spark.createDataFrame([([], []), ([1], []), ([1, 2], [2, 3])], "a array<int>, b array<int>")
    assert [round(r[0], 4) for r in both.select(sparse.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.3333]
    codes = spark.createDataFrame([([[1, 2, 3, 4], [1, 2, 3, 9], [7]],)], "c array<array<int>>")
    assert codes.select(sparse.separate(F.col("c"), 0.5)).first()[0] == [[2, 3, 4], [1, 2, 3, 9], [7]]


# ---------------------------------------------------------------- log, conversations, packing
def test_fold(spark):
    ops = [(1, "update", "a", None, None, '{"k": 0}'), (2, "store", "a", "one", "{}", None), (3, "store", "a", "ignored", "{}", None), (4, "update", "a", None, None, '{"k": 1}'), (5, "forget", "b", None, None, None), (6, "store", "b", "two", None, None), (7, "forget", "b", None, None, None), (8, "store", "b", "again", None, None), (9, "bad", "c", None, None, None), (10, "store", "d", "late", None, None)]
    log = spark.createDataFrame(ops, store.OPS)
    state = store.fold(store.before_damage(log))
    assert rows(state, "node_id", "text") == [("a", "one"), ("b", "again")]
    assert state.where("node_id = 'a'").first()["metadata"] == '{"k":1}'
    assert rows(store.fold(log, 6), "node_id", "text") == [("a", "one"), ("b", "two")]
    assert store.fold(log.limit(0)).count() == 0


def test_memory_store(spark, tmp_path):
    m = store.MemoryStore(spark, str(tmp_path), "b1")
    ids = m.store_batch(["one", "two"], ['{"a": 1}', None])
    with pytest.raises(ValueError):
        m.store_batch(["x", " "])
    with pytest.raises(KeyError):
        m.update_metadata("none", "{}")
    m.update_metadata(ids[0], '{"a": 2}')
    assert m.forget(ids[1]) and not m.forget(ids[1]) and ids[0] in m
    assert m.entries().count() == 1 and m.get(ids[0])["metadata"] == '{"a":2}' and m.get(ids[1]) is None and len(m) == 1
    at = m.compact()
    assert m.append(spark.createDataFrame([("three", None), (" ", None)], "text string, metadata string")) == 1
    m.update_metadata(ids[0], '{"b": [1]}')
    assert len(m) == 2 and m.get(ids[0])["metadata"] == '{"a":2,"b":[1]}' and m.changed(at).count() == 2
    with pytest.raises(ValueError):
        m.entries(at - 1)
    m.save(str(tmp_path / "saved"))
    assert len(store.MemoryStore.load(spark, str(tmp_path / "saved"), str(tmp_path / "other"))) == 2
    with pytest.raises(Exception):
        store.read_snapshot(spark, str(tmp_path / "nowhere"))
    with pytest.raises(ValueError):
        store.MemoryStore(spark, str(tmp_path), "bad/name")
    m.dump(str(tmp_path / "dump"))
    assert importers.bundles(spark, str(tmp_path)).count() == 1


def test_forgetting(spark):
    turns = spark.createDataFrame([("s", i, f"t{i}", "u", "secret" if i == 2 else "x") for i in range(1, 7)], "session_id string, turn_index long, turn_id string, user_id string, text string")
    gone = cv.forget_turns(turns, "SECRET")
    assert rows(gone, "turn_id") == [("t2",)]
    assert cv.forget_turns(turns).count() == 0
    made = spark.createDataFrame([("s", 1, 3), ("s", 2, 2), ("s", 4, 6), ("s", 6, 1)], "session_id string, summarized_turn_start long, summarized_turn_end long")
    assert rows(cv.forget_summaries(made, turns, gone), "summarized_turn_start", "fate") == [(1, "regenerate"), (2, "delete")]


def test_decisions(spark):
    df = spark.createDataFrame([(None,), (0.5,), (0.75,), (0.92,)], "s double")
    assert [r[0] for r in df.select(cv.decision(F.col("s"))).collect()] == ["add", "add", "ambiguous", "near_dup"]


def test_budget(spark):
    lines = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "bbbb"), (1, 3, "c")], "qid int, rank int, line string")
    assert packing.within_budget(lines, 9, ["qid"]).count() == 2
    assert packing.within_budget(lines, 3, ["qid"]).count() == 0
    assert packing.budgets({"recency": 0.0}) == {}


# ---------------------------------------------------------------- metrics and graphs
def test_answer_metrics(spark):
    df = spark.createDataFrame([("The cat.", "the cat"), ("", ""), (None, "x"), ("a b", "b a"), ("a", "a b c")], "h string, a string")
    h, a = F.col("h"), F.col("a")
    f1 = [round(r[0], 4) for r in df.select(metrics.token_f1(h, a)).collect()]
    assert f1 == [1.0, 1.0, 0.0, 1.0, 0.5]
    assert [r[0] for r in df.select(metrics.rouge_n(h, a, 2)).collect()][:2] == [1.0, 1.0]
    assert [round(r[0], 4) for r in df.select(metrics.rouge_l(h, a)).collect()] == [1.0, 1.0, 0.0, 0.5, 0.5]


def test_graph_rules(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 2)], "source_id long, target_id long")
    assert rows(graph.waves(edges), "id", "wave") == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (9, 0)]
    chain = graph.chains(edges.where("source_id <> 9")).collect()
    assert [c["nodes"] for c in chain] == [[2, 3, 4]]
    nodes = spark.createDataFrame([(1, "sensor"), (7, "associator"), (8, "output")], "id long, node_type string")
    assert rows(graph.isolated(nodes, edges), "id") == [(7,)]
    order = graph.topological_order(edges.withColumn("component", F.lit(1)))
    place = {r["id"]: r["place"] for r in order.collect()}
    assert all(place[a] < place[b] for a, b in ((1, 2), (2, 3), (3, 4), (4, 5), (9, 2)))


def test_token_bucket(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0, 10.0],)], "t array<double>")
    assert tuple(df.select(sequences.token_bucket(F.col("t"), 0.1, 2.0)).first()[0]) == (3, 1)


# ---------------------------------------------------------------- sources
def test_chunker(spark):
    text = "intro\n\n# A\npara one\nmore\n\n## B\n\ndeep\n# C\nlast\n#nothing"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "x" * 2500)], "doc_id long, text string")
    got = chunker.chunk(docs)
    assert rows(got.where("doc_id = 1"), "heading", "chunk") == [("", "intro"), ("A", "para one\nmore"), ("A > B", "deep"), ("C", "last\n#nothing")]
    assert got.where("doc_id = 3").count() == 3
    assert got.where("doc_id = 2").count() == 0


def test_importers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"memories": [{"memory": " hi ", "user_id": "u"}, {"text": "yo"}, {"memory": ""}]}))
    raw = importers.json_records(spark, str(tmp_path / "a.json"))
    got = importers.preset(raw, "mem0")
    assert rows(got, "text") == [("hi",), ("yo",)]
    assert {json.loads(r["metadata"])["source"] for r in got.collect()} == {"mem0"}
    (tmp_path / "b.jsonl").write_text('{"content": "c", "metadata": {"role": "x"}, "role": "user"}\n\n')
    zep = importers.preset(importers.jsonl(spark, str(tmp_path / "b.jsonl")), "zep").first()
    assert json.loads(zep["metadata"])["role"] == "x"
    (tmp_path / "c.md").write_text("# T\n\nbody")
    assert importers.markdown_files(spark, str(tmp_path)).count() == 1


def test_schemas(spark):
    assert len(schemas.names()) == 31
    with pytest.raises(ValueError):
        schemas.register("conv.fact", [])
    with pytest.raises(ValueError):
        schemas.typed_filter("agent.task_state", status="odd")
    df = spark.createDataFrame([("t", "c", "odd", None)], "hypothesis_id string, method string, status string, completed_at string").withColumns({c: F.lit("") for c in ("parameters", "started_at")})
    assert schemas.any_violation(df, "research.experiment").first()["violations"] == ["status"]


def test_text_functions(spark):
    df = spark.createDataFrame([("- one\n* two",), ("plain\n\nlines",), ("",)], "t string")
    assert [r[0] for r in df.select(tx.bullets(F.col("t"))).collect()] == [["one", "two"], ["plain", "lines"], []]
