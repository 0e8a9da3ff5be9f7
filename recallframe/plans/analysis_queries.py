"""Queries on imports, further retrieval, metrics of runs, graph rules and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallframe.functions import text as tx
from recallframe.functions import vector as vec
from recallframe.operators import fusion, retrieval, sparse
from recallframe.operators import graph as gr
from recallframe.operators import metrics as mt
from recallframe.operators import sequences as sq
from recallframe.operators import sessions as se
from recallframe.plans.memory_queries import _EDGES, _F1, _HITS, _NODES, _QA, _STEPS, _SW, _by_question, _edges, _hits, _nodes, _pair, _steps, _sweep
from recallframe.plans.retrieval_queries import _CODES, _HY, _SETS, _asked, _cosine_sql, _pools, _vectors, once
from recallframe.session import cut, shared_path, table
from recallframe.sources import importers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# ------------------------------------------------------------------ imports, through files in the shared folder
_REQ = "(SELECT DISTINCT * FROM store_requests)"


def _lines(s, d, *cols):
    """A table's rows as JSON lines in a file."""
    path = shared_path(s, "import")
    once(s, d, "store_requests", "request_id").select(F.to_json(F.struct(*cols)).alias("value")).write.mode("overwrite").text(path)
    return path


@query("import_jsonl", f"SELECT trim(text, ' ') AS text, user_id FROM {_REQ} WHERE trim(text, ' ') <> ''")
def import_jsonl(s, d):
    own = importers.records(importers.jsonl(s, _lines(s, d, "text", "user_id", "bundle")), fields=["user_id"])
    return own.select("text", F.get_json_object("metadata", "$.user_id").alias("user_id"))


@query("import_wrapped", "SELECT trim(question, ' ') AS text, category FROM (SELECT DISTINCT * FROM developmental_test) WHERE trim(question, ' ') <> '' AND result_id <= 2000")
def import_wrapped(s, d):
    """One file with its records in a wrapper."""
    path = shared_path(s, "import")
    rows = F.collect_list(F.struct(F.col("question").alias("text"), "category"))  # one file
    once(s, d, "developmental_test", "result_id").where("result_id <= 2000").agg(rows.alias("items")).select(F.to_json(F.struct("items")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return importers.records(importers.json_records(s, path)).select("text", F.get_json_object("metadata", "$.category").alias("category"))


@query("import_csv", "SELECT trim(method, ' ') AS text, question_id FROM (SELECT DISTINCT * FROM qa_compare)")
def import_csv(s, d):
    path = shared_path(s, "import")
    once(s, d, "qa_compare", "prediction_id").select(F.col("method").alias("text"), "question_id").write.mode("overwrite").option("header", True).csv(path)
    return importers.records(importers.csv(s, path)).select("text", F.get_json_object("metadata", "$.question_id").alias("question_id"))


@query("import_mem0", f"SELECT trim(text, ' ') AS text, 'mem0' AS source, user_id FROM {_REQ} WHERE trim(text, ' ') <> ''")
def import_mem0(s, d):
    raw = once(s, d, "store_requests", "request_id").select(F.to_json(F.struct(F.col("text").alias("memory"), "user_id", "bundle")).alias("raw"))
    j = lambda f: F.get_json_object("metadata", f"$.{f}").alias(f)
    return importers.preset(raw, "mem0").where(j("bundle").isNull()).select("text", j("source"), j("user_id"))


@query("import_letta", f"SELECT trim(text, ' ') AS text, bundle AS source, 'inner' AS tags FROM {_REQ} WHERE trim(text, ' ') <> ''")
def import_letta(s, d):
    """Nested metadata wins over the fields around it."""
    inner = F.struct(F.col("bundle").alias("source"), F.lit("inner").alias("tags"))
    raw = once(s, d, "store_requests", "request_id").select(F.to_json(F.struct(F.col("text").alias("content"), F.lit("outer").alias("tags"), inner.alias("metadata"))).alias("raw"))
    j = lambda f: F.get_json_object("metadata", f"$.{f}").alias(f)
    return importers.preset(raw, "letta").select("text", j("source"), j("tags"))


_DEV = "(SELECT *, row_number() OVER (PARTITION BY conversation ORDER BY result_id) AS n FROM (SELECT DISTINCT * FROM developmental_test))"


def _dialogues(s, d):
    """Conversations in the form of long dialogues: a session per three rows."""
    w = Window.partitionBy("conversation").orderBy("result_id")
    own = once(s, d, "developmental_test", "result_id").withColumn("n", F.row_number().over(w)).withColumn("session", F.floor((F.col("n") - 1) / 3) + 1)
    turn = F.struct(F.lit("user").alias("speaker"), F.concat(F.lit("D"), F.col("session").cast("string"), F.lit(":"), F.col("n").cast("string")).alias("dia_id"), F.col("question").alias("text"))
    sessions = own.groupBy("conversation", "session").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n", turn.alias("t")))), lambda x: x["t"])).alias("turns"))
    named = sessions.select("conversation", F.explode(F.array(F.struct(F.concat(F.lit('"session_'), F.col("session").cast("string"), F.lit('":')).alias("k"), F.col("turns").alias("v")), F.struct(F.concat(F.lit('"session_'), F.col("session").cast("string"), F.lit('_date_time":')).alias("k"), F.lit('"May 8"').alias("v")))).alias("e"))
    conv = named.groupBy("conversation").agg(F.array_join(F.sort_array(F.collect_list(F.concat("e.k", "e.v"))), ",").alias("parts"))
    qa = own.groupBy("conversation").agg(F.to_json(F.collect_list(F.struct("question", "answer", F.lit("none").alias("adversarial_answer"), F.array("conversation").alias("evidence"), F.lit(1).alias("category")))).alias("qa"))
    path = shared_path(s, "import")
    line = F.concat(F.lit('{"sample_id":"'), F.col("conversation"), F.lit('","conversation":{"speaker_a":"a",'), F.col("parts"), F.lit('},"qa":'), F.col("qa"), F.lit("}"))
    conv.join(qa, "conversation").agg(F.concat(F.lit("["), F.array_join(F.collect_list(line), ","), F.lit("]")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return importers.locomo(s, path)


@query("load_dialogues", f"SELECT conversation AS sample_id, CAST((n - 1) // 3 + 1 AS INTEGER) AS session, 'May 8' AS date_time, 'D' || ((n - 1) // 3 + 1) || ':' || n AS dia_id, question AS text FROM {_DEV}")
def load_dialogues(s, d):
    return _dialogues(s, d)[0].select("sample_id", "session", "date_time", "dia_id", "text")


@query("load_dialogue_questions", f"SELECT conversation AS sample_id, question, coalesce(answer, 'none') AS answer, conversation AS evidence FROM {_DEV}")
def load_dialogue_questions(s, d):
    return _dialogues(s, d)[1].select("sample_id", "question", "answer", F.col("evidence")[0].alias("evidence"))


@query("load_haystacks", "SELECT CAST(answer_id AS VARCHAR) AS question_id, CAST(i - 1 AS INTEGER) AS place, hits[i].node_id AS session_id, hits[i].text AS content FROM (SELECT answer_id, hits, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT DISTINCT * FROM rag_answers) WHERE hits IS NOT NULL)")
def load_haystacks(s, d):
    """Answers' hits in the form of haystack sessions of one turn."""
    own = once(s, d, "rag_answers", "answer_id").where("hits is not null")
    turns = F.transform("hits", lambda h: F.array(F.struct(F.lit("user").alias("role"), h["text"].alias("content"))))
    item = F.struct(F.col("answer_id").cast("string").alias("question_id"), F.lit("kind").alias("question_type"), "question", F.col("text").alias("answer"), F.col("hits.node_id").alias("haystack_session_ids"), turns.alias("haystack_sessions"))
    path = shared_path(s, "import")
    # a file is read as a whole, so the lists are of bounded size
    own.select(F.to_json(item).alias("value")).mapInPandas(importers.listed, "value string").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    return importers.longmemeval(s, path)[1].select("question_id", "place", "session_id", "content")


@query("scale_corpus", """WITH w AS (SELECT ['river', 'stone', 'cloud', 'maple', 'copper', 'harbour', 'lantern', 'meadow'] AS ws), r AS (SELECT unnest(range(5000)) AS id)
SELECT id, id % 100 AS topic, printf('doc %07d about topic_%d: ', id, id % 100) || array_to_string(list_transform(range(1, 6), lambda i: ws[((id + 1) * 7919 + i * (id % 13 + 1) * 31) % 8 + 1]), ' ') AS text FROM r, w""")
def scale_corpus(s, d):
    return importers.scale_corpus(s, 5000)


@query("templated_facts", "SELECT replace(replace(t, '{who}', who), '{what}', what) AS text FROM (SELECT unnest(['{who} likes {what}', '{who} never ate {what}', '{who} slept']) AS t), (SELECT unnest(['Ann', 'Ben', 'Cleo']) AS who), (SELECT unnest(['tea', 'figs']) AS what) GROUP BY 1")
def templated_facts(s, d):
    return importers.templated(s, ["{who} likes {what}", "{who} never ate {what}", "{who} slept"], who=["Ann", "Ben", "Cleo"], what=["tea", "figs"]).select("text")


# ------------------------------------------------------------------ further retrieval
@query("reranked_by_model", f"SELECT qid, node_id AS id, before, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id) AS rank FROM (SELECT h.qid, h.node_id, h.score AS before, -abs(length(text) - length(question))::DOUBLE AS score FROM (SELECT DISTINCT ON (qid, node_id) qid, node_id, score, text FROM {_HITS} WHERE text IS NOT NULL ORDER BY qid, node_id, rank) h JOIN (SELECT DISTINCT answer_id, question FROM rag_answers) a ON a.answer_id = h.qid)) WHERE rank <= 3")
def reranked_by_model(s, d):
    """A model that likes texts as long as the question; the score before stays beside."""
    w = Window.partitionBy("qid", "node_id").orderBy("rank")
    h = _hits(s, d).where("text is not null").withColumn("r", F.row_number().over(w)).where("r = 1").select("qid", F.col("node_id").alias("id"), "score", "rank", "text")
    named = h.join(once(s, d, "rag_answers", "answer_id").select(F.col("answer_id").alias("qid"), F.col("question").alias("query")), "qid")
    scorer = lambda qs, ts: [-float(abs(len(t) - len(q))) for q, t in zip(qs, ts)]
    return fusion.scored_rerank(named, 3, scorer).select("qid", "id", "before", F.col("score") + 0.0, "rank").toDF("qid", "id", "before", "score", "rank")


@query("activation_blend", f"""WITH h AS ({_cosine_sql('true', 30)}), m AS (SELECT qid, id, round(CASE WHEN id % 3 = 0 THEN h.score ELSE 0.75::DOUBLE * h.score + 0.25::DOUBLE * list_cosine_similarity(CAST(q.embedding[1:8] AS DOUBLE[]), CAST(c.embedding[1:8] AS DOUBLE[])) END, 6) AS score FROM h JOIN embeddings q ON q.vec_id = h.qid JOIN embeddings c ON c.vec_id = h.id)
SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM m) WHERE rank <= 10""")
def activation_blend(s, d):
    """Activations are the first eight dimensions; every third entry has none."""
    v = _vectors(s, d)
    hits = retrieval.top_k(_asked(v), v.select("id", "vector"), 30)
    return fusion.activation_blend(hits, v.select(F.col("id").alias("qid"), F.slice("vector", 1, 8).alias("act")), v.where("id % 3 <> 0").select("id", F.slice("vector", 1, 8).alias("act")), 0.25, 10)


@query("query_variants", """WITH q AS (SELECT DISTINCT result_id AS qid, question FROM developmental_test WHERE question IS NOT NULL)
SELECT qid, 0 AS list, question AS text FROM q UNION ALL SELECT qid, 1, 'about ' || question FROM q WHERE qid % 2 = 0 UNION ALL SELECT qid, 2, 'once more' FROM q WHERE qid % 2 = 0 UNION ALL SELECT qid, 1, 'plain line' FROM q WHERE qid % 2 = 1""")
def query_variants(s, d):
    """A model answers in bullets for even questions, in a plain line for others."""
    q = once(s, d, "developmental_test", "result_id").where("question is not null").select(F.col("result_id").alias("qid"), "question")
    raw = F.when(F.col("qid") % 2 == 0, F.concat(F.lit("- about "), "question", F.lit("\n* \"once more\"\n"))).otherwise(F.lit("plain line"))
    return fusion.variants(q.withColumn("raw", raw), 3)


@query("alpha_grid", _HY.replace("{flt}", "true").replace("{ck}", "20").replace("{bk}", "20") + """, al AS (SELECT unnest([0.0::DOUBLE, 0.3::DOUBLE, 0.7::DOUBLE, 1.0::DOUBLE]) AS alpha),
gm AS (SELECT alpha, qid, id, round(alpha * coalesce(a, 0) + (1 - alpha) * coalesce(b, 0), 6) AS score FROM (SELECT qid, id, a, b FROM ca FULL JOIN ba USING (qid, id)), al),
gr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alpha, qid ORDER BY score DESC, id) AS rank FROM gm) WHERE rank <= 5)
SELECT alpha, count(*) AS n, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit, round(avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS rank1, round(avg(rank), 6) AS mean_rank
FROM (SELECT al.alpha, qs.qid, gr.rank FROM qs CROSS JOIN al LEFT JOIN gr ON gr.alpha = al.alpha AND gr.qid = qs.qid AND gr.id = qs.qid) GROUP BY alpha""")
def alpha_grid(s, d):
    a, b = _pools(s, d)
    gold = _vectors(s, d).join(table(s, d, "documents").select(F.col("doc_id").alias("id")), "id").where("id % 20 = 0").select(F.col("id").alias("qid"), "id")
    return fusion.alpha_grid(a, b, [0.0, 0.3, 0.7, 1.0], gold)


@query("fingerprint_topk", _cosine_sql("true", 5, "round(list_cosine_similarity(CAST(q.embedding[1:16] AS DOUBLE[]), CAST(c.embedding[1:16] AS DOUBLE[])), 6)"))
def fingerprint_topk(s, d):
    """Search by another stored vector: the first sixteen dimensions."""
    v = _vectors(s, d).withColumn("vector", F.slice("vector", 1, 16))
    return retrieval.top_k(_asked(v), v.select("id", "vector"), 5)


@query("likest_facts", f"""WITH e AS (SELECT fact_id AS id, {_SETS.replace('{x}', 'text')} AS es FROM (SELECT DISTINCT fact_id, text FROM extracted_facts)), q AS (SELECT DISTINCT result_id AS qid, {_SETS.replace('{x}', 'question')} AS qs FROM developmental_test WHERE result_id % 20 = 0),
s AS (SELECT qid, id, round(len(list_intersect(qs, es))::DOUBLE / greatest(1, len(list_distinct(list_concat(qs, es)))), 6) AS score FROM q, e) SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def likest_facts(s, d):
    facts = once(s, d, "extracted_facts", "fact_id").select(F.col("fact_id").alias("id"), "text")
    q = once(s, d, "developmental_test", "result_id").where("result_id % 20 = 0").select(F.col("result_id").alias("qid"), F.col("question").alias("text"))
    return se.likest(q, facts, 5)


@query("topology_topk", f"WITH c AS {_CODES}, s AS (SELECT q.vec_id AS qid, c.vec_id AS id, round(len(list_intersect(q.code, c.code)) / 8.0::DOUBLE, 6) AS score FROM c q, c WHERE q.vec_id % 20 = 0 AND len(list_intersect(q.code, c.code)) > 0) SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5")
def topology_topk(s, d):
    c = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), sparse.winners(F.col("embedding"), 8).alias("code"))
    return sparse.topology(c.where("id % 20 = 0").select(F.col("id").alias("qid"), "code"), c, 5)


@query("gated_adaptive", _HY.replace("{flt}", "true").replace("{ck}", "20").replace("{bk}", "20") + """, ld AS (SELECT qid, max(CASE WHEN r = 1 THEN s END) - coalesce(max(CASE WHEN r = 2 THEN s END), 0) AS lead, 0.4::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, max(s))) AS w FROM bp WHERE r <= 2 GROUP BY qid),
g AS (SELECT cp.qid, cp.id, cp.s AS score, CASE WHEN lead >= 0.05 THEN (1 - w) * cp.s + w * coalesce(bp.s, 0) ELSE cp.s END AS mx FROM cp LEFT JOIN bp USING (qid, id) LEFT JOIN ld USING (qid))
SELECT qid, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(mx, 6) DESC, id) AS rank FROM g) WHERE rank <= 5""")
def gated_adaptive(s, d):
    a, b = _pools(s, d)
    return fusion.gated(a, b, 0.4, 0.05, 5, adaptive=True)


@query("code_separation", f"WITH c AS (SELECT x.vec_id, x.code, e.label FROM {_CODES} x JOIN embeddings e USING (vec_id)), p AS (SELECT q.label = c.label AS same, len(list_intersect(q.code, c.code))::DOUBLE / len(list_distinct(list_concat(q.code, c.code))) AS j FROM c q, c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id) SELECT round(avg(j) FILTER (WHERE same), 6) AS within, round(avg(j) FILTER (WHERE NOT same), 6) AS between, round(avg(j) FILTER (WHERE same) / avg(j) FILTER (WHERE NOT same), 6) AS ratio FROM p".replace("AS between", 'AS "between"'))
def code_separation(s, d):
    c = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", sparse.winners(F.col("embedding"), 8).alias("code"))
    return sparse.separation(c.where("id % 20 = 0"), c).select(*(F.round(x, 6).alias(x) for x in ("within", "between", "ratio")))


@query("distance_scores", f"SELECT qid, id, round(1 - (1 - score), 6) AS cosine, round(1 / (1 + (1 - score)), 6) AS l2, round(score - 1, 6) AS ip FROM ({_cosine_sql('true', 3)})")
def distance_scores(s, d):
    v = _vectors(s, d)
    far = retrieval.top_k(_asked(v), v.select("id", "vector"), 3).withColumn("d", 1 - F.col("score"))
    return far.select("qid", "id", *(F.round(vec.score_of_distance(F.col("d"), k), 6).alias(k) for k in ("cosine", "l2", "ip")))


@query("vectors_in_order", "SELECT row_number() OVER (ORDER BY -vec_id) - 1 AS pos, vec_id AS id, round(embedding[1]::DOUBLE, 6) AS x FROM embeddings WHERE vec_id % 20 = 0")
def vectors_in_order(s, d):
    """Asked from the last id to the first."""
    v = _vectors(s, d)
    ids = v.where("id % 20 = 0").select((F.row_number().over(Window.orderBy(F.desc("id"))) - 1).cast("long").alias("pos"), "id")  # the asked ids
    return retrieval.get_vectors(ids, v).select("pos", "id", F.round(F.col("vector")[0].cast("double"), 6).alias("x"))


@query("knn_graph", f"SELECT least(qid, id) AS a, greatest(qid, id) AS b, max(score) AS score FROM ({_cosine_sql('q.vec_id <> c.vec_id', 5)}) GROUP BY 1, 2")
def knn_graph(s, d):
    v = _vectors(s, d)
    return retrieval.knn_graph(v.select("id", "vector"), 5, v.where("id % 20 = 0").select("id"))


@query("nearest_pattern", f"SELECT t.qid, t.id, q.label = c.label AS same FROM ({_cosine_sql('q.vec_id <> c.vec_id', 1, 'round(-list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 4)')}) t JOIN embeddings q ON q.vec_id = t.qid JOIN embeddings c ON c.vec_id = t.id")
def nearest_pattern(s, d):
    """The nearest stored pattern by Euclidean distance."""
    v = _vectors(s, d)
    near = retrieval.top_k(_asked(v), v.select("id", "vector"), 1, same=True, measure="l2", digits=4)
    return near.join(v.select(F.col("id").alias("qid"), F.col("label").alias("x")), "qid").join(v.select("id", F.col("label").alias("y")), "id").select("qid", "id", (F.col("x") == F.col("y")).alias("same"))


_ENOUGH = "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0"


@query("ann_cells_recall", _ENOUGH)
def ann_cells_recall(s, d):
    """Whether nine in ten of the exact neighbours are found by cells."""
    v = _vectors(s, d)
    index, centres = retrieval.cell_index(v, retrieval.bounded_cells(v.count()))
    exact = retrieval.top_k(_asked(v), v.select("id", "vector"), 10, same=True)
    return retrieval.recall(retrieval.cell_search(index, centres, _asked(v), 10), exact).select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query("ann_hyperplanes_recall", _ENOUGH)
def ann_hyperplanes_recall(s, d):
    """Whether nine in ten of the exact neighbours are found by signatures."""
    v = _vectors(s, d)
    index, planes = retrieval.hyperplane_index(v, 64)
    exact = retrieval.top_k(_asked(v), v.select("id", "vector"), 10, same=True)
    return retrieval.recall(retrieval.hyperplane_search(index, planes, _asked(v), 10), exact).select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query("retrieve_events", f"SELECT qid, count(*) AS hits, max(score) AS best, 10 AS k, 'cosine' AS mode FROM ({_cosine_sql()}) GROUP BY qid")
def retrieve_events(s, d):
    """One structured event per retrieval."""
    v = _vectors(s, d)
    return retrieval.top_k(_asked(v), v.select("id", "vector"), 10).groupBy("qid").agg(F.count("*").alias("hits"), F.max("score").alias("best"), F.lit(10).alias("k"), F.lit("cosine").alias("mode"))


# ------------------------------------------------------------------ metrics of runs
@query("any_evidence", f"""WITH h AS (SELECT qid, node_id AS id, rank, score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM {_HITS} WHERE CAST(floor(score * 1000) AS BIGINT) % 3 = qid % 3),
f AS (SELECT qid, min(place) AS place FROM h WHERE (qid, id) IN (SELECT qid, node_id FROM {_HITS} WHERE score < 0.85) GROUP BY qid), q AS (SELECT DISTINCT qid FROM {_HITS})
SELECT q.qid, k, CASE WHEN place <= k THEN 1 ELSE 0 END AS found FROM q CROSS JOIN (SELECT unnest([1, 3, 5]) AS k) LEFT JOIN f ON f.qid = q.qid""")
def any_evidence(s, d):
    h = _hits(s, d).select("qid", F.col("node_id").alias("id"), "rank", "score", F.pmod(F.floor(F.col("score") * 1000).cast("long"), F.lit(3)).alias("sample"))
    samples = h.select("qid", (F.col("qid") % 3).alias("sample")).distinct()
    return mt.any_evidence(h, h.where("score < 0.85"), samples)


@query("substring_recall", f"WITH q AS (SELECT DISTINCT qid, CASE qid % 3 WHEN 0 THEN 'The' WHEN 1 THEN 'und' ELSE 'GARDEN' END AS expected FROM {_HITS}) SELECT q.qid, max(CASE WHEN contains(lower(h.text), lower(expected)) THEN 1 ELSE 0 END) AS found FROM q LEFT JOIN {_HITS} h ON h.qid = q.qid AND h.rank <= 3 GROUP BY q.qid")
def substring_recall(s, d):
    h = _hits(s, d).select("qid", "rank", "text")
    word = F.when(F.col("qid") % 3 == 0, "The").when(F.col("qid") % 3 == 1, "und").otherwise("GARDEN")
    return mt.substring_recall(h, h.select("qid").distinct().withColumn("expected", word), 3)


@query("rank_histogram", f"SELECT alpha, {', '.join(f'count(*) FILTER (WHERE gold_rank = {i}) AS rank{i}' for i in range(1, 6))}, count(*) FILTER (WHERE gold_rank = 0) AS missed FROM {_SW} GROUP BY alpha")
def rank_histogram(s, d):
    n = lambda i: F.count(F.when(F.col("gold_rank") == i, 1))
    return _sweep(s, d).groupBy("alpha").agg(*(n(i).alias(f"rank{i}") for i in range(1, 6)), n(0).alias("missed"))


@query("latency_histogram", f"SELECT alpha, le, count(*) FILTER (WHERE retrieval_ms <= le) AS n FROM (SELECT alpha, retrieval_ms FROM {_SW} WHERE retrieval_ms IS NOT NULL AND NOT isnan(retrieval_ms)), (SELECT unnest([5.0::DOUBLE, 25.0::DOUBLE, 100.0::DOUBLE, 500.0::DOUBLE, 'Infinity'::DOUBLE]) AS le) GROUP BY alpha, le")
def latency_histogram(s, d):
    return mt.histogram(_sweep(s, d), "alpha", "retrieval_ms", (5.0, 25.0, 100.0, 500.0))


@query("batch_buckets", "SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 10 THEN '10' WHEN n <= 100 THEN '100' WHEN n <= 1000 THEN '1000' ELSE '1000+' END AS bucket, count(*) AS batches FROM (SELECT len(texts) AS n FROM (SELECT DISTINCT batch_id, texts FROM store_batches)) GROUP BY 1")
def batch_buckets(s, d):
    own = once(s, d, "store_batches", "batch_id")
    return own.groupBy(mt.batch_bucket(F.size("texts")).alias("bucket")).agg(F.count("*").alias("batches"))


@query("qa_accuracy", f"SELECT method, count(*) AS n, round(avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT t.method, t.a, t.b, length(coalesce(q.hypothesis, '')) // 4 AS tokens FROM {_QA} t JOIN (SELECT DISTINCT prediction_id, hypothesis FROM qa_compare) q USING (prediction_id)) GROUP BY method")
def qa_accuracy(s, d):
    own = once(s, d, "qa_compare", "prediction_id")
    right, tokens = mt.exact_match(F.col("hypothesis"), F.col("answer")).cast("double"), F.floor(F.length(F.coalesce("hypothesis", F.lit(""))) / 4)
    return own.groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.sum(tokens).cast("long").alias("tokens"))


@query("best_per_call", "SELECT question_type, method, round(q / c, 9) AS per_call FROM (SELECT *, row_number() OVER (PARTITION BY question_type ORDER BY q / c DESC, method) AS r FROM (SELECT question_type, method, avg(hit_at_k) AS q, count(*) AS c FROM (SELECT DISTINCT * FROM qa_compare) WHERE question_type IS NOT NULL GROUP BY ALL) WHERE q IS NOT NULL) WHERE r = 1")
def best_per_call(s, d):
    own = once(s, d, "qa_compare", "prediction_id").where("question_type is not null").groupBy("question_type", "method").agg(F.avg("hit_at_k").alias("quality"), F.count("*").alias("calls"))
    return mt.best_per_call(own, "question_type", "method").withColumn("per_call", F.round("per_call", 9))


_BY2 = f"(SELECT question_id, method, max(coalesce(hit_at_k, 0)) AS hit, max(f1) AS f1 FROM (SELECT q.question_id, q.method, q.hit_at_k, {_F1} AS f1 FROM (SELECT DISTINCT * FROM qa_compare) q JOIN {_QA} t USING (prediction_id)) GROUP BY ALL)"


@query("lift_shares", f"SELECT hit_a, hit_b, round(lift, 6) AS lift, round(lift / sum(lift) OVER (), 4) AS share FROM (SELECT a.hit AS hit_a, b.hit AS hit_b, sum(b.f1 - a.f1) AS lift FROM {_BY2} a JOIN {_BY2} b ON a.question_id = b.question_id WHERE a.method = 'cosine' AND b.method = 'hybrid' GROUP BY ALL)")
def lift_shares(s, d):
    own = _pair(s, d).groupBy("hit_a", "hit_b").agg(F.sum(F.col("f1_b") - F.col("f1_a")).alias("lift"))
    total = F.sum("lift").over(Window.partitionBy(F.lit(1)))  # a row per cell
    return own.select("hit_a", "hit_b", F.round("lift", 6).alias("lift"), F.round(F.col("lift") / total, 4).alias("share"))


_IDK2 = " OR ".join(f"contains(lower(trim(hypothesis)), '{p.replace(chr(39), chr(39) * 2)}')" for p in tx.UNKNOWING)
_RANKS = f"(SELECT question_id, min(CASE WHEN gold_rank > 0 THEN gold_rank END) AS rank FROM {_SW} GROUP BY question_id)"


@query("idk_by_rank", f"SELECT coalesce(rank, 0) AS gold_rank, count(*) AS n, count(*) FILTER (WHERE coalesce({_IDK2}, false)) AS idk FROM (SELECT DISTINCT prediction_id, question_id, hypothesis FROM qa_compare) JOIN {_RANKS} USING (question_id) GROUP BY 1")
def idk_by_rank(s, d):
    ranks = _sweep(s, d).groupBy("question_id").agg(F.coalesce(F.min(F.when(F.col("gold_rank") > 0, F.col("gold_rank"))), F.lit(0)).alias("gold_rank"))
    own = once(s, d, "qa_compare", "prediction_id").select("question_id", tx.unknowing(F.col("hypothesis")).alias("idk")).join(ranks, "question_id")
    return own.groupBy("gold_rank").agg(F.count("*").alias("n"), F.count(F.when(F.col("idk"), 1)).alias("idk"))


@query("idk_by_cell", f"SELECT a.hit AS hit_a, b.hit AS hit_b, count(*) AS n, count(*) FILTER (WHERE idk) AS idk FROM (SELECT question_id, coalesce({_IDK2}, false) AS idk FROM (SELECT DISTINCT prediction_id, question_id, method, hypothesis FROM qa_compare) WHERE method = 'hybrid') p JOIN {_BY2} a ON a.question_id = p.question_id AND a.method = 'cosine' JOIN {_BY2} b ON b.question_id = p.question_id AND b.method = 'hybrid' GROUP BY ALL")
def idk_by_cell(s, d):
    said = once(s, d, "qa_compare", "prediction_id").where("method = 'hybrid'").select("question_id", tx.unknowing(F.col("hypothesis")).alias("idk"))
    return said.join(_pair(s, d), "question_id").groupBy("hit_a", "hit_b").agg(F.count("*").alias("n"), F.count(F.when(F.col("idk"), 1)).alias("idk"))


@query("judge_lift", f"""WITH y AS (SELECT question_id, min(question_type) AS question_type FROM qa_compare GROUP BY 1), r AS (SELECT b.*, question_type FROM {_BY2} b JOIN y USING (question_id)), p AS (SELECT a.question_type, a.f1 AS af, a.hit AS aj, b.f1 AS bf, b.hit AS bj FROM r a JOIN r b ON a.question_id = b.question_id AND a.method = 'cosine' AND b.method = 'hybrid')
SELECT CASE WHEN grouping(question_type) = 1 THEN 'ALL' ELSE question_type END AS question_type, count(*) AS n, round(avg(af), 6) AS a_f1, round(avg(bf), 6) AS b_f1, round(avg(aj), 6) AS a_judge, round(avg(bj), 6) AS b_judge,
round(CASE WHEN avg(af) > 0 THEN (avg(bf) / avg(af) - 1) * 100 END, 4) AS f1_lift, round(CASE WHEN avg(aj) > 0 THEN (avg(bj) / avg(aj) - 1) * 100 END, 4) AS judge_lift FROM p GROUP BY GROUPING SETS ((question_type), ())""")
def judge_lift(s, d):
    kinds = once(s, d, "qa_compare", "prediction_id").groupBy("question_id").agg(F.min("question_type").alias("question_type"))
    own = _by_question(s, d).join(kinds, "question_id").withColumnRenamed("hit", "judge")
    run = lambda m: own.where(F.col("method") == m).select("question_id", "question_type", "f1", "judge")
    out = mt.judge_lift(run("cosine"), run("hybrid"))
    return out.select("question_type", "n", *(F.round(c, 6).alias(c) for c in ("a_f1", "b_f1", "a_judge", "b_judge")), F.round("f1_lift", 4).alias("f1_lift"), F.round("judge_lift", 4).alias("judge_lift"))


@query("over_seeds", f"SELECT alpha, shard, bool_and(hit_at_k = 1) AS completion, round(avg(hit_at_k), 6) AS accuracy, CAST(round_even(avg(gold_rank), 0) AS BIGINT) AS steps, max(gold_rank) AS peak FROM {_SW} WHERE hit_at_k IS NOT NULL AND gold_rank IS NOT NULL GROUP BY alpha, shard")
def over_seeds(s, d):
    runs = _sweep(s, d).where("hit_at_k is not null and gold_rank is not null").select("alpha", "shard", (F.col("hit_at_k") == 1).alias("completion"), F.col("hit_at_k").alias("accuracy"), F.col("gold_rank").alias("steps"), F.col("gold_rank").alias("peak"))
    return mt.over_seeds(runs, ["alpha", "shard"]).withColumn("accuracy", F.round("accuracy", 6))


@query("tracker_last", "SELECT event_type, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, arg_max(value, event_id) AS last, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 10 GROUP BY event_type")
def tracker_last(s, d):
    return sq.last_of(table(s, d, "events"), "event_type", "event_id", "value", 10).withColumn("mean", F.round("mean", 6))


# ------------------------------------------------------------------ graph rules
@query("active_edges", f"SELECT source_id, target_id FROM {_EDGES} WHERE last_active_step >= 20000 - 8000")
def active_edges(s, d):
    return gr.active(_edges(s, d), 20000, 8000).select("source_id", "target_id")


@query("shape_buckets", f"SELECT node_type, coalesce(ins, 0) AS ins, coalesce(outs, 0) AS outs, count(*) AS nodes FROM {_NODES} n LEFT JOIN (SELECT source_id AS id, count(*) AS outs FROM {_EDGES} GROUP BY 1) o ON o.id = n.id LEFT JOIN (SELECT target_id AS id, count(*) AS ins FROM {_EDGES} GROUP BY 1) i ON i.id = n.id GROUP BY ALL")
def shape_buckets(s, d):
    sized = _nodes(s, d).join(gr.degrees(_edges(s, d)), "id", "left").fillna(0, ["ins", "outs"])
    return gr.shapes(sized, "node_type", "ins", "outs")


_XY = "(SELECT c_custkey AS id, c_acctbal / 100 AS x, (c_custkey * 37 % 1000) / 10.0::DOUBLE AS y, round(abs(c_acctbal) / 10000, 6) AS m FROM customer)"


@query("edge_births", f"SELECT a.id AS source_id, b.id AS target_id, round(least(1.0::DOUBLE, a.m * b.m * exp(-sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 0.5::DOUBLE) * 0.8::DOUBLE), 6) AS p FROM {_XY} a JOIN {_XY} b ON a.id <> b.id WHERE a.m > 0.2 AND b.m > 0.2 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 1.0 AND (a.id + b.id) % 5 <> 0 AND least(1.0::DOUBLE, a.m * b.m * exp(-sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 0.5::DOUBLE) * 0.8::DOUBLE) > 0")
def edge_births(s, d):
    """Customers in a plane; pairs whose numbers add up to a multiple of five lack the evidence or have an edge."""
    n = table(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).cast("double").alias("x"), ((F.col("c_custkey") * 37 % 1000) / 10.0).alias("y"), F.round(F.abs("c_acctbal") / 10000, 6).alias("magnitude"))
    none = n.select(F.col("id").alias("source_id"), F.col("id").alias("target_id")).limit(0)
    found = gr.births(n, none, 0.5, 0.8, 1.0, 0.2)
    again = gr.births(n, found.where("(source_id + target_id) % 5 = 0 and source_id < target_id").select("source_id", "target_id"), 0.5, 0.8, 1.0, 0.2, found.where("(source_id + target_id) % 5 = 0").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct())
    return again.withColumn("p", F.round("p", 6))


@query("newcomer_edges", """WITH t AS (SELECT vec_id, embedding FROM embeddings ORDER BY vec_id % 97 DESC, vec_id LIMIT 10), c AS (SELECT list(m ORDER BY pos) AS centre FROM (SELECT pos, avg(x) AS m FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(64)) AS pos FROM t) GROUP BY pos)),
n AS (SELECT vec_id FROM embeddings, c ORDER BY round(list_distance(CAST(embedding AS DOUBLE[]), centre), 9), vec_id LIMIT 5) SELECT vec_id AS source_id, CAST(-1 AS BIGINT) AS target_id FROM n UNION ALL SELECT CAST(-1 AS BIGINT), vec_id FROM n""")
def newcomer_edges(s, d):
    v = _vectors(s, d).withColumn("ema", F.col("id") % 97)
    return gr.newcomer(v, -1)


_GRADED = f"(SELECT source_id, target_id, (source_id % 10) / 10.0::DOUBLE AS strength, source_id AS creation_step FROM {_STEPS} WHERE target_id IS NOT NULL)"
_CHAINS = f"""e AS {_GRADED}, one AS (SELECT source_id AS id FROM e WHERE source_id IN (SELECT target_id FROM e)), i AS (SELECT * FROM e WHERE source_id IN (SELECT id FROM one) AND target_id IN (SELECT id FROM one)),
st AS (SELECT id FROM one WHERE id NOT IN (SELECT target_id FROM i)),
ch AS (SELECT st.id AS start, list_filter([st.id, a.target_id, b.target_id, c.target_id], lambda x: x IS NOT NULL) AS nodes FROM st JOIN i a ON a.source_id = st.id LEFT JOIN i b ON b.source_id = a.target_id LEFT JOIN i c ON c.source_id = b.target_id),
pl AS (SELECT start, len(nodes) AS n, unnest(nodes) AS node, unnest(range(len(nodes))) AS pos FROM ch),
ripe AS (SELECT p.start FROM pl p JOIN pl q ON q.start = p.start AND q.pos = p.pos + 1 JOIN e ON e.source_id = p.node AND e.target_id = q.node GROUP BY p.start HAVING bool_and(strength > 0.15 AND 30000 - creation_step > 10000))"""


def _graded(s, d):
    return _steps(s, d).select("source_id", "target_id", ((F.col("source_id") % 10) / 10.0).alias("strength"), F.col("source_id").alias("creation_step"), F.col("target_id").alias("last_active_step"))


@query("ripe_chains", f"WITH {_CHAINS} SELECT start, CAST(len(nodes) AS INTEGER) AS n FROM ch WHERE start IN (SELECT start FROM ripe)")
def ripe_chains(s, d):
    e = _graded(s, d)
    return gr.ripe(e, gr.chains(e), 30000, 0.15).select("start", F.size("nodes").alias("n"))


@query("compressed_edges", f"""WITH {_CHAINS}, rp AS (SELECT * FROM pl WHERE start IN (SELECT start FROM ripe)),
j AS (SELECT e.source_id, e.target_id, a.start AS ss, a.pos = a.n - 1 AS sl, b.start AS ts, b.pos = 0 AS tf FROM e LEFT JOIN rp a ON a.node = e.source_id LEFT JOIN rp b ON b.node = e.target_id)
SELECT DISTINCT coalesce(ss, source_id) AS source_id, coalesce(ts, target_id) AS target_id FROM j WHERE NOT (ss IS NOT NULL AND ss IS NOT DISTINCT FROM ts) AND (ss IS NULL OR sl) AND (ts IS NULL OR tf)""")
def compressed_edges(s, d):
    e = cut(_graded(s, d))
    return gr.compressed(e, gr.ripe(e, gr.chains(e), 30000, 0.15))


@query("back_edges", "SELECT user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS component, max(event_id) AS source_id, min(event_id) AS target_id FROM events GROUP BY 1 HAVING count(*) > 1")
def back_edges(s, d):
    """Each day's steps in a circle: the last leads back to the first."""
    w = Window.partitionBy("user_id", F.to_date("ts"))
    e = table(s, d, "events").select(F.concat_ws("/", "user_id", F.to_date("ts").cast("string")).alias("component"), F.col("event_id").alias("source_id"), F.coalesce(F.lead("event_id").over(w.orderBy("event_id")), F.min("event_id").over(w)).alias("target_id"))
    return gr.back_edges(e.where("source_id <> target_id"))


@query("message_sums", f"SELECT target_id AS id, pos, round(sum(weight * x), 6) AS total FROM {_EDGES} JOIN (SELECT id, unnest([activation, activation * activation]) AS x, unnest([0, 1]) AS pos FROM {_NODES}) ON id = source_id GROUP BY target_id, pos".replace("SELECT target_id AS id", "SELECT target_id AS id").replace("ON id = source_id", "n ON n.id = source_id"))
def message_sums(s, d):
    act = _nodes(s, d).select("id", F.array("activation", F.col("activation") * F.col("activation")).alias("vector"))
    return gr.messages(_edges(s, d), act).select("id", "pos", F.round("total", 6).alias("total"))


@query("old_episodes", "SELECT event_id AS id FROM events WHERE 110000 - event_id > 100000 AND CAST(json_extract_string(props, '$.k') AS BIGINT) >= 5")
def old_episodes(s, d):
    own = table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("step"), F.get_json_object("props", "$.k").cast("long").alias("replays"))
    return gr.old_episodes(own, 110000).select("id")


@query("episodic_topk", _cosine_sql("c.vec_id % 7 <> 0", 5))
def episodic_topk(s, d):
    """Only valid episodes are retrieved."""
    v = _vectors(s, d)
    return retrieval.top_k(_asked(v), v.where("id % 7 <> 0").select("id", "vector"), 5)


_SLOTS = "(SELECT vec_id AS slot, CAST(embedding AS DOUBLE[]) AS vector, (vec_id * 3 % 8) / 10.0::DOUBLE AS usage, 0 AS age FROM embeddings WHERE vec_id < 8)"


def _slots(s, d):
    return _vectors(s, d).where("id < 8").select(F.col("id").alias("slot"), "vector", ((F.col("id") * 3 % 8) / 10.0).alias("usage"), F.lit(0).alias("age"))


@query("memory_read", f"WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 9), e AS (SELECT vector, exp(list_inner_product(vector, q) / 8.0::DOUBLE) AS e FROM {_SLOTS}, q) SELECT CAST(pos AS INTEGER) AS pos, round(sum(e * x) / sum(e), 6) AS value FROM (SELECT e, unnest(vector) AS x, unnest(range(64)) AS pos FROM e) GROUP BY pos")
def memory_read(s, d):
    probe = _vectors(s, d).where("id = 9").first()["vector"]
    return gr.read_slots(_slots(s, d), list(probe)).withColumn("value", F.round("value", 6))


@query("memory_step", f"WITH l AS (SELECT arg_min(slot, (usage, slot)) AS least FROM {_SLOTS}), w AS (SELECT slot, CASE WHEN slot = least THEN list_transform(range(64), lambda i: 1.0::DOUBLE) ELSE vector END AS vector, CASE WHEN slot = least THEN 1.0::DOUBLE ELSE usage END AS usage, age FROM {_SLOTS}, l) SELECT slot, round(usage * 0.99::DOUBLE, 6) AS usage, CAST(age + 1 AS INTEGER) AS age, round(vector[1] * CASE WHEN usage * 0.99::DOUBLE < 0.25 THEN 0.9::DOUBLE ELSE 1 END, 6) AS first FROM w")
def memory_step(s, d):
    """A write to the least used slot, then one step of decay."""
    out = gr.step_slots(gr.write_slot(_slots(s, d), [1.0] * 64, True), threshold=0.25)
    return out.select("slot", F.round("usage", 6).alias("usage"), "age", F.round(F.col("vector")[0], 6).alias("first"))


@query("memory_occupancy", f"SELECT round(avg(CASE WHEN usage >= 0.3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS occupancy FROM {_SLOTS}")
def memory_occupancy(s, d):
    return gr.occupancy(_slots(s, d), 0.3).withColumn("occupancy", F.round("occupancy", 6))


_ATT = "SELECT list(v ORDER BY pos) AS q FROM (SELECT pos, sum(e * x) / sum(e) AS v FROM (SELECT e, unnest(x) AS x, unnest(range(64)) AS pos FROM (SELECT CAST(embedding AS DOUBLE[]) AS x, exp(4 * list_inner_product(CAST(embedding AS DOUBLE[]), q)) AS e FROM embeddings, {p})) GROUP BY pos)"


@query("modern_recall", f"WITH a AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 3), b AS ({_ATT.replace('{p}', 'a')}), c AS ({_ATT.replace('{p}', 'b')}) SELECT CAST(pos AS INTEGER) AS pos, round(v, 6) AS value FROM (SELECT unnest(q) AS v, unnest(range(64)) AS pos FROM c)")
def modern_recall(s, d):
    v = _vectors(s, d).select("id", "vector")
    return gr.modern_recall(v, list(v.where("id = 3").first()["vector"]), 4.0, 2).withColumn("value", F.round("value", 6))


@query("inhibited_events", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r <= greatest(3, floor(n * 0.1::DOUBLE))")
def inhibited_events(s, d):
    return gr.inhibited(table(s, d, "events"), ["user_id"], key="event_id").select("event_id")


@query("growth_journal", f"SELECT kind, count(*) AS n, min(step) AS first FROM (SELECT 'pruned' AS kind, last_active_step AS step FROM {_EDGES} WHERE 20000 - creation_step >= 2000 AND strength < 0.0003 AND 20000 - last_active_step > 8000 UNION ALL SELECT 'active', last_active_step FROM {_EDGES} WHERE last_active_step >= 12000) GROUP BY kind")
def growth_journal(s, d):
    e = _edges(s, d)
    entry = lambda rows: rows.select(F.col("last_active_step").alias("step"), F.concat_ws(">", "source_id", "target_id").alias("entry"))
    return gr.journal(pruned=entry(e.where(gr.weak(20000, strength=0.0003, idle=8000))), active=entry(gr.active(e, 20000, 8000))).groupBy("kind").agg(F.count("*").alias("n"), F.min("step").alias("first"))


@query("curriculum_shares", "SELECT event_id, round(CASE WHEN event_id < 1000 THEN 0.75 WHEN event_id < 5000 THEN 0.5 WHEN event_id < 9000 THEN 0.2 END, 6)::DOUBLE AS text_share FROM events")
def curriculum_shares(s, d):
    windows = [(0, 1000, {"text": 3.0, "audio": 1.0}), (1000, 5000, {"text": 1.0, "audio": 1.0}), (5000, 9000, {"text": 0.2, "audio": 0.8})]
    return table(s, d, "events").select("event_id", F.round(sq.by_step(F.col("event_id"), windows)["text"], 6).alias("text_share"))


@query("regimes", "SELECT event_id, CASE WHEN event_id < 2000 THEN 0 WHEN event_id < 5000 THEN 1 ELSE 2 END AS regime FROM events")
def regimes(s, d):
    return table(s, d, "events").select("event_id", sq.regime(F.col("event_id"), [2000, 3000, 1000]).alias("regime"))


@query("upkeep_cycle", f"""WITH {_CHAINS.replace('strength > 0.15', 'strength > 0.5')}, rp AS (SELECT * FROM pl WHERE start IN (SELECT start FROM ripe)),
j AS (SELECT e.source_id, e.target_id, a.start AS ss, a.pos = a.n - 1 AS sl, b.start AS ts, b.pos = 0 AS tf FROM e LEFT JOIN rp a ON a.node = e.source_id LEFT JOIN rp b ON b.node = e.target_id)
SELECT (SELECT count(*) FROM e) AS kept, (SELECT count(*) FROM ripe) AS merged, (SELECT count(*) FROM (SELECT DISTINCT coalesce(ss, source_id), coalesce(ts, target_id) FROM j WHERE NOT (ss IS NOT NULL AND ss IS NOT DISTINCT FROM ts) AND (ss IS NULL OR sl) AND (ts IS NULL OR tf))) AS edges, (SELECT least(32, count(*)) FROM events WHERE value > 0) AS replayed, CAST(0 AS BIGINT) AS gone""")
def upkeep_cycle(s, d):
    """A whole cycle on each day's steps: nothing is idle long enough to go at this step."""
    e, ev = _graded(s, d), table(s, d, "events")
    nodes = ev.select(F.col("event_id").alias("id"), F.lit("associator").alias("node_type"))
    episodes = ev.select(F.col("event_id").alias("id"), F.col("event_id").alias("step"), F.col("value").alias("surprise"), F.lit(9).alias("replays"))
    c = gr.consolidated(nodes, e, episodes, 30000, idle=100_000)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(c["kept"], "kept").crossJoin(n(c["merged"], "merged")).crossJoin(n(c["edges"], "edges")).crossJoin(n(c["replayed"], "replayed")).crossJoin(n(c["gone"], "gone"))  # one row each


# ------------------------------------------------------------------ sequences
_DAY = "(SELECT user_id, CAST(ts AS DATE) AS day, value, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS n FROM events)"


@query("loss_statistics", f"""WITH d AS {_DAY}, m AS (SELECT *, sum(0.1::DOUBLE * value * pow(0.9::DOUBLE, -i)) OVER (PARTITION BY user_id, day ORDER BY i) * pow(0.9::DOUBLE, i) AS mean FROM d), p AS (SELECT *, coalesce(lag(mean) OVER (PARTITION BY user_id, day ORDER BY i), 0) AS before FROM m)
SELECT user_id, day, round(max(CASE WHEN i = n THEN mean END) + 1e-9, 4) AS mean, round(sum(0.1::DOUBLE * pow(value - before, 2) * pow(0.9::DOUBLE, n - i)) + 1e-9, 3) AS variance FROM p GROUP BY user_id, day""")
def loss_statistics(s, d):
    e = table(s, d, "events").withColumn("day", F.to_date("ts"))
    return e.groupBy("user_id", "day").agg(sq.loss_statistics(sq.blocks(e, [], "event_id", F.col("value")), 0.9).alias("s")).select("user_id", "day", F.round(F.col("s.mean") + 1e-9, 4).alias("mean"), F.round(F.col("s.variance") + 1e-9, 3).alias("variance"))


@query("pair_average", f"SELECT user_id, day, round(sum(0.1::DOUBLE * value * pow(0.9::DOUBLE, n - i)) + 1e-9, 4) AS e FROM {_DAY} GROUP BY user_id, day")
def pair_average(s, d):
    e = table(s, d, "events").withColumn("day", F.to_date("ts"))
    return e.groupBy("user_id", "day").agg(F.round(sq.pair_average(sq.blocks(e, [], "event_id", F.col("value")), 0.9) + 1e-9, 4).alias("e"))


@query("live_revocations", "SELECT 'j' || user_id AS jti, max(event_id) AS exp FROM events WHERE event_id > 5000 AND event_id % 11 <> 0 GROUP BY user_id")
def live_revocations(s, d):
    """Every eleventh line of the list is torn."""
    line = F.to_json(F.struct(F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("jti"), F.col("event_id").alias("exp")))
    return sq.live_revocations(table(s, d, "events").select(F.when(F.col("event_id") % 11 == 0, F.substring(line, 1, 9)).otherwise(line).alias("raw")), 5000)
