"""Queries on texts, filters, vectors, words and their blends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallframe.functions import text as tx
from recallframe.functions import vector as vec
from recallframe.functions import where as wh
from recallframe.operators import fusion, lexical, retrieval, sparse
from recallframe.plans.planner import Retriever
from recallframe.session import cut, table
from recallframe.sources import chunker, importers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def once(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    """A table's records, each delivery once."""
    return table(spark, d, name).dropDuplicates([key])


# ------------------------------------------------------------------ texts
@query("tokenize", "SELECT doc_id, CAST(len(ts) AS INTEGER) AS n_tokens, CAST(len(list_distinct(ts)) AS INTEGER) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM documents WHERE text IS NOT NULL)")
def tokenize(s, d):
    own = table(s, d, "documents").where("text is not null").select("doc_id", tx.tokens(F.col("text")).alias("ts"))
    return own.select("doc_id", F.size("ts").alias("n_tokens"), F.size(F.array_distinct("ts")).alias("n_distinct"))


@query("answer_normalise", r"""SELECT prediction_id, trim(regexp_replace(translate(lower(coalesce(hypothesis, '')), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS norm
FROM (SELECT DISTINCT * FROM qa_compare)""")
def answer_normalise(s, d):
    return once(s, d, "qa_compare", "prediction_id").select("prediction_id", tx.normal_answer(F.col("hypothesis")).alias("norm"))


@query("word_set_size", r"SELECT doc_id, CAST(len(list_distinct(list_filter(string_split_regex(lower(text), '[ \t\n\r\f\v]+'), lambda w: w <> ''))) AS INTEGER) AS n FROM documents WHERE text IS NOT NULL")
def word_set_size(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.size(tx.word_set(F.col("text"))).alias("n"))


@query("paragraph_windows", """SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(least(1000, length(text) - s) AS INTEGER) AS n FROM (
SELECT doc_id, text, unnest(CASE WHEN length(text) <= 1000 THEN [0] ELSE range(0, length(text) - 120, 880) END) AS s FROM documents WHERE text IS NOT NULL)""")
def paragraph_windows(s, d):
    own = table(s, d, "documents").where("text is not null").select("doc_id", F.explode(tx.windows(F.col("text"))).alias("w"))
    return own.select("doc_id", F.col("w.start").alias("start"), F.length("w.piece").alias("n"))


@query("markdown_chunks")
def markdown_chunks(s, d):
    return chunker.chunk(table(s, d, "documents"))


@query("turn_format", "SELECT result_id, '[' || coalesce(category, 'other') || '] [' || conversation || '] user: ' || question AS line FROM (SELECT DISTINCT * FROM developmental_test) WHERE question IS NOT NULL")
def turn_format(s, d):
    own = once(s, d, "developmental_test", "result_id").where("question is not null")
    return own.select("result_id", F.format_string("[%s] [%s] user: %s", F.coalesce("category", F.lit("other")), "conversation", "question").alias("line"))


@query("session_flatten", """SELECT user_id, day, '[Session date: ' || CAST(day AS VARCHAR) || ']' || chr(10) || turns AS session FROM (
SELECT user_id, CAST(sent_at AS DATE) AS day, string_agg('user: ' || text, chr(10) ORDER BY timestamp_step, request_id) AS turns
FROM (SELECT DISTINCT * FROM store_requests) WHERE user_id IS NOT NULL AND text IS NOT NULL GROUP BY user_id, CAST(sent_at AS DATE))""")
def session_flatten(s, d):
    own = once(s, d, "store_requests", "request_id").where("user_id is not null and text is not null").withColumn("day", F.to_date("sent_at"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("timestamp_step", "request_id", "text"))), lambda t: F.concat(F.lit("user: "), t["text"]))
    # a user's day is a bounded group
    return own.groupBy("user_id", "day").agg(F.concat(F.lit("[Session date: "), F.first("day").cast("string"), F.lit("]\n"), F.array_join(turns, "\n")).alias("session"))


@query("bullet_items", r"""WITH l AS (SELECT prediction_id, string_split_regex(hypothesis, '\r?\n') AS ls FROM (SELECT DISTINCT * FROM qa_compare) WHERE hypothesis IS NOT NULL),
m AS (SELECT prediction_id, ls, list_filter(list_transform(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•]\s*(.+?)\s*$')), lambda x: trim(trim(trim(regexp_extract(x, '^\s*[-*•]\s*(.+?)\s*$', 1), ' '), '"'), '''')), lambda x: x <> '') AS b FROM l)
SELECT prediction_id, array_to_string(CASE WHEN len(b) > 0 THEN b ELSE list_transform(list_filter(list_transform(ls, lambda x: trim(x, ' ')), lambda x: x <> '' AND length(x) < 200), lambda x: trim(trim(x, '"'), '''')) END, '|') AS items FROM m""")
def bullet_items(s, d):
    return once(s, d, "qa_compare", "prediction_id").where("hypothesis is not null").select("prediction_id", F.array_join(tx.bullets(F.col("hypothesis")), "|").alias("items"))


_IDK = " OR ".join(f"contains(lower(trim(hypothesis)), '{p.replace(chr(39), chr(39) * 2)}')" for p in tx.UNKNOWING)


@query("idk_rate", f"SELECT method, count(*) AS n, round(avg(CASE WHEN coalesce({_IDK}, false) THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate FROM (SELECT DISTINCT * FROM qa_compare) GROUP BY method")
def idk_rate(s, d):
    return once(s, d, "qa_compare", "prediction_id").groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg(tx.unknowing(F.col("hypothesis")).cast("double")), 6).alias("rate"))


@query("verdicts", "SELECT result_id, CASE WHEN starts_with(lower(trim(answer)), 'no') OR answer IS NULL THEN 0 WHEN starts_with(lower(trim(answer)), 'yes') THEN 1 ELSE 0 END AS verdict FROM (SELECT DISTINCT * FROM developmental_test)")
def verdicts(s, d):
    return once(s, d, "developmental_test", "result_id").select("result_id", tx.verdict(F.col("answer")).alias("verdict"))


@query("judge_json", "SELECT prediction_id, coalesce(hit_at_k = 1 AND prediction_id % 5 <> 0, false) AS matched FROM (SELECT DISTINCT * FROM qa_compare)")
def judge_json(s, d):
    """Fenced and bare replies; every fifth is no JSON."""
    match = F.concat(F.lit("{\"match\": "), F.when(F.col("hit_at_k") == 1, "true").otherwise("\"false\""), F.lit("}"))
    p = F.col("prediction_id") % 5
    raw = F.when(p == 0, "it does match: true").when(p == 1, match).otherwise(F.concat(F.lit("```json\n"), match, F.lit("\n```")))
    return once(s, d, "qa_compare", "prediction_id").select("prediction_id", tx.judged(raw).alias("matched"))


@query("display_line", "SELECT request_id, CASE WHEN length(l) > 80 THEN substr(l, 1, 79) || '…' ELSE l END AS line FROM (SELECT request_id, trim(replace(text, chr(10), ' '), ' ') AS l FROM (SELECT DISTINCT * FROM store_requests))")
def display_line(s, d):
    return once(s, d, "store_requests", "request_id").select("request_id", tx.shortened(F.col("text")).alias("line"))


@query("token_windows", """SELECT doc_id, CAST(s AS INTEGER) AS start FROM (SELECT doc_id, unnest(range(0, n - 64 - 8 + 1, 32)) AS s FROM (
SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM documents WHERE text IS NOT NULL) WHERE n >= 72)""")
def token_windows(s, d):
    ids = table(s, d, "documents").where("text is not null").select("doc_id", F.transform(tx.tokens(F.col("text")), lambda t: F.hash(t)).alias("ids"))
    return importers.token_windows(ids, 64, 8, 32).select("doc_id", "start")


@query("import_records", "SELECT trim(text, ' ') AS text, user_id FROM (SELECT DISTINCT * FROM store_requests) WHERE trim(text, ' ') <> ''")
def import_records(s, d):
    raw = once(s, d, "store_requests", "request_id").select(F.to_json(F.struct("request_id", "text", "user_id")).alias("raw"))
    return importers.records(raw).select("text", F.get_json_object("metadata", "$.user_id").alias("user_id"))


@query("import_preset", "SELECT trim(text, ' ') AS text, 'zep' AS source, 'user' AS role FROM (SELECT DISTINCT * FROM store_requests) WHERE trim(text, ' ') <> ''")
def import_preset(s, d):
    raw = once(s, d, "store_requests", "request_id").select(F.to_json(F.struct(F.col("text").alias("content"), F.lit("user").alias("role"))).alias("raw"))
    return importers.preset(raw, "zep").select("text", F.get_json_object("metadata", "$.source").alias("source"), F.get_json_object("metadata", "$.role").alias("role"))


@query("embedding_cache", "SELECT DISTINCT sha256(text) AS sha, length(text) % 2 = 0 AS held FROM extracted_facts WHERE text IS NOT NULL")
def embedding_cache(s, d):
    """Which vectors came from the cache (those of one place) and which were made."""
    texts = table(s, d, "extracted_facts").where("text is not null").select("text")
    mark = F.array(F.lit(9.0)).cast("array<float>")
    held = texts.where("length(text) % 2 = 0").select(F.sha2("text", 256).alias("sha")).distinct().withColumn("vector", mark)
    return importers.cached_embeddings(texts, held, importers.hashed_embedding).select("sha", (F.size("vector") == 1).alias("held"))


# ------------------------------------------------------------------ filters
def _requests(s, d):
    return once(s, d, "store_requests", "request_id").select("request_id", "metadata")


_J = "(SELECT request_id, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.lang') END AS lang, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.source') END AS source, CASE WHEN json_valid(metadata) THEN TRY_CAST(json_extract_string(metadata, '$.turn') AS DOUBLE) END AS turn FROM (SELECT DISTINCT * FROM store_requests))"
for _name, _where, _sql in (
    ("where_eq", {"lang": "en"}, "lang = 'en'"),
    ("where_ne", {"lang": {"$ne": "en"}}, "lang IS NOT NULL AND lang <> 'en'"),
    ("where_range", {"turn": {"$gte": 5, "$lt": 20}}, "turn >= 5 AND turn < 20"),
    ("where_in", {"lang": {"$in": ["de", "fr"]}}, "lang IN ('de', 'fr')"),
    ("where_nin", {"lang": {"$nin": ["de", "fr"]}}, "lang IS NULL OR lang NOT IN ('de', 'fr')"),
    ("where_null", {"lang": None}, "lang IS NULL"),
    ("where_mixed", {"lang": "en", "turn": {"$gt": 3}}, "lang = 'en' AND turn > 3"),
    ("where_type_mismatch", {"source": {"$ne": 3}}, "source IS NOT NULL"),
    ("where_empty", {"lang": {}}, "true"),
):
    query(_name, f"SELECT request_id FROM {_J} WHERE {_sql}")(lambda s, d, w=_where: _requests(s, d).where(wh.compile_where(w, F.col("metadata"))).select("request_id"))


@query("metadata_key_counts", "SELECT k AS key, count(*) AS n FROM (SELECT unnest(json_keys(metadata)) AS k FROM (SELECT DISTINCT * FROM store_requests) WHERE metadata IS NOT NULL AND json_valid(metadata)) GROUP BY k")
def metadata_key_counts(s, d):
    return _requests(s, d).select(F.explode(F.json_object_keys("metadata")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("type_glob", "SELECT doc_id FROM documents WHERE doc_type LIKE 'n%' OR doc_type LIKE '%at'")
def type_glob(s, d):
    return table(s, d, "documents").where(wh.type_glob(F.col("doc_type"), ["n*", "*at"])).select("doc_id")


@query("text_matches", "SELECT request_id FROM (SELECT DISTINCT * FROM store_requests) WHERE contains(lower(text), 'password')")
def text_matches(s, d):
    return once(s, d, "store_requests", "request_id").where(F.contains(F.lower("text"), F.lit("password"))).select("request_id")


@query("prefix_match", "SELECT substr(node_id, 1, 3) AS prefix, count(DISTINCT node_id) AS n, count(DISTINCT node_id) = 1 AS clear FROM extracted_facts WHERE starts_with(node_id, 'a') GROUP BY 1")
def prefix_match(s, d):
    own = table(s, d, "extracted_facts").where(F.startswith("node_id", F.lit("a")))
    return own.groupBy(F.substring("node_id", 1, 3).alias("prefix")).agg(F.countDistinct("node_id").alias("n")).withColumn("clear", F.col("n") == 1)


# ------------------------------------------------------------------ vectors; the query set is every id divisible by 20
def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _asked(v):
    return v.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")


_S = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6)"


def _cosine_sql(extra: str = "true", k: int = 10, measure: str = _S) -> str:
    return f"""SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
SELECT q.vec_id AS qid, c.vec_id AS id, {measure} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND ({extra}))) WHERE rank <= {k}"""


@query("cosine_topk", _cosine_sql())
def cosine_topk(s, d):
    v = _vectors(s, d)
    return retrieval.top_k(_asked(v), v.select("id", "vector"), 10)


@query("related_knn", _cosine_sql("q.vec_id <> c.vec_id", 5))
def related_knn(s, d):
    v = _vectors(s, d)
    return retrieval.related(v.where("id % 20 = 0").select("id"), v.select("id", "vector"), 5)


@query("search_subset", _cosine_sql("c.label = 3", 5))
def search_subset(s, d):
    v = _vectors(s, d)
    return retrieval.top_k(_asked(v), v.join(v.where("label = 3").select("id"), "id", "left_semi").select("id", "vector"), 5)


@query("search_exclude", _cosine_sql("c.label <> 0", 5))
def search_exclude(s, d):
    v = _vectors(s, d)
    return retrieval.top_k(_asked(v), v.join(v.where("label = 0").select("id"), "id", "left_anti").select("id", "vector"), 5)


@query("l2_nearest", _cosine_sql("true", 5, "round(-list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 4)"))
def l2_nearest(s, d):
    v = _vectors(s, d)
    near = retrieval.top_k(_asked(v), v.select("id", "vector"), 5, measure="l2", digits=4)
    return near.withColumn("score", F.col("score") + 0.0)


@query("nearest_label", f"""SELECT round(avg(CASE WHEN q.label = c.label THEN 1.0::DOUBLE ELSE 0 END), 6) AS agreement, count(*) AS n FROM ({_cosine_sql('q.vec_id <> c.vec_id', 1)}) t JOIN embeddings q ON q.vec_id = t.qid JOIN embeddings c ON c.vec_id = t.id""")
def nearest_label(s, d):
    v = _vectors(s, d)
    near = retrieval.top_k(_asked(v), v.select("id", "vector"), 1, same=True)
    labels = near.join(v.select(F.col("id").alias("qid"), F.col("label").alias("a")), "qid").join(v.select("id", F.col("label").alias("b")), "id")
    return labels.agg(F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("agreement"), F.count("*").alias("n"))


@query("topic_purity", f"""SELECT t.qid, round(avg(CASE WHEN q.label = c.label THEN 1.0::DOUBLE ELSE 0 END), 6) AS purity FROM ({_cosine_sql('q.vec_id <> c.vec_id', 5)}) t JOIN embeddings q ON q.vec_id = t.qid JOIN embeddings c ON c.vec_id = t.id GROUP BY t.qid""")
def topic_purity(s, d):
    v = _vectors(s, d)
    near = retrieval.top_k(_asked(v), v.select("id", "vector"), 5, same=True)
    labels = near.join(v.select(F.col("id").alias("qid"), F.col("label").alias("a")), "qid").join(v.select("id", F.col("label").alias("b")), "id")
    return labels.groupBy("qid").agg(F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("purity"))


@query("get_vectors", "SELECT vec_id AS id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings WHERE vec_id % 20 = 0")
def get_vectors(s, d):
    return _vectors(s, d).where("id % 20 = 0").select("id", F.round(vec.norm(F.col("vector")), 6).alias("norm"))


@query("ann_hyperplanes")
def ann_hyperplanes(s, d):
    v = _vectors(s, d)
    index, planes = retrieval.hyperplane_index(v, 64)
    return retrieval.hyperplane_search(index, planes, _asked(v), 10)


@query("ann_cells")
def ann_cells(s, d):
    v = _vectors(s, d)
    index, centres = retrieval.cell_index(v, retrieval.bounded_cells(v.count()))
    return retrieval.cell_search(index, centres, _asked(v), 10, probes=6)


@query("ann_recall")
def ann_recall(s, d):
    v = _vectors(s, d)
    index, centres = retrieval.cell_index(v, retrieval.bounded_cells(v.count()))
    exact = retrieval.top_k(_asked(v), v.select("id", "vector"), 10, same=True)
    return retrieval.recall(retrieval.cell_search(index, centres, _asked(v), 10, probes=6), exact)


# ------------------------------------------------------------------ words
_DOCS = "(SELECT doc_id AS doc, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ts FROM documents)"
_BM25 = f"""WITH docs AS {_DOCS}, st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM docs),
p AS (SELECT doc, term, count(*) AS f, any_value(dl) AS dl FROM (SELECT doc, len(ts) AS dl, unnest(ts) AS term FROM docs) GROUP BY doc, term),
t AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (SELECT term, df, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) AS idf FROM t, st),
asked AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(regexp_extract_all(lower(q), '[a-z0-9]+')) AS term FROM qs) GROUP BY ALL),
sc AS (SELECT qid, doc, round(sum(qtf * idf * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(1.0::DOUBLE, avgdl)))), 6) AS s FROM asked JOIN i USING (term) JOIN p USING (term), st GROUP BY qid, doc)"""


def _questions(s, d):
    return once(s, d, "developmental_test", "result_id").where("result_id % 20 = 0 and question is not null").select(F.col("result_id").alias("qid"), F.col("question").alias("q"))


_QS = "(SELECT DISTINCT result_id AS qid, question AS q FROM developmental_test WHERE result_id % 20 = 0 AND question IS NOT NULL)"


@query("bm25_stats", f"SELECT count(*) AS n, round(avg(len(ts)), 6) AS avgdl FROM {_DOCS}")
def bm25_stats(s, d):
    return lexical.build(table(s, d, "documents")).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@query("idf_table", _BM25.replace("WITH docs", "WITH qs AS (SELECT 1 AS qid, 'x' AS q), docs") + " SELECT term, df, round(idf, 6) AS idf FROM i")
def idf_table(s, d):
    return lexical.idf(lexical.build(table(s, d, "documents"))).select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_topk", _BM25.replace("WITH docs", f"WITH qs AS {_QS}, docs") + """ SELECT qid, doc, score, CAST(rank AS INTEGER) AS rank FROM (SELECT qid, doc, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, doc) AS rank FROM sc WHERE s > 0) WHERE rank <= 10""")
def bm25_topk(s, d):
    return lexical.search(lexical.build(table(s, d, "documents")), _questions(s, d), 10, "qid", "q").withColumnRenamed("bm25", "score")


# ------------------------------------------------------------------ blends: entries are the documents that have a vector
def _entries(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", "title", F.to_json(F.struct("lang", "source")).alias("metadata"), "lang")
    return docs.join(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id")


def _batch(e):
    return e.where("id % 20 = 0").select(F.col("id").alias("qid"), F.coalesce("title", F.lit("")).alias("text"), "vector")


_E = "(SELECT doc_id, text, title, lang, embedding FROM documents JOIN embeddings ON doc_id = vec_id)"
_HY = f"""WITH e AS {_E}, docs AS (SELECT doc_id AS doc, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ts FROM e), qs AS (SELECT doc_id AS qid, coalesce(title, '') AS q, embedding FROM e WHERE doc_id % 20 = 0),""" + _BM25.split(f"WITH docs AS {_DOCS},")[1] + """,
cs AS (SELECT q.qid, c.doc_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS s FROM qs q, e c WHERE {flt}),
cp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS r FROM cs) WHERE r <= {ck}),
bp AS (SELECT * FROM (SELECT qid, doc AS id, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc) AS r FROM sc WHERE s > 0 AND doc IN (SELECT doc_id FROM e c WHERE {flt})) WHERE r <= {bk}),
ca AS (SELECT qid, id, CASE WHEN max(s) OVER (PARTITION BY qid) > 0 THEN s / max(s) OVER (PARTITION BY qid) ELSE 0 END AS a FROM cp),
ba AS (SELECT qid, id, CASE WHEN max(s) OVER (PARTITION BY qid) > 0 THEN s / max(s) OVER (PARTITION BY qid) ELSE 0 END AS b FROM bp),
mix AS (SELECT qid, id, round(0.3::DOUBLE * coalesce(a, 0) + 0.7::DOUBLE * coalesce(b, 0), 6) AS score FROM ca FULL JOIN ba USING (qid, id)),
hy AS (SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM mix) WHERE rank <= 5)
"""


@query("hybrid_blend", _HY.replace("{flt}", "true").replace("{ck}", "20").replace("{bk}", "20") + "SELECT qid, id, score, rank FROM hy")
def hybrid_blend(s, d):
    e = _entries(s, d)
    return Retriever(e).retrieve(_batch(e), 5, alpha=0.3).select("qid", "id", "score", "rank")


@query("hybrid_filtered", _HY.replace("{flt}", "c.lang = 'en'").replace("{ck}", "5").replace("{bk}", "1000000000") + "SELECT qid, id, score, rank FROM hy")
def hybrid_filtered(s, d):
    e = _entries(s, d)
    return Retriever(e).retrieve(_batch(e), 5, where={"lang": "en"}, alpha=0.3).select("qid", "id", "score", "rank")


_SETS = r"""list_distinct(list_filter(string_split_regex(lower(coalesce({x}, '')), '[ \t\n\r\f\v]+'), lambda w: w <> ''))"""


@query("stub_rerank", _HY.replace("{flt}", "true").replace("{ck}", "30").replace("{bk}", "30").replace("rank <= 5)\n", "rank <= 10)\n") + f""", w AS (
SELECT hy.qid, hy.id, {_SETS.replace('{x}', 'q.q')} AS a, {_SETS.replace('{x}', 'e.text')} AS b FROM hy JOIN qs q USING (qid) JOIN e ON e.doc_id = hy.id),
j AS (SELECT qid, id, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 6) AS score FROM w)
SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM j) WHERE rank <= 5""")
def stub_rerank(s, d):
    e = _entries(s, d)
    return Retriever(e).retrieve(_batch(e), 5, alpha=0.3, rerank_top=10).select("qid", "id", "score", "rank")


_RRF = _HY.replace("{flt}", "true").replace("{ck}", "20").replace("{bk}", "20") + """, ls AS (SELECT qid, 0 AS l, id, r FROM cp UNION ALL SELECT qid, 1, id, r FROM bp),
m AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score, min(l * 1000 + r) AS f FROM ls GROUP BY qid, id)
SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, f, id) AS rank FROM m) WHERE rank <= 10"""


def _pools(s, d, k: int = 20):
    e = _entries(s, d)
    q = _batch(e)
    words = lexical.scores(lexical.build(e, "id", "text"), q).where("bm25 > 0").select("qid", F.col("doc").alias("id"), F.col("bm25").alias("score"))
    return retrieval.top_k(q.select("qid", "vector"), e.select("id", "vector"), k), fusion.ranked(words, k)


@query("rrf_merge", _RRF)
def rrf_merge(s, d):
    a, b = _pools(s, d)
    return fusion.reciprocal_ranks(a.withColumn("list", F.lit(0)).unionByName(b.withColumn("list", F.lit(1))), 10)


@query("three_signals", _HY.replace("{flt}", "true").replace("{ck}", "20").replace("{bk}", "20") + f""", al AS (
SELECT qid, id, coalesce(cp.s, 0) AS s1, coalesce(bp.s, 0) AS s2 FROM cp FULL JOIN bp USING (qid, id)),
jj AS (SELECT al.qid, al.id, s1, s2, {_SETS.replace('{x}', 'q.q')} AS a, {_SETS.replace('{x}', 'e.text')} AS b FROM al JOIN qs q USING (qid) JOIN e ON e.doc_id = al.id),
sg AS (SELECT qid, id, s1, s2, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END AS s3 FROM jj),
mm AS (SELECT *, min(s1) OVER w AS l1, max(s1) OVER w AS h1, min(s2) OVER w AS l2, max(s2) OVER w AS h2, min(s3) OVER w AS l3, max(s3) OVER w AS h3 FROM sg WINDOW w AS (PARTITION BY qid)),
bl AS (SELECT qid, id, round(0.4::DOUBLE * CASE WHEN h1 - l1 < 1e-12 THEN 0 ELSE (s1 - l1) / (h1 - l1) END + 0.4::DOUBLE * CASE WHEN h2 - l2 < 1e-12 THEN 0 ELSE (s2 - l2) / (h2 - l2) END + 0.2::DOUBLE * CASE WHEN h3 - l3 < 1e-12 THEN 0 ELSE (s3 - l3) / (h3 - l3) END, 6) AS score FROM mm)
SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bl) WHERE rank <= 5""")
def three_signals(s, d):
    e = _entries(s, d)
    a, b = _pools(s, d)
    both = a.select("qid", "id", F.col("score").alias("s1")).join(b.select("qid", "id", F.col("score").alias("s2")), ["qid", "id"], "full").fillna(0.0, ["s1", "s2"])
    named = both.join(_batch(e).select("qid", F.col("text").alias("q")), "qid").join(e.select("id", "text"), "id")
    return fusion.three_signals(named.withColumn("s3", vec.jaccard(tx.word_set(F.col("q")), tx.word_set(F.col("text")))), (0.4, 0.4, 0.2), 5)


_NEAR = f"({_cosine_sql('q.vec_id <> c.vec_id', 3).replace('q.vec_id % 20 = 0 AND ', '')})"


@query("graph_expand", f"""WITH seeds AS ({_cosine_sql('true', 5)}), nn AS {_NEAR},
u AS (SELECT qid, id, score FROM seeds UNION ALL SELECT seeds.qid, nn.id, seeds.score * 0.5::DOUBLE FROM seeds JOIN nn ON nn.qid = seeds.id),
m AS (SELECT qid, id, round(max(score), 6) AS score FROM u GROUP BY qid, id)
SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM m) WHERE rank <= 8""")
def graph_expand(s, d):
    v = _vectors(s, d)
    seeds = retrieval.top_k(_asked(v), v.select("id", "vector"), 5)
    hop = retrieval.related(seeds.select("id").distinct(), v.select("id", "vector"), 3)  # only the seeds' neighbours
    return fusion.expand(seeds, hop, 8)


@query("centrality_prior", f"""WITH h AS ({_cosine_sql('true', 30)}), m AS (
SELECT qid, id, round(score * (1 + ln(1 + greatest(0.0::DOUBLE, e.label / 10.0::DOUBLE))), 6) AS score FROM h JOIN embeddings e ON e.vec_id = h.id)
SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM m) WHERE rank <= 10""")
def centrality_prior(s, d):
    v = _vectors(s, d)
    return fusion.with_prior(retrieval.top_k(_asked(v), v.select("id", "vector"), 30), v.select("id", (F.col("label") / 10.0).alias("prior")), 10)


@query("gated_blend", _HY.replace("{flt}", "true").replace("{ck}", "20").replace("{bk}", "20") + """, ld AS (SELECT qid, max(CASE WHEN r = 1 THEN s END) - coalesce(max(CASE WHEN r = 2 THEN s END), 0) AS lead FROM bp WHERE r <= 2 GROUP BY qid),
g AS (SELECT cp.qid, cp.id, cp.s AS score, CASE WHEN lead >= 0.05 THEN 0.6::DOUBLE * cp.s + 0.4::DOUBLE * coalesce(bp.s, 0) ELSE cp.s END AS mx FROM cp LEFT JOIN bp USING (qid, id) LEFT JOIN ld USING (qid))
SELECT qid, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(mx, 6) DESC, id) AS rank FROM g) WHERE rank <= 5""")
def gated_blend(s, d):
    a, b = _pools(s, d)
    return fusion.gated(a, b, 0.4, 0.05, 5)


@query("token_jaccard", f"""WITH f AS (SELECT DISTINCT fact_id, session_id, text FROM extracted_facts WHERE text IS NOT NULL AND session_id IS NOT NULL),
p AS (SELECT fact_id, lag(fact_id) OVER w AS other, {_SETS.replace('{x}', 'text')} AS a, {_SETS.replace('{x}', 'lag(text) OVER w')} AS b FROM f WINDOW w AS (PARTITION BY session_id ORDER BY fact_id))
SELECT fact_id, other, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 6) AS score FROM p WHERE other IS NOT NULL""")
def token_jaccard(s, d):
    w = Window.partitionBy("session_id").orderBy("fact_id")
    f = once(s, d, "extracted_facts", "fact_id").where("text is not null and session_id is not null").select("fact_id", F.lag("fact_id").over(w).alias("other"), "text", F.lag("text").over(w).alias("before"))
    return f.where("other is not null").select("fact_id", "other", F.round(vec.jaccard(tx.word_set(F.col("text")), tx.word_set(F.col("before"))), 6).alias("score"))


# ------------------------------------------------------------------ sparse codes
_CODES = "(SELECT vec_id, list(i ORDER BY i) AS code FROM (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS r FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(64)) AS i FROM embeddings)) WHERE r <= 8 GROUP BY vec_id)"


@query("kwta_codes", f"SELECT vec_id, array_to_string(code, ',') AS code FROM {_CODES}")
def kwta_codes(s, d):
    return table(s, d, "embeddings").select("vec_id", F.array_join(sparse.winners(F.col("embedding"), 8), ",").alias("code"))


@query("code_similarity", f"WITH c AS {_CODES} SELECT a.vec_id, round(len(list_intersect(a.code, b.code))::DOUBLE / len(list_distinct(list_concat(a.code, b.code))), 6) AS sim FROM c a JOIN c b ON b.vec_id = a.vec_id + 1")
def code_similarity(s, d):
    c = table(s, d, "embeddings").select("vec_id", sparse.winners(F.col("embedding"), 8).alias("code"))
    return c.join(c.select((F.col("vec_id") - 1).alias("vec_id"), F.col("code").alias("other")), "vec_id").select("vec_id", F.round(sparse.similarity(F.col("code"), F.col("other")), 6).alias("sim"))


@query("pattern_separate")
def pattern_separate(s, d):
    """Within a label, in order of vec_id."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    own = table(s, d, "embeddings").select(F.col("label").cast("long").alias("g"), place.cast("long").alias("place"), sparse.winners(F.col("embedding"), 8).alias("code"))
    return sparse.separate_rows(cut(own))


@query("projected_codes")
def projected_codes(s, d):
    return sparse.project_winners(_vectors(s, d), 12, 256)
