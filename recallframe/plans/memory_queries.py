"""Queries on the log, conversations, packing, metrics, graphs, sequences and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallframe.functions import text as tx
from recallframe.functions import vector as vec
from recallframe.operators import conversation as cv
from recallframe.operators import graph as gr
from recallframe.operators import metrics as mt
from recallframe.operators import packing as pk
from recallframe.operators import sequences as sq
from recallframe.operators import store as st
from recallframe.plans.retrieval_queries import once
from recallframe.session import cut, shared_path, table
from recallframe.sources import schemas
from recallframe.streaming import jobs

#: Facts that ask in one task.
FACTS = 256
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# ------------------------------------------------------------------ the log: events as operations, a user's value of k is an entry
def _ops(s, d):
    e = table(s, d, "events")
    op = F.when(F.col("event_type") == "error", "forget").when(F.col("event_type") == "signup", "update").otherwise("store")
    node = F.concat_ws("-", F.col("user_id"), F.pmod(F.get_json_object("props", "$.k").cast("long"), F.lit(4)))
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), node.alias("node_id"), F.col("event_type").alias("text"), F.col("props").alias("metadata"), F.when(op == "update", F.col("props")).alias("patch"))


_OPS = """(SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'forget' WHEN 'signup' THEN 'update' ELSE 'store' END AS op,
user_id || '-' || CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS node_id, event_type AS text FROM events{w})"""
_FOLD = f"""WITH o AS {_OPS}, g AS (SELECT *, coalesce(max(CASE WHEN op = 'forget' THEN seq END) OVER (PARTITION BY node_id), -1) AS gone FROM o),
l AS (SELECT *, min(CASE WHEN op = 'store' THEN seq END) OVER (PARTITION BY node_id) AS born FROM g WHERE seq > gone AND op <> 'forget')
SELECT node_id, born AS seq, max(CASE WHEN seq = born THEN text END) AS text, count(CASE WHEN op = 'update' THEN 1 END) AS patches FROM l WHERE born IS NOT NULL AND seq >= born GROUP BY node_id, born"""


@query("wal_fold", _FOLD.replace("{w}", ""))
def wal_fold(s, d):
    return st.fold(st.before_damage(_ops(s, d))).select("node_id", "seq", "text", "patches")


@query("time_travel", _FOLD.replace("{w}", " WHERE event_id <= 5000"))
def time_travel(s, d):
    return st.fold(_ops(s, d), 5000).select("node_id", "seq", "text", "patches")


@query("compaction_tail", f"SELECT op, count(*) AS n FROM {_OPS.replace('{w}', '')} WHERE seq > 5000 GROUP BY op")
def compaction_tail(s, d):
    return st.compact(_ops(s, d), 5000)[1].groupBy("op").agg(F.count("*").alias("n"))


@query("compaction_due", "SELECT user_id, count(*) > 60 OR sum(length(props)) > greatest(700, 300) AS due FROM events GROUP BY user_id")
def compaction_due(s, d):
    stats = table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("records"), F.sum(F.length("props")).alias("wal_bytes"), F.lit(300).alias("snapshot_bytes"), F.lit(0).alias("age_s"))
    return st.due_for_compaction(stats, 60, 700).select("user_id", "due")


@query("merged_metadata", """SELECT DISTINCT request_id, 'patched' AS source, json_extract_string(metadata, '$.lang') AS lang FROM store_requests WHERE metadata IS NOT NULL AND json_valid(metadata)""")
def merged_metadata(s, d):
    own = once(s, d, "store_requests", "request_id").where("metadata is not null and json_object_keys(metadata) is not null")
    m = st.merged(F.col("metadata"), F.array(F.lit('{"source": "first"}'), F.lit('{"source": "patched"}')))
    return own.select("request_id", F.get_json_object(m, "$.source").alias("source"), F.get_json_object(m, "$.lang").alias("lang"))


@query("recent_n", "SELECT request_id, timestamp_step FROM (SELECT DISTINCT request_id, timestamp_step FROM store_requests) ORDER BY request_id DESC LIMIT 20")
def recent_n(s, d):
    return st.recent(once(s, d, "store_requests", "request_id"), 20, "request_id").select("request_id", "timestamp_step")


@query("upsert_latest", "SELECT node_id, text FROM (SELECT node_id, text, row_number() OVER (PARTITION BY node_id ORDER BY fact_id DESC) AS r FROM (SELECT DISTINCT fact_id, node_id, text FROM extracted_facts)) WHERE r = 1")
def upsert_latest(s, d):
    own = once(s, d, "extracted_facts", "fact_id")
    return own.groupBy("node_id").agg(F.max_by("text", "fact_id").alias("text"))


@query("bundle_catalogue", "SELECT bundle, count(*) AS entries, CAST(sum(length(text)) AS BIGINT) AS chars, max(timestamp_step) AS step FROM (SELECT DISTINCT * FROM store_requests) GROUP BY bundle")
def bundle_catalogue(s, d):
    return once(s, d, "store_requests", "request_id").groupBy("bundle").agg(F.count("*").alias("entries"), F.sum(F.length("text")).alias("chars"), F.max("timestamp_step").alias("step"))


@query("crc_integrity", "SELECT event_id FROM events WHERE event_id % 97 = 0")
def crc_integrity(s, d):
    """Records whose payload is no longer what its check number says."""
    framed = st.framed(table(s, d, "events").select("event_id", "props"), "props")
    torn = framed.withColumn("props", F.when(F.col("event_id") % 97 == 0, F.concat("props", F.lit("x"))).otherwise(F.col("props")))
    return st.torn(torn, "props").select("event_id")


# ------------------------------------------------------------------ conversations; a user's day is a session
_TURNS = """(SELECT session_id, node_id AS turn_id, text, user_id, row_number() OVER (PARTITION BY session_id ORDER BY timestamp_step, request_id) AS turn_index FROM (
SELECT DISTINCT request_id, node_id, text, user_id, timestamp_step, user_id || '/' || CAST(CAST(sent_at AS DATE) AS VARCHAR) AS session_id FROM store_requests WHERE user_id IS NOT NULL))"""


def _turns(s, d):
    own = once(s, d, "store_requests", "request_id").where("user_id is not null").withColumn("session_id", F.concat_ws("/", "user_id", F.to_date("sent_at").cast("string")))
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("timestamp_step", "request_id"))
    return own.select("session_id", F.col("node_id").alias("turn_id"), "text", "user_id", n.cast("long").alias("turn_index"))


_BLOCKS = f"(SELECT session_id, turn_index AS n, CASE WHEN (turn_index // 4) % 5 = 0 THEN turn_index - 19 ELSE turn_index - 3 END AS summarized_turn_start, turn_index AS summarized_turn_end, (turn_index // 4) % 5 = 0 AS resummary FROM {_TURNS} WHERE turn_index % 4 = 0)"


@query("session_tail", f"SELECT session_id, turn_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index DESC) AS r FROM {_TURNS}) WHERE r <= 3")
def session_tail(s, d):
    r = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn_index")))
    return _turns(s, d).withColumn("r", r).where("r <= 3").select("session_id", "turn_id")


@query("summary_ranges", f"SELECT session_id, summarized_turn_start, summarized_turn_end, resummary FROM {_BLOCKS}")
def summary_ranges(s, d):
    return cv.summary_blocks(_turns(s, d), 4)


_GONE = f"SELECT * FROM {_TURNS} WHERE contains(lower(text), 'password')"


@query("forget_turns", f"SELECT session_id, turn_id FROM ({_GONE})")
def forget_turns(s, d):
    return cv.forget_turns(_turns(s, d), "password").select("session_id", "turn_id")


@query("forget_facts", f"SELECT fact_id FROM (SELECT DISTINCT fact_id, source_turn_id FROM extracted_facts) WHERE source_turn_id IN (SELECT turn_id FROM ({_GONE}))")
def forget_facts(s, d):
    return cv.forget_facts(once(s, d, "extracted_facts", "fact_id"), cv.forget_turns(_turns(s, d), "password")).select("fact_id")


@query("forget_summaries", f"""SELECT b.session_id, summarized_turn_start, summarized_turn_end, count(g.turn_id) AS deleted, count(*) - count(g.turn_id) AS "left", CASE WHEN count(*) = count(g.turn_id) THEN 'delete' ELSE 'regenerate' END AS fate
FROM {_BLOCKS} b JOIN {_TURNS} t ON t.session_id = b.session_id AND t.turn_index BETWEEN summarized_turn_start AND summarized_turn_end LEFT JOIN ({_GONE}) g ON g.turn_id = t.turn_id GROUP BY ALL HAVING count(g.turn_id) > 0""")
def forget_summaries(s, d):
    turns = _turns(s, d)
    return cv.forget_summaries(cv.summary_blocks(turns, 4), turns, cv.forget_turns(turns, "password"))


_CATS = "CASE WHEN lower(trim(category)) IN ('preference', 'goal', 'biographical', 'relationship', 'event', 'other') THEN lower(trim(category)) ELSE 'other' END"


@query("parse_facts", f"SELECT fact_id, {_CATS} AS category, trim(text, ' ') AS text FROM (SELECT DISTINCT fact_id, category, text FROM extracted_facts) WHERE category IS NOT NULL AND trim(text, ' ') <> '' AND fact_id % 7 > 1")
def parse_facts(s, d):
    """Every seventh reply is no JSON, every other seventh no list."""
    item = F.struct("category", "text")
    raw = F.when(F.col("fact_id") % 7 == 0, "no facts here").when(F.col("fact_id") % 7 == 1, F.to_json(F.struct(F.lit("x").alias("note")))).otherwise(F.to_json(F.array(item)))
    own = once(s, d, "extracted_facts", "fact_id").select("fact_id", raw.alias("raw"))
    return own.select("fact_id", F.explode(cv.parsed_facts(F.col("raw"))).alias("f")).select("fact_id", "f.category", "f.text")


_SET = r"list_distinct(list_filter(string_split_regex(lower({x}), '[ \t\n\r\f\v]+'), lambda w: w <> ''))"
_CAND = """SELECT f.fact_id, o.fact_id AS other_id, len(list_intersect(f.ws, o.ws))::DOUBLE / greatest(1, len(list_distinct(list_concat(f.ws, o.ws)))) AS score, o.fact_id % 7 = 0 AS superseded
FROM fs f JOIN fs o ON f.session_id = o.session_id AND (f.user_id IS NULL OR o.user_id = f.user_id) AND o.fact_id < f.fact_id"""


def candidates(s, d):
    """fact_id, other_id, score, superseded, r: the 5 likest of all facts before it of its session and user; without a user, of every user.

    Every earlier fact counts as stored.  The facts of a scope are numbered, and those that
    ask dealt into blocks by number, so a hot scope is many tasks; a block keeps its 5 best.
    """
    f = once(s, d, "extracted_facts", "fact_id").where("text is not null and session_id is not null").select("fact_id", "session_id", "user_id", tx.word_set(F.col("text")).alias("ws"))
    scopes = F.array(F.struct(F.lit(True).alias("every"), F.lit("").alias("user")), F.struct(F.lit(False).alias("every"), F.col("user_id").alias("user")))
    inside = ["session_id", "every", "user"]
    scope = Window.partitionBy(*inside)
    own = f.select("*", F.explode(scopes).alias("scope")).select("*", "scope.*").where("user is not null")
    own = own.withColumn("n", F.row_number().over(scope.orderBy("fact_id"))).withColumn("block", F.floor((F.col("n") - 1) / FACTS)).withColumn("last", F.max("block").over(scope))
    asking = own.where("every = (user_id is null)").select(*inside, "block", "fact_id", "n", "ws")
    stored = own.select(*inside, F.explode(F.sequence("block", "last")).alias("block"), F.col("fact_id").alias("other_id"), F.col("n").alias("at"), F.col("ws").alias("other"))
    met = asking.join(stored, [*inside, "block"]).where("at < n")
    c = met.select(*inside, "block", "fact_id", "other_id", vec.jaccard(F.col("ws"), F.col("other")).alias("score"), (F.col("other_id") % 7 == 0).alias("superseded"))
    r = F.row_number().over(Window.partitionBy(*inside, "block", "fact_id").orderBy(F.desc("score"), "other_id"))
    return c.withColumn("r", r).where("r <= 5").select("fact_id", "other_id", "score", "superseded", "r")


@query("reconcile_tristate", f"""WITH fs AS (SELECT fact_id, session_id, user_id, {_SET.replace('{x}', 'text')} AS ws FROM (SELECT DISTINCT fact_id, session_id, user_id, text FROM extracted_facts WHERE text IS NOT NULL AND session_id IS NOT NULL)),
c AS ({_CAND}), t AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY score DESC, other_id) AS r FROM c),
b AS (SELECT fact_id, max(score) AS best FROM t WHERE r <= 5 AND NOT superseded GROUP BY fact_id)
SELECT fs.fact_id, round(best, 6) AS best, CASE WHEN best IS NULL OR best < 0.75 THEN 'add' WHEN best >= 0.92 THEN 'near_dup' ELSE 'ambiguous' END AS decision FROM fs LEFT JOIN b USING (fact_id)""")
def reconcile_tristate(s, d):
    """Each fact against all facts before it of its session and user."""
    facts = once(s, d, "extracted_facts", "fact_id").where("text is not null and session_id is not null")
    return cv.reconcile(candidates(s, d).drop("r"), facts).withColumn("best", F.round("best", 6))


_NEXT = "(SELECT fact_id, lead(fact_id) OVER (PARTITION BY session_id, extract_batch ORDER BY fact_id) AS superseded_by, last_value(fact_id) OVER (PARTITION BY session_id, extract_batch ORDER BY fact_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS newest FROM (SELECT DISTINCT fact_id, session_id, extract_batch FROM extracted_facts))"


def _replaced(s, d):
    w = Window.partitionBy("session_id", "extract_batch").orderBy("fact_id")
    return once(s, d, "extracted_facts", "fact_id").withColumn("superseded_by", F.lead("fact_id").over(w))


@query("live_facts", f"SELECT fact_id FROM {_NEXT} WHERE superseded_by IS NULL")
def live_facts(s, d):
    return _replaced(s, d).where("superseded_by is null").select("fact_id")


@query("supersession_chain", f"SELECT fact_id, newest FROM {_NEXT}")
def supersession_chain(s, d):
    return cv.supersession(_replaced(s, d))


@query("clear_session", "SELECT category IS NULL AS loose, count(*) AS n FROM (SELECT DISTINCT * FROM extracted_facts) WHERE session_id IS NULL OR session_id <> (SELECT min(session_id) FROM extracted_facts) GROUP BY 1")
def clear_session(s, d):
    own = once(s, d, "extracted_facts", "fact_id")
    first = own.agg(F.min("session_id").alias("session_id"))
    return own.join(F.broadcast(first), "session_id", "left_anti").groupBy(F.col("category").isNull().alias("loose")).agg(F.count("*").alias("n"))


@query("forget_audit", f"SELECT user_id, count(*) AS turns FROM ({_GONE}) GROUP BY user_id")
def forget_audit(s, d):
    return cv.forget_turns(_turns(s, d), "password").groupBy("user_id").agg(F.count("*").alias("turns"))


# ------------------------------------------------------------------ packing
_HITS = "(SELECT answer_id AS qid, CAST(i AS INTEGER) AS rank, hits[i].node_id AS node_id, hits[i].text AS text, hits[i].score AS score FROM (SELECT answer_id, hits, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT DISTINCT * FROM rag_answers) WHERE hits IS NOT NULL))"


def _hits(s, d):
    own = once(s, d, "rag_answers", "answer_id").select(F.col("answer_id").alias("qid"), F.posexplode("hits").alias("p", "h"))
    return own.select("qid", (F.col("p") + 1).alias("rank"), "h.node_id", "h.text", "h.score", "h.metadata")


@query("pack_budget", f"""WITH l AS (SELECT qid, rank, '[hit] ' || text AS line FROM {_HITS} WHERE text IS NOT NULL), c AS (SELECT *, length(line) + CASE WHEN row_number() OVER (PARTITION BY qid ORDER BY rank) > 1 THEN 1 ELSE 0 END AS cost FROM l),
u AS (SELECT *, sum(cost) OVER (PARTITION BY qid ORDER BY rank) AS used FROM c) SELECT qid, rank, CAST(used AS BIGINT) AS used FROM u WHERE used <= 2280""")
def pack_budget(s, d):
    lines = _hits(s, d).where("text is not null").select("qid", "rank", F.concat(F.lit("[hit] "), "text").alias("line"))
    return pk.within_budget(lines, pk.budgets()["recency"], ["qid"]).select("qid", "rank", F.col("used").cast("long").alias("used"))


@query("pack_slots", f"""WITH a AS (SELECT qid, 0 AS slot_no, rank, node_id FROM {_HITS} WHERE rank <= 3 UNION ALL SELECT qid, 1, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS INTEGER), node_id FROM {_HITS})
SELECT qid, slot_no, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY qid, node_id ORDER BY slot_no, rank) AS r FROM a) WHERE r = 1 GROUP BY ALL""")
def pack_slots(s, d):
    h = _hits(s, d)
    by_score = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rank"))
    both = h.where("rank <= 3").select("qid", F.lit(0).alias("slot_no"), "rank", "node_id").unionByName(h.select("qid", F.lit(1).alias("slot_no"), by_score.alias("rank"), "node_id"))
    return pk.first_slot_wins(both, ["qid"]).groupBy("qid", "slot_no").agg(F.count("*").alias("n"))


@query("evidence_pack", f"""WITH b AS (SELECT *, length(text) + 80 AS size, coalesce(sum(length(text) + 80) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM {_HITS} WHERE text IS NOT NULL)
SELECT qid, rank, CAST(CASE WHEN size <= 2000 - bf THEN length(text) ELSE least(length(text), 2000 - bf - 80) END AS INTEGER) AS n FROM b WHERE size <= 2000 - bf OR 2000 - bf > 200""")
def evidence_pack(s, d):
    return pk.evidence(_hits(s, d).where("text is not null").select("qid", "rank", "text"), 2000).select("qid", "rank", F.length("kept").alias("n"))


@query("citations", f"SELECT qid, rank, '[' || rank || '] id=' || substr(node_id, 1, 8) || chr(10) || '    ' || text AS line FROM {_HITS} WHERE text IS NOT NULL")
def citations(s, d):
    none = F.lit(None).cast("string")
    return _hits(s, d).where("text is not null").select("qid", "rank", pk.citation(F.col("rank"), none, none, none, F.col("node_id"), F.col("text")).alias("line"))


# ------------------------------------------------------------------ metrics
@query("recall_mrr_ndcg", f"""WITH h AS {_HITS}, rel AS (SELECT DISTINCT qid, node_id AS id FROM h WHERE score >= 0.8), n AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid),
f AS (SELECT h.qid, count(*) AS got, min(rank) AS first, sum(1.0::DOUBLE / log2(rank + 1.0::DOUBLE)) AS dcg FROM h JOIN rel ON rel.qid = h.qid AND rel.id = h.node_id WHERE rank <= 3 GROUP BY h.qid)
SELECT n.qid, round(coalesce(got::DOUBLE / n, 0), 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 3) + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0::DOUBLE))), 0), 6) AS ndcg, CASE WHEN got > 0 THEN 1 ELSE 0 END AS hit, coalesce(first, 0) AS gold_rank FROM n LEFT JOIN f USING (qid)""")
def recall_mrr_ndcg(s, d):
    h = _hits(s, d).select("qid", F.col("node_id").alias("id"), "rank", "score")
    out = mt.at_k(h, h.where("score >= 0.8"), 3)
    return out.select("qid", *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")), "hit", "gold_rank")


_P = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"
_W = "list_filter(string_split(trim(regexp_replace(translate(lower(coalesce({x}, '')), " + _P + ", ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' '), ' '), lambda w: w <> '')"
_QA = f"(SELECT prediction_id, method, question_type, {_W.replace('{x}', 'hypothesis')} AS a, {_W.replace('{x}', 'answer')} AS b FROM (SELECT DISTINCT * FROM qa_compare))"
_OV = "list_sum(list_transform(list_distinct({a}), lambda w: least(len(list_filter({a}, lambda y: y = w)), len(list_filter({b}, lambda y: y = w)))))"
_F = "CASE WHEN coalesce({o}, 0) = 0 THEN 0.0::DOUBLE ELSE 2 * ({o}::DOUBLE / len({a})) * ({o}::DOUBLE / len({b})) / ({o}::DOUBLE / len({a}) + {o}::DOUBLE / len({b})) END"


def _f_sql(a: str, b: str) -> str:
    o = _OV.replace("{a}", a).replace("{b}", b)
    return _F.replace("{o}", o).replace("{a}", a).replace("{b}", b)


_F1 = f"CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0::DOUBLE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE {_f_sql('a', 'b')} END"


@query("token_f1", f"SELECT coalesce(method, 'ALL') AS method, count(*) AS n, round(avg(f1), 6) AS f1, round(avg(em), 6) AS em FROM (SELECT method, {_F1} AS f1, CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END AS em FROM {_QA}) GROUP BY GROUPING SETS ((method), ())")
def token_f1(s, d):
    own = once(s, d, "qa_compare", "prediction_id")
    scored = own.select("method", mt.token_f1(F.col("hypothesis"), F.col("answer")).alias("f1"), mt.exact_match(F.col("hypothesis"), F.col("answer")).cast("double").alias("em"))
    return mt.with_total(scored, "method", [F.count("*").alias("n"), F.round(F.avg("f1"), 6).alias("f1"), F.round(F.avg("em"), 6).alias("em")])


_N2 = "CASE WHEN len({x}) >= 2 THEN list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1]) ELSE CAST([] AS VARCHAR[]) END"


@query("rouge", f"""SELECT prediction_id, round(CASE WHEN len(b) < 1 THEN CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END WHEN len(a) < 1 THEN 0.0::DOUBLE ELSE {_f_sql('a', 'b')} END, 6) AS rouge1,
round(CASE WHEN len(b) < 2 THEN CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END WHEN len(a) < 2 THEN 0.0::DOUBLE ELSE {_f_sql('a2', 'b2')} END, 6) AS rouge2
FROM (SELECT *, {_N2.replace('{x}', 'a')} AS a2, {_N2.replace('{x}', 'b')} AS b2 FROM {_QA})""")
def rouge(s, d):
    h, a = F.col("hypothesis"), F.col("answer")
    return once(s, d, "qa_compare", "prediction_id").select("prediction_id", F.round(mt.rouge_n(h, a, 1), 6).alias("rouge1"), F.round(mt.rouge_n(h, a, 2), 6).alias("rouge2"))


@query("rouge_l")
def rouge_l(s, d):
    return once(s, d, "qa_compare", "prediction_id").select("prediction_id", F.round(mt.rouge_l(F.col("hypothesis"), F.col("answer")), 6).alias("rouge_l"))


_SW = "(SELECT DISTINCT * FROM alpha_sweep)"


def _sweep(s, d):
    return table(s, d, "alpha_sweep").distinct()


@query("rank_summary", f"""SELECT alpha, coalesce(question_type, CASE WHEN grouping(question_type) = 1 THEN 'ALL' END) AS question_type, count(*) AS n, round(avg(hit_at_k), 6) AS hit_rate, round(avg(CASE WHEN gold_rank = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS rank1,
round(avg(CASE WHEN gold_rank > 0 THEN gold_rank END), 6) AS mean_rank, count(CASE WHEN gold_rank = 2 THEN 1 END) AS rank2 FROM {_SW} GROUP BY GROUPING SETS ((alpha, question_type), (alpha))""")
def rank_summary(s, d):
    g = F.grouping("question_type")
    out = _sweep(s, d).groupingSets([["alpha", "question_type"], ["alpha"]], "alpha", "question_type").agg(
        g.alias("g"), F.count("*").alias("n"), F.round(F.avg("hit_at_k"), 6).alias("hit_rate"), F.round(F.avg(F.when(F.col("gold_rank") == 1, 1.0).otherwise(0.0)), 6).alias("rank1"),
        F.round(F.avg(F.when(F.col("gold_rank") > 0, F.col("gold_rank"))), 6).alias("mean_rank"), F.count(F.when(F.col("gold_rank") == 2, 1)).alias("rank2"),
    )
    return out.withColumn("question_type", F.when(F.col("g") == 1, "ALL").otherwise(F.col("question_type"))).drop("g")


@query("median_rank", f"SELECT alpha, gold_rank AS median FROM (SELECT alpha, gold_rank, row_number() OVER (PARTITION BY alpha ORDER BY gold_rank) AS r, count(*) OVER (PARTITION BY alpha) AS n FROM {_SW} WHERE gold_rank > 0) WHERE r = n // 2 + 1")
def median_rank(s, d):
    """Upper median from the histogram of ranks: few rows, whatever the number of probes."""
    h = _sweep(s, d).where("gold_rank > 0").groupBy("alpha", "gold_rank").agg(F.count("*").alias("c"))
    w = Window.partitionBy("alpha")
    upto = F.sum("c").over(w.orderBy("gold_rank"))
    at = F.expr("n div 2") + 1
    return h.withColumn("n", F.sum("c").over(w)).withColumn("upto", upto).where((F.col("upto") >= at) & (F.col("upto") - F.col("c") < at)).select("alpha", F.col("gold_rank").alias("median"))


@query("latency_percentiles", f"""WITH v AS (SELECT alpha, CAST(round(retrieval_ms * 10) AS BIGINT) AS t FROM {_SW} WHERE retrieval_ms >= 0 AND NOT isnan(retrieval_ms) AND retrieval_ms < 1e12),
r AS (SELECT *, row_number() OVER (PARTITION BY alpha ORDER BY t) AS r, count(*) OVER (PARTITION BY alpha) AS n FROM v)
SELECT alpha, CAST(p AS INTEGER) AS percent, t AS tenths FROM r, (VALUES (50), (95), (99)) AS x(p) WHERE r = greatest(1, (p * n + 99) // 100)""")
def latency_percentiles(s, d):
    """From the histogram of tenths of milliseconds; the error is half a tenth."""
    ms = F.col("retrieval_ms")
    h = _sweep(s, d).where((ms >= 0) & ~F.isnan(ms) & (ms < 1e12)).groupBy("alpha", F.round(ms * 10).cast("long").alias("t")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("alpha")
    h = h.withColumn("n", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(w.orderBy("t"))).withColumn("percent", F.explode(F.array(F.lit(50), F.lit(95), F.lit(99))))
    at = F.greatest(F.lit(1), F.expr("(percent * n + 99) div 100"))
    return h.where((F.col("upto") >= at) & (F.col("upto") - F.col("c") < at)).select("alpha", "percent", F.col("t").alias("tenths"))


@query("alpha_sweep_ranks", f"SELECT alpha, count(*) AS n, round(avg(hit_at_k), 6) AS hit, round(avg(CASE WHEN gold_rank = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS rank1 FROM {_SW} GROUP BY alpha")
def alpha_sweep_ranks(s, d):
    return _sweep(s, d).groupBy("alpha").agg(F.count("*").alias("n"), F.round(F.avg("hit_at_k"), 6).alias("hit"), F.round(F.avg(F.when(F.col("gold_rank") == 1, 1.0).otherwise(0.0)), 6).alias("rank1"))


_BY = f"(SELECT question_id, method, max(coalesce(hit_at_k, 0)) AS hit, max(f1) AS f1 FROM (SELECT q.question_id, q.method, q.hit_at_k, {_F1} AS f1 FROM (SELECT DISTINCT * FROM qa_compare) q JOIN {_QA} t USING (prediction_id)) GROUP BY ALL)"


def _by_question(s, d):
    own = once(s, d, "qa_compare", "prediction_id").withColumn("f1", mt.token_f1(F.col("hypothesis"), F.col("answer")))
    return own.groupBy("question_id", "method").agg(F.max(F.coalesce("hit_at_k", F.lit(0))).alias("hit"), F.max("f1").alias("f1"))


def _pair(s, d, a: str = "cosine", b: str = "hybrid"):
    own = _by_question(s, d)
    side = lambda m, n: own.where(F.col("method") == m).select("question_id", F.col("hit").alias(f"hit_{n}"), F.col("f1").alias(f"f1_{n}"))
    return side(a, "a").join(side(b, "b"), "question_id")


@query("partition_ab", f"SELECT a.hit AS hit_a, b.hit AS hit_b, count(*) AS n, round(sum(b.f1 - a.f1), 6) AS lift FROM {_BY} a JOIN {_BY} b ON a.question_id = b.question_id WHERE a.method = 'cosine' AND b.method = 'hybrid' GROUP BY ALL")
def partition_ab(s, d):
    return _pair(s, d).groupBy("hit_a", "hit_b").agg(F.count("*").alias("n"), F.round(F.sum(F.col("f1_b") - F.col("f1_a")), 6).alias("lift"))


@query("win_tie_loss", f"SELECT count(CASE WHEN b.f1 > a.f1 THEN 1 END) AS wins, count(CASE WHEN b.f1 = a.f1 THEN 1 END) AS ties, count(CASE WHEN b.f1 < a.f1 THEN 1 END) AS losses FROM {_BY} a JOIN {_BY} b ON a.question_id = b.question_id WHERE a.method = 'cosine' AND b.method = 'hybrid'")
def win_tie_loss(s, d):
    c = lambda t: F.count(F.when(t, 1))
    return _pair(s, d).agg(c(F.col("f1_b") > F.col("f1_a")).alias("wins"), c(F.col("f1_b") == F.col("f1_a")).alias("ties"), c(F.col("f1_b") < F.col("f1_a")).alias("losses"))


@query("mode_pairs", f"SELECT a.method AS mode_a, b.method AS mode_b, count(*) AS n, count(CASE WHEN a.f1 > b.f1 THEN 1 END) AS wins FROM {_BY} a JOIN {_BY} b ON a.question_id = b.question_id AND a.method < b.method GROUP BY ALL")
def mode_pairs(s, d):
    own = _by_question(s, d)
    other = own.select("question_id", F.col("method").alias("mode_b"), F.col("f1").alias("f1_b"))
    return own.join(other, "question_id").where("method < mode_b").groupBy(F.col("method").alias("mode_a"), "mode_b").agg(F.count("*").alias("n"), F.count(F.when(F.col("f1") > F.col("f1_b"), 1)).alias("wins"))


@query("common_questions", f"SELECT method, count(*) AS n, round(avg(f1), 6) AS f1 FROM (SELECT *, count(*) OVER (PARTITION BY question_id) AS m FROM {_BY}) WHERE m = (SELECT count(DISTINCT method) FROM qa_compare) GROUP BY method")
def common_questions(s, d):
    own = _by_question(s, d)
    modes = own.agg(F.countDistinct("method").alias("modes"))
    counted = own.withColumn("m", F.count("*").over(Window.partitionBy("question_id"))).crossJoin(F.broadcast(modes))  # one row
    return counted.where("m = modes").groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("f1"), 6).alias("f1"))


_RK = f"(SELECT question_id, alpha, min(CASE WHEN gold_rank > 0 THEN gold_rank END) AS rank FROM {_SW} WHERE alpha IN (0.3, 0.7) GROUP BY ALL)"


@query("rank_delta", f"SELECT CASE WHEN a.rank IS NULL AND b.rank IS NULL THEN 'both_miss' WHEN a.rank IS NULL THEN 'gained' WHEN b.rank IS NULL THEN 'lost' WHEN b.rank < a.rank THEN 'better' WHEN b.rank > a.rank THEN 'worse' ELSE 'same' END AS cell, count(*) AS n FROM {_RK} a JOIN {_RK} b ON a.question_id = b.question_id AND a.alpha = 0.3 AND b.alpha = 0.7 GROUP BY 1")
def rank_delta(s, d):
    own = _sweep(s, d).where("alpha in (0.3, 0.7)").groupBy("question_id", "alpha").agg(F.min(F.when(F.col("gold_rank") > 0, F.col("gold_rank"))).alias("rank"))
    both = own.where("alpha = 0.3").select("question_id", F.col("rank").alias("a")).join(own.where("alpha = 0.7").select("question_id", F.col("rank").alias("b")), "question_id")
    cell = F.when(F.col("a").isNull() & F.col("b").isNull(), "both_miss").when(F.col("a").isNull(), "gained").when(F.col("b").isNull(), "lost").when(F.col("b") < F.col("a"), "better").when(F.col("b") > F.col("a"), "worse").otherwise("same")
    return both.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))


@query("idk_by_hit", f"SELECT coalesce(hit_at_k, -1) AS hit, count(*) AS n, count(CASE WHEN coalesce({' OR '.join(f'contains(lower(trim(hypothesis)), {chr(39)}{p.replace(chr(39), chr(39) * 2)}{chr(39)})' for p in tx.UNKNOWING)}, false) THEN 1 END) AS idk FROM (SELECT DISTINCT * FROM qa_compare) GROUP BY 1")
def idk_by_hit(s, d):
    own = once(s, d, "qa_compare", "prediction_id")
    return own.groupBy(F.coalesce("hit_at_k", F.lit(-1)).alias("hit")).agg(F.count("*").alias("n"), F.count(F.when(tx.unknowing(F.col("hypothesis")), 1)).alias("idk"))


@query("cost_per_thousand", "SELECT method, round(avg(input_tokens) * 1000 * 0.15::DOUBLE / 1e6, 6) AS dollars FROM (SELECT DISTINCT * FROM qa_compare) GROUP BY method")
def cost_per_thousand(s, d):
    return once(s, d, "qa_compare", "prediction_id").groupBy("method").agg(F.round(F.avg("input_tokens") * 1000 * 0.15 / 1e6, 6).alias("dollars"))


@query("best_combination", "SELECT question_type, arg_max(method, (h, method)) AS method FROM (SELECT question_type, method, round(avg(hit_at_k), 6) AS h FROM (SELECT DISTINCT * FROM qa_compare) WHERE question_type IS NOT NULL AND hit_at_k IS NOT NULL GROUP BY ALL) GROUP BY question_type")
def best_combination(s, d):
    own = once(s, d, "qa_compare", "prediction_id").where("question_type is not null and hit_at_k is not null").groupBy("question_type", "method").agg(F.round(F.avg("hit_at_k"), 6).alias("h"))
    return own.groupBy("question_type").agg(F.max_by("method", F.struct("h", "method")).alias("method"))


_RG = "SELECT method AS system, '{m}' AS metric, avg({c}) AS value FROM (SELECT DISTINCT * FROM qa_compare) WHERE {c} >= 0 AND NOT isnan(CAST({c} AS DOUBLE)) AND {c} < 1e9 AND run_day {op} DATE '2025-03-16' GROUP BY method"


@query("regress_diff", "WITH g AS (" + " UNION ALL ".join(_RG.format(m=m, c=c, op="<") for m, c in (("llm_ms", "llm_ms"), ("hit", "hit_at_k"))) + "), c AS (" + " UNION ALL ".join(_RG.format(m=m, c=c, op=">=") for m, c in (("llm_ms", "llm_ms"), ("hit", "hit_at_k"))) + """)
SELECT system, metric, round(g.value, 4) AS golden, round(c.value, 4) AS current, CASE WHEN g.value IS NULL THEN 'new' WHEN c.value IS NULL THEN 'missing' WHEN CASE WHEN metric LIKE '%!_ms' ESCAPE '!' THEN c.value > g.value * (1 + 0.2::DOUBLE) ELSE c.value < g.value * (1 - 0.05::DOUBLE) END THEN 'regression' ELSE 'pass' END AS status FROM g FULL JOIN c USING (system, metric)""")
def regress_diff(s, d):
    own = once(s, d, "qa_compare", "prediction_id")

    def part(name, c, when):
        v = F.col(c).cast("double")
        return own.where((v >= 0) & ~F.isnan(v) & (v < 1e9) & when).groupBy(F.col("method").alias("system")).agg(F.avg(v).alias("value")).withColumn("metric", F.lit(name))

    side = lambda when: part("llm_ms", "llm_ms", when).unionByName(part("hit", "hit_at_k", when))
    cut_ = F.lit("2025-03-16").cast("date")
    out = mt.regressions(side(F.col("run_day") < cut_), side(F.col("run_day") >= cut_))
    return out.withColumn("golden", F.round("golden", 4)).withColumn("current", F.round("current", 4))


_SP = "(SELECT input_tokens AS a, hit_at_k AS b FROM (SELECT DISTINCT * FROM qa_compare) WHERE input_tokens IS NOT NULL AND hit_at_k IS NOT NULL)"


@query("spearman", f"SELECT count(*) AS n, round(coalesce(corr(ra, rb), 0), 6) AS rho FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM {_SP})")
def spearman(s, d):
    return mt.spearman(once(s, d, "qa_compare", "prediction_id"), "input_tokens", "hit_at_k").withColumn("rho", F.round("rho", 6))


@query("transfer_metrics", f"""WITH m AS (SELECT train_task, test_task, avg(hit_at_k) AS acc FROM (SELECT CAST(round(alpha * 10) AS INTEGER) % 4 AS train_task, shard % 4 AS test_task, hit_at_k FROM {_SW}) GROUP BY ALL), l AS (SELECT max(train_task) AS last FROM m), o AS (SELECT test_task, acc AS own FROM m WHERE train_task = test_task)
SELECT round(avg(CASE WHEN train_task = last THEN acc END), 6) AS acc, round(avg(CASE WHEN train_task = last AND test_task < last THEN acc - own END), 6) AS bwt, round(avg(CASE WHEN test_task = train_task + 1 THEN acc END), 6) AS fwt FROM m JOIN o USING (test_task), l""")
def transfer_metrics(s, d):
    acc = _sweep(s, d).groupBy((F.round(F.col("alpha") * 10).cast("int") % 4).alias("train_task"), (F.col("shard") % 4).alias("test_task")).agg(F.avg("hit_at_k").alias("acc"))
    return mt.transfer(acc).select(*(F.round(c, 6).alias(c) for c in ("acc", "bwt", "fwt")))


@query("drift_recall", f"SELECT CASE WHEN date_diff('day', run_day, DATE '2025-03-30') <= 3 THEN 'recent' WHEN date_diff('day', run_day, DATE '2025-03-30') <= 10 THEN 'mid' ELSE 'old' END AS age, count(*) AS n, round(avg(hit_at_k), 6) AS hit FROM {_SW} WHERE run_day IS NOT NULL GROUP BY 1")
def drift_recall(s, d):
    days = F.datediff(F.lit("2025-03-30").cast("date"), "run_day")
    age = F.when(days <= 3, "recent").when(days <= 10, "mid").otherwise("old")
    return _sweep(s, d).where("run_day is not null").groupBy(age.alias("age")).agg(F.count("*").alias("n"), F.round(F.avg("hit_at_k"), 6).alias("hit"))


@query("cooccurrence", "WITH u AS (SELECT DISTINCT user_id, event_type FROM events) SELECT a.event_type AS a, b.event_type AS b, count(*) AS n FROM u a JOIN u b ON a.user_id = b.user_id AND a.event_type <> b.event_type GROUP BY ALL")
def cooccurrence(s, d):
    """Both orders of the kinds that a user has; kinds are few, so are a user's pairs."""
    u = table(s, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return u.select(F.explode("kinds").alias("a"), "kinds").select("a", F.explode("kinds").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("tracker_summary", "SELECT event_type, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, arg_max(value, event_id) AS last, count(*) AS n FROM events GROUP BY event_type")
def tracker_summary(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("value", "event_id").alias("last"), F.count("*").alias("n"))


@query("mean_pool", "SELECT label, pos, round(avg(x), 6) AS value FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(64)) AS pos FROM embeddings) GROUP BY label, pos".replace("label, pos, round", "label, CAST(pos AS INTEGER) AS pos, round"))
def mean_pool(s, d):
    return table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("value"))


# ------------------------------------------------------------------ typed records
@query("schema_catalogue")
def schema_catalogue(s, d):
    return schemas.catalogue(s)


@query("schema_domains", "SELECT domain, CAST(types AS INTEGER) AS types FROM (VALUES ('agent', 4), ('code', 4), ('collab', 4), ('conv', 3), ('creative', 4), ('customer', 4), ('km', 4), ('research', 4)) AS t(domain, types)")
def schema_domains(s, d):
    """How many record types each domain declares."""
    return schemas.catalogue(s).select(F.split_part("type", F.lit("."), F.lit(1)).alias("domain"), "type").distinct().groupBy("domain").agg(F.count("*").cast("int").alias("types"))


@query("schema_violations", "SELECT count(*) AS n FROM (SELECT DISTINCT * FROM extracted_facts) WHERE text IS NULL OR user_id IS NULL OR (category IS NOT NULL AND category NOT IN ('identity', 'preference', 'relationship', 'goal', 'location', 'other'))")
def schema_violations(s, d):
    none = F.lit(None).cast("string")
    f = once(s, d, "extracted_facts", "fact_id").select(F.col("user_id").alias("subject"), F.lit("said").alias("predicate"), F.col("text").alias("object"), F.lit(1.0).alias("confidence"), none.alias("source_turn_id"), "category")
    return schemas.any_violation(f, "conv.fact").agg(F.count("*").alias("n"))


@query("schema_search_text", "SELECT fact_id, concat_ws(' ', user_id, 'said', text) AS line FROM (SELECT DISTINCT fact_id, user_id, text FROM extracted_facts)")
def schema_search_text(s, d):
    f = once(s, d, "extracted_facts", "fact_id").select("fact_id", F.col("user_id").alias("subject"), F.lit("said").alias("predicate"), F.col("text").alias("object"))
    return f.select("fact_id", schemas.search_text("conv.fact").alias("line"))


# ------------------------------------------------------------------ graph: customers and suppliers, an edge per pair that traded
_EDGES = """(SELECT o_custkey AS source_id, l_suppkey + 1000000 AS target_id, min(o_orderkey) AS creation_step, max(o_orderkey) AS last_active_step, round(sum(l_quantity) / 100000, 8) AS strength, round(avg(l_discount), 6) AS weight
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""


def _edges(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_discount")
    o = table(s, d, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("source_id"), (F.col("l_suppkey") + 1000000).alias("target_id")).agg(
        F.min("o_orderkey").alias("creation_step"), F.max("o_orderkey").alias("last_active_step"), F.round(F.sum("l_quantity") / 100000, 8).alias("strength"), F.round(F.avg("l_discount"), 6).alias("weight")
    )


def _nodes(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "sensor").otherwise("associator").alias("node_type"), F.round(F.col("c_acctbal") / 10000, 6).alias("activation"))
    p = table(s, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("id"), F.lit("integrator").alias("node_type"), F.round(F.col("s_acctbal") / 10000, 6).alias("activation"))
    return c.unionByName(p)


_NODES = "(SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'sensor' ELSE 'associator' END AS node_type, round(c_acctbal / 10000, 6) AS activation FROM customer UNION ALL SELECT s_suppkey + 1000000, 'integrator', round(s_acctbal / 10000, 6) FROM supplier)"


@query("prune_edges", f"SELECT source_id, target_id FROM {_EDGES} WHERE NOT (20000 - creation_step >= 2000 AND strength < 0.0003 AND 20000 - last_active_step > 8000)")
def prune_edges(s, d):
    return gr.prune(_edges(s, d), 20000, strength=0.0003, idle=8000).select("source_id", "target_id")


_SOME = f"(SELECT * FROM {_EDGES} WHERE (source_id + target_id) % 40 = 0)"


@query("isolated_nodes", f"SELECT id FROM {_NODES} WHERE node_type NOT IN ('sensor', 'output') AND id NOT IN (SELECT source_id FROM {_SOME} UNION ALL SELECT target_id FROM {_SOME})")
def isolated_nodes(s, d):
    """On a graph that lost most edges."""
    return gr.isolated(_nodes(s, d), _edges(s, d).where("(source_id + target_id) % 40 = 0")).select("id")


@query("degrees", f"SELECT coalesce(a.id, b.id) AS id, coalesce(outs, 0) AS outs, coalesce(ins, 0) AS ins FROM (SELECT source_id AS id, count(*) AS outs FROM {_EDGES} GROUP BY 1) a FULL JOIN (SELECT target_id AS id, count(*) AS ins FROM {_EDGES} GROUP BY 1) b ON a.id = b.id")
def degrees(s, d):
    return gr.degrees(_edges(s, d))


@query("hebbian_update", f"SELECT source_id, target_id, round(CASE WHEN a.activation IS NULL OR b.activation IS NULL THEN weight ELSE greatest(-5, least(5, CASE WHEN abs(a.activation) > 0.1 AND abs(b.activation) > 0.1 THEN weight * 0.999::DOUBLE + 0.01::DOUBLE * abs(a.activation) * abs(b.activation) ELSE weight END)) END, 6) AS weight, round(CASE WHEN a.activation IS NULL OR b.activation IS NULL THEN strength ELSE 0.999::DOUBLE * strength + (1 - 0.999::DOUBLE) * abs(a.activation) END, 6) AS strength FROM {_EDGES} e LEFT JOIN (SELECT * FROM {_NODES} WHERE id % 10 <> 0) a ON a.id = source_id LEFT JOIN (SELECT * FROM {_NODES} WHERE id % 10 <> 0) b ON b.id = target_id")
def hebbian_update(s, d):
    """Every tenth node is silent."""
    return gr.hebbian(_edges(s, d), _nodes(s, d).where("id % 10 <> 0"), threshold=0.1).select("source_id", "target_id", F.round("weight", 6).alias("weight"), F.round("strength", 6).alias("strength"))


@query("homeostatic_gain", f"SELECT id, round(CASE WHEN activation > 0.6 THEN 0.999::DOUBLE WHEN activation < 0.4 THEN 1.001::DOUBLE ELSE 1.0::DOUBLE END, 6) AS gain FROM {_NODES}")
def homeostatic_gain(s, d):
    return _nodes(s, d).select("id", F.round(gr.gain(F.col("activation"), F.lit(0.5), F.lit(1.0)), 6).alias("gain"))


@query("excess_edges", f"""WITH e AS (SELECT * FROM {_EDGES} WHERE NOT (20000 - creation_step >= 2000 AND strength < 0.0003 AND 20000 - last_active_step > 8000)),
r AS (SELECT *, row_number() OVER (ORDER BY strength, source_id, target_id) AS r FROM e WHERE 20000 - creation_step >= 2000)
SELECT source_id, target_id, strength FROM r WHERE r <= (SELECT count(*) FROM e) - 20 * (SELECT count(*) FROM {_NODES})""")
def excess_edges(s, d):
    """After the sweep of ``prune_edges``, at the same step."""
    left = cut(gr.prune(_edges(s, d), 20000, strength=0.0003, idle=8000))
    return gr.excess(left, _nodes(s, d).count(), 20000, 20.0).select("source_id", "target_id", "strength")


_STEPS = "(SELECT DISTINCT event_id AS source_id, lead(event_id) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS target_id FROM events)"


def _steps(s, d):
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("event_id")
    return table(s, d, "events").select(F.col("event_id").alias("source_id"), F.lead("event_id").over(w).alias("target_id")).where("target_id is not null")


@query("linear_chains", f"""WITH e AS (SELECT * FROM {_STEPS} WHERE target_id IS NOT NULL), one AS (SELECT source_id AS id FROM e WHERE source_id IN (SELECT target_id FROM e)), i AS (SELECT * FROM e WHERE source_id IN (SELECT id FROM one) AND target_id IN (SELECT id FROM one)),
st AS (SELECT id FROM one WHERE id NOT IN (SELECT target_id FROM i))
SELECT st.id AS start, CAST(1 + count(a.target_id) + count(b.target_id) + count(c.target_id) AS INTEGER) AS n FROM st JOIN i a ON a.source_id = st.id LEFT JOIN i b ON b.source_id = a.target_id LEFT JOIN i c ON c.source_id = b.target_id GROUP BY st.id""")
def linear_chains(s, d):
    return gr.chains(_steps(s, d)).select("start", F.size("nodes").alias("n"))


@query("wave_levels", f"SELECT CAST(n AS INTEGER) AS wave, count(*) AS nodes FROM (SELECT row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) - 1 AS n, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS m FROM events) WHERE m > 1 GROUP BY n")
def wave_levels(s, d):
    return gr.waves(_steps(s, d)).groupBy("wave").agg(F.count("*").alias("nodes"))


@query("topological_order", "SELECT user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS component, event_id AS id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) - 1 AS place FROM (SELECT *, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS n FROM events) WHERE n > 1")
def topological_order(s, d):
    e = table(s, d, "events")
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("event_id")
    steps = e.select(F.concat_ws("/", "user_id", F.to_date("ts").cast("string")).alias("component"), F.col("event_id").alias("source_id"), F.lead("event_id").over(w).alias("target_id")).where("target_id is not null")
    return gr.topological_order(steps)


@query("birth_probability", "SELECT event_id, round(least(1.0::DOUBLE, value / 10 * exp(-(event_id % 10)::DOUBLE / 3.0::DOUBLE) * 0.5::DOUBLE), 6) AS p FROM events")
def birth_probability(s, d):
    return table(s, d, "events").select("event_id", F.round(gr.birth_probability((F.col("event_id") % 10).cast("double"), F.col("value") / 10, 3.0, 0.5), 6).alias("p"))


@query("replay_priority", "SELECT event_id, round(value * exp(-pow(((10000 - event_id) - 1000.0::DOUBLE) / 2000.0::DOUBLE, 2)), 6) AS priority FROM events")
def replay_priority(s, d):
    return table(s, d, "events").select("event_id", F.round(gr.replay_priority(F.col("value"), (F.lit(10000) - F.col("event_id")).cast("double"), F.lit(True)), 6).alias("priority"))


@query("replay_sample")
def replay_sample(s, d):
    return gr.sample_without_replacement(table(s, d, "events").select("event_id", "value"), "value", 200, "event_id")


@query("critical_period", "SELECT event_id, round(CASE WHEN event_id < 1000 OR event_id > 9000 THEN 1.0::DOUBLE WHEN event_id <= 3000 THEN 1 + (event_id - 1000) / 2000.0::DOUBLE ELSE 1 + (9000 - event_id) / 6000.0::DOUBLE END, 6) AS m FROM events")
def critical_period(s, d):
    m = gr.critical_period(F.col("event_id"), F.lit(1000), F.lit(3000), F.lit(9000), F.lit(2.0))
    return table(s, d, "events").select("event_id", F.round(m, 6).alias("m"))


@query("attention_recall", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[]) AS q FROM embeddings), e AS (SELECT x, exp(4 * list_inner_product(x, q)) AS e FROM v) SELECT CAST(pos AS INTEGER) AS pos, round(sum(e * c) / sum(e), 6) AS value FROM (SELECT e, unnest(x) AS c, unnest(range(64)) AS pos FROM e) GROUP BY pos")
def attention_recall(s, d):
    v = table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    q = v.where("vec_id = 0").first()["vector"]
    return gr.attention(v.select("vector"), list(q), 4.0).withColumn("value", F.round("value", 6))


# ------------------------------------------------------------------ sequences on a user's days
@query("rolling_ratio", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS recent, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS baseline FROM events")
def rolling_ratio(s, d):
    out = sq.ratio_trigger(table(s, d, "events"), "value", ["user_id"], ["event_id"], 5, 20)
    return out.select("event_id", F.round("recent", 6).alias("recent"), F.round("baseline", 6).alias("baseline"))


@query("ring_statistics", "SELECT event_id, round(var_pop(value) OVER w, 2) AS variance, min(value) OVER w AS low, max(value) OVER w AS high FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def ring_statistics(s, d):
    r = lambda how: sq.rolling("value", 10, ["user_id"], ["event_id"], how)
    return table(s, d, "events").select("event_id", F.round(r(F.var_pop), 2).alias("variance"), r(F.min).alias("low"), r(F.max).alias("high"))


@query("delta_previous", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS delta FROM events")
def delta_previous(s, d):
    return table(s, d, "events").select("event_id", F.round(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id")), 6).alias("delta"))


@query("learning_progress", """SELECT event_id, round(CASE WHEN row_number() OVER w < 20 THEN 1.0::DOUBLE ELSE coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (avg(value) OVER (w ROWS BETWEEN 9 PRECEDING AND 2 PRECEDING) - avg(value) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) / greatest(abs(avg(value) OVER (w ROWS BETWEEN 9 PRECEDING AND 2 PRECEDING)), 1e-8))), 0) END, 6) AS progress FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY event_id)""")
def learning_progress(s, d):
    return sq.learning_progress(table(s, d, "events"), "value", ["event_type", "user_id"], ["event_id"], 20).select("event_id", F.round("progress", 6).alias("progress"))


@query("moving_average", """WITH n AS (SELECT user_id, CAST(ts AS DATE) AS day, value, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS n FROM events)
SELECT user_id, day, round(sum(value * CASE WHEN i = 1 THEN pow(0.9::DOUBLE, n - 1) ELSE 0.1::DOUBLE * pow(0.9::DOUBLE, n - i) END), 6) AS ema FROM n GROUP BY user_id, day""")
def moving_average(s, d):
    e = table(s, d, "events").withColumn("day", F.to_date("ts"))
    return e.groupBy("user_id", "day").agg(F.round(sq.exponential_mean(sq.blocks(e, [], "event_id", F.col("value")), 0.1), 6).alias("ema"))


_BUCKET = """WITH RECURSIVE o AS (SELECT {g}, epoch(ts) AS t, row_number() OVER (PARTITION BY {g} ORDER BY {o}) AS i FROM (SELECT *, CAST(ts AS DATE) AS day FROM events)),
r AS (SELECT {g}, i, t, {b} - 1.0::DOUBLE AS tokens, CAST(1 AS {n}) AS allowed, CAST(0 AS {n}) AS denied FROM o WHERE i = 1
UNION ALL SELECT {rg}, i, t, CASE WHEN x >= 1 THEN x - 1 ELSE x END, allowed + CAST(x >= 1 AS {n}), denied + CAST(x < 1 AS {n})
FROM (SELECT {rq}, o.i, greatest(o.t, r.t) AS t, r.allowed, r.denied, least({b}::DOUBLE, r.tokens + greatest(0.0::DOUBLE, o.t - r.t) / 3600) AS x FROM r JOIN o ON {j} AND o.i = r.i + 1))
SELECT {g}, max(allowed) AS allowed, max(denied) AS denied FROM r GROUP BY ALL"""


@query("rate_limit", _BUCKET.format(g="user_id, day", rg="user_id, day", rq="r.user_id, r.day", o="event_id", b="2.0", n="INTEGER", j="o.user_id = r.user_id AND o.day = r.day"))
def rate_limit(s, d):
    e = table(s, d, "events").withColumn("day", F.to_date("ts"))
    seconds = F.col("ts").cast("timestamp").cast("double")
    return e.groupBy("user_id", "day").agg(sq.token_bucket(sq.blocks(e, [], "event_id", seconds), 1 / 3600, 2.0).alias("b")).select("user_id", "day", "b.allowed", "b.denied")


@query("spike_multiplier", """WITH RECURSIVE o AS (SELECT event_type, day, value, row_number() OVER (PARTITION BY event_type, day ORDER BY event_id) AS i FROM (SELECT *, CAST(ts AS DATE) AS day FROM events)),
r AS (SELECT event_type, day, i, value::DOUBLE AS mean, 1.0::DOUBLE AS m FROM o WHERE i = 1
UNION ALL SELECT r.event_type, r.day, o.i, 0.9::DOUBLE * r.mean + 0.1::DOUBLE * o.value, CASE WHEN o.value > 2 * r.mean THEN r.m * 0.5::DOUBLE ELSE least(1.0::DOUBLE, r.m * 1.05::DOUBLE) END FROM r JOIN o ON o.event_type = r.event_type AND o.day = r.day AND o.i = r.i + 1)
SELECT event_type, day, round(arg_max(m, i), 6) AS multiplier FROM r GROUP BY ALL""")
def spike_multiplier(s, d):
    e = table(s, d, "events").withColumn("day", F.to_date("ts"))
    return e.groupBy("event_type", "day").agg(F.round(sq.spike_multiplier(sq.blocks(e, [], "event_id", F.col("value"))), 6).alias("multiplier"))


# ------------------------------------------------------------------ set operations and streams
@query("set_operations", "SELECT (SELECT count(*) FROM (SELECT node_id FROM store_requests INTERSECT SELECT source_turn_id FROM extracted_facts)) AS both_, (SELECT count(*) FROM (SELECT node_id FROM store_requests EXCEPT SELECT source_turn_id FROM extracted_facts)) AS only_a")
def set_operations(s, d):
    a, b = table(s, d, "store_requests").select("node_id"), table(s, d, "extracted_facts").select(F.col("source_turn_id").alias("node_id"))
    return a.intersect(b).agg(F.count("*").alias("both_")).crossJoin(a.subtract(b).agg(F.count("*").alias("only_a")))  # one row each


@query("stream_tumbling", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(s, d):
    return jobs.drain(jobs.tumbling(jobs.event_stream(s, f"{d}/events.parquet")), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sliding", "SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start FROM events) GROUP BY start")
def stream_sliding(s, d):
    return jobs.drain(jobs.sliding(jobs.event_stream(s, f"{d}/events.parquet")), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM n GROUP BY user_id, k""")
def session_windows(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.sessions(e).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_late", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL HAVING date_trunc('day', any_value(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stream_late(s, d):
    """Append mode: only windows that the watermark has closed."""
    return jobs.drain(jobs.tumbling(jobs.event_stream(s, f"{d}/events.parquet"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_rate_limit", _BUCKET.format(g="user_id", rg="user_id", rq="r.user_id", o="ts", b="5.0", n="BIGINT", j="o.user_id = r.user_id"))
def stream_rate_limit(s, d):
    out = shared_path(s, "streams")
    q = jobs.limited(jobs.event_stream(s, f"{d}/events.parquet"), 1 / 3600, 5.0).writeStream.outputMode("update").foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{out}/rows")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = s.read.parquet(f"{out}/rows")
    return rows.groupBy("user_id").agg(F.sum("allowed").alias("allowed"), F.sum("denied").alias("denied"))
