"""Queries on the store's state, writes to conversations, forgetting, and prompts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallframe.functions import where as wh
from recallframe.operators import conversation as cv
from recallframe.operators import packing as pk
from recallframe.operators import sessions as se
from recallframe.operators import store as st
from recallframe.plans.memory_queries import _BLOCKS, _FOLD, _GONE, _HITS, _OPS, _SET, _TURNS, _hits, _ops, _turns
from recallframe.plans.retrieval_queries import once
from recallframe.session import cut, shared_path, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# ------------------------------------------------------------------ the log's state
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_STATE = f"""WITH o AS (SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'forget' WHEN 'signup' THEN 'update' ELSE 'store' END AS op, user_id || '-' || {_K} % 4 AS node_id, {_K} AS k FROM events{{w}}),
g AS (SELECT *, coalesce(max(CASE WHEN op = 'forget' THEN seq END) OVER (PARTITION BY node_id), -1) AS gone FROM o),
l AS (SELECT *, min(CASE WHEN op = 'store' THEN seq END) OVER (PARTITION BY node_id) AS born FROM g WHERE seq > gone AND op <> 'forget')
SELECT node_id, born AS seq, arg_max(k, seq) FILTER (WHERE seq = born OR op = 'update') AS k, arg_max(seq, seq) FILTER (WHERE op = 'update') AS patched FROM l WHERE born IS NOT NULL AND seq >= born GROUP BY node_id, born"""


def _patched(s, d):
    """Operations whose patches also say when they came."""
    o = _ops(s, d)
    return o.withColumn("patch", F.when(F.col("op") == "update", F.to_json(F.struct(F.get_json_object("patch", "$.k").cast("long").alias("k"), F.col("seq").alias("patched")))))


def _contents(state):
    return state.select("node_id", "seq", F.get_json_object("metadata", "$.k").cast("long").alias("k"), F.get_json_object("metadata", "$.patched").cast("long").alias("patched"))


@query("merged_state", _STATE.replace("{w}", ""))
def merged_state(s, d):
    """Contents of the entries' metadata after all patches."""
    return _contents(st.fold(_patched(s, d)))


@query("snapshot_and_tail", _STATE.replace("{w}", ""))
def snapshot_and_tail(s, d):
    """The state from a written snapshot and the operations behind it."""
    ops, path = _patched(s, d), shared_path(s, "snapshots")
    snapshot, tail = st.compact(ops, 5000)
    st.write_snapshot(snapshot, path, 5000)
    return _contents(st.with_tail(st.read_snapshot(s, path)[0], tail))


@query("patched_filter", f"SELECT node_id FROM ({_STATE.replace('{w}', '')}) WHERE k > 50")
def patched_filter(s, d):
    """A numeric filter holds after a patch: fields keep their types."""
    return st.fold(_patched(s, d)).where(wh.compile_where({"k": {"$gt": 50}}, F.col("metadata"))).select("node_id")


@query("reload_changed", f"SELECT node_id, arg_max(op, seq) AS last_op, max(seq) AS seq FROM {_OPS.replace('{w}', '')} WHERE seq > 9000 GROUP BY node_id")
def reload_changed(s, d):
    return st.changed(_ops(s, d), 9000)


@query("recovered_log", _FOLD.replace("{w}", " WHERE event_id < 7919"))
def recovered_log(s, d):
    """A record without an operation in the middle of the log: all before it counts."""
    torn = _ops(s, d).withColumn("op", F.when(F.col("seq") % 7919 == 0, F.when(F.col("seq") == 0, F.col("op"))).otherwise(F.col("op")))
    return st.fold(st.before_damage(torn)).select("node_id", "seq", "text", "patches")


@query("migrated_records", "SELECT node_id AS chroma_id, trim(text, ' ') AS text, 'chroma-migration' AS source, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.lang') END AS lang FROM (SELECT DISTINCT * FROM store_requests) WHERE trim(text, ' ') <> ''")
def migrated_records(s, d):
    own = st.migrated(once(s, d, "store_requests", "request_id"), "node_id", "text")
    j = lambda f: F.get_json_object("metadata", f"$.{f}").alias(f)
    return own.select(j("chroma_id"), "text", j("source"), j("lang"))


@query("dumped_lines", _FOLD.replace("{w}", "").replace("count(CASE WHEN op = 'update' THEN 1 END) AS patches", "1 AS one").replace("SELECT node_id, born AS seq,", "SELECT node_id AS id, born AS timestamp_step,").replace(", 1 AS one", ""))
def dumped_lines(s, d):
    """The dump's JSON lines, read again."""
    path = shared_path(s, "dump")
    st.fold(_ops(s, d)).select(F.col("node_id").alias("id"), "text", "metadata", F.col("seq").alias("timestamp_step")).write.mode("overwrite").json(path)
    return s.read.schema("id string, text string, timestamp_step long").json(path)


@query("cleared_entries", "SELECT node_id, 'fact' AS kind FROM (SELECT DISTINCT fact_id, node_id, session_id, user_id FROM extracted_facts) WHERE session_id = (SELECT min(session_id) FROM extracted_facts)")
def cleared_entries(s, d):
    facts = once(s, d, "extracted_facts", "fact_id")
    first = facts.agg(F.min("session_id")).first()[0]
    return se.cleared(facts.withColumn("kind", F.lit("fact")), first or "").select("node_id", "kind")


# ------------------------------------------------------------------ scoped reads
def _scoped_facts(s, d):
    f = once(s, d, "extracted_facts", "fact_id")
    mark = F.when(F.col("fact_id") % 5 == 0, F.lit("x"))
    return f.select("fact_id", "text", F.to_json(F.struct("session_id", "user_id", F.lit("fact").alias("type"), "category", mark.alias("superseded_by"))).alias("metadata"))


_HOT = "(SELECT session_id, user_id FROM (SELECT DISTINCT fact_id, session_id, user_id FROM extracted_facts) WHERE session_id IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL ORDER BY count(*) DESC, session_id, user_id LIMIT 1)"


def _hot(s, d):
    f = once(s, d, "extracted_facts", "fact_id").where("session_id is not null and user_id is not null")
    return f.groupBy("session_id", "user_id").count().orderBy(F.desc("count"), "session_id", "user_id").first()


_FACTS = "(SELECT DISTINCT fact_id, text, session_id, user_id, category FROM extracted_facts)"
for _name, _how, _sql in (
    ("scoped_own_user", {}, "user_id = (SELECT user_id FROM hot) AND fact_id % 5 <> 0"),
    ("scoped_all_users", {"user_id": None}, "fact_id % 5 <> 0"),
    ("scoped_history", {"superseded": True}, "user_id = (SELECT user_id FROM hot)"),
    ("scoped_override", {"where": {"user_id": "u-000001", "category": {"$in": ["goal", "event"]}}}, "user_id = 'u-000001' AND category IN ('goal', 'event') AND fact_id % 5 <> 0"),
):
    def _scoped(s, d, how=_how):
        hot = _hot(s, d)
        where = se.scope(hot["session_id"], own_user=hot["user_id"], kind="fact", **how)
        return _scoped_facts(s, d).where(wh.compile_where(where, F.col("metadata"))).select("fact_id")

    query(_name, f"WITH hot AS {_HOT} SELECT fact_id FROM {_FACTS} WHERE session_id = (SELECT session_id FROM hot) AND {_sql}")(_scoped)


@query("string_filter", "SELECT request_id FROM (SELECT DISTINCT * FROM store_requests) WHERE metadata IS NOT NULL AND json_valid(metadata) AND json_extract_string(metadata, '$.lang') = 'en' ORDER BY request_id LIMIT 50")
def string_filter(s, d):
    """Fields compared as text, the first 50 that hold."""
    return once(s, d, "store_requests", "request_id").where(wh.as_text({"lang": "en"}, F.col("metadata"))).orderBy("request_id").limit(50).select("request_id")


# ------------------------------------------------------------------ writes
@query("batch_extract", f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY session_id, extract_batch ORDER BY fact_id) - 1 AS i, count(*) OVER (PARTITION BY session_id, extract_batch) AS n, list(node_id) OVER (PARTITION BY session_id, extract_batch ORDER BY fact_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ids
FROM (SELECT DISTINCT fact_id, node_id, session_id, extract_batch, category, text FROM extracted_facts WHERE session_id IS NOT NULL AND text IS NOT NULL)),
k AS (SELECT *, CASE WHEN fact_id % 3 = 0 THEN n + 5 ELSE i END AS spot FROM f WHERE category IS NOT NULL AND trim(text, ' ') <> '')
SELECT session_id, extract_batch, CASE WHEN lower(trim(category)) IN ('preference', 'goal', 'biographical', 'relationship', 'event', 'other') THEN lower(trim(category)) ELSE 'other' END AS category, trim(text, ' ') AS text, ids[CASE WHEN spot < n THEN spot + 1 ELSE n END] AS source_turn_id FROM k""")
def batch_extract(s, d):
    """A batch's facts with the turns they come from; every third index is out of range."""
    w = Window.partitionBy("session_id", "extract_batch")
    f = once(s, d, "extracted_facts", "fact_id").where("session_id is not null and text is not null").withColumn("i", F.row_number().over(w.orderBy("fact_id")) - 1).withColumn("n", F.count("*").over(w))
    item = F.struct("i", F.struct("category", "text", F.when(F.col("fact_id") % 3 == 0, F.col("n").cast("int") + 5).otherwise(F.col("i")).alias("turn_index")).alias("item"), "node_id")
    held = f.groupBy("session_id", "extract_batch").agg(F.array_sort(F.collect_list(F.struct("i", "node_id"))).alias("ids"), F.collect_list(item).alias("items"))  # one extraction's facts
    raw = held.select("session_id", "extract_batch", F.col("ids.node_id").alias("ids"), F.to_json(F.col("items.item")).alias("raw"))
    return raw.select("session_id", "extract_batch", F.explode(se.parsed_batch(F.col("raw"), F.col("ids"))).alias("f")).select("session_id", "extract_batch", "f.*")


def first_clause(texts: list[str]) -> str:
    return json.dumps([{"category": "other", "text": t.split(".")[0], "turn_index": i} for i, t in enumerate(texts)])


@query("add_messages", f"""WITH t AS (SELECT * FROM {_TURNS} WHERE trim(text, ' ') <> ''), n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index) AS n FROM t),
b AS (SELECT session_id, CASE WHEN (n // 4) % 5 = 0 THEN n - 19 ELSE n - 3 END AS a, n AS z FROM n WHERE n % 4 = 0)
SELECT 'turn' AS kind, session_id, text, turn_id AS source_turn_id FROM t UNION ALL SELECT 'fact', session_id, trim(split_part(text, '.', 1), ' '), turn_id FROM t WHERE trim(split_part(text, '.', 1), ' ') <> ''
UNION ALL SELECT 'summary', b.session_id, string_agg('user: ' || text, chr(10) ORDER BY turn_index), NULL FROM b JOIN t ON t.session_id = b.session_id AND t.turn_index BETWEEN a AND z GROUP BY b.session_id, a, z""")
def add_messages(s, d):
    return se.add_messages(_turns(s, d), first_clause, 8, 4)


@query("add_messages_each", "SELECT count(*) AS turns FROM (SELECT DISTINCT * FROM store_requests) WHERE user_id IS NOT NULL AND trim(text, ' ') <> ''")
def add_messages_each(s, d):
    """Extraction of every turn by itself asks once per turn."""
    return se.batches(_turns(s, d), 1).agg(F.sum(F.size("turn_ids")).alias("turns"))


_BEST = f"""fs AS (SELECT fact_id, session_id, user_id, {_SET.replace('{x}', 'text')} AS ws FROM (SELECT DISTINCT fact_id, session_id, user_id, text FROM extracted_facts WHERE text IS NOT NULL AND session_id IS NOT NULL)),
c AS (SELECT f.fact_id, o.fact_id AS other_id, len(list_intersect(f.ws, o.ws))::DOUBLE / greatest(1, len(list_distinct(list_concat(f.ws, o.ws)))) AS score FROM fs f JOIN fs o ON f.session_id = o.session_id AND (f.user_id IS NULL OR o.user_id = f.user_id) AND o.fact_id < f.fact_id),
t AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY score DESC, other_id) AS r FROM c)"""


def _best(s, d):
    """fact_id, best, target: the likest earlier fact of the session and user."""
    from recallframe.plans.memory_queries import candidates

    c = candidates(s, d).where("r = 1")
    facts = once(s, d, "extracted_facts", "fact_id").where("text is not null and session_id is not null").select("fact_id")
    return facts.join(c.select("fact_id", F.col("score").alias("best"), F.col("other_id").alias("target")), "fact_id", "left")


_DECIDED = f"""WITH {_BEST}, b AS (SELECT fs.fact_id, score AS best, other_id AS target, fs.fact_id % 6 AS m FROM fs LEFT JOIN t ON t.fact_id = fs.fact_id AND r = 1),
o AS (SELECT fact_id, CASE WHEN best >= 0.92 THEN 'NOOP' WHEN best >= 0.2 AND m = 1 THEN 'UPDATE' WHEN best >= 0.2 AND m = 2 THEN 'SUPERSEDE' WHEN best >= 0.2 AND m = 3 THEN 'NOOP' ELSE 'ADD' END AS op, target FROM b)"""


def _decisions(s, d):
    """Replies of a model that answers by the fact's number, now and then without a target or with an unknown operation."""
    best = cut(_best(s, d))
    m = F.col("fact_id") % 6
    op = F.when(m == 0, "ADD").when((m == 1) | (m == 5), "UPDATE").when(m == 2, "SUPERSEDE").when(m == 3, "NOOP").otherwise("MERGE")
    replies = best.select("fact_id", op.alias("op"), F.when(m != 5, F.col("target")).alias("target"), F.lit(True).alias("known"))
    return se.decided(best.select("fact_id", "best"), replies, 0.92, 0.2)


@query("reconcile_decisions", f"{_DECIDED} SELECT fact_id, op, CASE WHEN op IN ('UPDATE', 'SUPERSEDE') THEN target END AS target FROM o")
def reconcile_decisions(s, d):
    return _decisions(s, d)


@query("reconcile_writes", f"""{_DECIDED} SELECT fact_id, 1 AS place, 'store' AS action, fact_id AS entry, CASE WHEN op = 'ADD' THEN '' ELSE 'supersedes' END AS field, CASE WHEN op <> 'ADD' THEN target END AS value FROM o WHERE op <> 'NOOP'
UNION ALL SELECT fact_id, 0, 'forget', target, '', NULL FROM o WHERE op = 'UPDATE' UNION ALL SELECT fact_id, 2, 'update', target, 'superseded_by', fact_id FROM o WHERE op = 'SUPERSEDE'""")
def reconcile_writes(s, d):
    return se.fact_writes(_decisions(s, d))


# ------------------------------------------------------------------ forgetting
_FATES = f"""SELECT b.session_id, summarized_turn_start AS a, summarized_turn_end AS z, count(g.turn_id) AS dead, string_agg('user: ' || coalesce(t.text, ''), chr(10) ORDER BY t.turn_index) FILTER (WHERE g.turn_id IS NULL) AS text
FROM {_BLOCKS} b JOIN {_TURNS} t ON t.session_id = b.session_id AND t.turn_index BETWEEN summarized_turn_start AND summarized_turn_end LEFT JOIN ({_GONE}) g ON g.turn_id = t.turn_id GROUP BY ALL HAVING count(g.turn_id) > 0"""
_FORGET = f"""WITH f AS ({_FATES}), ops AS (
SELECT 0 AS place, 'fact' AS kind, 'delete' AS action, CAST(fact_id AS VARCHAR) AS entry, NULL AS text FROM (SELECT DISTINCT fact_id, source_turn_id FROM extracted_facts) WHERE source_turn_id IN (SELECT turn_id FROM ({_GONE}))
UNION ALL SELECT 1, 'turn', 'delete', turn_id, NULL FROM ({_GONE})
UNION ALL SELECT 2, 'summary', CASE WHEN text IS NULL THEN 'delete' ELSE 'regenerate' END, session_id || '/' || a || '/' || z, text FROM f)"""


def _forgotten(s, d, **how):
    turns = _turns(s, d)
    facts = once(s, d, "extracted_facts", "fact_id").select("fact_id", "source_turn_id", "user_id", F.col("category").alias("subject"))
    return se.forget(turns, facts, cv.summary_blocks(turns, 4), **how)


@query("forget_cascade", f"{_FORGET} SELECT * FROM ops")
def forget_cascade(s, d):
    return _forgotten(s, d, needle="password").ops


@query("forget_totals", f"{_FORGET} SELECT count(*) FILTER (WHERE kind = 'turn') AS deleted_turns, count(*) FILTER (WHERE kind = 'fact') AS deleted_facts, count(*) FILTER (WHERE kind = 'summary' AND action = 'delete') AS deleted_summaries, count(*) FILTER (WHERE action = 'regenerate') AS regenerated_summaries, count(*) FILTER (WHERE action = 'delete') AS total_deleted FROM ops")
def forget_totals(s, d):
    return _forgotten(s, d, needle="password").totals


@query("forget_dropping", f"{_FORGET} SELECT place, kind, entry FROM ops")
def forget_dropping(s, d):
    """Summaries dropped where they would be written anew."""
    return _forgotten(s, d, needle="password", strategy="drop").ops.where("action = 'delete'").select("place", "kind", "entry")


@query("forget_subject", "SELECT CAST(fact_id AS VARCHAR) AS entry FROM (SELECT DISTINCT fact_id, user_id, category FROM extracted_facts) WHERE user_id = 'u-000001' AND category = 'goal'")
def forget_subject(s, d):
    """Facts by user and subject together; turns of the user go as well."""
    return _forgotten(s, d, user_id="u-000001", subject="goal").ops.where("kind = 'fact'").select("entry")


@query("forget_audit_event", f"{_FORGET} SELECT 'forget' AS event, 'admin' AS actor, 'u-000001' AS target, count(*) FILTER (WHERE kind = 'turn') AS deleted_turns, count(*) FILTER (WHERE kind = 'fact') AS deleted_facts, count(*) FILTER (WHERE kind = 'summary' AND action = 'delete') AS deleted_summaries, count(*) FILTER (WHERE action = 'regenerate') AS regenerated_summaries, count(*) FILTER (WHERE action = 'delete') AS total_deleted FROM ops")
def forget_audit_event(s, d):
    """The audit's lines as they were written."""
    row, path = se.audit(_forgotten(s, d, needle="password").totals, "admin", "u-000001"), shared_path(s, "audit")
    st.append_lines(row, path)
    return s.read.schema(row.schema).json(path)


# ------------------------------------------------------------------ prompts
_META = "(SELECT answer_id AS qid, CAST(i AS INTEGER) AS rank, hits[i].node_id AS node_id, hits[i].text AS text, hits[i].score AS score, hits[i].timestamp_step AS step, CASE WHEN json_valid(hits[i].metadata) THEN json_extract_string(hits[i].metadata, '$.source') END AS source FROM (SELECT answer_id, hits, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT DISTINCT * FROM rag_answers) WHERE hits IS NOT NULL))"


def _sourced(s, d):
    own = once(s, d, "rag_answers", "answer_id").select(F.col("answer_id").alias("qid"), F.posexplode("hits").alias("p", "h"))
    return own.select("qid", (F.col("p") + 1).alias("rank"), "h.node_id", "h.text", "h.score", F.col("h.timestamp_step").alias("step"), F.get_json_object("h.metadata", "$.source").alias("source"))


@query("cited_sources", f"SELECT qid, rank, '[' || rank || '] ' || coalesce('docs/' || rank || '.md; heading: part ' || rank || '; ' || source, 'docs/' || rank || '.md; heading: part ' || rank) || chr(10) || '    ' || text AS line FROM {_META} WHERE text IS NOT NULL")
def cited_sources(s, d):
    """Citations with path, heading and source."""
    n = F.col("rank").cast("string")
    return _sourced(s, d).where("text is not null").select("qid", "rank", pk.citation(F.col("rank"), F.concat(F.lit("docs/"), n, F.lit(".md")), F.concat(F.lit("part "), n), F.col("source"), F.col("node_id"), F.col("text")).alias("line"))


@query("cite_lines", f"SELECT qid, rank, '[' || rank || '] ' || coalesce(source, substr(node_id, 1, 8)) || CASE WHEN rank % 2 = 0 THEN ' (part)' ELSE '' END || '  score=' || printf('%.3f', floor(score * 1000 + 0.5) / 1000) AS line FROM {_META}")
def cite_lines(s, d):
    none = F.lit(None).cast("string")
    return _sourced(s, d).select("qid", "rank", pk.cite_line(F.col("rank"), none, F.when(F.col("rank") % 2 == 0, "part"), F.col("source"), F.col("node_id"), F.col("score")).alias("line"))


@query("bench_context", f"SELECT qid, string_agg('[' || rank || '] ' || text, chr(10) ORDER BY rank) AS context FROM {_HITS} WHERE text IS NOT NULL AND rank <= 10 GROUP BY qid")
def bench_context(s, d):
    return pk.bench_context(_hits(s, d))


@query("rag_ask", f"""WITH c AS (SELECT qid, string_agg('[' || rank || '] ' || text, chr(10) ORDER BY rank) AS context FROM {_HITS} WHERE text IS NOT NULL AND rank <= 5 GROUP BY qid),
p AS (SELECT answer_id AS qid, CASE WHEN context IS NULL THEN 'Question: ' || question || chr(10) || 'Answer:' ELSE 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Answer:' END AS prompt FROM (SELECT DISTINCT answer_id, question FROM rag_answers) LEFT JOIN c ON qid = answer_id)
SELECT qid, prompt, CAST(length(prompt) AS VARCHAR) || ' characters read' AS answer FROM p""")
def rag_ask(s, d):
    """Asked of a model that says how much it read."""
    questions = once(s, d, "rag_answers", "answer_id").select(F.col("answer_id").alias("qid"), "question")
    return pk.ask(_hits(s, d), questions, lambda prompt: F.concat(F.length(prompt).cast("string"), F.lit(" characters read")))


@query("pack_context", f"""WITH m AS {_META}, s AS (
SELECT qid, 'recency' AS slot, 1 AS no, row_number() OVER (PARTITION BY qid ORDER BY step DESC, rank) AS rank, node_id, '[recent] ' || text AS line FROM m WHERE text IS NOT NULL
UNION ALL SELECT qid, 'relevant', 2, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank), node_id, '[hit] ' || text FROM m WHERE text IS NOT NULL
UNION ALL SELECT qid, 'decisions', 4, row_number() OVER (PARTITION BY qid ORDER BY rank), node_id, '[note] ' || text FROM m WHERE text IS NOT NULL AND source = 'note'),
l AS (SELECT * FROM s WHERE (slot = 'recency' AND rank <= 20) OR (slot = 'relevant' AND rank <= 20) OR (slot = 'decisions' AND rank <= 10)),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, node_id ORDER BY no, rank) AS f FROM l WHERE slot <> 'decisions') WHERE f = 1 UNION ALL SELECT *, 1 FROM l WHERE slot = 'decisions'),
u AS (SELECT *, sum(length(line) + CASE WHEN k > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY qid, slot ORDER BY rank) AS used FROM (SELECT *, row_number() OVER (PARTITION BY qid, slot ORDER BY rank) AS k FROM o))
SELECT qid, string_agg(line, chr(10) ORDER BY no, rank) AS context, count(*) AS lines FROM u WHERE used <= CASE slot WHEN 'recency' THEN 300 WHEN 'relevant' THEN 1000 ELSE 200 END GROUP BY qid""")
def pack_context(s, d):
    """Recency 20, relevant 20, typed 10, in a context of 500 tokens."""
    h = _sourced(s, d).where("text is not null")
    slot = lambda name, order, most, mark, own=h: own.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= most).select("qid", F.lit(name).alias("slot"), "rank", "node_id", F.concat(F.lit(f"[{mark}] "), "text").alias("line"))
    slots = slot("recency", [F.desc("step"), "rank"], 20, "recent").unionByName(slot("relevant", [F.desc("score"), "rank"], 20, "hit")).unionByName(slot("decisions", ["rank"], 10, "note", h.where("source = 'note'")))
    return pk.pack(slots, max_tokens=500)
