"""Queries of the training-data operators, and SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallframe.llm import dedup, encoder, neighbors, packer, percentiles, pii, reading, replies, splitter
from recallframe.session import cut, shared_path, table, written


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    """src, item_id, pos, text of the batches' texts and the facts, each delivery once."""
    batches = table(spark, d, "store_batches").dropDuplicates(["batch_id"]).select("batch_id", F.posexplode("texts").alias("pos", "text"))
    facts = table(spark, d, "extracted_facts").dropDuplicates(["fact_id"])
    return batches.select(F.lit("store_batches").alias("src"), F.col("batch_id").alias("item_id"), F.col("pos").cast("long"), "text").unionByName(
        facts.select(F.lit("extracted_facts").alias("src"), F.col("fact_id").alias("item_id"), F.lit(0).cast("long").alias("pos"), "text")
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.repeats(arrivals(spark, d)).distinct()


#: Deliveries into which ``p2_batches`` deals the order of arrival.
DELIVERIES = 4


def p2_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same cases as ``p2_found``, by checking one delivery after another against the stored history."""
    texts = cut(arrivals(spark, d))
    ends = texts.groupBy("src").agg(F.percentile_approx("item_id", [i / DELIVERIES for i in range(1, DELIVERIES)], 1000).alias("ends"))
    dealt = cut(texts.join(F.broadcast(ends), "src").withColumn("delivery", F.size(F.filter("ends", lambda e: e < F.col("item_id")))).drop("ends"))  # two rows
    history, found = dedup.History(spark, shared_path(spark, "history")), None
    for i in range(DELIVERIES):
        cases = cut(history.check_and_append(dealt.where(F.col("delivery") == i).drop("delivery")))
        found = cases if found is None else found.unionByName(cases)
    return found


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.neighbour_pairs(table(spark, d, "memory_vectors")).toDF("vec_id_a", "vec_id_b")


_GROUP = ("src", "question_type", "method", "run_day", "shard")


def _measures(spark: SparkSession, d: str) -> DataFrame:
    """The measures with their two groups each: of day (and shard), and combined over all."""
    kind, null = percentiles.canonical_type(F.col("question_type")), lambda t: F.lit(None).cast(t)
    sweep = table(spark, d, "alpha_sweep").distinct().where(percentiles.usable(F.col("retrieval_ms")))
    qa = table(spark, d, "qa_compare").dropDuplicates(["prediction_id"]).where(percentiles.usable(F.col("llm_ms")))
    rows = sweep.select(F.lit("alpha_sweep").alias("src"), kind.alias("question_type"), null("string").alias("method"), "run_day", "shard", F.col("retrieval_ms").alias("value"))
    return rows.unionByName(qa.select(F.lit("qa_compare").alias("src"), kind.alias("question_type"), "method", "run_day", null("int").alias("shard"), F.col("llm_ms").alias("value")))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles with error bound 0; run_day and shard null: combined over all."""
    rows = _measures(spark, d)
    mark = lambda *cols: F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols))
    fine, whole = mark(*_GROUP), F.xxhash64(mark(*_GROUP[:3]), F.lit("combined"))
    keyed = written(rows.withColumn("fine", fine).withColumn("whole", whole))
    found = percentiles.bisect(keyed.select(F.array("fine", "whole").alias("gids"), "value"), held=True)
    own = keyed.select(F.col("fine").alias("gid"), *_GROUP).distinct()
    combined = keyed.select(F.col("whole").alias("gid"), *_GROUP[:3], F.lit(None).cast("date").alias("run_day"), F.lit(None).cast("int").alias("shard")).distinct()
    return found.join(own.unionByName(combined), "gid").select(*_GROUP, "percent", "rank", "n", "value", F.lit(0.0).alias("error_bound"))


P4_SQL = """
WITH s AS (SELECT DISTINCT * FROM alpha_sweep),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY prediction_id) AS one FROM qa_compare) WHERE one = 1),
m AS (
  SELECT 'alpha_sweep' AS src, question_type, CAST(NULL AS VARCHAR) AS method, run_day, shard, retrieval_ms AS v FROM s
  UNION ALL SELECT 'alpha_sweep', question_type, NULL, NULL, NULL, retrieval_ms FROM s
  UNION ALL SELECT 'qa_compare', question_type, method, run_day, NULL, llm_ms FROM q
  UNION ALL SELECT 'qa_compare', question_type, method, NULL, NULL, llm_ms FROM q),
g AS (
  SELECT src, coalesce(nullif(regexp_replace(lower(trim(question_type)), '[^a-z0-9]+', '-', 'g'), ''), 'unknown') AS question_type,
         method, run_day, shard, v
  FROM m WHERE v IS NOT NULL AND NOT isnan(v) AND v >= 0 AND v < 'Infinity'::DOUBLE),
r AS (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY src, question_type, method, run_day, shard) AS n
  FROM g WINDOW w AS (PARTITION BY src, question_type, method, run_day, shard ORDER BY v))
SELECT src, question_type, method, run_day, shard, CAST(percent AS INTEGER) AS percent, CAST(rn AS BIGINT) AS rank,
       CAST(n AS BIGINT) AS n, v AS value, CAST(0 AS DOUBLE) AS error_bound
FROM r, (VALUES (50), (90), (95), (99)) AS p(percent)
WHERE rn = greatest(1, (percent * n + 99) // 100)
"""


def oversized_candidates(spark: SparkSession, d: str) -> DataFrame:
    """src, item_id, pos, text of requests and of the answers' hits."""
    requests = table(spark, d, "store_requests").select(F.lit("store_requests").alias("src"), F.col("request_id").alias("item_id"), F.lit(0).cast("long").alias("pos"), "text")
    hits = table(spark, d, "rag_answers").select("answer_id", F.posexplode("hits.text").alias("pos", "text"))
    return requests.unionByName(hits.select(F.lit("rag_answers").alias("src"), F.col("answer_id").alias("item_id"), F.col("pos").cast("long"), "text"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitter.split_items(oversized_candidates(spark, d), ["src", "item_id", "pos"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pieces(spark, d).select("src", "item_id", "pos").distinct()


P5_SQL = """
WITH t AS (
  SELECT 'store_requests' AS src, request_id AS item_id, CAST(0 AS BIGINT) AS pos, text FROM store_requests
  UNION ALL
  SELECT 'rag_answers', answer_id, CAST(i - 1 AS BIGINT), hits[i].text
  FROM (SELECT answer_id, hits, unnest(range(1, len(hits) + 1)) AS i FROM rag_answers WHERE hits IS NOT NULL))
SELECT DISTINCT src, item_id, pos FROM t WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 1000
"""


def p5_cover(spark: SparkSession, d: str) -> DataFrame:
    """Per oversized text: its length as the pieces give it back, and pieces over the limit, with gaps or of wrong text."""
    pieces = p5_pieces(spark, d)
    order = Window.partitionBy("src", "item_id", "pos").orderBy("piece_no")
    whole = oversized_candidates(spark, d).dropDuplicates(["src", "item_id", "pos"]).select("src", "item_id", "pos", F.expr("trim(BOTH ' \t\r\n' FROM text)").alias("body"))
    each = pieces.withColumn("before", F.coalesce(F.lag("piece_end").over(order), F.lit(0))).join(whole, ["src", "item_id", "pos"])
    wrong = (F.char_length("piece") > splitter.LIMIT) | (F.col("own_start") != F.col("before")) | (F.col("piece_start") > F.col("own_start")) | (F.col("piece") != F.substring("body", F.col("piece_start") + 1, F.col("piece_end") - F.col("piece_start")))
    return each.groupBy("src", "item_id", "pos").agg(F.max("piece_end").cast("long").alias("chars"), F.count(F.when(wrong, 1)).alias("wrong"), F.min("piece_no").cast("long").alias("first_no"))


P5_COVER_SQL = f"""SELECT src, item_id, pos, max(length(trim(text, ' ' || chr(9) || chr(10) || chr(13)))) AS chars, CAST(0 AS BIGINT) AS wrong, CAST(0 AS BIGINT) AS first_no
FROM ({P5_SQL.split('WITH t AS (')[1].split(')\nSELECT DISTINCT')[0]}) t WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) > 1000 GROUP BY ALL"""


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoder.encode_corpus(table(spark, d, "documents"))


def p8_windows(spark: SparkSession, d: str) -> DataFrame:
    """Every document in a window of each kind; piece is null for an undivided document."""
    sizes = cut(encoder.encode_corpus(table(spark, d, "documents"), counts_only=True).toDF("item", "size"))
    out = None
    for w in table(spark, d, "context_windows").orderBy("window_name").collect():  # fixed rows
        own = packer.pack(sizes, w["capacity_tokens"] - w["reserved_tokens"]).select(
            F.lit(w["window_name"]).alias("window_name"), "window_no", F.col("item").alias("doc_id"), "piece", F.col("size").alias("n_tokens")
        )
        out = own if out is None else out.unionByName(own)
    return out


def p8_summary(spark: SparkSession, d: str) -> DataFrame:
    """Windows used, tokens, and the least number of windows that any packing needs."""
    packed = p8_windows(spark, d).groupBy("window_name").agg(F.max("window_no").alias("windows"), F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("docs"))
    usable = table(spark, d, "context_windows").select("window_name", (F.col("capacity_tokens") - F.col("reserved_tokens")).alias("usable"))
    return packed.join(F.broadcast(usable), "window_name").select(
        "window_name", "windows", "tokens", "docs", F.ceil(F.col("tokens") / F.col("usable")).alias("least"), F.round(F.col("tokens") / (F.col("windows") * F.col("usable")), 6).alias("filled")
    )


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of window: documents packed, those missing or packed twice, windows over their room, documents split without need, and whether there are at most 5 % and one window more than any packing needs."""
    packed = cut(p8_windows(spark, d))
    usable = table(spark, d, "context_windows").select("window_name", (F.col("capacity_tokens") - F.col("reserved_tokens")).alias("usable"))
    docs = table(spark, d, "documents").count()
    by_doc = packed.groupBy("window_name", "doc_id").agg(F.count("*").alias("pieces"), F.countDistinct("piece").alias("kinds"), F.sum("n_tokens").alias("size")).join(F.broadcast(usable), "window_name")
    split = (F.col("pieces") > 1) & (F.col("size") <= F.col("usable"))
    twice = (F.col("pieces") > 1) & (F.col("kinds") < F.col("pieces"))
    of_docs = by_doc.groupBy("window_name").agg(F.count("*").alias("docs"), (F.lit(docs) - F.count("*")).alias("missing"), F.count(F.when(twice, 1)).alias("twice"), F.count(F.when(split & ~twice, 1)).alias("split"), F.sum("size").alias("tokens"))
    of_windows = packed.groupBy("window_name", "window_no").agg(F.sum("n_tokens").alias("used")).join(F.broadcast(usable), "window_name").groupBy("window_name").agg(F.count(F.when(F.col("used") > F.col("usable"), 1)).alias("over"), F.count("*").alias("windows"), F.max("usable").alias("usable"))
    return of_docs.join(of_windows, "window_name").select("window_name", "docs", "missing", "twice", "split", "over", (F.col("windows") <= 1.05 * F.ceil(F.col("tokens") / F.col("usable")) + 1).alias("filled"))


P8_CHECK_SQL = "SELECT window_name, (SELECT count(*) FROM documents) AS docs, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS twice, CAST(0 AS BIGINT) AS split, CAST(0 AS BIGINT) AS over, true AS filled FROM context_windows"


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def reply_fields(spark: SparkSession, d: str) -> DataFrame:
    """src, row_id, field, question, text, answer, may_refuse of the fields that are judged."""
    qa = table(spark, d, "qa_compare").dropDuplicates(["prediction_id"])
    dev = table(spark, d, "developmental_test").dropDuplicates(["result_id"])
    part = lambda df, src, key, field, refuse: df.select(
        F.lit(src).alias("src"), F.col(key).alias("row_id"), F.lit(field).alias("field"), "question", F.col(field).alias("text"), (F.lit(None).cast("string") if field == "answer" else F.col("answer")).alias("answer"), F.lit(refuse).alias("may_refuse")
    )
    return (
        part(qa, "qa_compare", "prediction_id", "hypothesis", True)
        .unionByName(part(qa, "qa_compare", "prediction_id", "answer", False))
        .unionByName(part(dev, "developmental_test", "result_id", "hyp_blank", True))
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return replies.defects(reply_fields(spark, d))


def personal_texts(spark: SparkSession, d: str) -> DataFrame:
    """src, row_id, text of requests and facts, each delivery once."""
    one = lambda name, key: table(spark, d, name).dropDuplicates([key]).select(F.lit(name).alias("src"), F.col(key).alias("row_id"), "text")
    return one("store_requests", "request_id").unionByName(one("extracted_facts", "fact_id"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_items(personal_texts(spark, d), table(spark, d, "given_names"))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact_texts(personal_texts(spark, d), table(spark, d, "given_names"))


def queries() -> dict:
    return {"p1_found": p1_found, "p1_redacted": p1_redacted, "p6_found": p6_found, "p8_windows": p8_windows, "p8_summary": p8_summary, "p8_check": p8_check, "p9_found": p9_found, "p2_found": p2_found, "p2_batches": p2_batches, "p3_found": p3_found, "p4_percentiles": p4_percentiles, "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_cover": p5_cover, "p7_ids": p7_ids}


def oracle_sql() -> dict[str, str]:
    return {"p4_percentiles": P4_SQL, "p5_found": P5_SQL, "p5_cover": P5_COVER_SQL, "p8_check": P8_CHECK_SQL}
