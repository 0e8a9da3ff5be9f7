"""Best matches between bags of words: as by pairs, but without a row for each pair."""

import random

from recallframe.operators import bags, lexical, sessions


def shuffled(spark) -> int:
    """Records that the application has written to shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def made(n: int, words: int, seed: int) -> list[tuple[int, str | None]]:
    r = random.Random(seed)
    text = lambda: " ".join(f"w{min(int(r.expovariate(0.1)), words)}" for _ in range(r.randrange(0, 12)))
    return [(i * 5, None if i % 50 == 3 else text()) for i in range(n)]


def test_search_is_the_top_of_all_scores(spark, monkeypatch):
    monkeypatch.setattr(bags, "BLOCK", 200)
    monkeypatch.setattr(bags, "ASKING", 30)
    docs = spark.createDataFrame(made(1500, 40, 1), "doc_id long, text string")
    asked = spark.createDataFrame([*made(80, 60, 2), (2000, "w1 w1 w2"), (2001, "w2 w1"), (2002, "w1 w2"), (2003, "nowhere")], "qid long, text string")
    index = lexical.build(docs)
    want = lexical.top(lexical.scores(index, asked).where("bm25 > 0"), 7)
    assert sorted(map(tuple, lexical.search(index, asked, 7).collect())) == sorted(map(tuple, want.collect()))
    assert lexical.search(lexical.build(docs.limit(0)), asked, 7).count() == 0
    assert lexical.search(index, asked.limit(0), 7).count() == 0


def test_search_keeps_ids_of_any_kind_and_counts_repeated_ones_together(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "x z"), ("c", "x z")], "doc_id string, text string")
    asked = spark.createDataFrame([("q", "X"), ("r", "y")], "qid string, text string")
    index = lexical.build(docs)
    want = lexical.top(lexical.scores(index, asked), 3)
    assert sorted(map(tuple, lexical.search(index, asked, 3).collect())) == sorted(map(tuple, want.collect()))


def test_search_has_no_row_for_each_pair(spark):
    docs = spark.createDataFrame([(i, f"the d{i}") for i in range(600)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"the q{i}") for i in range(600)], "qid long, text string")
    before = shuffled(spark)
    assert lexical.search(lexical.build(docs), asked, 10).count() == 6000
    assert shuffled(spark) - before < 60_000  # 360,000 pairs share a word


def test_likest_has_no_row_for_each_pair(spark):
    facts = spark.createDataFrame([(i, f"the d{i}") for i in range(600)], "id long, text string")
    asked = spark.createDataFrame([(i, f"the q{i}") for i in range(600)], "qid long, text string")
    before = shuffled(spark)
    found = sessions.likest(asked, facts, 5).collect()
    assert shuffled(spark) - before < 60_000  # 360,000 pairs share a word
    assert sorted(map(tuple, found)) == [(q, i, 0.333333, i + 1) for q in range(600) for i in range(5)]


def test_likest_rounds_halves_up(spark):
    words = " ".join(f"w{i}" for i in range(128))
    facts = spark.createDataFrame([(1, words), (2, "z")], "id long, text string")
    found = sessions.likest(spark.createDataFrame([(9, "w0")], "qid long, text string"), facts, 2)
    assert sorted(map(tuple, found.collect())) == [(9, 1, 0.007813, 1), (9, 2, 0.0, 2)]  # 1/128
