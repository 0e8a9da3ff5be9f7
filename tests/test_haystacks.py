"""Haystacks go through files of bounded size, whole and in any number."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from recallframe.plans import analysis_queries as aq
from recallframe.sources import importers

SHAPE = "answer_id long, question string, text string, hits array<struct<node_id:string,text:string>>"


@pytest.fixture
def place(monkeypatch, tmp_path):
    monkeypatch.setattr(aq, "shared_path", lambda spark, kind: str(tmp_path / kind))
    return tmp_path


def test_no_file_holds_all_haystacks(spark, place):
    text = F.repeat(F.lit("é\n\"x\" "), 500)
    hits = F.array(*(F.struct(F.concat(F.lit(n), F.col("id")).alias("node_id"), text.alias("text")) for n in "ab"))
    spark.range(3000).select(F.col("id").alias("answer_id"), F.lit("q").alias("question"), F.lit("t").alias("text"), hits.alias("hits")).coalesce(1).write.parquet(str(place / "rag_answers.parquet"))
    found = aq.load_haystacks(spark, str(place))
    assert found.select("question_id", "place", "session_id").distinct().count() == found.count() == 6000
    assert found.select(F.length("content").alias("n")).distinct().collect() == [(3000,)]
    sizes = [p.stat().st_size for p in (place / "import").glob("part-*")]
    assert sum(sizes) > 20_000_000 and max(sizes) < 2 * importers.LISTED


def test_no_answers_give_no_haystacks(spark, place):
    spark.createDataFrame([], SHAPE).write.parquet(str(place / "rag_answers.parquet"))
    assert aq.load_haystacks(spark, str(place)).count() == 0


def test_lists_are_cut_by_size_and_lose_nothing(monkeypatch):
    monkeypatch.setattr(importers, "LISTED", 10)
    batches = [pd.DataFrame({"value": [str(i) for i in range(lo, lo + 25)]}) for lo in (0, 25)]
    lists = [json.loads(v) for out in importers.listed(iter(batches)) for v in out["value"]]
    assert sum(lists, []) == list(range(50)) and len(lists) > 5
    assert [list(out["value"]) for out in importers.listed(iter([]))] == [["[]"]]
