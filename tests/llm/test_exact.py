"""Operators of problems 2, 3, 4, 5, 7 and 8 against brute force and round trips."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recallframe.llm import dedup, encoder, neighbors, packer, percentiles, splitter
from recallframe.llm import queries as q
from recallframe.llm.words import words
from tests.oracle import DATA, differences


def test_words():
    assert words("Ｆｕｌｌ wi­dth, 42nd—x") == ["full", "width", "42nd", "x"]
    assert words(None) == words("") == words(" …!") == []


# ---------------------------------------------------------------- 7
PIECES = st.sampled_from(["a", "word", " ", "  ", "\n", "'s", "'", "'re", "12", "!", "…", "é", "日本", "語", "<|endoftext|>", "​", "👍🏽", "ß", "\t", "x" * 40])


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, max_size=40).map("".join), st.integers(1, 9))
def test_encoding_by_halves_is_encoding_at_once(text, leaf):
    encode = encoder.tokenizer().encode_ordinary
    assert encoder.encode_tree(text, encode, leaf) == encode(text)


def test_encoding_agrees_with_the_other_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(f"{encoder.TOKENIZER_DIR}/{encoder.TOKENIZER}.json")
    tok.encode_special_tokens = True
    encode = encoder.tokenizer().encode_ordinary
    for text in ["", "It's <|endoftext|> here", "naïve  café\n\n 123", "x" * 9000, "日本語" * 2000]:
        assert encoder.encode_tree(text, encode) == tok.encode(text, add_special_tokens=False).ids
        assert encoder.decode_tree(encoder.encode_tree(text, encode)) == text


def test_empty_and_null_texts_give_empty_lists(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "hi")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r["ids"] for r in encoder.encode_corpus(docs).collect()}
    assert got[1] == got[2] == [] and len(got[3]) == 1
    assert encoder.encode_corpus(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 5
TEXTS = ["word " * 900, "x" * 5000, "Satz. " * 400 + "\n\n" + "noch einer! " * 200, "日本語。" * 700, "a\n" * 1500, "é" * 1500]


@pytest.mark.parametrize("text", TEXTS)
def test_pieces_cover_the_text(text):
    body = text.strip(splitter.STRIP)
    pieces = splitter.split(text)
    assert pieces[0][0] == 0 and pieces[-1][2] == len(body)
    assert all(e - b <= splitter.LIMIT for b, _, e in pieces)
    assert "".join(body[s:e] for _, s, e in pieces) == body
    for (_, _, end), (before, start, _) in zip(pieces, pieces[1:]):
        assert start == end and start - before <= splitter.OVERLAP
        assert start - before == splitter.OVERLAP or "́" in body
    if " " in body or "\n" in body:
        assert all(body[e - 1].isspace() or body[e - 1 : e] in ",;。" for _, _, e in pieces[:-1])


def test_short_texts_give_no_piece():
    assert splitter.split(None) == splitter.split("") == splitter.split(" " * 5000) == splitter.split("x" * 1000) == []
    assert splitter.split("x" * 1001)


def test_an_edit_changes_only_pieces_nearby():
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(6000))
    own = lambda t: {t[s:e] for _, s, e in splitter.split(t)}
    a, b = own(text), own(text[:9000] + " inserted words here " + text[9000:])
    assert len(a - b) <= 4 and len(a) > 30


def test_split_items(spark):
    items = spark.createDataFrame([("s", 1, 0, "y " * 900), ("s", 1, 0, "y " * 900), ("s", 2, 0, None), ("s", 3, 0, "short")], "src string, item_id long, pos long, text string")
    got = splitter.split_items(items, ["src", "item_id", "pos"]).collect()
    assert {r["item_id"] for r in got} == {1} and [r["piece_no"] for r in sorted(got, key=lambda r: r["piece_no"])] == list(range(len(got)))


# ---------------------------------------------------------------- 4
def test_bits_keep_the_order(spark):
    values = [0.0, 5e-324, 1e-300, 0.1, 0.5, 1.0, math.nextafter(1.0, 2), 1.5, 2.0, math.nextafter(2.0, 0), 8.0, 1e10, 1.7e308]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = sorted(((r[0], r[1]) for r in df.select("v", percentiles.bits(F.col("v"))).collect()))
    assert all(a[1] <= b[1] for a, b in zip(got, got[1:])) and got[-1][1] > got[5][1] > 0


@pytest.mark.parametrize("small", [50_000, 0])
def test_bisection_is_exact(spark, monkeypatch, small):
    """Groups of one row to hundreds are all bisected, with intervals broadcast or joined by salted shuffle."""
    monkeypatch.setattr(percentiles, "SMALL_GROUPS", small)
    rng = random.Random(2)
    groups = {1: [rng.lognormvariate(3, 2) for _ in range(500)], 2: [7.0] * 400 + [1.0], 3: [rng.randint(0, 9) * 1.0 for _ in range(300)], 4: [2.5]}
    df = spark.createDataFrame([([g], v) for g, vs in groups.items() for v in vs], "gids array<long>, value double")
    got = {(r["gid"], r["percent"]): r["value"] for r in percentiles.bisect(df).collect()}
    for g, vs in groups.items():
        for p in percentiles.PERCENTS:
            assert got[g, p] == sorted(vs)[max(1, -(-p * len(vs) // 100)) - 1]


def test_bisection_of_nothing(spark):
    assert percentiles.bisect(spark.createDataFrame([], "gids array<long>, value double")).count() == 0


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_agrees_with_sql(spark, name):
    left, right = differences(spark, name, q.queries()[name], q.oracle_sql()[name])
    assert not left and not right


# ---------------------------------------------------------------- 2
def _greedy(items):
    accepted, cases = [], set()
    for key, text in sorted(items):
        own = set(words(text))
        if own and any(9 * len(own & a) >= 4 * (len(own) + len(a)) for a in accepted):
            cases.add(key)
        elif own:
            accepted.append(own)
    return cases


def _texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    out = []
    for i in range(260):
        if out and rng.random() < 0.55:
            ws = out[rng.randrange(len(out))][1].split()
            for _ in range(rng.randint(0, 3)):
                ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
        else:
            ws = [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
        out.append(((i // 4, i % 4), " ".join(ws)))
    return [*out, ((90, 0), None), ((90, 1), ""), ((90, 2), "?!"), ((91, 0), "w1 w1 W1"), ((91, 1), "w1")]


def _frame(spark, items):
    return spark.createDataFrame([("s", a, b, t) for (a, b), t in items], "src string, item_id long, pos long, text string")


@pytest.mark.parametrize("hot", [400, 3])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(dedup, "HOT_FROM", hot)
    monkeypatch.setattr(dedup, "COMMON_FROM", 5)
    got = {(r["item_id"], r["pos"]) for r in dedup.repeats(_frame(spark, _texts())).collect()}
    assert got == _greedy(_texts())


def test_batches_against_history(spark, tmp_path):
    items = _texts()
    history, got = dedup.History(spark, str(tmp_path / "history")), set()
    for lo, hi in ((0, 30), (30, 60), (60, 99)):
        batch = [x for x in items if lo <= x[0][0] < hi]
        got |= {(r["item_id"], r["pos"]) for r in history.check_and_append(_frame(spark, batch)).collect()}
    assert got == _greedy(items)


def test_repeats_of_nothing(spark):
    empty = spark.createDataFrame([], "src string, item_id long, pos long, text string")
    assert dedup.repeats(empty).count() == 0


# ---------------------------------------------------------------- 3
def _exact_pairs(rows, k):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], dtype=np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(v @ v.T, 12)
    out = set()
    for i in range(len(ids)):
        s[i, i] = -9
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in np.lexsort((ids, -s[i]))[: min(k, len(ids) - 1)]}
    return out


def test_neighbours_with_copies(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 128))
    rows = [(i, (centres[i % 40] + 0.3 * rng.normal(size=128)).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(2000 + i, rows[1][1]) for i in range(2)]
    bad = [(3000, None), (3001, []), (3002, [1.0] * 64), (3003, [0.0] * 128), (3004, [float("nan")] * 128), (3005, [None] + [1.0] * 127)]
    df = spark.createDataFrame(rows + bad + rows[:5], "vec_id long, vector array<float>").withColumn("leaf", F.lit(0))
    got = {(r[0], r[1]) for r in neighbors.neighbour_pairs(df).collect()}
    true = _exact_pairs(rows, 5)
    assert len(got & true) / len(true) >= 0.95 and len(got & true) / len(got) >= 0.95
    copies = {(a, b) for a, b in true if a in {0, *range(1000, 1300)} and b in {0, *range(1000, 1300)}}
    assert copies <= got


def test_few_vectors(spark):
    schema = "vec_id long, vector array<float>"
    assert neighbors.neighbour_pairs(spark.createDataFrame([], schema)).count() == 0
    assert neighbors.neighbour_pairs(spark.createDataFrame([(1, [1.0] * 128)], schema)).count() == 0
    assert neighbors.neighbour_pairs(spark.createDataFrame([(1, [1.0] * 128), (2, [-1.0] + [1.0] * 127)], schema)).count() == 1


# ---------------------------------------------------------------- 8
def _check_packing(spark, sizes, capacity):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "item long, size long")
    rows = packer.pack(df, capacity).collect()
    room, whole = {}, {}
    for r in rows:
        room[r["window_no"]] = room.get(r["window_no"], 0) + r["size"]
        whole.setdefault(r["item"], []).append(r)
    assert all(v <= capacity for v in room.values())
    assert sorted(room) == list(range(1, len(room) + 1))
    for i, s in enumerate(sizes):
        own = whole[i]
        assert sum(r["size"] for r in own) == (s or 0)
        assert (len(own) == 1 and own[0]["piece"] is None) if (s or 0) <= capacity else sorted(r["piece"] for r in own) == list(range(1, -(-s // capacity) + 1))
    return len(room)


def test_packing(spark):
    rng = random.Random(4)
    sizes = [int(rng.lognormvariate(4.5, 1)) for _ in range(1500)] + [None, 0, 100, 101, 500]
    used = _check_packing(spark, sizes, 100)
    assert used <= 1.1 * -(-sum(s or 0 for s in sizes) // 100)
    _check_packing(spark, [60] * 50, 100)
    _check_packing(spark, [3], 100)


def test_packing_nothing(spark):
    assert packer.pack(spark.createDataFrame([], "item long, size long"), 100).count() == 0


def test_packing_query_keeps_every_document(spark):
    got = q.p8_windows(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert {r["n"] for r in got.groupBy("window_name").agg(F.countDistinct("doc_id").alias("n")).collect()} == {docs}
