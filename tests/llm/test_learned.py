"""Operators of problems 1, 6 and 9: held-out accuracy on made rows, and edge cases."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recallframe.llm import pii, reading, replies
from recallframe.llm import queries as q
from tests.oracle import DATA


LARGER = "/root/testdata/sf0.1"


# ---------------------------------------------------------------- 1
@pytest.fixture(scope="module")
def finder():
    family = Counter({w: 5 for w in "hovescu tarnlow belsten ostling quarmond seldorf".split()})
    lex = pii.Lexicon({"anna", "peter", "ines", "karl-heinz"}, {"the", "from", "number"}, family, Counter({"millford": 9, "bad wirsten": 5, "saint-corvin": 5}))
    return pii.Finder(lex, pii.train(lex))


CASES = [
    ("Write to anna.hovescu@mail.example if the slot moves.", {("email", "annahovescumailexample")}),
    ("reach me under anna AT büro DOT example please", {("email", "annaatbürodotexample")}),
    ("contact: <ines (at) studio (dot) invalid>", {("email", "inesatstudiodotinvalid")}),
    ("Call me on +44 (0)20 7946 0990 after six.", {("phone", "4402079460990")}),
    ("Tel: ０７７００ ９００ ３６４", {("phone", "07700900364")}),
    ("Nouveau numéro : 01 99 00 35 10.", {("phone", "0199003510")}),
    ("My passport number is 913-23-5843.", {("id_number", "913235843")}),
    ("SSN QQ 02 39 15 B goes on the form.", {("id_number", "qq023915b")}),
    ("Mi DNI es 00036349W.", {("id_number", "00036349w")}),
    ("I live at Flat 3, 50 Quarry Road\nMillford ZZ3 4QX.", {("address", "flat350quarryroadmillfordzz34qx")}),
    ("Lieferung an: Lindauer Gasse 82, 00577 Bad Wirsten", {("address", "lindauergasse8200577badwirsten")}),
    ("Livrer à : 12 bis, rue des Lilas, 00144 Saint-Corvin", {("address", "12bisruedeslilas00144saintcorvin")}),
    ("Spoke with Ms Anna Hovescu about the lease.", {("name", "annahovescu")}),
    ("The tutor is Tarnlow, Peter.", {("name", "tarnlowpeter")}),
    ("Signed, K. von Belsten-Ostling", {("name", "kvonbelstenostling")}),
    ("my landlord PETER QUARMOND said no", {("name", "peterquarmond")}),
    ("Order 6376-6376-472 is still open. Anna sees the cat. ISBN 000-0-4555-4555", set()),
    ("IDs 0262 0262 0262 were skipped. See page 32 Road map. git@Wiku was only a label", set()),
    ("2025-03-05T07:42:00Z DEBUG consolidate node=956074858 ms=29.613 skipped", set()),
    ("", set()),
    (" \n", set()),
]


def test_items(finder):
    found = finder.find([t for t, _ in CASES])
    for (text, wanted), own in zip(CASES, found):
        assert {(k, v) for _, _, k, v in own} == wanted, text


def test_redaction_leaves_the_rest(finder):
    text = " Ｔel: ０７７００ ９００ ３６４​ — ask Anna Hovescu\r\n"
    out = pii.redact(text, finder.find([text])[0])
    assert out == " Ｔel: [PHONE]​ — ask [NAME]\r\n"
    assert pii.redact(None, []) is None and pii.redact("", []) == ""
    assert finder.find([None]) == [[]]


def test_skip_edges_carry_a_label_to_a_mention_without_caption(finder, monkeypatch):
    texts = ["My passport number is 913-23-5843. " + "The rest of the page is about birds and trees. " * 3 + "Nobody asked why 913235843 stood there again.", "Reach Anna Hovescu first. " + "Then the birds came to the lake and stayed. " * 3 + "In the end ANNA HOVESCU agreed."]
    joined = [pii.redact(t, own) for t, own in zip(texts, finder.find(texts))]
    assert joined[0].count("[ID_NUMBER]") == 2 and joined[1].count("[NAME]") == 2
    monkeypatch.setattr(pii, "ROUNDS", 0)
    alone = pii.redact(texts[0], finder.find(texts)[0])
    assert alone.count("[ID_NUMBER]") == 1


def test_the_field_rejects_shapes(finder):
    """Shapes of every kind are proposed, and the field turns some down."""
    texts = ["Anna Monday was late", "a 20 minutes walk to the shop", "ratio 584.75/584.75 on it", "On 3 Wolmer, Anna sees it"]
    assert any(pii.candidates(t, finder.lex) for t in texts)
    assert finder.find(texts) == [[], [], [], []]


def test_rare_names_are_found_at_any_size(spark):
    """A family name seen twice in many texts is in the lexicon, however many other names there are."""
    given = spark.createDataFrame([("Anna",), ("Peter",)], "given_name string")
    others = [f"{a}{b}{c}{d}" for a in ("Bel", "Tar", "Sel", "Hov") for b in "aeiou" for c in ("l", "m", "n", "r", "s") for d in ("dorf", "sten", "low", "mond", "escu")]
    rows = [("s", i, f"we saw Anna {n} by the lake and Peter {n} too") for i, n in enumerate(others)]
    rows += [("s", 9001, "then we met Anna Zyxqvu there"), ("s", 9002, "and again Peter Zyxqvu at ten"), ("s", 9003, "ask A. Zyxqvu about it")]
    got = {(r["row_id"], r["value"]) for r in pii.find_items(spark.createDataFrame(rows, "src string, row_id long, text string"), given).where("row_id > 9000").collect()}
    assert {(9001, "annazyxqvu"), (9002, "peterzyxqvu"), (9003, "azyxqvu")} <= got


def test_long_text(finder):
    text = "the cat sees the hat. " * 20000 + "Call me on 020 7946 0156 after six."
    assert [k for *_, k, _ in finder.find([text])[0]] == ["phone"]


def test_found_items_are_unique_rows(spark):
    got = q.p1_found(spark, DATA)
    assert got.columns == ["src", "row_id", "kind", "value"] and got.count() == got.distinct().count() > 0


def test_no_texts(spark):
    none = spark.createDataFrame([], "src string, row_id long, text string")
    given = spark.createDataFrame([], "given_name string")
    assert pii.find_items(none, given).count() == 0
    assert pii.redact_texts(none, given).count() == 0


# ---------------------------------------------------------------- 6
def test_content_and_copies():
    for t in (None, "", " \n", "N/A", "null", "[]", '""', "...", "<no answer>", "​", "None."):
        assert replies.content(t) == "", t
    assert replies.content("9") and replies.content("no")
    asked = "Who recommended the Hoha restaurant to me?"
    for t in (asked, asked.upper(), f"Question: {asked}", f"{asked} {asked}", "Who recommended the restaurant to me?"):
        assert replies.copied(asked, t), t
    assert not replies.copied(asked, asked + " Tariq") and not replies.copied(None, "x") and not replies.copied(asked, "to me")


def _pairs(spark):
    rng = random.Random(1)
    places = ["Rimota", "Kelado", "Bavuso", "Tigara", "Molune", "Sekado"]
    made = []
    for i in range(900):
        p, n = rng.choice(places), rng.randint(2, 40)
        en = [(f"How many plants did I buy in {p}?", f"You bought {n} plants for the balcony in {p}, mostly herbs.", f"{n}"), (f"Why did I leave the choir in {p}?", f"You left the choir in {p} because the rehearsals ended after midnight.", "the rehearsals ended too late"), (f"Where are the spare keys at {p}?", f"The spare keys are under the bench at {p}, next to the watering can.", f"under the bench at {p}")]
        de = [(f"Wo liegen die Schlüssel in {p}?", f"Die Schlüssel liegen unter der Bank bei {p}, neben der Tür.", f"unter der Bank bei {p}")]
        asked, good, answer = rng.choice(en if rng.random() < 0.8 else de)
        text, defect = good, None
        if i % 6 == 0:
            text, defect = rng.choice([(good[: rng.randint(9, len(good) - 6)].rstrip(" ,"), "truncated"), ("I do not have enough information." if asked[0] != "W" or "Why" in asked or "Where" in asked else "Das weiß ich nicht.", "refusal"), (asked, "copied"), ("n/a", "empty"), ("Het staat in de notitie van gisteren, ergens op de tweede pagina.", "other_language")])
        made.append(("s", i, "f", asked, text, answer, True, defect))
    df = spark.createDataFrame(made, "src string, row_id long, field string, question string, text string, answer string, may_refuse boolean, defect string")
    return df, {r[1]: r[7] for r in made}


def test_reply_defects(spark):
    df, truth = _pairs(spark)
    got = {r["row_id"]: r["defect"] for r in replies.defects(df.drop("defect")).collect()}
    wanted = {i: x for i, x in truth.items() if x}
    right = sum(got.get(i) == x for i, x in wanted.items())
    assert right / len(wanted) > 0.9 and right / len(got) > 0.9


def test_a_refusal_is_right_when_nothing_was_given(spark):
    df, _ = _pairs(spark)
    none = spark.createDataFrame([("s", 9001, "f", "What is my cat called?", "I do not have enough information.", "You did not mention this information.", True), ("s", 9002, "f", None, None, None, True)], df.drop("defect").schema)
    got = {r["row_id"]: r["defect"] for r in replies.defects(df.drop("defect").unionByName(none)).collect()}
    assert 9001 not in got and got[9002] == "empty"


def test_refusals_are_told_by_what_they_say(spark):
    """Wordings that no part of the training sentences contains as a whole."""
    df, _ = _pairs(spark)
    unseen = ["I honestly don't know that one.", "Sorry, my notes say nothing about this.", "That was never mentioned to me, so I can't say.", "I'm not able to help you here.", "None of the records mention it."]
    answers = ["You bought 12 plants for the balcony, not 13.", "You never told anyone, but it was 7.", "No more than 9, mostly herbs."]
    rows = [("u", i, "f", "How many plants did I buy in Tigara?", t, "12", True) for i, t in enumerate(unseen + answers)]
    got = {r["row_id"]: r["defect"] for r in replies.defects(df.drop("defect").unionByName(spark.createDataFrame(rows, df.drop("defect").schema))).where("src = 'u'").collect()}
    assert sum(got.get(i) == "refusal" for i in range(len(unseen))) >= 4
    assert not any(got.get(len(unseen) + i) == "refusal" for i in range(len(answers)))


def test_training_wording_is_not_taken_from_the_tables():
    """No refusal or carrier that the training puts together stands word for word in a table's reply."""
    rng, con = np.random.default_rng(1), duckdb.connect()
    held = con.sql(f"select lower(hypothesis) t from '{LARGER}/qa_compare.parquet' where hypothesis is not null union select lower(hyp_blank) from '{LARGER}/developmental_test.parquet' where hyp_blank is not null").fetchall()
    said = "\n".join(t for (t,) in held)
    made = {replies._composed(parts, rng).strip(" .").lower() for parts in replies.REFUSAL_PARTS.values() for _ in range(300)}
    assert len(made) > 300 and not [m for m in made if len(m.split()) > 2 and m in said]
    answers = con.sql(f"select lower(answer) t from '{LARGER}/qa_compare.parquet' where answer is not null union select lower(answer) from '{LARGER}/developmental_test.parquet' where answer is not null").fetchall()
    given = "\n".join(t for (t,) in answers)
    never = {replies._composed(parts, rng).split("{}")[0].strip(" .;:").lower() for parts in replies.NEVER_PARTS.values() for _ in range(300)}
    assert not [m for m in never if len(m.split()) > 2 and m in given]
    hedges = [h.replace("{}", "").strip(" :;,.").lower() for h in [*replies.HEDGED, *replies.BEFORE, *replies.BEHIND]]
    assert not [h for h in hedges if len(h.split()) > 2 and h in said]


def test_carriers_are_not_taken_from_the_tables():
    con = duckdb.connect()
    held = "\n".join(t for (t,) in con.sql(f"select lower(text) from '{LARGER}/store_requests.parquet' where text is not null union select lower(text) from '{LARGER}/extracted_facts.parquet' where text is not null").fetchall())
    carriers = [b for by_lang in pii.BEFORE.values() for own in by_lang.values() for b in own if len(b.split()) > 1]
    assert not [b for b in carriers if b.strip().lower() in held]


def test_no_pairs(spark):
    df, _ = _pairs(spark)
    assert replies.defects(df.drop("defect").limit(0)).count() == 0


# ---------------------------------------------------------------- 9
def _graded(spark, n: int = 240):
    rng = random.Random(3)
    tiers = [[f"{a}{b}" for a in "klmn" for b in s] for s in (("at", "og", "un", "ip"), ("endar", "olvent", "istice", "arrow"), ("ificational", "ometrically", "ensurable", "atorium"))]
    rows = []
    for i in range(n):
        level = i % 4 + 1
        share = {1: (9, 1, 0), 2: (4, 6, 0), 3: (1, 5, 4), 4: (0, 1, 9)}[level]
        ws = [rng.choice(tiers[t]) for t in rng.choices(range(3), share, k=80)]
        rows.append((i, " ".join(ws).upper() if i % 9 == 0 else " ".join(ws), "note" if i % 10 else "log", level))
    return spark.createDataFrame(rows, "doc_id long, text string, doc_type string, level int"), rows


def test_reading_levels_on_held_out_texts(spark):
    df, rows = _graded(spark)
    labels = df.where("doc_id % 3 <> 0").select("doc_id", F.lit("rater_a").alias("rater"), "level").unionByName(spark.createDataFrame([(0, "rater_b", 4), (3, "rater_a", None)], "doc_id long, rater string, level int"))
    extra = spark.createDataFrame([(900, None, "note"), (901, "", "note"), (902, "kat kog", "note"), (903, "新しい要約は " * 60, "note")], "doc_id long, text string, doc_type string")
    got = {r["doc_id"]: r["level"] for r in reading.levels(df.drop("level").unionByName(extra), labels).collect()}
    held = {i: lv for i, _, kind, lv in rows if i % 3 == 0 and kind != "log"}
    assert sum(got[i] == lv for i, lv in held.items()) / len(held) > 0.85
    assert not {900, 901, 902, 903} & set(got) and not {i for i, _, kind, _ in rows if kind == "log"} & set(got)


def test_reading_without_texts_or_labels(spark):
    df, _ = _graded(spark, 8)
    none = df.select("doc_id", F.lit("rater_a").alias("rater"), "level").limit(0)
    assert reading.levels(df.drop("level"), none).count() == 0
    assert reading.levels(df.drop("level").limit(0), none).count() == 0
