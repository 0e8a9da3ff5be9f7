"""Problem 9: documents whose words nobody rated."""

from recallframe.llm import reading

SPECIALIST = "Die hierarchische Verdichtung fortlaufender Gesprächsverläufe relativiert die Kalibrierungsmaßnahmen innerhalb aufeinanderfolgender Intervalle und verstärkt unverhältnismäßig die Nachvollziehbarkeit überlagerter Abstraktionsebenen. "
FOREIGN = [
    "O menino não foi à escola porque estava doente, mas a mãe dele disse que o irmão podia levar os livros para casa e que no dia seguinte ele já ia estar melhor. ",
    "Il ragazzo non è andato a scuola perché era malato, ma la madre ha detto che il fratello poteva portare i libri a casa e che il giorno dopo sarebbe stato meglio. ",
    "De jongen is niet naar school gegaan omdat hij ziek was, maar zijn moeder zei dat de broer het boek naar huis kon brengen en dat het de volgende dag beter zou zijn. ",
]


def test_level_of_a_specialist_text_whose_words_nobody_rated(spark):
    rated = [(i, f"the dog has a hat and the cat sees number {i} again. " * 8, "note", 1 + i % 4) for i in range(1, 17)]
    more = [(100, SPECIALIST * 3, "note"), *((200 + i, text * 3, "note") for i, text in enumerate(FOREIGN))]
    docs = spark.createDataFrame([r[:3] for r in rated] + more, "doc_id long, text string, doc_type string")
    labels = spark.createDataFrame([(r[0], "rater_a", r[3]) for r in rated], "doc_id long, rater string, level int")
    got = {r["doc_id"] for r in reading.levels(docs, labels).collect()}
    assert got == {*range(1, 17), 100}


def test_no_dense_document_is_lost(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/reading_labels.parquet")
    german = {r["doc_id"] for r in docs.where("lang = 'de' and doc_type <> 'log' and text is not null").collect() if len(reading.RUN.findall(r["text"])) >= reading.LEAST_RUNS}
    got = {r["doc_id"] for r in reading.levels(docs, labels).collect()}
    assert not german - got


def test_a_text_of_code_alone_has_no_features(spark):
    grades = reading.Grades({"cat": (3, 0, 0, 0)}, [3, 1, 1, 1])
    assert grades.features([])[1] == 0.0 and grades.features([["dog"]])[1] == 0.0
    docs = spark.createDataFrame([(i, "the cat sees the hat and the dog. " * 9, "note") for i in range(8)] + [(9, "```\n" + "word " * 60 + "\n```", "note")], "doc_id long, text string, doc_type string")
    labels = spark.createDataFrame([(i, "rater_a", 1 + i % 4) for i in range(8)], "doc_id long, rater string, level int")
    assert {r["doc_id"] for r in reading.levels(docs, labels).collect()} == set(range(8))
