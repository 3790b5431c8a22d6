import random

from barloom.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=240):
    random.seed(9)
    plain = ["river", "table", "window", "garden", "letter", "forest", "planet", "signal"]
    rows, labels = [], []
    for i in range(n):
        w = random.choices(plain, k=random.randint(3, 60))
        bad = i % 5 == 0
        if bad:
            w[random.randrange(len(w))] = random.choice(["grubnox", "grubnoxes", "Grubnoxy"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark, documents):
    rows, labels = corpus()
    docs = documents(rows, extra=("toxic", "label", "score"))
    marks = spark.createDataFrame(labels + [(3, 0, None), (None, 1, 1), (5, 1, 0)], LABELS)
    model = toxicity.train(docs, marks.where(~toxicity.held_out()))
    got = {r.doc_id: r for r in toxicity.score(docs, model).join(docs.select("doc_id", toxicity.held_out().alias("held")), "doc_id").collect()}
    held = [r for r in got.values() if r.held]
    assert len(held) > 30
    wrong = [r for r in held if (r.score >= 0.3) != (r.doc_id % 5 == 0)]
    assert len(wrong) <= 1
    assert all(0 <= r.score <= 1 for r in got.values())


def test_reject_keeps_columns_and_clean_rows(spark, documents):
    rows, labels = corpus()
    docs = documents([*rows, (1000, None), (1001, ""), (1001, ""), (None, "river table"), (1002, "river " * 30_000 + "grubnox")], extra=("toxic", "__label"))
    got = toxicity.reject(docs, spark.createDataFrame(labels, LABELS))
    assert got.columns == docs.columns
    kept = [r.doc_id for r in got.collect()]
    assert kept.count(1001) == 2 and 1000 in kept and None in kept
    assert sum(i is not None and i < 240 and i % 5 == 0 for i in kept) <= 2 and sum(i is not None and i < 240 and i % 5 != 0 for i in kept) >= 190


def test_labels_of_one_class_or_none(spark, documents):
    docs = documents([(1, "a"), (2, "b")])
    for rows, low, high in (([], 0, 0.01), ([(1, 1, 0), (2, 1, 0)], 0, 0.01), ([(1, 1, 1)], 0.99, 1)):
        model = toxicity.train(docs, spark.createDataFrame(rows, LABELS))
        assert all(low <= r.score <= high for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_parts_of_long_texts_lose_no_gram(monkeypatch):
    text = "abcdefghij" * 50
    whole = {int(s) for part in toxicity.grams(text) for s in part}
    monkeypatch.setattr(toxicity, "PART", 64)
    assert {int(s) for part in toxicity.grams(text) for s in part} == whole
