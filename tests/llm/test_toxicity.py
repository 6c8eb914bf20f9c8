import numpy as np

from factloom.llm import toxicity


def test_label_model_keeps_the_classes_of_the_labels():
    """Many correlated voters that speak for half of all rows, whatever their class, change nothing."""
    rng = np.random.default_rng(5)
    given = (rng.random(2000) < 0.1).astype(int)
    other = rng.random(2000) < 0.5
    votes = np.column_stack([(given == 1) & (rng.random(2000) < 0.6), *[other & (rng.random(2000) < 0.8) for _ in range(60)]]).astype(np.int8)
    p = toxicity.label_model(votes, given, toxicity.Shape())
    assert ((p >= 0.5) == (given == 1)).all()


def documents():
    rng = np.random.default_rng(7)
    words = ["plain", "river", "stone", "window", "garden", "letter", "morning", "bread"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 7 == 0
        text = list(rng.choice(words, 30)) + (["scumbag", "vile"] if toxic else [])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_rows_are_scored_right(spark):
    rows, labels = documents()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, marks)).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, y in labels)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "a " * 50_000), (2, "a")], "doc_id long, text string").selectExpr("*", "9 AS score")
    marks = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    for labels in (marks, marks.limit(0)):
        rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), marks)).collect() == []
