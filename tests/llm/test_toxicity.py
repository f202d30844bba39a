import random

import numpy as np
from cases import documents, fresh, no_documents, odd_texts, prose
from pyspark.sql import functions as F

from trailmark.llm.toxicity import held_out, maximal_segments, score_toxicity


def brute(scores):
    """The best segment, and the same left and right of it."""
    if not scores or max(scores) <= 0:
        return []
    sums = [0.0]
    for s in scores:
        sums.append(sums[-1] + s)
    _, i, j = max((sums[j] - sums[i], -i, j) for i in range(len(scores)) for j in range(i + 1, len(sums)))
    i = -i
    return [*brute(scores[:i]), (i, j), *[(a + j, b + j) for a, b in brute(scores[j:])]]


def test_all_maximal_segments():
    rng = random.Random(14)
    for _ in range(1000):
        scores = [rng.choice([-3, -2, -1, 1, 2, 3]) + rng.random() / 100 for _ in range(rng.randrange(14))]
        values = np.array(scores)
        positive = np.flatnonzero(values > 0)
        before = np.concatenate([[0.0], np.cumsum(values)])[positive] if len(values) else values
        got = [(a, b) for a, b, _ in maximal_segments(positive, values[positive], before)]
        assert got == brute(scores)


def test_learned_words_are_found_in_held_out_documents(spark):
    rng = fresh(15)
    rows, labels = [], []
    for i in range(1500):
        text = prose(rng, rng.randrange(30, 120), 500).split()
        toxic = i % 8 == 0
        for _ in range(4 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["Vile!", "nasty", "vermin,"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = documents(spark, rows)
    table = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")
    scored = score_toxicity(docs, table).withColumn("test", held_out(F.col("doc_id")))
    test = [row for row in scored.collect() if row.test]
    assert all((row.score >= 0.7) == (row.doc_id % 8 == 0) for row in test)
    assert all(len(row.segments) > 0 for row in test if row.doc_id % 8 == 0)
    # labels that are held out change nothing
    flipped = table.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {row.doc_id: row.score for row in score_toxicity(docs, flipped).collect()}
    assert again == {row.doc_id: row.score for row in scored.collect()}


def test_odd_texts_and_missing_labels(spark):
    docs = documents(spark, odd_texts(fresh()))
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    scores = [row.score for row in score_toxicity(docs, labels).collect()]
    assert scores == [0.0] * docs.count()
    labels = spark.createDataFrame([(i, i % 2) for i in range(13)], "doc_id bigint, toxic int")
    got = score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= row.score <= 1 for row in got)
    assert score_toxicity(no_documents(spark), labels).collect() == []
