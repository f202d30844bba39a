import math
import re

from cases import documents, fresh, no_documents, odd_texts, prose, words
from pyspark.sql import functions as F

from trailmark.llm.rule_ensemble import STATISTICS, held_out, learn, measure, score_quality
from trailmark.llm.queries import op12_quality_classifier

LABELS = "doc_id bigint, quality int, toxic int"


def brute(text):
    w, text = words(text), text or ""
    lines = [x for x in text.split("\n") if words(x)]
    letters = re.sub(r"[\x20\x09-\x0D]", "", text)

    def share(a, b):
        return a / max(b, 1)

    def count(characters):
        return sum(c in characters for c in text)

    return [
        float(len(w)),
        share(len(letters), len(w)),
        share(count("#*$%&|<>"), len(w)),
        share(sum(c.isupper() for c in text), len(letters)),
        share(count("!"), len(w)),
        share(count("0123456789"), len(letters)),
        share(count(".?"), len(w)),
        share(sum(len(x) <= 3 for x in w), len(w)),
        share(len(set(w)), len(w)),
        share(sum(a == b for a, b in zip(w, w[1:])), len(w)),
        share(len(w), len(lines)),
        share(len(lines) - len(set(lines)), len(lines)),
    ]


def corpus(rng, n):
    """Prose (label 1) and three kinds of junk (label 0), told by nothing but what they look like."""
    rows, labels = [], []
    for i in range(n):
        text, bad = prose(rng, rng.randrange(30, 150), 900), i % 4 == 0
        if bad:
            text = [text.upper().replace(" ", "!! "), text.replace(" ", "### "), f"{text.split()[0]} " * 60][i // 4 % 3]
        rows.append((i, text))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_statistics(spark):
    texts = [*odd_texts(fresh()), "A? b! 12 #x | y.\n\nA? b! 12 #x | y.", "Ä ä ä ß É"]
    got = measure(documents(spark, texts)).collect()
    expected = [brute(t[1] if isinstance(t, tuple) else t) for t in texts]
    assert [[row[s] for s in STATISTICS] for row in got] == expected
    assert "row" in got[0].row.asDict() and "text" not in got[0].row.asDict()


def test_held_out_documents_and_labels(spark, tmp_path):
    rng = fresh(12)
    rows, labels = corpus(rng, 600)
    docs = documents(spark, rows)
    table = spark.createDataFrame([*labels, (None, 0, 0), (3, None, 0), (10**6, 0, 0)], LABELS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    table.write.parquet(f"{tmp_path}/labels.parquet")
    got = op12_quality_classifier(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and dict(got.dtypes)["predicted"] == "int"
    got = got.collect()
    test = [row for row in got if row.held_out]
    assert len(test) > 60 and all(row.predicted == (row.doc_id % 4 != 0) for row in test)
    # labels that are held out change nothing
    flipped = table.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {row.row.doc_id: row.score for row in score_quality(docs, flipped).collect()}
    assert all(math.isclose(again[row.doc_id], row.score, rel_tol=1e-9) for row in got)


def test_the_column_is_the_weighted_rules(spark):
    rows, labels = corpus(fresh(13), 300)
    measured = measure(documents(spark, rows))
    model = learn(measured, spark.createDataFrame(labels, LABELS))
    assert 0 < len(model.weights) < 100
    scored = measured.withColumn("score", model.score())
    assert not re.search("Python|Arrow", scored._jdf.queryExecution().executedPlan().toString())
    for row in scored.collect():
        total = model.intercept + sum(
            weight
            for rule, weight in model.weights.items()
            if all(low < row[name] <= high for name, low, high in rule.bounds)
        )
        assert math.isclose(row.score, 1 / (1 + math.exp(-total)), rel_tol=1e-12)


def test_odd_texts_and_missing_labels(spark):
    docs = documents(spark, odd_texts(fresh()))
    none = score_quality(docs, spark.createDataFrame([], LABELS)).collect()
    assert [row.score for row in none] == [0.5] * docs.count()
    good = score_quality(docs, spark.createDataFrame([(i, 1, 0) for i in range(13)], LABELS)).collect()
    assert len({row.score for row in good}) == 1 and 0.5 < good[0].score < 1
    mixed = score_quality(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(13)], LABELS)).collect()
    assert len(mixed) == docs.count() and all(0 <= row.score <= 1 for row in mixed)
    assert score_quality(no_documents(spark), spark.createDataFrame([(1, 0, 0)], LABELS)).collect() == []
