import math
from collections import Counter

from cases import documents, fresh, no_documents, odd_texts, prose

from trailmark.llm.mixing import distributions, mix_sources, replication_rates


def test_distributions_equal_the_formula(spark):
    rates = spark.createDataFrame([("a", 1, 0.3), (None, 1, 4.0), ("c", 1, 900.0), ("d", 0, 0.0)], "source string, size bigint, rate double")
    got = {row.of_source: row.steps for row in distributions(rates).collect()}
    assert set(got) == {"a", None, "c"}
    for source, rate in (("a", 0.3), (None, 4.0), ("c", 900.0)):
        total = 0.0
        for k, step in enumerate(got[source]):
            total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
            assert abs(step - total) < 1e-9
        assert step > 1 - 1e-10


def test_sources_reach_their_weights(spark):
    rng = fresh(16)
    rows = [(i, prose(rng, 50), "en", "big" if i % 3 else "small") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")
    mixed = mix_sources(docs, {"big": 1.0, "small": 3.0}, repeat=2.0)
    size = Counter()
    copies = Counter()
    for row in mixed.collect():
        size[row.source] += len(row.text)
        copies[row.doc_id, row.n_copies] += 1
    total = sum(len(row[1]) for row in rows)
    assert abs(sum(size.values()) / total - 2) < 0.1
    assert abs(size["small"] / sum(size.values()) - 0.75) < 0.02
    assert all(n == count for (_, n), count in copies.items())
    # the same draw whatever the partitions
    assert sorted(map(tuple, mixed.select("doc_id", "copy", "shuffle_key").collect())) == sorted(
        map(tuple, mix_sources(docs.repartition(7), {"big": 1.0, "small": 3.0}, repeat=2.0).select("doc_id", "copy", "shuffle_key").collect())
    )


def test_odd_cases(spark):
    docs = documents(spark, odd_texts(fresh())).withColumnRenamed("number", "Copy")
    mixed = mix_sources(docs, repeat=5.0)
    assert [c for c in mixed.columns if c not in docs.columns] == ["copy", "n_copies", "shuffle_key"]
    rows = mixed.collect()
    # the rows of one id are in different sources here, with rates of their own
    counts = {(row.doc_id, row.source, row.text): row.n_copies for row in rows}
    assert len(rows) == sum(counts.values())
    assert mix_sources(no_documents(spark)).collect() == []
    textless = documents(spark, [None, ""])
    assert mix_sources(textless).collect() == []
    rates = {row.source: row.rate for row in replication_rates(documents(spark, ["abc", "abc", ""]), {"web": 1.0}).collect()}
    assert rates == {"web": 1.0, None: 0.0}
