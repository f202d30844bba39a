from cases import documents, fresh, prose

from trailmark.llm import decontaminate


def test_no_part_is_beyond_its_bound_when_one_row_is_repeated(spark, monkeypatch):
    rng, made, init = fresh(26), [], decontaminate.Phrases.__init__

    def recorded(self, items, window):
        made.append([len(name) + len(text) for name, text in items])
        init(self, items, window)

    monkeypatch.setattr(decontaminate.Phrases, "__init__", recorded)
    items = [(i, prose(rng, 12)) for i in range(6)]
    benchmark = spark.createDataFrame(items + items[:1] * 300, "item_id int, text string")
    docs = documents(spark, [f"before {text} behind" for _, text in items])
    found = decontaminate.find_contamination(docs, benchmark, part_bytes=200).collect()
    assert {row.doc_id: row["items"] for row in found} == {i: [str(i)] for i in range(6)}
    assert sum(map(len, made)) == 6
    assert all(sum(part) <= 200 or len(part) == 1 for part in made)
