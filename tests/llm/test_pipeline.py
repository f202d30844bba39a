import corpus_pipeline
import pytest
from cases import documents, fresh, odd_texts, prose
from compare import connect, mismatch

from trailmark.llm.queries import ORACLE, QUERIES
from trailmark.storage import materialize

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    assert mismatch(QUERIES[name](spark, folder), connect(folder), ORACLE[name]) is None


def test_each_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_every_stage_takes_odd_documents_and_keeps_clean_ones(spark):
    rng = fresh(18)
    clean = [prose(rng, 120) + "\n" + prose(rng, 120) for _ in range(30)]
    docs = documents(spark, odd_texts(rng) + [(100 + i, t) for i, t in enumerate(clean)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, docs, FOLDER), name)
        assert kept.columns == docs.columns
        assert {row.doc_id: row.text for row in kept.collect() if (row.doc_id or 0) >= 100} == {
            100 + i: t for i, t in enumerate(clean)
        }
        docs = kept
    name, stage = corpus_pipeline.STAGES[-1]
    assert set(docs.columns) <= set(stage(spark, docs, FOLDER).columns)


def test_the_pipeline_runs_from_the_tables(spark):
    ids = {row.doc_id for row in corpus_pipeline.run(spark, FOLDER).select("doc_id").collect()}
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert ids and ids <= {row.doc_id for row in table.select("doc_id").collect()}
