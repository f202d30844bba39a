"""Every query with an oracle returns what plain SQL returns on the same tables."""

import pytest
from compare import connect, mismatch

from trailmark.plans.catalog import QUERIES
from trailmark.plans.oracle import ORACLE

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_only_unsuitable_queries_lack_an_oracle():
    assert set(QUERIES) - set(ORACLE) == {"kmeans_clusters", "cluster_summary"}
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    assert mismatch(QUERIES[name](spark, FOLDER), duck, ORACLE[name]) is None
