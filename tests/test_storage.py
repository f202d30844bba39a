from pathlib import Path

import pytest

from trailmark.llm.components import connected_components
from trailmark.storage import materialize, shared_folder, workspace


def test_a_run_has_a_folder_of_its_own_that_is_removed(spark):
    with workspace(spark) as folder:
        table = materialize(spark.range(5), "five")
        assert table.count() == 5
        local = Path(folder.removeprefix("file:"))
        assert list(local.glob("five-*"))
        assert folder.startswith(shared_folder(spark))
    assert not local.exists()
    assert materialize(spark.range(3), "three").count() == 3


def test_the_folder_is_removed_after_an_error(spark):
    with pytest.raises(KeyError), workspace(spark) as folder:
        materialize(spark.range(1), "one")
        raise KeyError
    assert not Path(folder.removeprefix("file:")).exists()


def test_small_tables_are_not_a_file_for_every_partition(spark):
    settings = {
        "spark.sql.shuffle.partitions": "96",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        with workspace(spark) as folder:
            local = Path(folder.removeprefix("file:"))
            pairs = spark.range(2000).selectExpr("2 * id AS a", "2 * id + 1 AS b")
            found = connected_components(pairs)
            assert found.where("class = node - node % 2").count() == found.distinct().count() == 4000
            for label in ("links", "large-star", "small-star"):
                assert 0 < len(list(local.glob(f"{label}-*/part-*"))) <= spark.sparkContext.defaultParallelism
            # long rows stay in the partitions they are in
            materialize(spark.range(2000).selectExpr("id % 1000 AS n").groupBy("n").count(), "long")
            assert len(list(local.glob("long-*/part-*"))) > 64
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_merged_partitions_are_written_as_they_are(spark):
    with workspace(spark) as folder:
        materialize(spark.range(2000).selectExpr("id % 1000 AS n").groupBy("n").count(), "merged", small=True)
        assert len(list(Path(folder.removeprefix("file:")).glob("merged-*/part-*"))) == 1
