"""From raw documents to a training corpus, stage by stage.

Each stage is a function of (spark, docs, folder of tables). Its result is
written as Parquet to the shared folder and read back as the next one's input,
so a lost executor costs no more than its own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailmark.llm.decontaminate import remove_contamination
from trailmark.llm.line_dedup import dedup_runs, without_repeated_lines
from trailmark.llm.mixing import mix_sources
from trailmark.llm.near_dedup import keep_one_of_each
from trailmark.llm.quality import keep_good
from trailmark.sources.tables import read_table
from trailmark.storage import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break the base rules or lie beyond their source's fences go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that stand at an earlier place are cut out of the texts."""
    return without_repeated_lines(docs, dedup_runs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts."""
    return remove_contamination(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out at their source's rate, in random order."""
    return mix_sources(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

# Signatures depend on 64-bit hashes that SQL does not have; a test compares all
# rows with a plain chain of the five stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
