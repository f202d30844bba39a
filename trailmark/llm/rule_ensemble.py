"""Quality classifier: a sparse ensemble of rules over statistics of a text, as one column expression.

Statistics of every text are measured in DataFrame functions. A forest of shallow regression
trees is fitted to the labelled rows; every path from a root to a node is a rule, a conjunction
of bounds on statistics. Rules become indicators, and logistic regression with the lasso penalty
``LASSO`` gives each a weight, most of them 0. The rules that are left are compiled into a Spark
column expression over the statistics, which scores all documents in one pass without Python.

At most ``MAX_LABELLED`` labelled ids (those with the smallest hash) are learned from, each with
one row; this bounds the training table only. Everything else covers all documents.

Defined cases: labels of one id that differ count as the lowest; rows of one id with different
texts teach by the smallest statistics; null ids and labels teach nothing; without labels every
score is 0.5, with labels of one class the smoothed share (good + 1) / (n + 2). Null, empty and
blank texts have zero statistics and are scored like others. Repeated documents each get their
row. Other columns are carried along in ``row``, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trailmark.storage import materialize, shared_folder

MAX_LABELLED = 50_000
TREES = 12
DEPTH = 3
MIN_ROWS = 5
BINS = 64
LASSO = 0.0005
SEED = 1
#: The training rows are dealt to so many tasks by their id, so that the model depends on no file or partition.
FIT_TASKS = 4

STATISTICS = [
    "n_words",
    "word_length",
    "symbol_share",
    "upper_share",
    "shout_share",
    "digit_share",
    "stop_share",
    "short_share",
    "distinct_share",
    "echo_share",
    "line_words",
    "same_line_share",
]


@dataclass(frozen=True)
class Rule:
    """Bounds on statistics: (name, above this, up to this), infinite where there is none."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        holds = F.lit(True)
        for name, low, high in self.bounds:
            if low > float("-inf"):
                holds = holds & (F.col(name) > low)
            if high < float("inf"):
                holds = holds & (F.col(name) <= high)
        return holds


@dataclass
class Ensemble:
    """Rules with their weights; ``intercept`` is the log-odds where no rule holds."""

    intercept: float
    weights: dict[Rule, float] = field(default_factory=dict)

    def score(self) -> Column:
        """Probability of label 1, over the columns of ``measure``."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total = total + F.when(rule.column(), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    """The fifth of the ids that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def measure(docs: DataFrame) -> DataFrame:
    """``row`` (a struct of the columns but ``text``) and the statistics of every text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    others = [name for name in docs.columns if name != "text"]
    # One projection a step: what a step refers to more than once is computed once.
    split = docs.select(
        F.struct(*others).alias("row"),
        text.alias("text"),
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("every_word"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("every_line"),
    )

    def left(pattern: str) -> Column:
        return F.char_length(F.regexp_replace("text", pattern, ""))

    def count(characters: str) -> Column:
        return F.char_length("text") - F.char_length(F.translate("text", characters, ""))

    counted = split.select(
        "row",
        F.size("every_word").alias("words"),
        F.size("every_line").alias("lines"),
        left(r"[\x20\x09-\x0D]+").alias("chars"),
        count("#*$%&|<>").alias("symbols"),
        left(r"[^\p{Lu}]+").alias("upper"),
        count("!").alias("shouts"),
        count("0123456789").alias("digits"),
        count(".?").alias("stops"),
        F.size(F.filter("every_word", lambda w: F.char_length(w) <= 3)).alias("short"),
        F.size(F.array_distinct("every_word")).alias("distinct"),
        F.size(F.filter("every_word", lambda w, i: w == F.get("every_word", i - 1))).alias("echoes"),
        F.size(F.array_distinct("every_line")).alias("distinct_lines"),
    )

    def share(part: Column, whole: str) -> Column:
        return part.cast("double") / F.greatest(F.col(whole), F.lit(1)).cast("double")

    values = {
        "n_words": F.col("words").cast("double"),
        "word_length": share(F.col("chars"), "words"),
        "symbol_share": share(F.col("symbols"), "words"),
        "upper_share": share(F.col("upper"), "chars"),
        "shout_share": share(F.col("shouts"), "words"),
        "digit_share": share(F.col("digits"), "chars"),
        "stop_share": share(F.col("stops"), "words"),
        "short_share": share(F.col("short"), "words"),
        "distinct_share": share(F.col("distinct"), "words"),
        "echo_share": share(F.col("echoes"), "words"),
        "line_words": share(F.col("words"), "lines"),
        "same_line_share": share(F.col("lines") - F.col("distinct_lines"), "lines"),
    }
    return counted.select("row", *[values[name].alias(name) for name in STATISTICS])


def training_rows(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, label`` and statistics: one row for each labelled id that may be learned from."""
    known = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min(F.when(F.col("quality") != 0, 1.0).otherwise(0.0)).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_LABELLED)
    )
    known = materialize(known, "rule-labels")
    texts = measured.select(F.col("row.doc_id").alias("of"), F.struct(*STATISTICS).alias("statistics"))
    taught = texts.join(F.broadcast(known), F.col("of") == F.col("doc_id"))
    one = taught.groupBy("doc_id", "label").agg(F.min("statistics").alias("statistics"))
    return materialize(one.select("doc_id", "label", "statistics.*"), "rule-training")


def paths_of(spark: SparkSession, model: RandomForestRegressionModel) -> list[Rule]:
    """All paths of the trees, from the table of nodes that a stored model consists of."""
    folder = f"{shared_folder(spark)}/trailmark/rule-trees-{uuid.uuid4().hex}"
    model.write().save(folder)
    # TREES * 2^(DEPTH + 1) rows at most
    nodes = {
        (row.treeID, row.id): row
        for row in spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").collect()
    }
    found: dict[Rule, None] = {}

    def walk(tree: int, node: int, bounds: dict[str, tuple[float, float]]) -> None:
        if bounds:
            found[Rule(tuple((name, *bounds[name]) for name in STATISTICS if name in bounds))] = None
        row = nodes[tree, node]
        if row.leftChild < 0:
            return
        name, cut = STATISTICS[row.split.featureIndex], row.split.leftCategoriesOrThreshold[0]
        low, high = bounds.get(name, (float("-inf"), float("inf")))
        walk(tree, row.leftChild, {**bounds, name: (low, min(high, cut))})
        walk(tree, row.rightChild, {**bounds, name: (max(low, cut), high)})

    for tree in sorted({tree for tree, _ in nodes}):
        walk(tree, 0, {})
    return list(found)


def learn(measured: DataFrame, labels: DataFrame) -> Ensemble:
    """The weighted rules that tell label 1 from label 0."""
    rows = training_rows(measured, labels)
    n, good = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or good in (0, n):
        share = ((good or 0) + 1) / (n + 2)
        return Ensemble(math.log(share / (1 - share)))
    dealt = rows.repartition(FIT_TASKS, "doc_id").sortWithinPartitions("doc_id")
    statistics = array_to_vector(F.array(*STATISTICS)).alias("features")
    trees = RandomForestRegressor(
        numTrees=TREES,
        maxDepth=DEPTH,
        minInstancesPerNode=MIN_ROWS,
        maxBins=BINS,
        featureSubsetStrategy="onethird",
        seed=SEED,
    ).fit(dealt.select("label", statistics))
    rules = paths_of(rows.sparkSession, trees)
    if not rules:
        return Ensemble(math.log(good / (n - good)))
    indicators = array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("features")
    fitted = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, tol=1e-4).fit(
        dealt.select("label", indicators)
    )
    weights = {r: float(w) for r, w in zip(rules, fitted.coefficients.toArray()) if w}
    return Ensemble(float(fitted.intercept), weights)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``row`` (a struct of the columns but ``text``), the statistics and ``score``."""
    measured = materialize(measure(docs), "rule-statistics")
    return measured.withColumn("score", learn(measured, labels).score())
