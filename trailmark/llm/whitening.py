"""Whitening of embeddings by principal components, on MLlib's distributed block matrices.

Entries are put on a grid of 1/``SCALE`` as whole numbers x, so that equal vectors can be told
and sums are exact. The components are fitted to each distinct x vector once: the vectors are
numbered, centred exactly (n x - S, over n) and dealt into a BlockMatrix of ``ROWS_PER_BLOCK``
rows a block; its transpose times itself is the scatter matrix, whose eigenvectors are found
locally (dimension x dimension); and the block matrix times the whitening matrix projects the
vectors. Rows get the projection of their vector by a join on x.

The product of transpose and matrix has one block. It is split along the middle dimension, so
that a task multiplies ``BLOCKS_PER_TASK`` blocks at most and only products are added up; MLlib
would otherwise send all blocks to one task. It keeps the places of all blocks on the driver:
two numbers for every ``ROWS_PER_BLOCK`` vectors.

Defined cases: rows whose vector is null, empty, or holds an entry that is null, not finite or
too large to be put on the grid exactly (2^53 and more) are dropped, and so are those whose
length differs from the commonest one (the smallest of several). Null ids and repeated rows each
get their rows. Components without variance (all of them if there is one distinct vector) have a
null ``whitened`` and 0.0 ``explained``. A ``deviation`` beyond 64 bits is null. Other columns
are carried along in ``row``, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trailmark.storage import materialize

SCALE = 256
COMPONENTS = 4
ROWS_PER_BLOCK = 4096
BLOCKS_PER_TASK = 4
#: Eigenvalues below this share of the largest one are rounding errors of zero.
NO_VARIANCE = 1e-12


def on_grid(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``row`` (a struct of all columns) and ``x`` (whole numbers) of the rows that have a valid vector."""
    entries = F.col(column).cast("array<double>")

    def is_valid(entry: Column) -> Column:
        # nan is larger than every number
        return entry.isNotNull() & (F.abs(entry) * SCALE < 2.0**53)

    rows = vectors.select(F.struct(*vectors.columns).alias("row"), entries.alias("x"))
    valid = rows.where((F.size("x") > 0) & F.forall("x", is_valid))
    return valid.select("row", F.transform("x", lambda c: F.floor(c * SCALE)).alias("x"))


def number_rows(distinct: DataFrame) -> DataFrame:
    """The vectors with consecutive numbers ``index``: their place in a task behind all tasks before it."""
    place = F.monotonically_increasing_id()
    placed = materialize(
        distinct.select("x", F.shiftright(place, 33).alias("part"), (place % (1 << 33)).alias("place")),
        "whitening-vectors",
    )
    # one row for each task that wrote vectors
    sizes = sorted(tuple(r) for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    offsets = placed.sparkSession.createDataFrame(
        [(part, offset) for (part, _), offset in zip(sizes, before)], "part int, offset bigint"
    )
    numbered = placed.join(F.broadcast(offsets), placed.part == offsets.part)
    return numbered.select("x", (F.col("offset") + F.col("place")).alias("index"))


def sums_of(vectors: DataFrame) -> tuple[int, list[int]]:
    """The count and the exact sum of every dimension."""
    entries = vectors.select(F.posexplode("x").alias("dimension", "entry"))
    total = F.sum(F.col("entry").cast("decimal(38,0)")).alias("total")
    found = entries.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), total).collect()
    return found[0].n, [int(row.total) for row in sorted(found)]


def block_matrix(vectors: DataFrame, n: int, sums: list[int]) -> BlockMatrix:
    """The centred vectors, by ``index``, as a matrix of blocks."""
    totals = F.array(*[F.lit(s).cast("bigint") for s in sums])
    centred = F.zip_with("x", totals, lambda x, s: (x * n - s).cast("double") / n)
    rows = vectors.select("index", array_to_vector(centred).alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(rows, "vector"), n, len(sums))
    return matrix.toBlockMatrix(ROWS_PER_BLOCK, len(sums))


def scatter(centred: BlockMatrix) -> np.ndarray:
    """Transpose times matrix, with the middle dimension split among tasks."""
    turned = centred.transpose()
    splits = math.ceil(centred.numRowBlocks / BLOCKS_PER_TASK)
    product = turned._java_matrix_wrapper.call(
        "multiply", centred._java_matrix_wrapper._java_model, splits
    )
    return BlockMatrix(product, turned.rowsPerBlock, centred.colsPerBlock).toLocalMatrix().toArray()


def components_of(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) by falling eigenvalue; 0 for those without variance."""
    values, directions = np.linalg.eigh((covariance + covariance.T) / 2)
    values, directions = values[::-1][:most].copy(), directions[:, ::-1][:, :most]
    values[values <= NO_VARIANCE * max(values.max(initial=0.0), 0.0)] = 0.0
    return values, directions


def project(spark: SparkSession, centred: BlockMatrix, matrix: np.ndarray) -> DataFrame:
    """``index`` and ``whitened`` (an array) of every vector, as a product of block matrices."""
    block = DenseMatrix(*matrix.shape, matrix.flatten(order="F"))
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)], 1), *matrix.shape)
    rows = centred.multiply(right).toIndexedRowMatrix().rows
    pairs = rows.map(lambda row: (row.index, row.vector.toArray().tolist()))
    return spark.createDataFrame(pairs, "index bigint, whitened array<double>")


def identity_error(projected: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity."""
    if not components:
        return 0.0
    entry = [F.get("whitened", i) for i in range(components)]
    means = projected.agg(*[F.avg(e) for e in entry]).first()
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    products = [F.avg((entry[i] - means[i]) * (entry[j] - means[j])) for i, j in pairs]
    found = projected.agg(*products).first()
    return max((abs(value - (i == j)) for (i, j), value in zip(pairs, found)), default=0.0)


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row a vector and component: ``row, component, n, deviation, whitened, explained, identity_error``."""
    result = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    every = materialize(on_grid(vectors, column), "whitening-rows")
    # one row for each length that occurs; the first one counts
    lengths = every.groupBy(F.size("x").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), "length").first()
    if common is None:
        nothing = [F.lit(None).cast(kind).alias(name) for name, kind in map(str.split, result.split(", "))]
        return every.select("row", *nothing)
    rows = every.where(F.size("x") == common.length)
    numbered = materialize(number_rows(rows.select("x").distinct()), "whitening-fit")
    n, sums = sums_of(numbered)
    centred = block_matrix(numbered, n, sums)
    covariance = scatter(centred) / n
    values, directions = components_of(covariance, components)
    live = int((values > 0).sum())
    if live:
        scaled = directions[:, :live] / np.sqrt(values[:live])
        projected = materialize(project(vectors.sparkSession, centred, scaled), "whitening-projected")
    else:
        projected = numbered.select("index", F.array().cast("array<double>").alias("whitened"))
    error = identity_error(projected, live)
    trace = float(np.trace(covariance))
    # written, so that its size is known: the join with all rows is broadcast, or split where many have one vector
    known = materialize(
        numbered.join(projected, "index").select(F.col("x").alias("of"), "whitened"), "whitening-known"
    )
    totals = F.array(*[F.lit(s).cast("bigint") for s in sums])
    apart = F.zip_with("x", totals, lambda x, s: (x * n - s).cast("decimal(18,0)"))
    squares = F.aggregate(
        apart, F.lit(0).cast("decimal(38,0)"), lambda sum_, d: (sum_ + d * d).cast("decimal(38,0)")
    )
    shares = F.array(*[F.lit(float(v) / trace if trace else 0.0) for v in values])
    joined = rows.join(known, F.col("x") == F.col("of")).select(
        "row", squares.try_cast("bigint").alias("deviation"), "whitened", F.posexplode(shares).alias("at", "explained")
    )
    return joined.select(
        "row",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        F.get("whitened", F.col("at")).alias("whitened"),
        "explained",
        F.lit(error).alias("identity_error"),
    )
