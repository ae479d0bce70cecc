"""Whitening of embeddings with MLlib's distributed block matrices.

Entries become whole numbers, so that counts, sums and deviations are exact. Centred rows are indexed
into a BlockMatrix; its transpose times itself is the scatter, a small square matrix whose
eigenvectors are found locally; the rows' BlockMatrix times the whitening matrix projects them.
Only matrices of the vectors' dimension and one count per task pass the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm.common import cut, table
from turnmill.llm.registry import query

#: An entry c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Entries of a block, and columns of a block at most.
BLOCK_ENTRIES, BLOCK_COLUMNS = 1 << 18, 1024
#: An eigenvalue of less than this part of the trace is no variance but rounding.
LEAST = 1e-12
#: 64 c and n x - S of larger entries don't fit a long.
LARGEST = 2.0**40


@dataclass
class Whitening:
    """n fitted vectors, their sums per dimension, and the components of falling variance."""

    n: int
    sums: list[int]
    components: np.ndarray  # dimension x k, unit columns
    variances: np.ndarray  # k
    explained: np.ndarray  # k
    identity_error: float


def whole_entries(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """rows with x, an array of longs; rows whose vector is null, empty, of another length than most
    vectors, or holds an entry that is null, not finite or beyond LARGEST are left out."""
    entry = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST)
    vectors = rows.withColumn("x", F.col(vector).cast("array<double>")).where(
        F.col("x").isNotNull() & (F.size("x") > 0) & ~F.coalesce(F.exists("x", entry), F.lit(True))
    )
    # One row for each length there is.
    sizes = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    size = sizes.d if sizes else 0
    return vectors.where(F.size("x") == size).withColumn(
        "x", F.transform("x", lambda c: F.floor(c * SCALE).cast("long") + F.lit(SHIFT).cast("long"))
    )


def indexed(rows: DataFrame, name: str) -> DataFrame:
    """rows, written, with index 0, 1, ... without gaps. One count per task passes the driver."""
    low = (1 << 33) - 1  # a row's place in its task, in the lower 33 bits
    held = cut(rows, name).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33).cast("int")
    before, base = 0, []
    for p, n in sorted(held.groupBy(part.alias("p")).count().collect()):
        base.append((p, before))
        before += n
    starts = rows.sparkSession.createDataFrame(base, "_part int, _start long")
    placed = held.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn("index", F.col("_id").bitwiseAND(low) + F.col("_start")).drop("_id", "_part", "_start")


def centred(sums: list[int], n: int) -> Column:
    """x less its mean, from exact whole numbers."""
    totals = F.array(*[F.lit(s).cast("long") for s in sums])
    return F.transform(
        F.arrays_zip(F.col("x").alias("x"), totals.alias("s")),
        lambda p: (p["x"] * F.lit(n).cast("long") - p["s"]).cast("double") / F.lit(float(n)),
    )


def blocks(rows: DataFrame, values: Column, n: int, dimension: int) -> BlockMatrix:
    """The rows' values by their index, in blocks of BLOCK_ENTRIES at most."""
    vectors = rows.select("index", array_to_vector(values).alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, dimension)
    columns = min(dimension, BLOCK_COLUMNS)
    return matrix.toBlockMatrix(max(1, BLOCK_ENTRIES // columns), columns)


def transposed_product(matrix: BlockMatrix) -> np.ndarray:
    """The matrix's transpose times itself. Each of the inner dimension's splits is multiplied by a
    task of its own, which holds a few blocks, and the products are summed."""
    splits = max(1, -(-matrix.numRows() // (4 * matrix.rowsPerBlock)))
    java = matrix._java_matrix_wrapper._java_model
    product = java.transpose().multiply(java, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def projected(matrix: BlockMatrix, directions: np.ndarray) -> BlockMatrix:
    """The rows times directions: the small matrix joins every block of rows."""
    side, (d, k) = matrix.colsPerBlock, directions.shape
    context = SparkSession.active().sparkContext
    parts = [
        ((i // side, 0), DenseMatrix(len(directions[i : i + side]), k, directions[i : i + side].ravel("F").tolist()))
        for i in range(0, d, side)
    ]
    return matrix.multiply(BlockMatrix(context.parallelize(parts, 1), side, k, d, k))


def rows_of(matrix: BlockMatrix) -> DataFrame:
    """index and values (array<double>) of a block matrix's rows, as the JVM holds them."""
    java = matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model
    frame = callMLlibFunc("getIndexedRows", java)
    return frame.select(F.col("index"), vector_to_array("vector").alias("values"))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of vectors (x), in which every distinct x counts once; None without rows.

    The sums are exact. Components without variance are left out; equal vectors alone have none.
    """
    distinct = indexed(vectors.select("x").distinct(), "vectors")
    n = distinct.count()
    if not n:
        return None
    totals = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s"))
    sums = [r.s for r in totals.orderBy("i").collect()]
    matrix = blocks(distinct, centred(sums, n), n, len(sums))
    covariance = transposed_product(matrix) / n
    values, directions = np.linalg.eigh(covariance)
    trace = float(np.trace(covariance))
    falling = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > LEAST * trace]
    values, directions = values[falling], directions[:, falling]
    if not falling:
        return Whitening(n, sums, directions, values, values, 0.0)
    after = transposed_product(projected(matrix, directions / np.sqrt(values))) / n
    error = float(np.abs(after - np.eye(len(values))).max())
    return Whitening(n, sums, directions, values, values / trace, error)


def transform(vectors: DataFrame, fitted: Whitening) -> DataFrame:
    """vectors with index and whitened (array<double>, one entry per component). Columns named so are replaced."""
    rows = indexed(vectors.drop("index", "whitened"), "rows")
    found = blocks(rows, centred(fitted.sums, fitted.n), rows.count(), len(fitted.sums))
    scaled = fitted.components / np.sqrt(fitted.variances)
    return rows.join(rows_of(projected(found, scaled)).withColumnRenamed("values", "whitened"), "index")


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for every row of rows with a whole vector and every component: vec_id, component, n,
    deviation, whitened, explained, identity_error.

    Rows are left out as whole_entries says. Fitted is every distinct vector once, whitened is every
    row: repeated rows and ids are whitened one by one, a null vec_id stays null. Components without
    variance are left out, so one vector alone, or an empty table, gives no rows. deviation is null if
    it doesn't fit a long. Other columns are not looked at.
    """
    vectors = cut(whole_entries(rows.select("vec_id", vector), vector).select("vec_id", "x"), "whole")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(vectors, components)
    if fitted is None or not len(fitted.variances):
        return rows.sparkSession.createDataFrame([], schema)
    totals = F.array(*[F.lit(s).cast("long") for s in fitted.sums])
    gaps = F.transform(
        F.arrays_zip(F.col("x").alias("x"), totals.alias("s")),
        lambda p: (p["x"] * F.lit(fitted.n).cast("long") - p["s"]).cast("decimal(19,0)"),
    )
    squares = F.aggregate(gaps, F.lit(0).cast("decimal(38,0)"), lambda a, g: (a + g * g).cast("decimal(38,0)"))
    explained = F.array(*[F.lit(float(e)) for e in fitted.explained])
    done = transform(vectors, fitted).withColumn("deviation", squares.try_cast("long"))
    return done.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened")).select(
        "vec_id",
        (F.col("i") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("i")).alias("explained"),
        F.lit(fitted.identity_error).alias("identity_error"),
    )


@query("op13_block_matrix_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings along their first 16 whitened components."""
    return whiten(table(spark, sf_dir, "embeddings"))
