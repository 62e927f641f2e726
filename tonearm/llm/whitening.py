"""Whitening of embeddings with MLlib's BlockMatrix.

Centred rows are indexed and dealt into distributed blocks.  The transpose times
the matrix is the scatter, its eigenvectors over the roots of its eigenvalues
are the whitening matrix (a local ``eigh`` of one dimensions x dimensions matrix),
and the blocks times that matrix are the projected rows.  The product behind the
scatter is split along the rows (``numMidDimSplits``), so that no task gets the
whole matrix.

Entries are put on a grid first: ``floor(scale * c) + offset`` as long, with
``floor(scale * c)`` held within ``LIMIT`` (2^40) on either side.  Sums are exact.

Rows whose vector is null, empty, or has a null or non-finite entry are left out,
and so are vectors of another length than most have (of equally frequent lengths
the longest counts).  Components whose eigenvalue is not above 1e-12 of the
largest are left out: constant or dependent dimensions give fewer components, and
a single row or equal rows give none.  Equal eigenvalues have any basis, the same
for all rows.  Rows with equal ids or null ids count each.  ``deviation`` is null
where it does not fit a long.  Empty tables give empty results.  Only the id and
the vector are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, functions as F

from tonearm.llm.common import table
from tonearm.session import materialize

SCALE, OFFSET, LIMIT = 1024, 100_000, float(1 << 40)
COMPONENTS, ROWS_PER_BLOCK, COLUMNS_PER_BLOCK = 8, 1024, 1024
LEAST = 1e-12
PART_BITS = 33  # monotonically_increasing_id: the partition above, the row below


def grid_rows(frame: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, offset: int = OFFSET) -> tuple[DataFrame, int, int]:
    """(vec_id, index, x) of the usable rows with indexes 0.., their number and their dimensions."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    usable = frame.filter(v.isNotNull() & (F.size(v) > 0) & finite)
    sizes = usable.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return frame.sparkSession.createDataFrame([], "vec_id long, index long, x array<long>"), 0, 0
    n, d = sizes["count"], sizes["d"]
    entry = lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(c.cast("double") * scale).cast("double"))).cast("long") + offset
    rows = materialize(usable.filter(F.size(v) == d).select(F.col(id_col).alias("vec_id"), F.transform(v, entry).alias("x"))
                       .withColumn("row", F.monotonically_increasing_id()))
    part = F.shiftright("row", PART_BITS)
    counts = sorted(rows.groupBy(part.alias("part")).count().collect())  # one row per written partition
    starts = np.cumsum([0, *(c for _, c in counts[:-1])]).tolist()
    begin = frame.sparkSession.createDataFrame([(int(p), int(s)) for (p, _), s in zip(counts, starts)], "part long, start long")
    indexed = rows.withColumn("part", part).join(F.broadcast(begin), "part")
    return indexed.select("vec_id", (F.col("start") + F.col("row").bitwiseAND(F.lit((1 << PART_BITS) - 1))).alias("index"), "x"), n, d


def column_sums(rows: DataFrame, d: int) -> list[int]:
    """Exact sum of each dimension."""
    def add(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(x.sum(0))], names=["at", "s"])

    found = rows.select("x").mapInArrow(add, "at long, s long").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return [int(s) for _, s in sorted((r["at"], r["s"]) for r in found)]


def scatter(block: BlockMatrix, splits: int) -> np.ndarray:
    """Transpose times matrix, the rows dealt into ``splits`` parts."""
    left = block.transpose()._java_matrix_wrapper
    product = BlockMatrix(left.call("multiply", block._java_matrix_wrapper._java_model, splits), block.colsPerBlock, block.colsPerBlock)
    return product.toLocalMatrix().toArray()


def whitening_matrix(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions x components, eigenvalues), by falling eigenvalue."""
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = np.flatnonzero(values > max(LEAST * values[0], 0))[:components]
    return vectors[:, keep] / np.sqrt(values[keep]), values[keep]


def _local_blocks(spark, matrix: np.ndarray, rows_per_block: int) -> BlockMatrix:
    parts = [((i, 0), DenseMatrix(len(m), m.shape[1], m.ravel("F"))) for i, m in
             enumerate(matrix[at:at + rows_per_block] for at in range(0, len(matrix), rows_per_block))]
    return BlockMatrix(spark.sparkContext.parallelize(parts, 1), rows_per_block, matrix.shape[1])


SCHEMA = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(frame: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           rows_per_block: int = ROWS_PER_BLOCK, columns_per_block: int = COLUMNS_PER_BLOCK) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per usable row and component."""
    spark = frame.sparkSession
    rows, n, d = grid_rows(frame, id_col, vector_col)
    none = spark.createDataFrame([], SCHEMA.format(dict(frame.dtypes)[id_col]))
    if not n:
        return none
    sums = column_sums(rows, d)
    mean = F.array(*(F.lit(s / n) for s in sums))
    centred = rows.select("index", array_to_vector(F.zip_with("x", mean, lambda x, m: x.cast("double") - m)).alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(centred, "vector"), n, d)
    columns = min(columns_per_block, d)
    block = matrix.toBlockMatrix(rows_per_block, columns)
    splits = max(1, min(block.numRowBlocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    v = scatter(block, splits) / n
    if not v.trace() > 0:
        return none
    w, values = whitening_matrix(v, components)
    projected = block.multiply(_local_blocks(spark, w, columns)).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    scores = materialize(found.select("index", vector_to_array("vector").alias("scores")))
    error = identity_error(scores, len(values))
    whole = rows.select("vec_id", "index", _gaps(sums, n).alias("deviation")).join(scores, "index")
    explained = F.array(*(F.lit(float(e / v.trace())) for e in values))
    return whole.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", F.posexplode("scores").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))


def _gaps(sums: list[int], n: int):
    """Sum of the squares of n*x - S, null beyond a long."""
    s = F.array(*(F.lit(x).cast("decimal(38,0)") for x in sums))
    gap = F.zip_with("x", s, lambda x, m: (x.cast("decimal(19,0)") * F.lit(n).cast("decimal(18,0)") - m).cast("decimal(38,0)"))
    longs = F.transform(gap, lambda g: g.try_cast("long"))
    return F.aggregate(longs, F.lit(0).cast("long"), lambda total, g: F.try_add(total, F.try_multiply(g, g)))


def identity_error(scores: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of the scores minus the identity."""
    at = lambda i: F.element_at("scores", i + 1)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = scores.agg(*(F.covar_pop(at(i), at(j)) for i, j in pairs)).first()
    return float(max(abs(c - (i == j)) for (i, j), c in zip(pairs, found)))


def op13_embedding_whitening(spark, folder):
    return whiten(table(spark, folder, "embeddings"))


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
ORACLE: dict[str, str] = {}
