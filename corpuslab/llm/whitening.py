"""Whitening of embeddings with Spark MLlib's BlockMatrix.

An entry c becomes the integer x = floor(``SCALE`` * c) + ``SHIFT``, so counts,
sums and deviations are exact.

1. One pass: the number of vectors, the sums by dimension (partial sums a task).
2. Every task cuts its rows into blocks of centred rows, (n x - S) / n; the last
   block of a task is filled with zero rows, which add nothing. Blocks get
   gapless numbers from the tasks' block counts and are written once.
3. Scatter: the blocks stand one below the other; the transpose times the matrix
   is summed over ``splits`` shares of the rows, since all of it is one result
   block and would else be one task. Divided by n it goes to the driver,
   dimensions x dimensions whatever the rows, for ``eigh``.
4. Projection: the same blocks stand in a square grid (a column of blocks alone
   would be dealt to the square root of the partitions), multiplied by the
   whitening matrix repeated along the diagonal.
5. Mean and covariance of the projected rows, centred before multiplying, give
   ``identity_error``.

Vectors that are null or hold null or non-finite entries are left out. A vector
shorter than the longest counts as if filled up with zero entries. Components
without variance (at most ``RANK_TOL`` of the largest eigenvalue) cannot be
whitened and are left out, so a table of equal vectors gives no rows, nor does an
empty table. A null id is returned as null, repeated rows count each; other
columns, whatever their names, are not read. Entries are to be below 2**40 and
n * x below 2**63, else the query fails; a deviation beyond 64 bits is null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from corpuslab.session import materialize, scratch_path

SCALE, SHIFT, COMPONENTS, RANK_TOL = 64, 1_000_000, 32, 1e-12
#: Values of a block, at least and at most; blocks aimed at; columns of a block.
BLOCK_VALUES, MAX_BLOCK_VALUES, MAX_BLOCKS, COLUMNS = 1 << 15, 1 << 22, 100_000, 1024
RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
_GRID = S.StructType([S.StructField("blockRowIndex", S.LongType()), S.StructField("blockColIndex", S.LongType())])


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and v (array<double>) of the vectors without null or non-finite entries."""
    v = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return v.filter(F.col("v").isNotNull() & F.forall("v", lambda e: e.isNotNull() & (F.abs(e) < float("inf"))))


def _entries(column, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(x of all entries, or of rows filled up to ``dims``; lengths of the rows)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    c = np.asarray(column.flatten(), dtype=np.float64)
    length = np.asarray(pc.list_value_length(column), dtype=np.int64)
    if len(c) and np.abs(c).max() >= 2.0 ** 40:
        raise OverflowError("an embedding entry is 2**40 or more")
    x = np.floor(SCALE * c).astype(np.int64) + SHIFT
    if dims is None:
        return x, length
    full = np.full((len(length), dims), SHIFT, np.int64)
    full[np.arange(dims) < length[:, None]] = x
    return full, length


def _sums(batches):
    """Partial sums and counts by dimension; dimension -1 counts the rows."""
    total, count, rows = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for b in batches:
        x, length = _entries(b.column("v"))
        rows += len(length)
        d = max([len(total), *length.tolist()])
        total, count = np.pad(total, (0, d - len(total))), np.pad(count, (0, d - len(count)))
        at = np.arange(len(x)) - np.repeat(np.cumsum(length) - length, length)
        np.add.at(total, at, x)
        count += np.bincount(at, minlength=d)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total))), pa.array(np.append(rows, total)), pa.array(np.append(rows, count))],
                                     names=["dim", "total", "n"])


def sums(valid: DataFrame) -> tuple[int, np.ndarray]:
    """(number of vectors, sums by dimension): one row a dimension comes back."""
    got = valid.select("v").mapInArrow(_sums, "dim bigint, total bigint, n bigint").groupBy("dim").agg(F.sum("total"), F.sum("n")).collect()
    got = {r[0]: (r[1], r[2]) for r in got}
    n = got.pop(-1, (0, 0))[0]
    out = [got[i][0] + (n - got[i][1]) * SHIFT for i in range(len(got))]
    return n, np.array(out, dtype=np.int64)


MATRIX = MatrixUDT.sqlType()
BLOCK = S.StructType([S.StructField("part", S.IntegerType()), S.StructField("ids", S.ArrayType(S.LongType())),
                      S.StructField("deviations", S.ArrayType(S.LongType())), S.StructField("m", MATRIX)])
_BLOCK = pa.schema([("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("deviations", pa.list_(pa.int64())),
                    ("m", pa.struct([("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())),
                                     ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())]))])


def deviations(far: np.ndarray) -> list:
    """Sum of squares of each row of integers; null where 64 bits cannot hold it."""
    if not far.size:
        return [0] * len(far)
    if float(np.abs(far).max()) ** 2 * far.shape[1] < 2 ** 62:
        return (far * far).sum(axis=1).tolist()
    out = [sum(v * v for v in row) for row in far.tolist()]
    return [v if v < 1 << 63 else None for v in out]


def _blocks(n: int, total: np.ndarray, rows: int, columns: int, parts: int):
    """Rows -> blocks of ``rows`` centred rows, cut into ``parts`` column blocks."""
    dims = len(total)

    def block(ids, x):
        far = n * x - total
        m = np.zeros((rows, parts * columns))
        m[:len(ids), :dims] = far / n
        dev = deviations(far)
        out = []
        for p in range(parts):
            piece = np.ascontiguousarray(m[:, p * columns:(p + 1) * columns]).ravel()
            out.append({"part": p, "ids": ids if p == 0 else [], "deviations": dev if p == 0 else [],
                        "m": {"type": 1, "numRows": rows, "numCols": columns, "colPtrs": None, "rowIndices": None, "values": piece, "isTransposed": True}})
        return pa.RecordBatch.from_pylist(out, schema=_BLOCK)

    def run(batches):
        ids, held = [], []
        for b in batches:
            x, _ = _entries(b.column("v"), dims)
            ids += b.column("id").to_pylist()
            held.append(x)
            if len(ids) >= rows:
                x = np.concatenate(held)
                a = 0
                while len(ids) - a >= rows:
                    yield block(ids[a:a + rows], x[a:a + rows])
                    a += rows
                ids, held = ids[a:], [x[a:]]
        if ids:
            yield block(ids, np.concatenate(held))
    return run


def centred_blocks(valid: DataFrame, n: int, total: np.ndarray) -> tuple[DataFrame, int, int, int]:
    """(blocks: label, part, ids, deviations, m; rows and columns of a block; column blocks)."""
    columns = min(len(total), COLUMNS)
    parts = -(-len(total) // columns)
    rows = max(BLOCK_VALUES // columns, min(-(-n // MAX_BLOCKS), MAX_BLOCK_VALUES // columns), 1)
    b = valid.mapInArrow(_blocks(n, total, rows, columns, parts), BLOCK).withColumn("at", F.monotonically_increasing_id())
    b = materialize(b.select(F.shiftright("at", 33).alias("task"), F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / parts).cast("bigint").alias("seq"), *BLOCK.names),
                    "whitening-tasks")
    per = b.filter("part = 0").groupBy("task").agg(F.count(F.lit(1)).alias("blocks"))
    first = per.select("task", (F.sum("blocks").over(Window.orderBy("task")) - F.col("blocks")).alias("first"))  # one row a task
    b = b.join(first, "task").select((F.col("first") + F.col("seq")).alias("label"), *BLOCK.names)
    return materialize(b, "whitening-blocks"), rows, columns, parts


def _as_matrices(df: DataFrame, name: str) -> DataFrame:
    """(block row, block column), matrix: the struct column written, and read as MLlib's matrix type."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(S.StructType([S.StructField("at", _GRID), S.StructField("m", MatrixUDT())])).parquet(path)


def block_matrix(df: DataFrame, rows: int, columns: int) -> BlockMatrix:
    """A BlockMatrix straight from a DataFrame of blocks, without a Python row in between."""
    return BlockMatrix(callMLlibFunc("createBlockMatrix", df, rows, columns, 0, 0), rows, columns)


def multiply(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product with the inner dimension cut into ``splits`` shares, each multiplied
    in a task of its own and summed (an argument that Python's ``multiply`` lacks)."""
    m = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(m, left.rowsPerBlock, right.colsPerBlock)


def scatter(blocks: DataFrame, rows: int, columns: int) -> np.ndarray:
    """Transpose times matrix of the blocks standing one below the other."""
    tall = block_matrix(blocks, rows, columns)
    splits = max(1, min(tall.numRowBlocks, blocks.rdd.getNumPartitions()))
    return multiply(tall.transpose(), tall, splits).toLocalMatrix().toArray()


def principal(cov: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns), falling, at most ``limit``."""
    e, u = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-e, kind="stable")
    e, u = e[order], u[:, order]
    keep = min(limit, int((e > RANK_TOL * max(e[0], 0.0)).sum())) if len(e) else 0
    return e[:keep], u[:, :keep]


def _projected(blocks: DataFrame, rows: int, columns: int, parts: int, w: np.ndarray) -> DataFrame:
    """label, m (struct): the blocks times the whitening matrix."""
    spark, k = blocks.sparkSession, w.shape[1]
    count = blocks.agg(F.max("label")).first()[0] + 1
    side = math.isqrt(count - 1) + 1
    grid = F.struct(F.floor(F.col("label") / side).alias("blockRowIndex"), ((F.col("label") % side) * parts + F.col("part")).cast("bigint").alias("blockColIndex"))
    left = block_matrix(_as_matrices(blocks.select(grid.alias("at"), "m"), "whitening-grid"), rows, columns)
    full = np.zeros((parts * columns, k))
    full[:len(w)] = w
    diagonal = [((j * parts + p, j), DenseMatrix(columns, k, full[p * columns:(p + 1) * columns].ravel(order="F").tolist()))
                for j in range(side) for p in range(parts)]
    right = BlockMatrix(spark.sparkContext.parallelize(diagonal, max(1, min(side, 64))), columns, k)
    product = left.multiply(right)  # kept by name: its wrapper lets go of the matrix when collected
    y = callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model)
    path = scratch_path(spark, "whitening-projected")
    y.toDF("at", "m").write.parquet(path)
    y = spark.read.schema(S.StructType([S.StructField("at", S.StructType([S.StructField("_1", S.LongType()), S.StructField("_2", S.LongType())])),
                                        S.StructField("m", MATRIX)])).parquet(path)
    return y.select((F.col("at._1") * side + F.col("at._2")).alias("label"), "m")


def _dense(m: dict, used: int) -> np.ndarray:
    values = np.asarray(m["values"])
    y = values.reshape(m["numRows"], m["numCols"]) if m["isTransposed"] else values.reshape(m["numCols"], m["numRows"]).T
    return y[:used]


def _moments(k: int, mean: np.ndarray | None):
    """Partial sums of the projected rows, or of their products about the mean."""
    def run(batches):
        total = np.zeros((k, k) if mean is not None else (1, k))
        for b in batches:
            for m, ids in zip(b.column("m").to_pylist(), b.column("ids").to_pylist()):
                y = _dense(m, len(ids))
                total += y.sum(axis=0) if mean is None else (y - mean).T @ (y - mean)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])
    return run


def _moment(rows: DataFrame, n: int, k: int, mean: np.ndarray | None) -> np.ndarray:
    got = rows.select("m", "ids").mapInArrow(_moments(k, mean), "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((k if mean is not None else 1, k))
    for r in got:  # k x k numbers
        out[r["i"], r["j"]] = r["v"] / n
    return out


def _expand(k: int):
    def run(batches):
        for b in batches:
            for m, ids, dev in zip(*(b.column(c).to_pylist() for c in ("m", "ids", "deviations"))):
                y = _dense(m, len(ids))
                take = pa.array(np.repeat(np.arange(len(ids)), k))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))),
                                                  pa.array(dev, pa.int64()).take(take), pa.array(np.ascontiguousarray(y).ravel())],
                                                 names=["vec_id", "component", "deviation", "whitened"])
    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each remaining vector and component."""
    spark = vectors.sparkSession
    valid = valid_vectors(vectors, id_col, vector_col)
    n, total = sums(valid)
    empty = spark.createDataFrame([], RESULT)
    if not n or not len(total):
        return empty
    blocks, rows, columns, parts = centred_blocks(valid, n, total)
    grid = F.struct(F.col("label").alias("blockRowIndex"), F.col("part").cast("bigint").alias("blockColIndex"))
    cov = scatter(_as_matrices(blocks.select(grid.alias("at"), "m"), "whitening-tall"), rows, columns)[:len(total), :len(total)] / n
    e, u = principal(cov, components)
    if not len(e):
        return empty
    k = len(e)
    y = _projected(blocks, rows, columns, parts, u / np.sqrt(e))
    y = materialize(y.join(blocks.filter("part = 0").select("label", "ids", "deviations"), "label"), "whitening-rows")
    mean = _moment(y, n, k, None)[0]
    error = float(np.abs(_moment(y, n, k, mean) - np.eye(k)).max())
    explained = F.array(*[F.lit(float(v)) for v in e / np.trace(cov)])
    return y.select("m", "ids", "deviations").mapInArrow(_expand(k), "vec_id bigint, component int, deviation bigint, whitened double").select(
        "vec_id", "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("component")).alias("explained"), F.lit(error).alias("identity_error"))
