"""Whitening of embeddings: components from the singular values of centred rows.

Entries become whole numbers (64 steps a unit), so that sums and deviations are exact. The rows
less their mean, as a distributed RowMatrix, go to MLlib's computeSVD; a singular value s of n
rows is the eigenvalue s * s / n of their covariance. A row's whitened form is its centred
vector on each component over the root of that eigenvalue. The total variance, which says how much a component explains,
comes from the exact deviations and not from the singular values. How far the whitened rows' covariance is
from the identity is measured on the whitened rows themselves, centred again before they are multiplied.

Only matrices of dimensions by dimensions reach the driver. All dimensions are asked of computeSVD, for
which it decomposes the Gram matrix in full double precision instead of iterating to a tolerance.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are dropped, as are those
with an entry of more than 2^53 steps, which no double holds exactly, and those of another
length than most (of equally common lengths the longest); rows that repeat count each; a row without a vec_id
keeps it null; components whose singular value is below a millionth of the largest have no whitened form, so a table of one row or of
equal rows gives none, like an empty one; a deviation that no long holds is null. Other columns are not read by `digest`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scoped, written

STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Singular values below this share of the largest are zero but for rounding of the Gram matrix.
LEAST_SINGULAR = 1e-6
LONG = (1 << 63) - 1


def whole(vector: Column) -> Column:
    """The vector's entries as whole numbers, or null if it is not fit for that."""
    entries = vector.cast("array<double>")
    fit = F.forall(entries, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) * STEPS <= float(1 << 53)), F.lit(False)))
    return F.when(fit & (F.size(entries) > 0), F.transform(entries, lambda c: F.floor(c * float(STEPS)) + F.lit(OFFSET).cast("long")))


def fit_rows(rows: DataFrame, vector: str = "embedding", held: str = "x") -> DataFrame:
    """The rows that can be whitened, with their whole numbers in the column `held`, written."""
    found = written(rows.withColumn(held, whole(rows[vector])).where(F.col(held).isNotNull()))
    lengths = found.groupBy(F.size(held).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    return found.where(F.size(held) == lengths[0]["d"]) if len(lengths) > 1 else found


@dataclass
class Whitening:
    """n rows with sums by dimension; components as rows of `axes`, by falling eigenvalue; the total variance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    eigenvalues: np.ndarray
    total: float


def column_sums(found: DataFrame, held: str = "x") -> tuple[int, list[int]]:
    """(rows, exact sums by dimension): partial sums from each task, of Python's integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := len(batch):
                x = batch.column(0).flatten().to_numpy().reshape(n, -1)
                high, low = x >> 32, x & 0xFFFFFFFF  # so that no sum of a batch leaves 64 bits
                sums = [(int(h) << 32) + int(w) for h, w in zip(high.sum(0), low.sum(0), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[Decimal(v) for v in sums]], pa.list_(pa.decimal128(38)))], names=["n", "sums"])

    parts = found.select(held).mapInArrow(run, "n long, sums array<decimal(38,0)>")
    by_place = parts.select("n", F.posexplode("sums").alias("place", "v")).groupBy("place").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).orderBy("place").collect()
    return (by_place[0]["n"] if by_place else 0), [int(r["v"]) for r in by_place]


def _sums(sums: list[int]) -> Column:
    return F.array(*[F.lit(Decimal(v)).cast("decimal(38,0)") for v in sums])


def with_deviation(found: DataFrame, n: int, sums: list[int], held: str = "x") -> DataFrame:
    """found with m (n times each entry less its dimension's sum) and deviation (the sum of the squares of m), both exact."""
    m = F.zip_with(held, _sums(sums), lambda x, s: F.try_subtract(F.lit(Decimal(n)).cast("decimal(20,0)") * x.cast("decimal(17,0)"), s).try_cast("long"))
    square = F.aggregate("m", F.lit(0).cast("decimal(38,0)"), lambda a, v: F.try_add(a, F.try_multiply(v.cast("decimal(19,0)"), v.cast("decimal(19,0)"))).try_cast("decimal(38,0)"))
    return found.withColumn("m", m).withColumn("deviation", square)


def _matrix(rows: DataFrame, vector: Column) -> RowMatrix:
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(vector).alias("v")), "v"))


def centred(n: int) -> Column:
    """A row less the mean: the exact numerators over n."""
    return F.transform("m", lambda v: v.cast("double") / float(n))


def fit(found: DataFrame, components: int = COMPONENTS, held: str = "x") -> tuple[Whitening | None, DataFrame]:
    """The whitening of all rows of `found`, and found with m and deviation; none without variance."""
    n, sums = column_sums(found, held)
    if not n:
        return None, found
    rows = written(with_deviation(found, n, sums, held))
    exact = rows.agg(F.sum(F.col("deviation")).alias("s"), F.count("deviation").alias("known"), F.sum(F.aggregate(centred(n), F.lit(0.0), lambda a, v: a + v * v)).alias("rough")).first()
    total = float(Fraction(int(exact["s"]), n**3)) if exact["known"] == n and exact["s"] is not None else exact["rough"] / n
    if not total:
        return None, rows
    svd = _matrix(rows, centred(n)).computeSVD(len(sums), computeU=False, rCond=LEAST_SINGULAR)
    singular, axes = np.array(svd.s.toArray()), np.array(svd.V.toArray()).T
    axes = axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return Whitening(n, sums, axes[:components], singular[:components] ** 2 / n, total), rows


def whiten(rows: DataFrame, by: Whitening, whitened: str = "whitened") -> DataFrame:
    """rows (with m) and the array of their whitened values, one for each component."""
    scaled = (by.axes / np.sqrt(by.eigenvalues)[:, None]).T / by.n
    kept = [c for c in rows.columns if c != whitened]
    at = kept.index("m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(at).flatten().to_numpy().reshape(len(batch), len(scaled)).astype(np.float64) @ scaled
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * scaled.shape[1]), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*kept, whitened])

    return rows.select(*kept).mapInArrow(run, T.StructType([*[rows.schema[c] for c in kept], T.StructField(whitened, T.ArrayType(T.DoubleType()))]))


def identity_error(rows: DataFrame, n: int, whitened: str = "whitened") -> float:
    """The largest entry by which the covariance of the whitened rows differs from the identity."""
    means = [r["v"] for r in rows.select(F.posexplode(whitened).alias("place", "v")).groupBy("place").agg(F.avg("v").alias("v")).orderBy("place").collect()]
    again = F.zip_with(whitened, F.array(*[F.lit(v) for v in means]), lambda a, b: a - b)
    gram = _matrix(rows, again).computeGramianMatrix().toArray()
    return float(np.abs(gram / n - np.eye(len(means))).max())


@scoped
def digest(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every fit row and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    by, found = fit(fit_rows(rows.select(rows["vec_id"].cast("long").alias("vec_id"), rows[vector].alias("vector")), "vector").select("vec_id", "x"), components)
    if by is None:
        return rows.sparkSession.createDataFrame([], schema)
    done = written(whiten(found, by).select("vec_id", F.when(F.col("deviation") <= LONG, F.col("deviation")).cast("long").alias("deviation"), "whitened"))
    error = identity_error(done, by.n)
    explained = F.array(*[F.lit(float(e / by.total)) for e in by.eigenvalues])
    each = done.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(by.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("place") + 1).alias("explained"), F.lit(error).alias("identity_error"))
