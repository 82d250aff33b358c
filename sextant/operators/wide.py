"""Tables of many columns: products of all pairs of columns in one pass, correlations and principal components from them.

A plan has one node for any number of columns: each task multiplies its batches as matrices and gives a row for each column, and these
rows are added up, first in parts, then over all. What comes to the driver for components is a matrix of columns by columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators import kernels

#: Columns at most; a task holds the products of all pairs, 8 bytes each, and the driver does for components.
MOST_COLUMNS = 4096

#: Parts in which the tasks' products are added up first.
PARTS = 64


def products(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, n, sum, products): for each column by its place, over complete rows, the number of rows, the sum, and the sums of its products with every column.

    Values are taken less their column's mean, so that nothing is lost between large sums; a sum is therefore 0 but for rounding. Without
    a complete row there are no rows.
    """
    if not 0 < len(columns) <= MOST_COLUMNS:
        raise ValueError(f"{len(columns)} columns; from 1 to {MOST_COLUMNS} can be taken")
    whole = df.select(*(F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns))).dropna()
    means = np.array([0.0 if m is None else m for m in whole.agg(*(F.avg(c) for c in whole.columns)).first()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(len(means)), np.zeros((len(means), len(means)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - means
            n, total, square = n + len(x), total + x.sum(axis=0), square + x.T @ x
        if n:
            rows = pa.FixedSizeListArray.from_arrays(pa.array(square.ravel()), len(means)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(means)), pa.int32()), pa.array([n] * len(means), pa.int64()), pa.array(total), rows], names=["i", "n", "sum", "products"])

    def add(rows: pa.Table) -> pa.Table:
        together = np.add.reduce([np.asarray(x) for x in rows["products"].to_pylist()])
        return pa.table({"i": rows["i"][:1], "n": pa.array([sum(rows["n"].to_pylist())], pa.int64()), "sum": pa.array([float(rows["sum"].to_numpy().sum())]), "products": pa.array([together.tolist()], pa.list_(pa.float64()))})

    fields = "i int, n long, sum double, products array<double>"
    each = whole.mapInArrow(run, fields).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    return each.groupBy("i", "part").applyInArrow(add, fields).groupBy("i").applyInArrow(add, fields)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, r): the correlation of every two columns over complete rows, both ways round; null with a constant."""
    found = products(df, columns)
    name = lambda i: F.element_at(F.array(*(F.lit(c) for c in columns)), F.col(i) + 1)
    long = found.select("i", "n", "sum", F.posexplode("products").alias("j", "xy"))
    # a row for each column
    own = found.select("i", F.col("sum").alias("s"), F.get("products", "i").alias("xx"))
    long = long.join(F.broadcast(own.drop("s").withColumnRenamed("xx", "xi")), "i").join(F.broadcast(own.select(F.col("i").alias("j"), F.col("s").alias("sj"), F.col("xx").alias("xj"))), "j")
    less = lambda p, a, b: F.col(p) - F.col(a) * F.col(b) / F.col("n")
    spread = F.sqrt(less("xi", "sum", "sum")) * F.sqrt(less("xj", "sj", "sj"))
    return long.select(name("i").alias("a"), name("j").alias("b"), "n", F.try_divide(less("xy", "sum", "sj"), spread).alias("r"))


def principal_components(df: DataFrame, columns: list[str], components: int = 5) -> DataFrame:
    """(component, eigenvalue, ratio, column, loading) of the standardised columns: at most ``components``, from 1, of the largest eigenvalues.

    Each component's largest loading is positive. Constants load nothing. Fewer than two complete rows have no components.
    """
    found = sorted(products(df, columns).collect(), key=lambda r: r.i)
    rows = []
    if found and found[0].n > 1:
        got = kernels.pca(found[0].n, np.array([r["sum"] for r in found]), np.array([r.products for r in found]), components)
        rows = [(k, e, ratio, c, w) for k, (e, ratio, loads) in enumerate(zip(got["eigenvalues"], got["ratios"], got["loadings"], strict=True), 1) for c, w in zip(columns, loads, strict=True)]
    return df.sparkSession.createDataFrame(rows, "component int, eigenvalue double, ratio double, column string, loading double")
