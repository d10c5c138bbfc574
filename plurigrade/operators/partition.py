"""Batches and chunks of cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plurigrade.sources.shared import shared_dir


#: Places that are handed to Spark at once.
SLICE = 4_000_000


def permutation(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """``cell_idx, pos``: a shuffle of ``0 .. n - 1`` by the legacy Mersenne Twister generator, which only the driver can run in order.

    The driver holds one number per place; slices of it go out as Arrow tables, more than one into the shared folder.
    """
    order = np.arange(n)
    np.random.RandomState(seed).shuffle(order)

    def part(a: int) -> DataFrame:
        own = order[a : a + SLICE]
        return spark.createDataFrame(pa.table({"cell_idx": own, "pos": np.arange(a, a + len(own))}))

    if n <= SLICE:
        return part(0) if n else spark.createDataFrame([], "cell_idx long, pos long")
    path = shared_dir(spark, "permutation")
    for a in range(0, n, SLICE):
        part(a).write.mode("append").parquet(path)
    return spark.read.schema("cell_idx long, pos long").parquet(path)


def permutations(spark: SparkSession, sizes: DataFrame, seed: int) -> DataFrame:
    """``n, cell_idx, pos``: the shuffle of every distinct number in column ``n``; batches of a split have two at most."""
    out = spark.createDataFrame([], "n long, cell_idx long, pos long")
    for n in sorted(r["n"] for r in sizes.select("n").distinct().collect()):
        out = out.unionByName(permutation(spark, n, seed).select(F.lit(n).cast("long").alias("n"), "cell_idx", "pos"))
    return out


def chunk_of(pos: Column, n: int | Column, chunks: int | Column) -> Column:
    """The chunk of a place when ``n`` places are split into so many, the first ``n % chunks`` of them one longer."""
    n, chunks = (x if isinstance(x, Column) else F.lit(x) for x in (n, chunks))
    base, more = F.floor(n / chunks), n % chunks
    edge = more * (base + 1)
    return F.when(pos < edge, F.floor(pos / (base + 1))).otherwise(more + F.floor((pos - edge) / F.greatest(base, F.lit(1)))).cast("int")


def parts_of(n: Column, size: Column | int, least: Column | int = 0) -> Column:
    """Parts of at most ``size`` places; one if there are fewer than ``least`` places or the size is above their number."""
    size, least = (x if isinstance(x, Column) else F.lit(x) for x in (size, least))
    return F.when((n < least) | (size > n), 1).otherwise(F.ceil(n / size)).cast("int")


def batch_count(n: int, size: int, least: int = 1000) -> int:
    """:func:`parts_of` of numbers."""
    return 1 if n < least or size > n else -(-n // size)


def batched(cells: DataFrame, n: int, size: int, seed: int, least: int = 1000) -> DataFrame:
    """``cells`` with ``batch``: shuffled before the split only if there is more than one batch."""
    count = batch_count(n, size, least)
    if count == 1:
        return cells.withColumn("batch", F.lit(0))
    return cells.join(permutation(cells.sparkSession, n, seed), "cell_idx").withColumn("batch", chunk_of(F.col("pos"), n, count)).drop("pos")
