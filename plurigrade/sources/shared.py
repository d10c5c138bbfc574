"""Tables settled in the folder that the cluster shares, and running totals over all rows of a table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, or under a folder of our own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{(root or 'file:///tmp/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: what was not deterministic stays as it came, and lineage ends."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: list[str], weight: Column | None = None, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``weight`` (1 by default) over all rows that come before in the order.

    Rows are range-partitioned and summed inside their partition; only the partitions' totals, one row each, meet in a task.
    """
    weight = F.lit(1).cast("long") if weight is None else weight
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__weight": weight, "__at": F.monotonically_increasing_id()})
    laid = settled(laid, "running").withColumn("__part", F.shiftright("__at", 33))
    totals = laid.groupBy("__part").agg(F.sum("__weight").alias("__total"))
    offsets = totals.select("__part", (F.sum("__total").over(Window.orderBy("__part")) - F.col("__total")).alias("__offset"))
    inside = F.sum("__weight").over(Window.partitionBy("__part").orderBy("__at")) - F.col("__weight")
    return laid.withColumn("__inside", inside).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__offset") + F.col("__inside")).drop("__part", "__at", "__weight", "__inside", "__offset")
