"""Dispersion of features and the most dispersed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _spread(stored, count, mean, variance, low, high):
    """Variance over mean of ``count`` values, of which ``stored`` have this mean and population variance and the others are 0."""
    share = stored / count
    whole = share * mean
    equal = stored.isNull() | ((stored == count) & (low == high)) | (whole == 0)
    # The variance of the two groups and that between them: nothing cancels, so it is never below 0.
    return F.when(equal, 0.0).otherwise((share * variance + share * (1 - share) * mean * mean) / whole)


def _sums(lg: DataFrame, *keys: str) -> DataFrame:
    return lg.groupBy(*keys).agg(F.count("*").cast("double").alias("stored"), F.avg("lg").alias("mean"), F.var_pop("lg").alias("variance"), F.min("lg").alias("low"), F.max("lg").alias("high"))


def dispersion(lg: DataFrame, features: DataFrame, n_cells: int) -> DataFrame:
    """``feature_idx, disp``: population variance over mean across all cells, implicit zeros included; 0 if all are equal.

    One partially aggregated pass over the stored entries.
    """
    joined = features.select("feature_idx").join(_sums(lg, "feature_idx"), "feature_idx", "left")
    return joined.select("feature_idx", _spread(F.col("stored"), F.lit(float(n_cells)), F.col("mean"), F.col("variance"), F.col("low"), F.col("high")).alias("disp"))


def batch_dispersion(lg: DataFrame, features: DataFrame, sizes: DataFrame) -> DataFrame:
    """``batch, feature_idx, disp`` of every feature in every batch; ``lg`` has ``batch``, and ``sizes(batch, n)`` is broadcast: one row per batch."""
    every = features.select("feature_idx").crossJoin(F.broadcast(sizes.select("batch", "n")))
    joined = every.join(_sums(lg, "batch", "feature_idx"), ["batch", "feature_idx"], "left")
    return joined.select("batch", "feature_idx", _spread(F.col("stored"), F.col("n").cast("double"), F.col("mean"), F.col("variance"), F.col("low"), F.col("high")).alias("disp"))


def top_dispersed(disp: DataFrame, k: int) -> DataFrame:
    """``feature_idx, disp`` of the ``k`` most dispersed features; ties by number."""
    return disp.orderBy(F.round("disp", 9).desc(), "feature_idx").limit(k)


def batch_top_dispersed(disp: DataFrame, k: int) -> DataFrame:
    """``batch, feature_idx, at``: the ``k`` most dispersed features of each batch, ``at`` their place in order of number."""
    own = Window.partitionBy("batch")
    ranked = disp.withColumn("__rank", F.row_number().over(own.orderBy(F.round("disp", 9).desc(), "feature_idx"))).where(F.col("__rank") <= k)
    return ranked.select("batch", "feature_idx", (F.row_number().over(own.orderBy("feature_idx")) - 1).cast("int").alias("at"))
