"""Rank binning inside each category, labels, relative scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plurigrade.functions.scalars import category_label, min_max, or_null
from plurigrade.settings import CATEGORIES

#: Fixed value: what is kept free at either end of an interval.
MARGIN = 1e-8


def rank_binned(scores: DataFrame, classes: int = len(CATEGORIES)) -> DataFrame:
    """``scores`` (batch, cell_id, category, smooth) with ``binned``: each category's cells, in order of ``smooth`` and id, spread
    evenly over the category's interval less a margin.  A category of one cell has no spread and gives null.
    """
    inside = Window.partitionBy("batch", "category")
    at = F.row_number().over(inside.orderBy("smooth", "cell_id")) - 1
    n = F.count("*").over(inside)
    low = F.col("category") / classes + MARGIN
    high = (F.col("category") + 1) / classes - MARGIN
    return scores.select("*", F.when(n > 1, low + at * ((high - low) / (n - 1))).alias("binned"))


def labelled(scores: DataFrame, column: str, name: str = "label") -> DataFrame:
    return scores.withColumn(name, category_label(F.col(column)))


def relative(scores: DataFrame, column: str = "score", name: str = "relative") -> DataFrame:
    """The score on the scale from the least to the greatest of all cells, missing ones left out.

    The range is one row, aggregated partially and joined; the one statistic across batches.
    """
    span = scores.agg(F.min(or_null(F.col(column))).alias("__low"), F.max(or_null(F.col(column))).alias("__high"))
    return scores.crossJoin(F.broadcast(span)).withColumn(name, min_max(or_null(F.col(column)), F.col("__low"), F.col("__high"))).drop("__low", "__high")
