"""Per-cell normalisation over a sparse matrix whose zeros are implicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalised(expr: DataFrame, n_features: int) -> DataFrame:
    """``cell_id, feature_idx, value, lg, rk, zero_rank``: log2 of counts per million plus 1, and average descending rank.

    One shuffle by cell serves the total, the ranks and the counts.  Ranks run over all ``n_features``: the stored values
    are ranked, and the zeros form one tie between the positive and the negative ones.
    """
    cell = Window.partitionBy("cell_id")
    falling = cell.orderBy(F.col("value").desc())
    rows = expr.where("value <> 0").select(
        "cell_id",
        "feature_idx",
        "value",
        F.sum("value").over(cell).alias("total"),
        F.rank().over(falling).alias("first"),
        F.count("*").over(Window.partitionBy("cell_id", "value")).alias("ties"),
        F.count("*").over(cell).alias("stored"),
        F.count_if(F.col("value") > 0).over(cell).alias("positive"),
    )
    zeros = F.lit(n_features) - F.col("stored")
    return rows.select(
        "cell_id",
        "feature_idx",
        "value",
        F.log2(F.col("value") * 1e6 / F.nullif("total", F.lit(0.0)) + 1).alias("lg"),
        (F.col("first") + (F.col("ties") - 1) / 2 + F.when(F.col("value") < 0, zeros).otherwise(0)).alias("rk"),
        (F.col("positive") + (zeros + 1) / 2).alias("zero_rank"),
    )


def without_total(cells: DataFrame, expr: DataFrame) -> DataFrame:
    """The cells whose values add up to zero: their logarithms are missing, so a run must not go on with them."""
    totals = expr.groupBy("cell_id").agg(F.sum("value").alias("total"))
    return cells.select("cell_id").distinct().join(totals, "cell_id", "left").where(F.coalesce("total", F.lit(0.0)) == 0).select("cell_id")


def dense(cells: DataFrame, features: DataFrame, sparse: DataFrame) -> DataFrame:
    """Every pair of cell and feature with ``sparse``'s columns: what a dense result has; only for results that are wanted so."""
    pairs = cells.select("cell_id").crossJoin(F.broadcast(features.select("feature_idx")))
    return pairs.join(sparse, ["cell_id", "feature_idx"], "left")


def row_statistics(lg: DataFrame, n_features: int) -> DataFrame:
    """``cell_id, mean, sd`` (population) of each cell over all features; null ``sd`` for a constant row.

    The stored entries' own mean and variance are combined with the zeros in closed form, so that nothing cancels.
    """
    n = F.lit(float(n_features))
    own = lg.groupBy("cell_id").agg(F.count("*").alias("stored"), F.avg("lg").alias("own"), F.var_pop("lg").alias("variance"), F.min("lg").alias("low"), F.max("lg").alias("high"))
    share = F.col("stored") / n
    constant = (F.col("low") == F.col("high")) & ((F.col("stored") == n_features) | (F.col("low") == 0))
    spread = F.sqrt(share * F.col("variance") + share * (1 - share) * F.col("own") * F.col("own"))
    return own.select("cell_id", (share * F.col("own")).alias("mean"), F.when(~constant, F.nullif(spread, F.lit(0.0))).alias("sd"))


def row_zscores(lg: DataFrame, n_features: int) -> DataFrame:
    """``cell_id, feature_idx, z`` of the stored entries; an implicit zero is ``-mean / sd``."""
    stats = row_statistics(lg, n_features)
    return lg.join(stats, "cell_id").select("cell_id", "feature_idx", ((F.col("lg") - F.col("mean")) / F.col("sd")).alias("z"), (-F.col("mean") / F.col("sd")).alias("zero_z"))


def column_means(values: DataFrame, column: str, n_cells: int) -> DataFrame:
    """``feature_idx, mean`` over all cells, implicit zeros included."""
    return values.groupBy("feature_idx").agg((F.sum(column) / F.lit(float(n_cells))).alias("mean"))


def centred(values: DataFrame, column: str, n_cells: int) -> DataFrame:
    """``cell_id, feature_idx, centred`` of the stored entries; an implicit zero is ``-mean``."""
    return values.join(column_means(values, column, n_cells), "feature_idx").select("cell_id", "feature_idx", (F.col(column) - F.col("mean")).alias("centred"))


def low_counts(lg: DataFrame, cells: DataFrame, least: int = 500, share: float = 0.2) -> DataFrame:
    """``n_cells, n_low, warn``: cells with fewer than ``least`` expressed features, and whether they are too large a share."""
    counts = lg.groupBy("cell_id").agg(F.count_if(F.col("lg") > 0).alias("n"))
    per = cells.select("cell_id").distinct().join(counts, "cell_id", "left")
    sums = per.agg(F.count("*").alias("n_cells"), F.count_if(F.coalesce("n", F.lit(0)) < least).alias("n_low"))
    return sums.select("n_cells", "n_low", (F.try_divide("n_low", "n_cells") >= share).alias("warn"))


def looks_logged(expr: DataFrame, limit: float = 20.0) -> DataFrame:
    """``top, warn``: the largest value (missing ones skipped, 0 at least) and whether the table looks log-transformed already."""
    top = F.greatest(F.coalesce(F.max(F.when(~F.isnan("value"), F.col("value"))), F.lit(0.0)), F.lit(0.0))
    return expr.agg(top.alias("top")).select("top", (F.col("top") <= limit).alias("warn"))
