"""Comparison of two result tables, cell by cell, with missing values told apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurigrade.sources.shared import running

NUMBERS = ("score", "relative", "preknn_score")
LABELS = ("potency", "preknn_potency")


def compared(a: DataFrame, b: DataFrame, key: str = "cell_id", numbers: tuple[str, ...] = NUMBERS, labels: tuple[str, ...] = LABELS, atol: float = 1e-6, rtol: float = 0.0) -> DataFrame:
    """One row per compared column: ``name, n, n_missing_a, n_missing_b, n_mask_mismatch, n_outside, max_abs_delta, mean_delta, n_mismatch``.

    One inner join on the cell id and one aggregate: only cells of both tables are compared, the others are counted by
    :func:`identity`.  An id that stands twice in either table fails the comparison.
    """
    if atol < 0 or rtol < 0:
        raise ValueError("tolerances must not be negative")
    left = a.select(F.col(key), *(F.col(c).alias(f"a_{c}") for c in (*numbers, *labels)))
    right = b.select(F.col(key), *(F.col(c).alias(f"b_{c}") for c in (*numbers, *labels)))
    both = left.join(right, key)

    def number(c: str) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        d = y - x
        return F.struct(
            F.lit(c).alias("name"),
            F.count(d).alias("n"),
            F.count_if(x.isNull()).alias("n_missing_a"),
            F.count_if(y.isNull()).alias("n_missing_b"),
            F.count_if(x.isNull() != y.isNull()).alias("n_mask_mismatch"),
            F.count_if(F.abs(d) > atol + rtol * F.abs(x)).alias("n_outside"),
            F.max(F.abs(d)).alias("max_abs_delta"),
            F.avg(d).alias("mean_delta"),
            F.lit(None).cast("long").alias("n_mismatch"),
        )

    def label(c: str) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        none = F.lit(None)
        return F.struct(
            F.lit(c).alias("name"),
            F.count("*").alias("n"),
            F.count_if(x.isNull()).alias("n_missing_a"),
            F.count_if(y.isNull()).alias("n_missing_b"),
            F.count_if(x.isNull() != y.isNull()).alias("n_mask_mismatch"),
            none.cast("long").alias("n_outside"),
            none.cast("double").alias("max_abs_delta"),
            none.cast("double").alias("mean_delta"),
            F.count_if(~x.eqNullSafe(y)).alias("n_mismatch"),
        )

    single = F.count("*") == F.count_distinct(F.col(key))
    rows = both.agg(F.when(single, F.array(*map(number, numbers), *map(label, labels))).otherwise(F.raise_error(F.lit("a cell id stands twice"))).alias("rows"))
    return rows.select(F.explode("rows").alias("r")).select("r.*")


def identity(a: DataFrame, b: DataFrame, key: str = "cell_id") -> DataFrame:
    """``n_a, n_b, n_both``: cells of either table and of both."""
    flags = a.select(key, F.lit(1).alias("a")).join(b.select(key, F.lit(1).alias("b")), key, "full_outer")
    return flags.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"))


def only_in(a: DataFrame, b: DataFrame, key: str = "cell_id") -> DataFrame:
    """``cell_id, side`` of cells that one table alone has."""
    return a.join(b, key, "left_anti").select(key, F.lit("a").alias("side")).unionByName(b.join(a, key, "left_anti").select(key, F.lit("b").alias("side")))


def average_ranks(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``df`` with ``r_<column>``, the ascending average rank, from a running total over one row per distinct value."""
    for c in columns:
        counts = running(df.groupBy(c).agg(F.count("*").alias("n")), [c], F.col("n"))
        df = df.join(counts.select(c, (F.col("before") + (F.col("n") + 1) / 2).alias(f"r_{c}")), c)
    return df


def spearman(a: DataFrame, b: DataFrame, column: str, key: str = "cell_id") -> DataFrame:
    """``rho`` of the cells that have both numbers; null if there are fewer than two or one side is constant."""
    pairs = a.select(key, F.col(column).alias("x")).join(b.select(key, F.col(column).alias("y")), key).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    ranked = average_ranks(pairs, ("x", "y"))
    spread = F.try_divide(F.covar_pop("r_x", "r_y"), F.stddev_pop("r_x") * F.stddev_pop("r_y"))
    return ranked.agg(F.when((F.count("*") > 1) & spread.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), spread))).alias("rho"))


def verdict(metrics: DataFrame, same_cells: bool) -> bool:
    """Whether nothing differs: the cells, the masks, the numbers within tolerance, the labels."""
    clean = [F.coalesce(F.col(c), F.lit(0)) == 0 for c in ("n_mask_mismatch", "n_outside", "n_mismatch")]
    return same_cells and metrics.where(~reduce(lambda p, q: p & q, clean) | (F.col("n") == 0)).isEmpty()


def file_digests(df: DataFrame) -> DataFrame:
    """``path, sha256`` of rows of the binary file source, which leaves empty files out."""
    return df.select("path", F.sha2("content", 256).alias("sha256"))
