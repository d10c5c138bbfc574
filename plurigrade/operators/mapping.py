"""Feature names: aliases, orthologs, alignment to the feature list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def alias_names(names: DataFrame, alias: DataFrame, features: DataFrame) -> DataFrame:
    """``name, mapped``: a name that is no feature becomes its alias target, unless the target is among the names already.

    ``names(name)``, ``alias(alias, target)``, ``features(feature)``.  Small sides are left to Catalyst to broadcast by size.
    """
    known = features.select(F.col("feature").alias("name"), F.lit(True).alias("is_feature"))
    present = names.select(F.col("name").alias("target"), F.lit(True).alias("taken")).distinct()
    targets = alias.select(F.col("alias").alias("name"), "target").join(present, "target", "left")
    joined = names.join(known, "name", "left").join(targets, "name", "left")
    use = F.col("is_feature").isNull() & F.col("target").isNotNull() & F.col("taken").isNull()
    return joined.select("name", F.when(use, F.col("target")).otherwise(F.col("name")).alias("mapped"))


def ortholog_names(names: DataFrame, orthologs: DataFrame, alias: DataFrame) -> DataFrame:
    """``gene_idx, name, mapped``: the ortholog, else the alias, else none; of names with one target the first in the input stays.

    ``names(gene_idx, name)``, ``orthologs(name, ortholog)``, ``alias(alias, target)``.
    """
    joined = names.join(orthologs, "name", "left").join(alias.select(F.col("alias").alias("name"), "target"), "name", "left")
    mapped = joined.select("gene_idx", "name", F.coalesce("ortholog", "target").alias("mapped")).where(F.col("mapped").isNotNull())
    order = Window.partitionBy("mapped").orderBy("gene_idx")
    return mapped.withColumn("at", F.row_number().over(order)).where("at = 1").drop("at")


def double_top_hits(pairs: DataFrame) -> DataFrame:
    """``human, mouse``: the best pair of each human gene by ``id1``, then of each mouse gene by ``id2``; ties by name.

    ``max_by`` keeps one row per gene before the shuffle, so a gene with very many candidates is no hot key.
    """
    best = pairs.groupBy("human").agg(F.min(F.struct((-F.col("id1")).alias("less"), "mouse", "id2")).alias("b")).select("human", "b.mouse", "b.id2")
    return best.groupBy("mouse").agg(F.min(F.struct((-F.col("id2")).alias("less"), "human")).alias("b")).select("b.human", "mouse")


def aligned(expr: DataFrame, features: DataFrame, strict: bool = True) -> DataFrame:
    """``cell_id, feature_idx, value`` of the features only; absent ones are implicit zeros.

    Two inputs of one cell that map to one feature are an error if ``strict``.
    """
    kept = expr.join(features, "feature").select("cell_id", "feature_idx", "value").where("value <> 0")
    if not strict:
        return kept
    summed = kept.groupBy("cell_id", "feature_idx").agg(F.first("value").alias("value"), F.count("*").alias("n"))
    fails = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two inputs map to feature "), F.col("feature_idx").cast("string")))).otherwise(F.lit(True))
    return summed.where(fails).select("cell_id", "feature_idx", "value")


def coverage(names: DataFrame, features: DataFrame) -> DataFrame:
    """``n_present``: how many features are among the names."""
    return features.join(names.select(F.col("name").alias("feature")), "feature", "left_semi").agg(F.count("*").alias("n_present"))


def feature_list(expr: DataFrame) -> DataFrame:
    """``feature, feature_idx``: the features in order of name, numbered from 0."""
    names = expr.select("feature").distinct()
    # One row per feature name, whatever the number of cells, so one task may number them.
    return names.select("feature", (F.row_number().over(Window.orderBy("feature")) - 1).cast("int").alias("feature_idx"))
