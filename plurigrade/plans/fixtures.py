"""Inputs of the registered queries, made from the driver's tables: an expression matrix, gene sets, name maps, score tables.

Whatever is synthetic follows from integer arithmetic on indexes, so that SQL can make the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurigrade.operators import mapping

MODELS, LAYERS, SETS = 3, 6, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cell_id, feature, value``: quantity per supplier and brand with size."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("_", "p_brand", F.col("p_size").cast("string")).alias("feature"))
    joined = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("l_suppkey").alias("cell_id"), "feature").agg(F.sum("l_quantity").alias("value"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``feature, feature_idx`` of all parts that were sold."""
    return mapping.feature_list(expression(spark, sf_dir))


def sparse(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """The aligned matrix, its features, and how many."""
    expr = expression(spark, sf_dir)
    listed = mapping.feature_list(expr)
    return mapping.aligned(expr, listed, strict=False), listed, listed.count()


def model(spark: SparkSession, listed: DataFrame) -> dict[str, DataFrame]:
    """``geneset, head, weight, background`` of a small ensemble."""
    heads = spark.range(MODELS).select(F.col("id").cast("int").alias("model")).crossJoin(spark.range(LAYERS).select(F.col("id").cast("int").alias("layer")))
    sets = heads.crossJoin(spark.range(SETS).select(F.col("id").cast("int").alias("k")))
    member = (F.col("feature_idx") * 31 + F.col("k") * 17 + F.col("layer") * 7 + F.col("model") * 13) % 10 < 3
    index = listed.select("feature_idx")
    pairs = index.select(F.col("feature_idx").alias("r")).crossJoin(index.select(F.col("feature_idx").alias("c")))
    terms = heads.crossJoin(spark.range(2 * SETS).select(F.col("id").cast("int").alias("j")))
    return {
        "geneset": index.crossJoin(F.broadcast(sets)).where(member).select("model", "layer", "k", "feature_idx"),
        "background": pairs.where((F.col("r") * 7 + F.col("c") * 11) % 97 == 0).select("r", "c", ((1 + (F.col("r") + F.col("c")) % 5) / 10.0).alias("v")),
        "head": heads.select("model", "layer", ((F.col("model") * 6 + F.col("layer")) % 5 / 10.0).alias("maxrank"), ((F.col("layer") - 2.5) * 0.1).alias("bias")),
        "weight": terms.select("model", "layer", "j", (F.col("j") % 5 * 0.1).alias("rm"), (0.5 + F.col("j") % 3 * 0.25).alias("rv"), (((F.col("j") * 7 + F.col("layer") * 3 + F.col("model")) % 11 - 5) / 10.0).alias("ow")),
    }


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cell_id, category, smooth, score``: events as scored cells; one category holds a single cell, one score in fifty is missing."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("cell_id"), F.col("value"))
    span = e.agg(F.min("value").alias("low"), F.max("value").alias("high"))
    scaled = e.crossJoin(F.broadcast(span)).select("cell_id", ((F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))).alias("smooth"))
    category = F.when(F.col("cell_id") == 7, 5).otherwise(F.col("cell_id") % 5).cast("int")
    return scaled.select("cell_id", category.alias("category"), "smooth", F.when(F.col("cell_id") % 50 != 3, F.col("smooth")).alias("score"))


def results(spark: SparkSession, sf_dir: str, shift: bool) -> DataFrame:
    """``cell_id, score, relative, preknn_score, potency, preknn_potency``: a result table, or one that differs from it here and there."""
    base = scores(spark, sf_dir)
    moved = F.when(F.col("cell_id") % 11 == 0, F.col("score") + F.col("cell_id") % 3 * 0.25).otherwise(F.col("score")) if shift else F.col("score")
    named = F.concat(F.lit("class "), (F.col("category") + F.when(F.lit(shift) & (F.col("cell_id") % 13 == 0), 1).otherwise(0)).cast("string"))
    rows = base.select("cell_id", moved.alias("score"), F.col("smooth").alias("relative"), (F.col("smooth") * 0.5).alias("preknn_score"), named.alias("potency"), F.concat(F.lit("class "), F.col("category").cast("string")).alias("preknn_potency"))
    return rows.where(F.col("cell_id") % 101 != (5 if shift else 6))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cell_id, x, s``: the embedding vectors as doubles with a score from their label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("x"), ((F.col("label") + 0.5) / 10.0 * 0.9 + F.col("vec_id") % 7 * 0.01).alias("s"))


def large_model(spark: SparkSession, n_features: int = 14_271, models: int = 19, layers: int = 6, sets: int = 24) -> dict[str, DataFrame]:
    """The tables of :func:`model` in the size that is published: about 3 % of the features in each set, 20 graph neighbours each."""
    heads = spark.range(models).select(F.col("id").cast("int").alias("model")).crossJoin(spark.range(layers).select(F.col("id").cast("int").alias("layer")))
    keyed = heads.crossJoin(spark.range(sets).select(F.col("id").cast("int").alias("k")))
    index = spark.range(n_features).select(F.col("id").cast("int").alias("feature_idx"))
    terms = heads.crossJoin(spark.range(2 * sets).select(F.col("id").cast("int").alias("j")))
    near = spark.range(n_features).crossJoin(spark.range(20).select(F.col("id").alias("d")))
    return {
        "geneset": index.crossJoin(F.broadcast(keyed)).where(F.pmod(F.xxhash64("model", "layer", "k", "feature_idx"), F.lit(100)) < 3),
        "background": near.select(F.col("id").cast("int").alias("r"), F.pmod(F.col("id") * 31 + F.col("d") * 997, F.lit(n_features)).cast("int").alias("c"), (0.1 + F.col("d") % 5 / 10).alias("v")),
        "head": heads.select("model", "layer", ((F.col("model") * 6 + F.col("layer")) % 5 / 10.0).alias("maxrank"), ((F.col("layer") - 2.5) * 0.1).alias("bias")),
        "weight": terms.select("model", "layer", "j", (F.col("j") % 5 * 0.1).alias("rm"), (0.5 + F.col("j") % 3 * 0.25).alias("rv"), (((F.col("j") * 7 + F.col("layer") * 3 + F.col("model")) % 11 - 5) / 10.0).alias("ow")),
    }


def large_matrix(spark: SparkSession, cells: int, n_features: int = 14_271, entries: int = 2_000) -> DataFrame:
    """``cell_id, feature_idx, value`` of so many cells with about so many stored entries each."""
    pairs = spark.range(0, cells, 1, max(8, cells // 200)).select(F.col("id").alias("cell_id"), F.explode(F.sequence(F.lit(0), F.lit(n_features - 1))).alias("feature_idx"))
    h = F.xxhash64("cell_id", "feature_idx")
    return pairs.where(F.pmod(h, F.lit(n_features)) < entries).select("cell_id", F.col("feature_idx").cast("int").alias("feature_idx"), (1 + F.pmod(F.shiftright(h, 20), F.lit(50))).cast("double").alias("value"))
