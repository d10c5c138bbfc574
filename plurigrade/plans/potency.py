"""The whole scoring run as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plurigrade.functions.scalars import category_label
from plurigrade.operators import binning, diffusion, ensemble, features, mapping, neighbours, normalise, partition
from plurigrade.settings import CATEGORIES, Settings
from plurigrade.sources.shared import running, settled
from plurigrade.sources.sinks import Stages


def named(index) -> F.Column:
    return F.get(F.array(*map(F.lit, CATEGORIES)), index)


def score(expr: DataFrame, feature: DataFrame, model: dict[str, DataFrame], sets: int, settings: Settings | None = None, stages: Stages | None = None, cells: DataFrame | None = None) -> DataFrame:
    """``cell_idx, cell_id, score, potency, relative, preknn_score, preknn_potency`` of every cell.

    ``cells(cell_idx, cell_id)`` gives the cells and their order; without it they are those of ``expr`` in order of id.

    ``expr(cell_id, feature, value)`` with mapped names, ``feature(feature, feature_idx)``, and the model's tables
    ``geneset, background, head, weight``.  Cells whose values add up to zero fail the run.  Each batch has its own
    dispersion, diffusion, binning and smoothing; only the relative score spans batches.
    """
    settings, stages = settings or Settings(), stages or Stages()
    n_features = feature.count()
    sparse = stages.keep("aligned", mapping.aligned(expr, feature))
    ids = stages.keep("ids", cells.select("cell_id") if cells is not None else expr.select("cell_id").distinct())
    if not (bare := normalise.without_total(ids, sparse)).isEmpty():
        raise ValueError(f"cell {bare.first()[0]!r} has no expression")
    n = ids.count()
    placed = cells.select(F.col("cell_idx").cast("long").alias("cell_idx"), "cell_id") if cells is not None else running(ids, ["cell_id"], name="cell_idx")
    cells = partition.batched(placed, n, settings.batch_size, settings.seed, settings.least_for_batches)
    cells = stages.keep("cells", cells.select("cell_id", "cell_idx", "batch"))
    # The batch joins where rows lie by cell already, and every later step reads it from the stage.
    normal = stages.keep("normalised", normalise.normalised(sparse, n_features).join(cells.select("cell_id", "batch"), "cell_id"))
    predicted = stages.keep("predicted", ensemble.predictions(normal, model["geneset"], model["background"], model["head"], model["weight"], n_features, sets))
    # The least and greatest score are needed before any row is final.
    final = binning.relative(stages.keep("scored", _scored(cells, normal, predicted, feature, n_features, settings, stages)))
    return final.select("cell_idx", "cell_id", "score", category_label(F.col("score")).alias("potency"), "relative", F.col("binned").alias("preknn_score"), named(F.col("category")).alias("preknn_potency"))


def _scored(cells: DataFrame, own: DataFrame, predicted: DataFrame, feature: DataFrame, n_features: int, settings: Settings, stages: Stages) -> DataFrame:
    """``cell_idx, cell_id, category, binned, score`` of all batches in one plan; ``batch`` is a column all the way."""
    # One row per batch of thousands of cells.
    sizes = stages.keep("sizes", cells.groupBy("batch").agg(F.count("*").alias("n")))
    width = min(settings.top_features, n_features)
    top = features.batch_top_dispersed(features.batch_dispersion(own, feature, sizes), width)
    # A batch has a bounded number of cells, so one task may number them.
    numbered = cells.join(F.broadcast(sizes), "batch").withColumn("at_batch", (F.row_number().over(Window.partitionBy("batch").orderBy("cell_idx")) - 1).cast("long"))
    order = partition.permutations(cells.sparkSession, sizes, settings.seed).withColumnRenamed("cell_idx", "at_batch")
    chunked = numbered.join(order, ["n", "at_batch"]).withColumn("chunk", partition.chunk_of(F.col("pos"), F.col("n"), partition.parts_of(F.col("n"), settings.smooth_batch_size)))
    scored = chunked.join(predicted.select("cell_id", F.col("order_score").cast("float").cast("double").alias("score"), "category"), "cell_id")
    graph = scored.join(diffusion.batch_sparse_vectors(own, top), "cell_id", "left")
    smooth = diffusion.diffused(graph.select("batch", "chunk", "cell_id", "score", "at", "lg"), width)
    binned = binning.rank_binned(scored.select("batch", "n", "cell_id", "cell_idx", "category").join(smooth.select("cell_id", "smooth"), "cell_id"))
    binned = stages.keep("binned", binned.select("batch", "n", "cell_idx", "cell_id", "category", "binned"))
    small = F.col("n") < settings.least_for_smoothing
    alone = binned.where(small).withColumn("score", F.col("binned"))
    large = sizes.where(~small).select("batch")
    rows = own.join(F.broadcast(large), "batch").groupBy("batch", "cell_id").agg(F.collect_list("feature_idx").alias("at"), F.collect_list("lg").alias("lg"))
    embed = _embedded(rows, own, sizes, n_features, settings)
    near = neighbours.knn_smoothed(embed.join(binned.where(~small).select("cell_id", F.col("binned").alias("score")), "cell_id"), settings.neighbours)
    smoothed = binned.where(~small).join(near.select("cell_id", "score"), "cell_id")
    return smoothed.unionByName(alone).select("cell_idx", "cell_id", "category", "binned", "score")


def _embedded(rows: DataFrame, own: DataFrame, sizes: DataFrame, n_features: int, settings: Settings) -> DataFrame:
    """The batches' embeddings, each by one task; only batches that no task can hold are gone through one by one."""
    most = sizes.agg(F.max("n")).first()[0] or 0
    entries = own.groupBy("batch").agg(F.count("*").alias("entries")).where(F.col("entries") > neighbours.TASK_ENTRIES)
    too_large = [r["batch"] for r in entries.collect()] if most * n_features > neighbours.TASK_ENTRIES else []
    if not too_large:
        return neighbours.embedded(rows, n_features, settings.components, settings.seed)
    # Every pass of the process reads the rows again, so they are settled first.
    held = settled(rows, "rows")
    out = neighbours.embedded(held.where(~F.col("batch").isin(too_large)), n_features, settings.components, settings.seed)
    for batch in too_large:
        part = neighbours.embedded_at_large(held.where(F.col("batch") == batch), n_features, settings.components, settings.seed)
        out = out.unionByName(part.select(F.lit(batch).alias("batch"), "cell_id", "x"))
    return out
