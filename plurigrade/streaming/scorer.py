"""Micro-batch scoring of arriving cells up to the ensemble's score: the stages that need no other cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plurigrade.functions.scalars import category_label
from plurigrade.operators import ensemble, normalise


def score_cells(expr: DataFrame, features: DataFrame, model: dict[str, DataFrame], sets: int, n: int | None = None, own: ensemble.Kernel | Broadcast | None = None) -> DataFrame:
    """``cell_id, preknn_score, preknn_potency`` of complete cells (cell_id, feature, value); the number of features and the kernel may be given."""
    n = features.count() if n is None else n
    sparse = expr.join(features, "feature").select("cell_id", "feature_idx", "value")
    out = ensemble.predictions(normalise.normalised(sparse, n), model["geneset"], model["background"], model["head"], model["weight"], n, sets, own)
    return out.select("cell_id", F.col("order_score").alias("preknn_score"), category_label(F.col("order_score")).alias("preknn_potency"))


def start(stream: DataFrame, features: DataFrame, model: dict[str, DataFrame], sets: int, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Score each micro-batch (whole cells in a batch) and hand the rows to ``sink`` with the batch's number, which makes retries idempotent.

    The model is counted, packed and broadcast once, before the first batch.
    """
    n = features.count()
    own = ensemble.kernel(model["geneset"], model["background"], model["head"], model["weight"], n)
    shared = stream.sparkSession.sparkContext.broadcast(own) if own else None
    run = lambda df, number: sink(score_cells(df, features, model, sets, n, shared), number)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
