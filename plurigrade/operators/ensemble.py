"""The ensemble of gene-set models.

Tables: ``geneset(model, layer, k, feature_idx)`` holds set members; ``head(model, layer, maxrank, bias)`` and
``weight(model, layer, j, rm, rv, ow)`` the heads over ``2 * sets`` measures, rank scores first; ``background(r, c, v)`` a
feature graph.  The measures exist in two forms that agree: DataFrame joins, and a kernel that multiplies batches of cells
with set matrices of a checked size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plurigrade.functions.scalars import first_largest, order_score, softmax

SET = ["model", "layer", "k"]
#: Fixed value: what is added to variances in the batch norm.
EPSILON = 1e-5
#: Bytes of the model up to which the kernel is used, five per feature and set beyond ``EXACT`` of these, and entries of the feature
#: graph that it may have.  Both follow from the model, not from the data.
KERNEL_BYTES, GRAPH_ENTRIES = 1 << 30, 20_000_000
#: Features by sets up to which weights are kept in double precision; beyond, in single, as published models have them.
EXACT = 8_000_000
#: Cells that the kernel makes dense at once.
CELLS = 256


def last_triples(triples: DataFrame) -> DataFrame:
    """``r, c, v``: of triples ``seq, r, c, v`` with one place the last (the largest of equal ``seq``); zeros are dropped."""
    return triples.groupBy("r", "c").agg(F.max(F.struct("seq", "v"))["v"].alias("v")).where("v <> 0")


def background_weights(geneset: DataFrame, background: DataFrame) -> DataFrame:
    """``model, layer, k, feature_idx, gs``: the sum of the graph's values from a set's members to each feature."""
    joined = background.join(geneset, background["r"] == geneset["feature_idx"])
    return joined.groupBy(*SET, F.col("c").alias("feature_idx")).agg(F.sum("v").alias("gs")).where("gs <> 0")


def set_sizes(geneset: DataFrame, head: DataFrame) -> DataFrame:
    """``model, layer, k, n, maxrank, half, denom``: set size, the layer's rank limit, ``n (n + 1) / 2`` and ``n * maxrank``."""
    n = geneset.groupBy(*SET).agg(F.count("*").alias("n"))
    top = F.max("n").over(Window.partitionBy("model", "layer"))
    sized = n.join(head, ["model", "layer"]).withColumn("limit", top + 10 + F.greatest("maxrank", F.lit(0.0)) * 1000)
    return sized.select(*SET, "n", F.col("limit").alias("maxrank"), (F.col("n") * (F.col("n") + 1) / 2).alias("half"), (F.col("n") * F.col("limit")).alias("denom"))


def rank_scores(ranked: DataFrame, geneset: DataFrame, sizes: DataFrame) -> DataFrame:
    """``cell_id, model, layer, k, score``: one less the excess of the members' limited rank sum over its least, per ``denom``.

    ``ranked`` has the stored entries with ``rk`` and ``zero_rank``; members without entry have the cell's zero rank.
    """
    members = geneset.join(sizes, SET)
    sums = ranked.join(members, "feature_idx").groupBy("cell_id", *SET).agg(F.sum(F.least("rk", "maxrank")).alias("s"), F.count("*").alias("stored"))
    cells = ranked.groupBy("cell_id").agg(F.first("zero_rank").alias("zero_rank"))
    every = cells.crossJoin(F.broadcast(sizes)).join(sums, ["cell_id", *SET], "left")
    total = F.coalesce("s", F.lit(0.0)) + (F.col("n") - F.coalesce("stored", F.lit(0))) * F.least("zero_rank", "maxrank")
    return every.select("cell_id", *SET, (1 - (total - F.col("half")) / F.col("denom")).alias("score"))


def mean_differences(logged: DataFrame, geneset: DataFrame, weights: DataFrame, sizes: DataFrame) -> DataFrame:
    """``cell_id, model, layer, k, diff``: the set's mean log value less the background-weighted mean."""
    raw = logged.join(geneset, "feature_idx").groupBy("cell_id", *SET).agg(F.sum("lg").alias("raw"))
    bg = logged.join(weights, "feature_idx").groupBy("cell_id", *SET).agg(F.sum(F.col("lg") * F.col("gs")).alias("bg"))
    whole = weights.groupBy(*SET).agg(F.sum("gs").alias("gs"))
    every = logged.select("cell_id").distinct().crossJoin(F.broadcast(sizes.join(whole, SET)))
    joined = every.join(raw, ["cell_id", *SET], "left").join(bg, ["cell_id", *SET], "left")
    return joined.select("cell_id", *SET, (F.coalesce("raw", F.lit(0.0)) / F.col("n") - F.coalesce("bg", F.lit(0.0)) / F.col("gs")).alias("diff"))


def head_logits(scores: DataFrame, diffs: DataFrame, head: DataFrame, weight: DataFrame, sets: int) -> DataFrame:
    """``cell_id, model, layer, z``: non-affine batch norm and a linear head over the rank scores and mean differences."""
    measures = scores.select("cell_id", "model", "layer", F.col("k").alias("j"), F.col("score").alias("x")).unionByName(
        diffs.select("cell_id", "model", "layer", (F.col("k") + sets).alias("j"), F.col("diff").alias("x"))
    )
    terms = measures.join(F.broadcast(weight), ["model", "layer", "j"])
    sums = terms.groupBy("cell_id", "model", "layer").agg(F.sum((F.col("x") - F.col("rm")) / F.sqrt(F.col("rv") + EPSILON) * F.col("ow")).alias("s"))
    return sums.join(F.broadcast(head), ["model", "layer"]).select("cell_id", "model", "layer", (F.col("s") + F.col("bias")).alias("z"))


def model_predictions(logits: DataFrame) -> DataFrame:
    """``cell_id, model, prob, order_score``: softmax over the layers, and its mean category on [0, 1]."""
    listed = logits.groupBy("cell_id", "model").agg(F.transform(F.array_sort(F.collect_list(F.struct("layer", "z"))), lambda x: x["z"]).alias("z"))
    return with_order(listed)


def with_order(listed: DataFrame) -> DataFrame:
    return listed.select("cell_id", "model", softmax(F.col("z")).alias("prob")).select("cell_id", "model", "prob", order_score(F.col("prob")).alias("order_score"))


def ensemble_means(predictions: DataFrame, classes: int = 6) -> DataFrame:
    """``cell_id, order_score, prob, category``: means over the models, and the first largest mean probability."""
    means = predictions.groupBy("cell_id").agg(F.avg("order_score").alias("order_score"), *(F.avg(F.get("prob", F.lit(h))).alias(f"p{h}") for h in range(classes)))
    gathered = means.select("cell_id", "order_score", F.array(*(f"p{h}" for h in range(classes))).alias("prob"))
    return gathered.withColumn("category", first_largest(F.col("prob")))


@dataclass
class Kernel:
    """The model as matrices of features by all sets of a layer: members as bytes, background weights as floats."""

    models: list[int]
    layers: list[int]
    member: np.ndarray
    background: np.ndarray
    sizes: np.ndarray
    maxrank: np.ndarray
    head: dict[str, np.ndarray]

    def logits(self, rank: np.ndarray, lg: np.ndarray) -> np.ndarray:
        """Cells by models by layers, from dense ranks and logs."""
        out = np.empty((len(rank), len(self.models), len(self.layers)))
        for m in range(len(self.models)):
            for y in range(len(self.layers)):
                w, b, n, top = self.member[m, y].astype(float), self.background[m, y].astype(float), self.sizes[m, y], self.maxrank[m, y]
                score = 1 - (np.minimum(rank, top) @ w - n * (n + 1) / 2) / (n * top)
                diff = lg @ w / n - lg @ b / b.sum(axis=0)
                x = (np.concatenate([score, diff], axis=1) - self.head["rm"][m, y]) / np.sqrt(self.head["rv"][m, y] + EPSILON)
                out[:, m, y] = x @ self.head["ow"][m, y] + self.head["bias"][m, y]
        return out


def packed_sets(geneset: DataFrame, background: tuple[np.ndarray, np.ndarray, np.ndarray], n_features: int, sets: int, kind: str) -> DataFrame:
    """``model, layer, member, background``: each layer's two matrices as bytes, the graph's part summed where the layer is packed."""
    shared = geneset.sparkSession.sparkContext.broadcast(background)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        r, c, v = shared.value
        member = np.zeros((n_features, sets), dtype=np.uint8)
        member[frame["feature_idx"], frame["k"]] = 1
        graph = np.empty((n_features, sets), dtype=kind)
        for k in range(sets):
            of = member[r, k].astype(bool)
            graph[:, k] = np.bincount(c[of], v[of], n_features)
        return pd.DataFrame({"model": [key[0]], "layer": [key[1]], "member": [member.tobytes()], "background": [graph.tobytes()]})

    return geneset.select("model", "layer", "k", "feature_idx").groupBy("model", "layer").applyInPandas(run, "model int, layer int, member binary, background binary")


def kernel(geneset: DataFrame, background: DataFrame, head: DataFrame, weight: DataFrame, n_features: int) -> Kernel | None:
    """The matrices, or nothing if model or graph are too large; their size follows from the model alone.

    Layers are packed where the sets are and come to the driver one partition at a time.
    """
    sets = (geneset.agg(F.max("k")).first()[0] or 0) + 1
    heads, terms = head.toPandas(), weight.toPandas()  # a row per layer, and two per set
    models, layers = sorted(heads["model"].unique()), sorted(heads["layer"].unique())
    shape = (len(models), len(layers))
    entries = n_features * len(models) * len(layers) * sets
    kind = "<f8" if entries <= EXACT else "<f4"
    if entries * (1 + int(kind[-1])) > KERNEL_BYTES or background.count() > GRAPH_ENTRIES:
        return None
    graph = background.select("r", "c", F.col("v").cast("double").alias("v")).toPandas()
    member, weights = np.zeros((*shape, n_features, sets), dtype=np.uint8), np.zeros((*shape, n_features, sets), dtype=kind)
    for row in packed_sets(geneset, tuple(graph[x].to_numpy() for x in "rcv"), n_features, sets, kind).toLocalIterator():
        at = models.index(row["model"]), layers.index(row["layer"])
        member[at] = np.frombuffer(row["member"], dtype=np.uint8).reshape(n_features, sets)
        weights[at] = np.frombuffer(row["background"], dtype=kind).reshape(n_features, sets)
    at = lambda df: (df["model"].map({m: i for i, m in enumerate(models)}), df["layer"].map({y: i for i, y in enumerate(layers)}))
    sizes = member.sum(axis=2, dtype=np.int64).astype(float)
    named = {c: np.zeros((*shape, 2 * sets)) for c in ("rm", "rv", "ow")}
    for c, a in named.items():
        a[(*at(terms), terms["j"])] = terms[c]
    bias, limit = np.zeros(shape), np.zeros(shape)
    bias[at(heads)], limit[at(heads)] = heads["bias"], heads["maxrank"]
    return Kernel([int(m) for m in models], [int(y) for y in layers], member, weights, sizes, sizes.max(axis=2) + 10 + np.maximum(limit, 0) * 1000, named | {"bias": bias})


def kernel_logits(normalised: DataFrame, model: Kernel | Broadcast, n_features: int) -> DataFrame:
    """``cell_id, model, z`` with the layers' logits in an array: one shuffle by cell, then products per batch of cells."""
    shared = normalised.sparkSession.sparkContext.broadcast(model) if isinstance(model, Kernel) else model
    # A cell has at most one entry per feature.
    rows = normalised.groupBy("cell_id").agg(F.collect_list("feature_idx").alias("i"), F.collect_list("rk").alias("rk"), F.collect_list("lg").alias("lg"), F.first("zero_rank").alias("zero_rank"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for frame in frames:
            for a in range(0, len(frame), CELLS):
                part = frame.iloc[a : a + CELLS]
                rank = np.repeat(part["zero_rank"].to_numpy(dtype=float)[:, None], n_features, axis=1)
                lg = np.zeros((len(part), n_features))
                for row, (i, r, v) in enumerate(zip(part["i"], part["rk"], part["lg"], strict=True)):
                    rank[row, i], lg[row, i] = r, v
                z = own.logits(rank, lg)
                yield pd.DataFrame({"cell_id": np.repeat(part["cell_id"].to_numpy(), len(own.models)), "model": np.tile(own.models, len(part)), "z": [x.tolist() for x in z.reshape(-1, len(own.layers))]})

    kind = normalised.schema["cell_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"cell_id {kind}, model int, z array<double>")


def predictions(normalised: DataFrame, geneset: DataFrame, background: DataFrame, head: DataFrame, weight: DataFrame, n_features: int, sets: int, own: Kernel | Broadcast | None = None) -> DataFrame:
    """The ensemble's means for every cell, by the kernel (``own`` if it was built before) where the model fits, else by joins."""
    own = own or kernel(geneset, background, head, weight, n_features)
    if own:
        return ensemble_means(with_order(kernel_logits(normalised, own, n_features)))
    sizes = set_sizes(geneset, head)
    graph = background_weights(geneset, background)
    logits = head_logits(rank_scores(normalised, geneset, sizes), mean_differences(normalised, geneset, graph, sizes), head, weight, sets)
    return ensemble_means(model_predictions(logits))
