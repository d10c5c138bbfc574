"""Converter of supplied weight files to the model tables, a one-off step before runs."""

from __future__ import annotations

import io
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurigrade.operators.ensemble import last_triples

#: Names of the arrays in weight files, per layer, and in the graph's file.
LAYER = re.compile(r"layers\.(\d+)\.(weight|maxrank|batchnorm\.running_mean|batchnorm\.running_var|out\.weight|out\.bias)")
FIELDS = ("weight", "maxrank", "batchnorm.running_mean", "batchnorm.running_var", "out.weight", "out.bias")
GRAPH = ("indices", "values", "shape")


def _layers(frames: Iterator[pd.DataFrame], position: dict[str, int]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            name = os.path.basename(path).removesuffix(".npz")
            if name not in position:
                raise ValueError(f"{path}: no such model in the manifest")
            arrays = {n: a for n, a in np.load(io.BytesIO(content), allow_pickle=False).items() if LAYER.fullmatch(n)}
            seen = {LAYER.fullmatch(n).groups() for n in arrays}
            if lacking := sorted({(y, f) for y, _ in seen for f in FIELDS} - seen) or not seen:
                raise ValueError(f"{path}: arrays are missing: {lacking}")
            for n, a in arrays.items():
                layer, field = LAYER.fullmatch(n).groups()
                flat = np.asarray(a, dtype=float)
                # Of the sets' weights only those above zero make members.
                row, column = np.nonzero(flat > 0) if field == "weight" else (np.arange(flat.size), np.zeros(flat.size, dtype=int))
                value = flat[row, column] if field == "weight" else flat.ravel()
                yield pd.DataFrame({"model": position[name], "layer": int(layer), "field": field, "at": row, "k": column, "value": value})


def model_tables(spark: SparkSession, path: str, order: DataFrame) -> dict[str, DataFrame]:
    """``geneset, head, weight`` from the npz files at ``path``; ``order(position, model)`` is the manifest's (see ``matrix.model_order``).

    Every layer needs a matrix of features by sets, a rank limit, running means and variances, output weights and a bias; a
    file that lacks one, or that the manifest does not name, fails the conversion.
    """
    position = {r["model"]: r["position"] for r in order.collect()}  # a row per model
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    long = files.mapInPandas(lambda it: _layers(it, position), "model int, layer int, field string, at int, k int, value double")
    own = lambda name: F.max(F.when(F.col("field") == name, F.col("value")))
    scalars = long.where(F.col("field").isin("maxrank", "out.bias")).groupBy("model", "layer").agg(own("maxrank").alias("maxrank"), own("out.bias").alias("bias"))
    vectors = long.where(F.col("field").isin("batchnorm.running_mean", "batchnorm.running_var", "out.weight"))
    terms = vectors.groupBy("model", "layer", F.col("at").alias("j")).agg(own("batchnorm.running_mean").alias("rm"), own("batchnorm.running_var").alias("rv"), own("out.weight").alias("ow"))
    return {"geneset": long.where("field = 'weight'").select("model", "layer", "k", F.col("at").alias("feature_idx")), "head": scalars, "weight": terms}


def _triples(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            arrays = dict(np.load(io.BytesIO(content), allow_pickle=False).items())
            if lacking := [n for n in GRAPH if n not in arrays]:
                raise ValueError(f"{path}: arrays are missing: {lacking}")
            at, values = arrays["indices"].reshape(2, -1), arrays["values"].ravel()
            if at.shape[1] != len(values) or at.size and (at.min() < 0 or (at.max(axis=1) >= arrays["shape"]).any()):
                raise ValueError(f"{path}: indices do not fit values or shape")
            for a in range(0, len(values), 1_000_000):
                b = min(a + 1_000_000, len(values))
                yield pd.DataFrame({"seq": np.arange(a, b), "r": at[0, a:b], "c": at[1, a:b], "v": values[a:b].astype(float)})


def background_table(spark: SparkSession, path: str) -> DataFrame:
    """``r, c, v`` of the graph file at ``path``: of triples with one place the last; zeros are dropped."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return last_triples(files.mapInPandas(_triples, "seq long, r int, c int, v double"))


def convert(spark: SparkSession, models: str, background: str, order: DataFrame, output: str) -> None:
    """The model's tables as Parquet folders at ``output``."""
    for name, table in (model_tables(spark, models, order) | {"background": background_table(spark, background)}).items():
        table.write.mode("errorifexists").parquet(f"{output}/{name}")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that :func:`convert` wrote."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("geneset", "head", "weight", "background")}
