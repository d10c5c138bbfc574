"""Array files (npy, npz) and model weights as tables."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Number types that array files may hold.
KINDS = ("float32", "float64", "int64")


def _arrays(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            loaded = np.load(io.BytesIO(content), allow_pickle=False)
            named = dict(loaded.items()) if hasattr(loaded, "files") else {os.path.basename(path).removesuffix(".npy"): loaded}
            for name, a in named.items():
                if a.dtype.name not in KINDS:
                    raise ValueError(f"{path}: {name} holds {a.dtype}")
                yield pd.DataFrame({"path": [path], "name": [name], "dtype": [a.dtype.name], "shape": [list(a.shape)], "data": [a.ravel().astype(float).tolist()]})


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """``path, name, dtype, shape, data`` of every array in the files at ``path``; other number types fail the read."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_arrays, "path string, name string, dtype string, shape array<int>, data array<double>")


def write_array(values: np.ndarray, path: str) -> None:
    """An npy file of a bounded array, on the driver."""
    if values.dtype.name not in KINDS:
        raise ValueError(f"{values.dtype} cannot be written")
    np.save(path, values, allow_pickle=False)


def gene_sets(weights: DataFrame) -> DataFrame:
    """``model, layer, k, feature_idx``: the members of each set, those with a weight above zero."""
    return weights.where(F.col("weight") > 0).select("model", "layer", "k", "feature_idx")


def assets_dir(configured: str | None, candidates: tuple[str, ...] = ("./assets",)) -> str | None:
    """The configured folder, else the first candidate that there is."""
    return configured or next((c for c in candidates if os.path.isdir(c)), None)
