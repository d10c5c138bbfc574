"""Diffusion of scores over correlation graphs of chunks of cells.

A chunk has a bounded number of cells (``smooth_batch_size``), so its matrix fits a task; chunks are independent groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the start, relative change that ends the rounds, most rounds, what is added to row sums.
RESTART, TOLERANCE, ROUNDS, FLOOR = 0.1, 1e-6, 10_000, 1e-5


def correlations(x: np.ndarray) -> np.ndarray:
    """Pearson correlations of the rows, clipped to [-1, 1]; a constant row's are missing."""
    c = x - x.mean(axis=1, keepdims=True)
    cov = c @ c.T
    sd = np.sqrt(np.diag(cov))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.clip(cov / sd[:, None] / sd[None, :], -1, 1)


def transitions(corr: np.ndarray) -> np.ndarray:
    """Rows of weights: no self-loops, missing ones 0, those below the mean of all (if that is positive) 0, divided by the row's sum."""
    w = corr.copy()
    np.fill_diagonal(w, 0.0)
    w[~np.isfinite(w)] = 0.0
    w[w < max(w.mean(), 0.0)] = 0.0
    return w / (w.sum(axis=1, keepdims=True) + FLOOR)


def fixed_point(a: np.ndarray, start: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, int]:
    """Rounds of ``0.9 A x + 0.1 x0`` until the mean change over the mean start is below the tolerance; how many."""
    scale = float(start.astype(np.float32).mean()) + 1e-6
    x, n = start, 0
    while n < rounds:
        new, n = (1 - RESTART) * (a @ x) + RESTART * start, n + 1
        done = np.abs(new - x).mean() / scale < tolerance
        x = new
        if done:
            break
    return x, n


def sparse_vectors(lg: DataFrame, top: DataFrame) -> DataFrame:
    """``cell_id, at, lg``: arrays of places and values of each cell's entries among the chosen features."""
    order = top.selectExpr("feature_idx", "cast(row_number() over (order by feature_idx) - 1 as int) as at")
    return _listed(lg.join(order, "feature_idx"))


def batch_sparse_vectors(lg: DataFrame, top: DataFrame) -> DataFrame:
    """:func:`sparse_vectors` where ``lg`` has ``batch`` and each batch its own features, ``top(batch, feature_idx, at)``."""
    return _listed(lg.join(top, ["batch", "feature_idx"]))


def _listed(placed: DataFrame) -> DataFrame:
    return placed.groupBy("cell_id").agg(F.collect_list("at").alias("at"), F.collect_list("lg").alias("lg"))


def _matrix(frame: pd.DataFrame, width: int) -> np.ndarray:
    x = np.zeros((len(frame), width))
    for row, (at, lg) in enumerate(zip(frame["at"], frame["lg"], strict=True)):
        if at is not None:
            x[row, at] = lg
    return x


def chunk_pairs(chunks: DataFrame, width: int, markov: bool = False) -> DataFrame:
    """``chunk, i, j, w`` of every pair of cells in a chunk: correlations, or transition weights.

    ``chunks(chunk, cell_id, at, lg)``.
    """
    kind = chunks.schema["cell_id"].dataType.simpleString()

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cell_id")
        w = correlations(_matrix(frame, width))
        w = transitions(w) if markov else w
        ids = frame["cell_id"].to_numpy()
        return pd.DataFrame({"chunk": key[0], "i": np.repeat(ids, len(ids)), "j": np.tile(ids, len(ids)), "w": w.ravel()})

    return chunks.groupBy("chunk").applyInPandas(run, f"chunk int, i {kind}, j {kind}, w double")


def diffused(chunks: DataFrame, width: int, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``chunk, cell_id, smooth, rounds``, and ``batch`` if there is one: the scores after diffusion in each chunk.

    ``chunks(chunk, cell_id, score, at, lg)``; with ``batch``, a chunk is one of its batch.
    """
    kind = chunks.schema["cell_id"].dataType.simpleString()
    keys = [c for c in ("batch", "chunk") if c in chunks.columns]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cell_id")
        x, n = fixed_point(transitions(correlations(_matrix(frame, width))), frame["score"].to_numpy(dtype=float), rounds, tolerance)
        return pd.DataFrame(dict(zip(keys, key, strict=True)) | {"cell_id": frame["cell_id"].to_numpy(), "smooth": x, "rounds": n})

    return chunks.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} int" for k in keys) + f", cell_id {kind}, smooth double, rounds int")
