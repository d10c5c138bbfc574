"""Principal components and adaptive nearest-neighbour smoothing within batches.

A batch has a bounded number of cells (``batch_size``), so each is one group for a NumPy kernel; the DataFrame forms of the
single steps define what the kernel computes and serve small inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurigrade.functions.scalars import category_index, squared_distance
from plurigrade.settings import EDGES

#: Distances are compared at so many decimals, then by id.
PLACES = 9
#: Greatest residual of an eigenpair relative to the largest eigenvalue.
RESIDUAL = 1e-10
#: Entries of a batch's dense matrix up to which its Gram matrix is taken: 400 MB.  Stored entries of a batch up to which one task holds
#: them, about 2 GB.  Rows that a kernel makes dense at once.
DENSE_ENTRIES, TASK_ENTRIES, BLOCK = 50_000_000, 150_000_000, 256
#: Most steps of the block Lanczos process.
STEPS = 40


def pair_distances(rows: DataFrame) -> DataFrame:
    """``i, j, d``: distances of all pairs (itself included) of ``rows(cell_id, x)``, divided by the largest of the row.  For small inputs."""
    left, right = rows.select(F.col("cell_id").alias("i"), F.col("x").alias("a")), rows.select(F.col("cell_id").alias("j"), F.col("x").alias("b"))
    d = left.crossJoin(right).select("i", "j", F.sqrt(F.greatest(squared_distance(F.col("a"), F.col("b")), F.lit(0.0))).alias("d"))
    top = F.max("d").over(Window.partitionBy("i"))
    return d.select("i", "j", (F.col("d") / F.nullif(top, F.lit(0.0))).alias("d"))


def nearest(distances: DataFrame, k: int) -> DataFrame:
    """``i, j, d, rn``: the ``k`` nearest of each, itself included, ties by id."""
    order = Window.partitionBy("i").orderBy(F.round("d", PLACES), "j")
    return distances.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def consensus(near: DataFrame) -> DataFrame:
    """``i, keep`` from ``near(i, rn, s)``: twice the least m of 2 or more whose first m and next m neighbours have mean scores in one category; 4 if none."""
    running = Window.partitionBy("i").orderBy("rn")
    sums = near.select("i", "rn", F.coalesce(F.sum("s").over(running), F.lit(0.0)).alias("t"), F.count("s").over(running).alias("known"), F.count("*").over(Window.partitionBy("i")).alias("n"))
    twice = sums.select("i", (F.col("rn") / 2).alias("rn"), F.col("t").alias("t2"), F.col("known").alias("known2"))
    both = sums.join(twice, ["i", "rn"]).where((F.col("rn") >= 2) & (F.col("rn") <= F.floor(F.col("n") / 2)))
    # A mean is missing if a score of its own is, not if one before is.
    part = lambda t, known: category_index(F.when(known == F.col("rn"), F.round(t / F.col("rn"), PLACES)))
    same = part(F.col("t"), F.col("known")) == part(F.col("t2") - F.col("t"), F.col("known2") - F.col("known"))
    return both.groupBy("i").agg((2 * F.coalesce(F.min(F.when(same, F.col("rn"))), F.lit(2))).cast("int").alias("keep"))


def weighted_mean(score: Column, distance: Column) -> Column:
    """The mean with weights ``(1 - d) ** 2``; null if any score is missing."""
    weight = (1 - distance) * (1 - distance)
    return F.when(F.count(score) == F.count("*"), F.try_divide(F.sum(score * weight), F.sum(weight)))


def smoothed(near: DataFrame, keep: DataFrame) -> DataFrame:
    """``i, score`` from ``near(i, rn, d, s)`` and each row's ``keep``."""
    kept = near.join(keep, "i").where(F.col("rn") <= F.col("keep"))
    return kept.groupBy("i").agg(weighted_mean(F.col("s"), F.col("d")).alias("score"))


def embedding(x: np.ndarray, components: int) -> np.ndarray:
    """``U sqrt(lambda)`` of the column-centred rows, largest first, each column's largest entry positive.

    Eigenpairs come from the smaller of the two Gram matrices; one whose residual is too large is an error.
    """
    if not np.isfinite(x).all():
        raise ValueError("a row is constant or not finite")
    c = x - x.mean(axis=0)
    n = min(components, len(x) - 1)
    wide = c.shape[1] > len(c)
    gram = c @ c.T if wide else c.T @ c
    values, vectors = np.linalg.eigh(gram)
    values, vectors = np.maximum(values[::-1][:n], 0.0), vectors[:, ::-1][:, :n]
    if len(values) and np.linalg.norm(gram @ vectors - vectors * values, axis=0).max() > RESIDUAL * max(values[0], 1e-300):
        raise ArithmeticError("eigenpairs have not converged")
    out = vectors * np.sqrt(values) if wide else c @ vectors
    out = np.pad(out, ((0, 0), (0, n - out.shape[1])))
    return out * np.where(out[np.abs(out).argmax(axis=0), np.arange(n)] < 0, -1.0, 1.0)


def _category(x: np.ndarray) -> np.ndarray:
    index = np.searchsorted(np.array(EDGES), x, side="left")
    return np.where(np.isnan(x) | (x > 1), -1, index)


def _nearest_rows(ids: np.ndarray, embed: np.ndarray, k: int, block: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each row its number, its ``k`` nearest in order, itself included, and its scaled distances to them; distances are taken in blocks of rows."""
    n = len(ids)
    squares = (embed**2).sum(axis=1)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    for a in range(0, n, block):
        d = np.sqrt(np.maximum(squares[a : a + block, None] + squares[None, :] - 2 * embed[a : a + block] @ embed.T, 0.0))
        d[np.arange(len(d)), np.arange(a, a + len(d))] = 0.0
        top = d.max(axis=1, keepdims=True)
        if (top == 0).any():
            raise ValueError("all cells of a batch lie on one point")
        d = d / top
        for r, row in enumerate(np.round(d, PLACES)):
            # All that tie with the k-th are sorted, so ties go by id.
            edge = np.partition(row, k - 1)[k - 1]
            near = np.flatnonzero(row <= edge)
            near = near[np.lexsort((rank[near], row[near]))][:k]
            yield a + r, near, d[r, near]


def smooth_batch(ids: np.ndarray, embed: np.ndarray, score: np.ndarray, k: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Kept neighbours and smoothed scores of one batch; missing scores (NaN) spread."""
    n, k = len(ids), min(k, len(ids))
    keep, out = np.empty(n, dtype=np.int64), np.empty(n)
    for i, near, d in _nearest_rows(ids, embed, k, block):
        s = score[near]
        # A mean is missing if a score of its own is, not if one before is.
        t, missing = np.cumsum(np.where(np.isnan(s), 0.0, s)), np.cumsum(np.isnan(s))
        half = np.arange(2, k // 2 + 1)
        first, both = half - 1, 2 * half - 1
        one = np.where(missing[first] > 0, np.nan, np.round(t[first] / half, PLACES))
        two = np.where(missing[both] > missing[first], np.nan, np.round((t[both] - t[first]) / half, PLACES))
        same = _category(one) == _category(two)
        m = 2 * int(half[same.argmax()]) if same.any() else 4
        w = (1 - d[:m]) ** 2
        keep[i], out[i] = m, (s[:m] * w).sum() / w.sum()
    return keep, out


def knn(rows: DataFrame, k: int) -> DataFrame:
    """``batch, i, j, d, rn``: the ``k`` nearest of each row of ``rows(batch, cell_id, x)`` within its batch, as :func:`nearest` of all pairs has them."""
    kind = rows.schema["cell_id"].dataType.simpleString()

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["cell_id"].to_numpy()
        found = list(_nearest_rows(ids, np.array(frame["x"].tolist(), dtype=float), min(k, len(ids)), 512))
        size = [len(near) for _, near, _ in found]
        return pd.DataFrame({"batch": key[0], "i": np.repeat(ids[[i for i, _, _ in found]], size), "j": ids[np.concatenate([near for _, near, _ in found])], "d": np.concatenate([d for _, _, d in found]), "rn": np.concatenate([np.arange(1, m + 1) for m in size])})

    return rows.groupBy("batch").applyInPandas(run, f"batch int, i {kind}, j {kind}, d double, rn int")


def knn_smoothed(rows: DataFrame, k: int) -> DataFrame:
    """``batch, cell_id, keep, score`` of ``rows(batch, cell_id, x, score)``, ``x`` the embedding."""
    kind = rows.schema["cell_id"].dataType.simpleString()

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["cell_id"].to_numpy()
        keep, score = smooth_batch(ids, np.array(frame["x"].tolist(), dtype=float), frame["score"].to_numpy(dtype=float), k)
        return pd.DataFrame({"batch": key[0], "cell_id": ids, "keep": keep, "score": score})

    out = rows.groupBy("batch").applyInPandas(run, f"batch int, cell_id {kind}, keep int, score double")
    return out.withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def _scaled_block(frame: pd.DataFrame, width: int) -> np.ndarray:
    """Dense rows of sparse ones (``at, lg``), as z-scores."""
    x = np.zeros((len(frame), width))
    for row, (at, lg) in enumerate(zip(frame["at"], frame["lg"], strict=True)):
        x[row, at] = lg
    x -= x.mean(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        x /= x.std(axis=1, keepdims=True)
    if not np.isfinite(x).all():
        raise ValueError("a row is constant or not finite")
    return x


def _summed(rows: DataFrame, width: int, partial) -> np.ndarray:
    """The sum over all rows of ``partial(block)``, an array of one shape, from one partial sum per partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            for a in range(0, len(frame), BLOCK):
                part = partial(_scaled_block(frame.iloc[a : a + BLOCK], width))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"data": [total.astype("<f8").tobytes()]})

    out = 0.0
    for r in rows.mapInPandas(run, "data binary").toLocalIterator():
        out = out + np.frombuffer(r["data"], dtype="<f8")
    return out


def _axes(n: int, width: int, components: int, seed: int, steps: int, summed: Callable[[Callable[[np.ndarray], np.ndarray]], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column means, the leading axes (features by components) and eigenvalues of ``n`` rows that are seen through sums over blocks only.

    A block Lanczos process with full reorthogonalisation: each step is one pass over the rows.  It ends when all wanted
    pairs have small residuals, and fails if they never do.
    """
    k = min(components, n - 1, width)
    block = min(width, k + 10)
    mean = summed(lambda x: x.sum(axis=0)).ravel() / n
    basis = np.linalg.qr(np.random.RandomState(seed).standard_normal((width, block)))[0]
    applied, last = np.empty((width, 0)), basis
    for _ in range(steps):
        applied = np.hstack([applied, summed(lambda x, q=last: (x - mean).T @ ((x - mean) @ q)).reshape(width, -1)])
        small = basis.T @ applied
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        residual = np.linalg.norm(applied @ vectors - (basis @ vectors) * values, axis=0)
        if k == 0 or residual.max() <= RESIDUAL * max(values[0], 1e-300) or basis.shape[1] == width:
            return mean, basis @ vectors, np.maximum(values, 0.0)
        last = applied[:, -last.shape[1] :]
        for _ in range(2):
            last = last - basis @ (basis.T @ last)
        q, r = np.linalg.qr(last)
        last = q[:, np.abs(np.diag(r)) > 1e-12 * max(values[0], 1e-300)][:, : width - basis.shape[1]]
        if last.shape[1] == 0:
            return mean, basis @ vectors, np.maximum(values, 0.0)
        basis = np.hstack([basis, last])
    raise ArithmeticError("eigenpairs have not converged")


def principal_axes(rows: DataFrame, width: int, components: int, seed: int = 14, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`_axes` of ``rows(cell_id, at, lg)`` without the rows ever meeting in one place: a step brings back features by block size."""
    return _axes(rows.count(), width, components, seed, steps, lambda partial: _summed(rows, width, partial))


def _embedding_by_blocks(frame: pd.DataFrame, width: int, components: int, seed: int) -> np.ndarray:
    """The embedding of sparse rows, made dense some at a time; each column's largest entry positive."""
    blocks = [frame.iloc[a : a + BLOCK] for a in range(0, len(frame), BLOCK)]

    def summed(partial: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        total = None
        for b in blocks:
            part = partial(_scaled_block(b, width))
            total = part if total is None else total + part
        return total

    mean, axes, _ = _axes(len(frame), width, components, seed, STEPS, summed)
    out = np.concatenate([(_scaled_block(b, width) - mean) @ axes for b in blocks])
    return out * np.where(out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])] < 0, -1.0, 1.0)


def embedded_at_large(rows: DataFrame, width: int, components: int, seed: int = 14) -> DataFrame:
    """``cell_id, x`` as :func:`embedded` gives them but for signs and small errors, for batches whose dense matrix is too large for a task."""
    mean, axes, _ = principal_axes(rows, width, components, seed)
    shared = rows.sparkSession.sparkContext.broadcast((mean, axes))
    kind = rows.schema["cell_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, axes = shared.value
        for frame in frames:
            for a in range(0, len(frame), BLOCK):
                part = frame.iloc[a : a + BLOCK]
                yield pd.DataFrame({"cell_id": part["cell_id"].to_numpy(), "x": list((_scaled_block(part, width) - mean) @ axes)})

    return rows.mapInPandas(run, f"cell_id {kind}, x array<double>")


def embedded(rows: DataFrame, width: int, components: int, seed: int = 14) -> DataFrame:
    """``batch, cell_id, x``: the principal components of each batch from ``rows(batch, cell_id, at, lg)``, the rows scaled to z-scores.

    Each batch is a group of its own; one whose dense matrix would be too large is made dense in blocks.
    """
    kind = rows.schema["cell_id"].dataType.simpleString()

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cell_id")
        x = embedding(_scaled_block(frame, width), components) if len(frame) * width <= DENSE_ENTRIES else _embedding_by_blocks(frame, width, components, seed)
        return pd.DataFrame({"batch": key[0], "cell_id": frame["cell_id"].to_numpy(), "x": list(x)})

    return rows.groupBy("batch").applyInPandas(run, f"batch int, cell_id {kind}, x array<double>")
