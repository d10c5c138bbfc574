"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are cut into bins.  Cyclic boosting visits one feature after the other and adds a shallow
tree over its bins to that feature's lookup table, fitted to the gradient of the log loss; then the pairs of features
whose joint bins best explain what is left get tables of their own.  A score is the sum of one table entry per feature
and pair, taken for all rows of a batch at once.

Training rows are a sample of at most about ``sample`` labelled ids, chosen by a hash of the id, and of each id at most
one text, the smallest by checksum, counted up to ``COPIES`` times; their features are the only thing gathered on the driver.  Null and
empty texts have all-zero features and a score like any other.  Rows whose label is null are not learnt from; with no label
of either kind left, every score is the prior.  Repeated rows give repeated results, an empty table an empty one.  A very
long text is measured whole.  Only the id and text columns are read, so others may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurigrade.llm.common import slices, small_batches, texts_of

#: Labelled rows that a model is fitted on, about; their features are some 3 MB on the driver.
SAMPLE = 20_000
#: Rows of one id and text that count in training.
COPIES = 4
BINS, ROUNDS, RATE, LEAVES, PAIRS, PAIR_BINS, PAIR_ROUNDS, RIDGE = 64, 60, 0.15, 4, 6, 8, 20, 5.0
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "bars", "exclamations", "stops", "commas", "beyond_ascii", "white",
    "distinct_words", "top_word", "repeat_windows", "line_bytes", "dup_lines", "short_words", "long_words", "capital_words",
)
_CLASSES = {"upper": range(65, 91), "digits": range(48, 58), "symbols": b"#*$%&<>{}[]=@^~\\_", "bars": b"|", "exclamations": b"!?", "stops": b".", "commas": b",;:", "beyond_ascii": range(128, 256), "white": b" \t\n\x0b\x0c\r"}
_TABLE = np.zeros((256, len(_CLASSES)), dtype=np.int64)
for _i, _bytes in enumerate(_CLASSES.values()):
    _TABLE[list(_bytes), _i] = 1


def features(text: bytes) -> list[float]:
    """The :data:`FEATURES` of a text, all zero if it has no words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    share = (np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) @ _TABLE / len(text)).tolist()
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    windows = set(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in text.split(b"\n") if x.strip()]
    capital = sum(w[:1].isupper() for w in counts) / len(counts)
    return [
        np.log1p(len(text)), np.log1p(n), float(sizes.mean()), *share,
        len(counts) / n, max(counts.values()) / n, 1 - len(windows) / max(1, n - 2), float(np.log1p(len(text) / len(lines))), 1 - len(set(lines)) / len(lines),
        float((sizes <= 2).mean()), float((sizes >= 12).mean()), capital,
    ]


@dataclass
class AdditiveModel:
    """Bin edges, one table per feature and per pair, and the prior's log odds."""

    edges: list[np.ndarray]
    prior: float
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), dtype=np.int64)

    def odds(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.prior)
        for j, t in enumerate(self.tables):
            total += t[b[:, j]]
        for j, k, t in self.pairs:
            total += t[self.coarse[j][b[:, j]], self.coarse[k][b[:, k]]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x), -30, 30)))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Values per bin of a tree with so many leaves at most: the best split of any leaf, again and again."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + RIDGE)
    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for p in parts:
            cut = np.arange(p[0] + 1, p[1])
            if len(cut):
                better = gain(p[0], cut) + gain(cut, p[1]) - gain(*p)
                i = int(np.argmax(better))
                best = max(best, (float(better[i]), p, int(cut[i])), key=lambda x: x[0])
        if best[1] is None:
            break
        _, (a, b), c = best
        parts.remove((a, b))
        parts += [(a, c), (c, b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + RIDGE)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of the features' tables, then of the most telling pairs' tables."""
    n, width = x.shape if x.ndim == 2 else (0, len(FEATURES))
    rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if n else 0.5
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.empty(0) for j in range(width)]
    model = AdditiveModel(edges, float(np.log(rate / (1 - rate))), [np.zeros(len(e) + 1) for e in edges])
    model.coarse = [np.arange(len(e) + 1) * PAIR_BINS // (len(e) + 1) for e in edges]
    if not n or y.min() == y.max():
        return model
    b = model.bins(x)
    odds = np.full(n, model.prior)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-odds))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, t in enumerate(model.tables):
            r, w = slope()
            step = RATE * _tree(np.bincount(b[:, j], r, len(t)), np.bincount(b[:, j], w, len(t)), LEAVES)
            t += step
            odds += step[b[:, j]]
    r, w = slope()
    cells = {}
    for j, k in combinations(range(width), 2):
        cell = model.coarse[j][b[:, j]] * PAIR_BINS + model.coarse[k][b[:, k]]
        g, h = np.bincount(cell, r, PAIR_BINS**2), np.bincount(cell, w, PAIR_BINS**2)
        cells[j, k] = float((g * g / (h + RIDGE)).sum())
    chosen = sorted(cells, key=lambda p: (-cells[p], p))[:PAIRS]
    model.pairs = [(j, k, np.zeros((PAIR_BINS, PAIR_BINS))) for j, k in chosen]
    for _ in range(PAIR_ROUNDS):
        for j, k, t in model.pairs:
            r, w = slope()
            u, v = model.coarse[j][b[:, j]], model.coarse[k][b[:, k]]
            g, h = np.bincount(u * PAIR_BINS + v, r, PAIR_BINS**2).reshape(t.shape), np.bincount(u * PAIR_BINS + v, w, PAIR_BINS**2).reshape(t.shape)
            # A tree of depth two: rows are split once, then the columns of either side.
            rows = _tree(g.sum(1), h.sum(1), 2)
            step = np.zeros_like(t)
            for value in np.unique(rows):
                side = rows == value
                step[side] = _tree(g[side].sum(0), h[side].sum(0), 2)
            t += RATE * step
            odds += RATE * step[u, v]
    return model


def held_out(key: Column) -> Column:
    """Whether the CRC-32 of the id as text leaves 1 when divided by three; a row without id is not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality") -> AdditiveModel:
    """A model of the labelled documents that are not held out, or of a hash sample of them if they are more than ``sample``."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    usable = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("label"))
    count = usable.count()
    part = min(1.0, sample / max(1, count))
    drawn = usable.withColumn("draw", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1_000_000))).where(F.col("draw") < int(part * 1_000_000))
    # At most 2 * sample ids are broadcast; the hash leaves about sample, and ties at the bound go by id.
    chosen = drawn.orderBy("draw", "key").limit(2 * sample).select("key", "label")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("value")).join(F.broadcast(chosen), "key")
    measured = rows.mapInArrow(lambda it: _labelled(it), f"key {kind}, x array<double>, label double, mark long")
    # Repeated ids and texts have one result whatever rows come first: counted per text, then the smallest few of an id.
    counted = measured.groupBy("key", "mark").agg(F.min("x").alias("x"), F.min("label").alias("label"), F.least(F.count("*"), F.lit(COPIES)).cast("int").alias("n"))
    kept = counted.groupBy("key").agg(F.min(F.struct("mark", "x", "label", "n")).alias("one")).select("key", "one.x", "one.label", "one.n")
    firsts = kept.toPandas().sort_values(["key", "label"], kind="stable")
    firsts = firsts.loc[firsts.index.repeat(firsts["n"])]
    x = np.array(firsts["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, firsts["label"].to_numpy(dtype=float))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = texts_of(batch.column(1))
        x, mark = [features(t) for t in texts], [zlib.crc32(t) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64())), batch.column(2).cast(pa.float64()), pa.array(mark, pa.int64())], ["key", "x", "label", "mark"])


def _scored(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in slices(batches):
        x = np.array([features(t) for t in texts_of(batch.column(1))], dtype=float).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["key", "score"])


def scored(docs: DataFrame, model: AdditiveModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted`` of every whole text."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("value")).mapInArrow(lambda it: _scored(it, shared), f"key {kind}, score double")
    return rows.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
