"""Benchmark decontamination with a broadcast hash set of test n-grams.

Words are runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII.  A window is ``n`` consecutive
words of an item, or all words of an item that has fewer.  Documents' windows are looked up by hash, and each hit is
verified word by word; what lies inside a verified window is hit.

The set is broadcast only while the windows number at most ``block_windows`` and hold at most ``BLOCK_BYTES`` of text; a
larger benchmark is taken in blocks of that size, each block scanned against all documents, and the blocks' hits are united.

A null text has no words; an item without words has no window; repeated items count once per ``item_id``.  Windows of an
item whose id is null make words hit like any other, but the item has no name to count: it adds nothing to the items of
a document, so by itself it makes none contaminated.  Repeated document rows give repeated results, an empty table of
documents an empty result, and without items nothing is hit.  Texts of any length are scanned whole, cut between rows
only.  Only the named columns are read, so others may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurigrade.llm.common import map_rows, slices, small_batches, stored, texts_of

#: Lower-cases A-Z and blanks every byte that belongs to no word; UTF-8 bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20
#: Windows that are broadcast at once, about 1 kB each, and bytes of text in them.
BLOCK, BLOCK_BYTES = 200_000, 64 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WindowSet:
    """Hash set of one block of windows; what is broadcast."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]]) -> None:
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for x in windows for w in x}))}
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]] = {}
        for n in sorted({len(x) for x in windows}):
            keys = sorted(x for x in windows if len(x) == n)
            ids = np.array([[self.vocabulary[w] for w in x] for x in keys], dtype=np.int64)
            hashes = self.hashed(ids.T)
            order = np.argsort(hashes, kind="stable")
            seen = np.zeros(1 << _BITS, dtype=bool)
            seen[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.by_length[n] = (hashes[order], ids[order], seen, [windows[keys[i]] for i in order])

    @staticmethod
    def hashed(columns: np.ndarray | list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(columns[0]), dtype=np.uint64)
        for c in columns:
            h = (h ^ c.astype(np.uint64)) * _MIX
            h ^= h >> np.uint64(29)
        return h * _MIX

    def scan(self, ids: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, list[str]]]:
        """Verified windows as (position, words, item ids); ``ids`` is 0 for words of no window, ``doc`` the document of each word."""
        found = []
        known = np.flatnonzero(ids)
        for n, (hashes, rows, seen, items) in self.by_length.items():
            at = known[known <= len(ids) - n]
            # A window lies within one document and has no unknown word: n known words from here reach exactly n - 1 further.
            place = np.searchsorted(known, at)
            at = at[(place + n <= len(known)) & (known[np.minimum(place + n - 1, len(known) - 1)] == at + n - 1)]
            at = at[doc[at] == doc[at + n - 1]]
            if not len(at):
                continue
            h = self.hashed([ids[at + k] for k in range(n)])
            keep = seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)]
            at, h = at[keep], h[keep]
            first = np.searchsorted(hashes, h)
            for p, value, i in zip(at.tolist(), h, first.tolist(), strict=True):
                while i < len(hashes) and hashes[i] == value:
                    if np.array_equal(rows[i], ids[p : p + n]):
                        found.append((p, n, items[i]))
                    i += 1
        return found


def item_windows(items: DataFrame, n: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """``window array<string>, item string``: the distinct windows of each item; ``item`` is null for items without id."""
    folded = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = items.select(F.col(key).cast("string").alias("item"), F.filter(F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "").alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    return rows.where(F.size("w") > 0).select("item", "w", F.explode(starts).alias("at")).select(F.slice("w", F.col("at"), n).alias("window"), "item").distinct()


def _blocks(items: DataFrame, n: int, block: int, key: str, text: str) -> list[DataFrame]:
    """The stored windows in blocks of about half of what may be broadcast at once, dealt by hash."""
    windows = stored(item_windows(items, n, key, text), "windows")
    count, size = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "window", "item"))), F.lit(0))).first()
    if count <= block and size <= BLOCK_BYTES:
        return [windows]
    parts = max(-(-2 * count // block), -(-2 * size // BLOCK_BYTES))
    return [windows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == k) for k in range(parts)]


def _window_set(block: DataFrame) -> WindowSet:
    held: dict[tuple[bytes, ...], list[str]] = {}
    for r in block.toLocalIterator():
        names = held.setdefault(tuple(w.encode() for w in r["window"]), [])
        if r["item"] is not None:
            names.append(r["item"])
    return WindowSet({w: sorted(x) for w, x in held.items()})


def _scanned(texts: list[bytes], windows: WindowSet) -> tuple[list[int], list[list[tuple[int, int, list[str]]]]]:
    """Words of each text, and its verified windows with positions inside the text."""
    get = windows.vocabulary.get
    split = [words_of(t) for t in texts]
    counts = [len(w) for w in split]
    doc = np.repeat(np.arange(len(texts)), counts)
    ids = np.array([get(w, 0) for ws in split for w in ws], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    hits: list[list[tuple[int, int, list[str]]]] = [[] for _ in texts]
    if len(ids) and windows.vocabulary:
        for p, n, items in windows.scan(ids, doc):
            d = int(doc[p])
            hits[d].append((p - int(starts[d]), n, items))
    return counts, hits


def _ranges(hits: list[tuple[int, int, list[str]]]) -> list[list[int]]:
    """Disjoint word ranges, end exclusive, that the windows cover."""
    out: list[list[int]] = []
    for a, n, _ in sorted(hits, key=lambda h: h[:2]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return out


_REPORT = "n_words long, hit array<array<int>>, items array<string>"


def _reported(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        counts, hits = _scanned(texts_of(batch.column(1)), shared.value)
        ranges = pa.array([_ranges(h) for h in hits], pa.list_(pa.list_(pa.int32())))
        items = pa.array([sorted({i for h in x for i in h[2]}) for x in hits], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), ranges, items], ["key", "n_words", "hit", "items"])


def find(docs: DataFrame, items: DataFrame, n: int = 8, min_items: int = 2, block_windows: int = BLOCK, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key, n_words, hit, items, contaminated``: the hit word ranges and the items with a window in each document."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    blocks = _blocks(items, n, block_windows, item_key, item_text)
    if len(blocks) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(_window_set(blocks[0]))
        rows = docs.select(F.col(key).alias("key"), F.col(text).alias("value")).mapInArrow(lambda it: _reported(it, shared), f"key {kind}, {_REPORT}")
    else:
        numbered = stored(docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key")).alias("key"), F.col(text).alias("value")), "numbered")
        rows = _united(numbered, blocks, f"struct<row: bigint, key: {kind}>").withColumn("key", F.col("key.key"))
    return rows.select(F.col("key").alias(key), "n_words", "hit", "items", (F.size("items") >= min_items).alias("contaminated"))


def _united(numbered: DataFrame, blocks: list[DataFrame], kind: str) -> DataFrame:
    """Each block scanned against all of ``numbered`` (key, value), a row of which meets its hits again by its key."""
    found = None
    for block in blocks:
        shared = numbered.sparkSession.sparkContext.broadcast(_window_set(block))
        part = numbered.mapInArrow(lambda it, shared=shared: _reported(it, shared), f"key {kind}, {_REPORT}")
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hit")).alias("hit"), F.flatten(F.collect_list("items")).alias("items"))

    def joined(done, r):
        last = F.element_at(done, -1)
        meets = (F.size(done) > 0) & (F.try_element_at(F.try_element_at(done, F.lit(-1)), F.lit(2)) >= r[0])
        longer = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.array(last[0], F.greatest(last[1], r[1]))))
        return F.when(meets, longer).otherwise(F.concat(done, F.array(r)))

    ranges = F.aggregate(F.array_sort("hit"), F.array().cast("array<array<int>>"), joined)
    return merged.select("key", "n_words", ranges.alias("hit"), F.array_sort(F.array_distinct("items")).alias("items"))


def _without(text: bytes, ranges: list[list[int]]) -> bytes:
    """The text less the bytes from the first to the last word of each range."""
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    out, last = [], 0
    for a, b in ranges:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def _cleaned(batches: Iterator[pa.RecordBatch], shared, column: int, min_items: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, column):
        texts = texts_of(batch.column(column))
        _, hits = _scanned(texts, shared.value)
        if not any(hits):
            yield batch
            continue
        keep = [len({i for h in x for i in h[2]}) < min_items for x in hits]
        old = batch.column(column).to_pylist()
        new = pa.array([_without(t, _ranges(h)).decode() if h else o for t, h, o in zip(texts, hits, old, strict=True)], batch.schema.field(column).type)
        yield batch.set_column(column, batch.schema.field(column), new).filter(pa.array(keep))


def _cut(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Documents, all columns and last their hit ranges, their texts without those ranges."""
    for batch in batches:
        old, ranges = batch.column(column).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        new = pa.array([_without(o.encode(), r).decode() if r else o for o, r in zip(old, ranges, strict=True)], batch.schema.field(column).type)
        yield batch.set_column(column, batch.schema.field(column), new)


def clean(docs: DataFrame, items: DataFrame, n: int = 8, min_items: int = 2, block_windows: int = BLOCK, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, all columns, without those that windows of ``min_items`` items or more occur in, and without the hit spans in the rest.

    The first and last word of a hit range and all between them go; documents without a hit stay as they are.
    """
    small_batches(docs.sparkSession)
    column = docs.columns.index(text)
    blocks = _blocks(items, n, block_windows, item_key, item_text)
    if len(blocks) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(_window_set(blocks[0]))
        return map_rows(docs, lambda it: _cleaned(it, shared, column, min_items))
    whole = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")), "numbered")
    hits = _united(whole.select(F.col("row").alias("key"), F.col("doc")[text].alias("value")), blocks, "bigint")
    kept = whole.join(hits.where(F.size("items") < min_items), F.col("row") == F.col("key")).select("doc.*", F.col("hit").alias("__hit_ranges"))
    return map_rows(kept, lambda it: _cut(it, column)).toDF(*docs.columns, "__hit_ranges").drop("__hit_ranges")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns of :func:`find`'s rows."""
    hit = F.aggregate("hit", F.lit(0).cast("long"), lambda acc, r: acc + r[1] - r[0])
    return found.select(key, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
