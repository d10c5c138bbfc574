"""SimHash near-duplicate detection by anchor-point covering.

Fingerprint: the text's A-Z are lower-cased, words are runs of anything but ASCII white space, and each shingle of
``words`` consecutive words (repeats included, space-joined; fewer words: all of them) is hashed with XXH64, seed 42.
A bit is 1 if more than half of the hashes have it.  No words: zero.

Search: the 64 bits are dealt to blocks.  Two fingerprints with at most ``distance`` differing bits differ in at most
``distance // blocks`` bits of some block.  The anchors of a block are a covering code: a Hamming code over its first 15 or
31 bits with all values of the others, of covering radius 1.  A fingerprint is at home at its nearest anchor and is
replicated to every anchor of each block within radius plus threshold; whatever is within the threshold of a fingerprint
therefore visits the fingerprint's home, and homes are compared with visitors per anchor.

The code follows the number of fingerprints (:func:`plan_for`): three blocks have few anchors, which costs few visits but
fills them up as fingerprints grow in number; two blocks of 32 bits have about a hundred times fewer pairs for eight times
the visits.  Both find the same links.

Links inside an anchor come out as stars around their smallest member, never as all pairs, and components of the stars
are found by alternating large-star and small-star rounds over distributed tables.  Equal fingerprints are one node, so a
group of copies costs one row.  Anchors with very many homes are split by salt.

Null and empty texts have fingerprint zero and are linked like any other.  Rows without id take part in linking; the
component's id is the smallest that is not null.  Repeated rows give repeated results, an empty table an empty one.  A very
long text is hashed whole, some shingles at a time.  Only the id and text columns are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurigrade.llm.common import drop_stored, slices, small_batches, stored, texts_of

#: Homes of one anchor above which the anchor is split.
HOT_HOMES = 20_000
#: Pairs compared at once, and shingles hashed at once.
PAIRS, SHINGLES = 1 << 21, 1 << 15
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Rows of anchors and fingerprints that one task makes, about.
PLACED = 4_000_000
#: What a row that is shuffled costs, in pairs compared.
ROW_COST = 100


@dataclass(frozen=True)
class Plan:
    """Widths of the blocks, and how many bits of each the Hamming code is over, as a power of two less one."""

    widths: tuple[int, ...]
    coded: int

    def rows(self, distance: int) -> int:
        """Anchors that a fingerprint visits, at most, and its homes."""
        radius = 1 + distance // len(self.widths)
        return sum(1 + -(-sum(comb(w, k) for k in range(radius + 1)) // (self.coded + 1)) for w in self.widths)

    def pairs(self, distance: int) -> float:
        """Share of all pairs that meet, if fingerprints lie evenly."""
        radius = 1 + distance // len(self.widths)
        return sum(sum(comb(w, k) for k in range(radius + 1)) / 2.0**w for w in self.widths)


PLANS = (Plan((22, 21, 21), 15), Plan((32, 32), 31))


def plan_for(n: int, distance: int) -> Plan:
    """The plan whose rows and pairs cost least for so many fingerprints."""
    return min(PLANS, key=lambda p: ROW_COST * p.rows(distance) * n + p.pairs(distance) * n * n)


def fingerprint(text: bytes, words: int = 4) -> int:
    from xxhash import xxh64_intdigest as h

    parts = text.translate(_LOWER).split()
    n = len(parts)
    if not n:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=n) + 1)
    k = min(words, n)
    begin = np.concatenate([[0], ends[: n - k]]).tolist()
    stop = (ends[k - 1 :] - 1).tolist()
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(begin), SHINGLES):
        hashes = np.array([h(joined[a:b], 42) for a, b in zip(begin[i : i + SHINGLES], stop[i : i + SHINGLES], strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > len(begin)))


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def _fingerprinted(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        prints = _signed([fingerprint(t, words) for t in texts_of(batch.column(1))])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["key", "fp"])


def fingerprints(docs: DataFrame, words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp`` (the 64 bits as a signed long) of each whole text."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("value")).mapInArrow(lambda it: _fingerprinted(it, words), f"key {kind}, fp long")


class Anchors:
    """The covering code of one block and the error patterns that lead from a value to the anchors around it."""

    def __init__(self, width: int, radius: int, coded: int = 15) -> None:
        self.width, self.coded = width, coded
        flips = np.zeros(1, dtype=np.int64)
        for _ in range(radius):
            flips = np.unique(np.concatenate([flips, *(flips ^ (1 << b) for b in range(width))]))
        of = np.zeros(len(flips), dtype=np.int64)
        for b in range(coded):
            of ^= np.where((flips >> b) & 1, b + 1, 0)
        self.around = [flips[of == s] for s in range(coded + 1)]

    def syndrome(self, values: np.ndarray) -> np.ndarray:
        s = np.zeros(len(values), dtype=np.int64)
        for b in range(self.coded):
            s ^= ((values >> b) & 1) * (b + 1)
        return s

    def home(self, values: np.ndarray) -> np.ndarray:
        """The anchor within distance 1."""
        s = self.syndrome(values)
        return values ^ np.where(s > 0, np.int64(1) << np.maximum(s - 1, 0), 0)

    def near(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the values and the anchors within the radius of each."""
        s = self.syndrome(values)
        index, anchor = [], []
        for k, flips in enumerate(self.around):
            at = np.flatnonzero(s == k)
            index.append(np.repeat(at, len(flips)))
            anchor.append((values[at][:, None] ^ flips[None, :]).ravel())
        return np.concatenate(index), np.concatenate(anchor)


def _block_values(fp: np.ndarray, plan: Plan) -> list[np.ndarray]:
    unsigned, shift, out = fp.view(np.uint64), 0, []
    for w in plan.widths:
        out.append(((unsigned >> np.uint64(shift)) & np.uint64((1 << w) - 1)).astype(np.int64))
        shift += w
    return out


def _placed(batches: Iterator[pa.RecordBatch], distance: int, plan: Plan, homes_only: bool) -> Iterator[pa.RecordBatch]:
    """``anchor, visitor, fp``: a fingerprint's home (visitor false) and, with it, every anchor that it visits."""
    codes = [Anchors(w, 1 + distance // len(plan.widths), plan.coded) for w in plan.widths]
    for batch in batches:
        whole = batch.column(0).to_numpy()
        for i in range(0, len(whole), 4096):
            fp = whole[i : i + 4096]
            for k, (code, values) in enumerate(zip(codes, _block_values(fp, plan), strict=True)):
                tag = np.int64(k) << 40
                home = code.home(values)
                yield pa.RecordBatch.from_arrays([pa.array(home | tag), pa.array(np.zeros(len(fp), dtype=bool)), pa.array(fp)], ["anchor", "visitor", "fp"])
                if not homes_only:
                    at, anchor = code.near(values)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor | tag), pa.array(np.ones(len(at), dtype=bool)), pa.array(fp[at])], ["anchor", "visitor", "fp"])


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links as stars: each node but the smallest of its component, and that smallest one."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[off], nodes[label[off]]


def _compared(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Stars of links from rows ``(anchor, salt), visitor, fp`` in that order; only the homes of an unfinished anchor are carried on."""
    carried_key, carried = None, np.empty(0, dtype=np.int64)
    for batch in batches:
        key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        visitor, fp = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
        if not len(fp):
            continue
        if carried_key is not None and (carried_key == key[:, 0]).all():
            n = len(carried)
            key = np.concatenate([np.repeat(carried_key[:, None], n, axis=1), key], axis=1)
            visitor, fp = np.concatenate([np.zeros(n, dtype=bool), visitor]), np.concatenate([carried, fp])
        first = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
        stop = np.append(first[1:], len(fp))
        group = np.repeat(np.arange(len(first)), stop - first)
        homes = np.bincount(group, weights=~visitor, minlength=len(first)).astype(np.int64)
        at = np.flatnonzero(visitor)
        pairs = homes[group[at]]
        total = np.concatenate([[0], np.cumsum(pairs)])
        found_a, found_b = [], []
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS, side="right")) - 1)
            n = pairs[i:j]
            v = np.repeat(at[i:j], n)
            h = np.repeat(first[group[at[i:j]]] - (np.cumsum(n) - n), n) + np.arange(len(v))
            near = (np.bitwise_count((fp[v] ^ fp[h]).view(np.uint64)) <= distance) & (fp[v] != fp[h])
            if near.any():
                a, b = _stars(fp[v[near]], fp[h[near]])
                found_a.append(a)
                found_b.append(b)
            i = j
        carried_key, last = key[:, -1], int(first[-1])
        carried = fp[last : last + int(homes[-1])]
        if found_a:
            a, b = _stars(np.concatenate(found_a), np.concatenate(found_b))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def star_links(prints: DataFrame, distance: int = 4, hot_homes: int = HOT_HOMES, plan: Plan | None = None) -> DataFrame:
    """``a, b``: links that join all fingerprints (distinct, stored, column ``fp``) that a chain of links of at most ``distance`` bits joins."""
    n = prints.count()
    plan = plan or plan_for(n, distance)
    # A fingerprint becomes tens or hundreds of rows, so few of them are a task's work already.
    dealt = prints.select("fp").repartition(max(1, -(-n * plan.rows(distance) // PLACED)), "fp")
    placed = dealt.mapInArrow(lambda it: _placed(it, distance, plan, False), "anchor long, visitor boolean, fp long")
    homes = prints.select("fp").mapInArrow(lambda it: _placed(it, distance, plan, True), "anchor long, visitor boolean, fp long")
    hot = stored(homes.groupBy("anchor").count().where(F.col("count") > hot_homes).select("anchor", F.ceil(F.col("count") / hot_homes).cast("int").alias("salts")), "hot-anchors")
    if hot.isEmpty():
        dealt = placed.withColumn("salt", F.lit(0))
    else:
        one = F.array(F.pmod(F.xxhash64("fp"), F.coalesce("salts", F.lit(1)).cast("long")).cast("int"))
        every = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
        dealt = placed.join(hot, "anchor", "left").select("anchor", F.explode(F.when(F.col("visitor"), every).otherwise(one)).alias("salt"), "visitor", "fp")
    rows = dealt.select("anchor", "salt", "visitor", "fp").repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "visitor")
    return rows.mapInArrow(lambda it: _compared(it, distance), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, root``: for every node of the links (columns ``a, b``) but the root, the smallest node of its component.

    Each round sends every node's larger neighbours, then its smaller ones, to the smallest it knows, and writes the
    links into the shared folder; rounds end when the links stay the same.
    """
    apart = lambda df: df.where("a <> b").distinct()
    edges = stored(apart(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The minima are tables of their own, so that a join with them is broadcast while they are small, and beyond that
        # split by Spark where the node in the middle of a star has very many links.
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "links")
        large = stored(apart(both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))), "links")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "links")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new = stored(apart(small), "links")
        for old in (edges, low, large, least):
            drop_stored(old)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def linked(prints: DataFrame, distance: int = 4) -> DataFrame:
    """``key, fp, root``: the rows of a stored table (columns ``key, fp``) with the fingerprint that stands for their component."""
    nodes = prints.select("fp").distinct()
    roots = components(star_links(nodes, distance))
    return prints.join(roots, prints["fp"] == roots["node"], "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fingerprint, component_id``: the fingerprint in hex and the smallest id of the component, itself included."""
    prints = stored(fingerprints(docs, words, key, text), "fingerprints")
    # Per fingerprint first, so that the largest group of copies is one row wherever rows of a key meet.
    nodes = stored(prints.groupBy("fp").agg(F.min("key").alias("key")), "nodes")
    rooted = linked(nodes, distance)
    lowest = rooted.groupBy("root").agg(F.min("key").alias("component_id"))
    classes = rooted.join(lowest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 4, distance: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, one of each component: the one with the smallest id, the first stored of equals; without an id only if none has one."""
    row, whole = "row", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    held = stored(docs.select(F.monotonically_increasing_id().alias(row), whole), "numbered")
    keyed = held.select(F.struct(F.col("doc")[key].isNull().alias("no"), F.col("doc")[key].alias("key"), row).alias("key"), F.col("doc")[text].alias("text"))
    prints = stored(fingerprints(keyed, words, "key", "text").groupBy("fp").agg(F.min("key").alias("key")), "nodes")
    first = linked(prints, distance).groupBy("root").agg(F.min("key").alias("key")).select(F.col("key.row").alias(row))
    return held.join(first, row, "left_semi").select("doc.*")


