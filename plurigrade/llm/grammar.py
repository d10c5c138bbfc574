"""Token ids in shard files compressed by Re-Pair grammars.

Documents are laid out in ascending id order (ties by text) and dealt to contiguous shards of about ``SHARD_IDS`` ids.
In each shard the frequent adjacent id pairs are replaced by nonterminals again and again; the shard file holds the
rules, the length that each nonterminal expands to, the remaining sequence and the documents' lengths.  Lengths give
random access: :func:`read_range` expands only the symbols that overlap the wanted ids.

A shard file is one binary blob, written by Spark as a row of a Parquet table so that any store Spark writes to will do:
magic ``RPG2``; twelve little-endian uint32, namely the version, the number of terminals, and the count, then the bits a
value, of the arrays named in ``_LAYOUT``; those arrays, bit-packed; the CRC-32 of all before.

Null text is empty and holds the end id only.  Repeated rows are laid out one after the other, rows without id last.  A
very long text is one document of a shard that is longer for it.  An empty table makes no shard and reads back empty.
Ids may be of any type that Spark orders and Arrow holds.  Only the id and text columns are read, so others may have any names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plurigrade.llm.bpe import codec, take_ranges
from plurigrade.llm.common import slices, small_batches, texts_of

#: Ids after which a shard is closed; a longer document makes a longer shard.
SHARD_IDS = 1 << 19
#: A pair is replaced if it stands at least so often: rules for rarer pairs take more room than they save.
LEAST = 8
#: Most slots of the table that counts pairs, as a power of two: it should fit a core's cache.
SLOT_BITS = 18
_MAGIC = b"RPG2"
_LAYOUT = ("left", "right", "expands", "sequence", "lengths")
_HASH = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.int32(2**31 - 1)
#: Rounds that go over the whole sequence.
WHOLE = 2
#: Values that are packed at once; a multiple of eight, so that slabs end at bytes.
_SLAB = 1 << 16


def _ranked(key: np.ndarray, odd: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rank of each pair that counts (``_NEVER`` if it is rare), whether it may still be frequent, and the pairs by rank.

    Pairs are counted in a hash table in which each slot holds one of its pairs; the others wait for a round with another
    hash.  A pair that holds its slot and is rare is rare for good.
    """
    bits = min(SLOT_BITS, max(4, len(key).bit_length() + 1))
    slots = 1 << bits
    slot = ((key.view(np.uint64) * (_HASH + np.uint64(2 * turn))) >> np.uint64(64 - bits)).astype(np.int32)
    holder = np.empty(slots, dtype=np.int64)
    holder[slot] = key
    other = holder[slot] != key
    # What does not count goes to a slot beyond the table.
    counted = slot.copy()
    counted[other] = slots
    counted[odd] = slots
    count = np.bincount(counted, minlength=slots + 1)[:slots]
    frequent = np.flatnonzero(count >= LEAST)
    frequent = frequent[np.lexsort((holder[frequent], -count[frequent]))]
    rank_of = np.full(slots + 1, _NEVER, dtype=np.int32)
    rank_of[frequent] = np.arange(len(frequent), dtype=np.int32)
    own = rank_of[counted]
    going = other | (own < _NEVER)
    going[odd] |= rank_of[slot[odd]] < _NEVER
    return own, going, holder[frequent]


def _odd(twin: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Every other pair of runs of one symbol; ``twin`` are the pairs of equal symbols, ``joined`` those that overlap the one before."""
    place = np.arange(len(twin))
    return twin[(place - np.maximum.accumulate(np.where(joined, 0, place))) % 2 == 1] if len(twin) else twin


def _ruled(own: np.ndarray, won: np.ndarray, pairs: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs that won where they stand, those that did so often enough: their places, their names there, and the pairs that get rules."""
    used = np.bincount(own[won], minlength=len(pairs))
    ruled = np.flatnonzero(used >= LEAST)
    name = np.zeros(len(pairs), dtype=np.int64)
    name[ruled] = symbols + np.arange(len(ruled))
    won = won[used[own[won]] >= LEAST]
    return won, name[own[won]], pairs[ruled]


def compress(ids: np.ndarray, terminals: int) -> dict[str, np.ndarray]:
    """Rules (``left``, ``right``, ``expands``) and ``sequence`` of a Re-Pair grammar of the ids.

    Symbols from ``terminals`` on are nonterminals.  A round counts the adjacent pairs that still may be frequent, ranks
    those that stand at least ``LEAST`` times by frequency, and replaces each occurrence that ranks above both that it
    overlaps; rounds end when no pair of the sequence stands so often without overlapping itself.

    A pair of old symbols never gains an occurrence, so once it is known to be rare its places are not looked at again.  The
    first rounds, in which most places change, go over the whole sequence; then it is linked, and rounds go over what changed.
    """
    s = ids.astype(np.int64)
    rules: list[np.ndarray] = []
    symbols, turn = terminals, 0
    active = np.ones(len(s), dtype=bool)
    while turn < WHOLE and len(s) > LEAST:
        twin = np.flatnonzero(s[:-1] == s[1:])
        own, going, pairs = _ranked((s[:-1] << 32) | s[1:], _odd(twin, np.diff(twin, prepend=-2) == 1), turn)
        turn += 1
        rank = np.full(len(s) + 1, _NEVER, dtype=np.int32)
        rank[1:-1] = own
        chosen, names, new = _ruled(own, np.flatnonzero((own < rank[:-2]) & (own < rank[2:])), pairs, symbols)
        rules.append(new)
        symbols += len(new)
        s[chosen] = names
        keep = np.ones(len(s), dtype=bool)
        keep[chosen + 1] = False
        active = np.append(going, False)
        active[chosen] = True
        active[chosen[chosen > 0] - 1] = True
        s, active = s[keep], active[keep]
    n = len(s)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    alive = np.ones(n, dtype=bool)
    rank = np.full(n + 1, _NEVER, dtype=np.int32)
    at = np.flatnonzero(active[:-1]).astype(np.int32)
    while len(at) >= LEAST:
        a, to = s[at], after[at]
        b = s[to]
        twin = np.flatnonzero(a == b)
        own, going, pairs = _ranked((a << 32) | b, _odd(twin, np.append(False, to[twin[:-1]] == at[twin[1:]])[: len(twin)]), turn)
        turn += 1
        # The first place has no pair before it: index -1 is the last, which never ranks.
        rank[at] = own
        chosen, names, new = _ruled(own, np.flatnonzero((own < rank[before[at]]) & (own < rank[to])), pairs, symbols)
        rank[at] = _NEVER
        rules.append(new)
        symbols += len(new)
        chosen, at = at[chosen], at[going]
        gone = after[chosen]
        s[chosen], alive[gone] = names, False
        beyond = after[gone]
        after[chosen] = beyond
        inner = beyond < n
        before[beyond[inner]] = chosen[inner]
        # New pairs begin at what was replaced and just before it.
        fresh = before[chosen]
        again = np.zeros(n, dtype=bool)
        again[at] = True
        again[chosen] = True
        again[fresh[fresh >= 0]] = True
        at = np.flatnonzero(again & alive).astype(np.int32)
        if len(at) and after[at[-1]] >= n:
            at = at[:-1]
    pairs = np.concatenate(rules) if rules else np.empty(0, dtype=np.int64)
    a, b = pairs >> 32, pairs & 0xFFFFFFFF
    return {"left": a, "right": b, "expands": expanded_lengths(a, b, terminals)[terminals:], "sequence": s[alive]}


def expanded_lengths(left: np.ndarray, right: np.ndarray, terminals: int) -> np.ndarray:
    """Ids that each symbol stands for."""
    n = np.ones(terminals + len(left), dtype=np.int64)
    a, b = left.tolist(), right.tolist()
    out = n.tolist()
    for i in range(len(a)):
        out[terminals + i] = out[a[i]] + out[b[i]]
    return np.array(out, dtype=np.int64)


def expand(symbols: np.ndarray, rules: dict[str, np.ndarray], terminals: int) -> np.ndarray:
    """The ids that the symbols stand for: each rule is opened once, and the symbols gather their ids from these."""
    opened: list[list[int]] = []
    for a, b in zip(rules["left"].tolist(), rules["right"].tolist(), strict=True):
        opened.append((opened[a - terminals] if a >= terminals else [a]) + (opened[b - terminals] if b >= terminals else [b]))
    size = np.concatenate([np.ones(terminals, dtype=np.int64), rules["expands"].astype(np.int64)])
    start = np.cumsum(size) - size
    pool = np.concatenate([np.arange(terminals), np.array([i for x in opened for i in x], dtype=np.int64)]).astype(np.uint32)
    return take_ranges(pool, start[symbols], size[symbols])


def packed(values: np.ndarray, width: int) -> bytes:
    """The values in so many bits each, high bits first."""
    wide = values.astype(">u4")
    parts = [np.packbits(np.unpackbits(wide[i : i + _SLAB].view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width :]) for i in range(0, len(wide), _SLAB)]
    return b"".join(x.tobytes() for x in parts)


def unpacked(data: bytes, at: int, count: int, width: int) -> np.ndarray:
    """``count`` values of so many bits each, from byte ``at`` on; what :func:`packed` packed."""
    out = np.empty(count, dtype=np.uint32)
    raw = np.frombuffer(data, dtype=np.uint8, count=-(-count * width // 8), offset=at)
    for i in range(0, count, _SLAB):
        n = min(_SLAB, count - i)
        bits = np.zeros((n, 32), dtype=np.uint8)
        bits[:, 32 - width :] = np.unpackbits(raw[i * width // 8 :], count=n * width).reshape(n, width)
        out[i : i + n] = np.packbits(bits, axis=1).view(">u4").ravel()
    return out


def pack(grammar: dict[str, np.ndarray], lengths: np.ndarray, terminals: int) -> bytes:
    """A shard file: each array in as many bits a value as its largest needs."""
    parts = {**grammar, "lengths": lengths}
    widths = [max(1, int(parts[k].max()).bit_length()) if len(parts[k]) else 1 for k in _LAYOUT]
    body = _MAGIC + struct.pack("<12I", 2, terminals, *(len(parts[k]) for k in _LAYOUT), *widths) + b"".join(packed(parts[k], w) for k, w in zip(_LAYOUT, widths, strict=True))
    return body + struct.pack("<I", zlib.crc32(body))


def unpack(blob: bytes) -> tuple[dict[str, np.ndarray], int]:
    """The arrays of a shard file and the number of terminals; raises if it is damaged."""
    if blob[:4] != _MAGIC or struct.unpack("<I", blob[-4:])[0] != zlib.crc32(memoryview(blob)[:-4]):
        raise ValueError("damaged shard file")
    _, terminals, *sizes = struct.unpack("<12I", blob[4:52])
    at, parts = 52, {}
    for k, n, w in zip(_LAYOUT, sizes[:5], sizes[5:], strict=True):
        parts[k] = unpacked(blob, at, n, w)
        at += -(-n * w // 8)
    return parts, terminals


def read_range(blob: bytes, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a shard, expanding only the symbols that overlap them."""
    parts, terminals = unpack(blob)
    size = np.concatenate([np.ones(terminals, dtype=np.int64), parts["expands"]])[parts["sequence"]]
    ends = np.cumsum(size)
    a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop)
    before = int(ends[a - 1]) if a else 0
    return expand(parts["sequence"][a : b + 1], parts, terminals)[start - before : stop - before]


def _shards(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    own, part, serial = codec(tokenizer), TaskContext.get().partitionId(), 0
    terminals = max(len(own.length), end_id + 1)
    keys: list = []
    held: list[np.ndarray] = []
    end = np.array([end_id], dtype="<u4")

    def shard() -> pa.RecordBatch:
        ids = np.concatenate([x for one in held for x in (one, end)])
        lengths = np.array([len(x) + 1 for x in held])
        blob = pack(compress(ids, terminals), lengths, terminals)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([serial], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([keys], pa.list_(kind)), pa.array([blob], pa.binary())], ["part", "serial", "n_ids", "keys", "blob"])

    n = 0
    for batch in slices(batches):
        for k, ids in zip(batch.column(0).to_pylist(), own.encode(texts_of(batch.column(1))), strict=True):
            keys.append(k)
            held.append(ids)
            n += len(ids) + 1
            if n >= SHARD_IDS:
                yield shard()
                keys, held, n, serial = [], [], 0, serial + 1
    if held:
        yield shard()


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write the shard files in ascending order of ``key``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("value"))
    # The hash splits a key that very many rows share; equal hashes are equal texts but for accidents, whose order is the hash's.
    tie = F.xxhash64("value")
    laid = rows.repartitionByRange(F.col("key").asc_nulls_last(), tie).sortWithinPartitions(F.col("key").asc_nulls_last(), tie)
    kind = docs.schema[key].dataType.simpleString()
    arrow = to_arrow_type(docs.schema[key].dataType)
    laid.mapInArrow(lambda it: _shards(it, tokenizer, end_id, arrow), f"part int, serial int, n_ids long, keys array<{kind}>, blob binary").write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            blob = batch.column(3)[i].as_py()
            parts, terminals = unpack(blob)
            ids = expand(parts["sequence"], parts, terminals).astype("<u4")
            lengths = parts["lengths"].astype(np.int64)
            ends = np.cumsum(lengths)
            keys = batch.column(2)[i].values
            n = len(lengths)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), pa.int32())
            at = pa.array(ends - lengths, pa.int64())
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * n, pa.int32()), pa.array([batch.column(1)[i].as_py()] * n, pa.int32()), keys, at, lists], ["part", "serial", "key", "at", "ids"])


def _placed(spark: SparkSession, path: str, opened, columns: str) -> DataFrame:
    """``key, start`` and the given columns of every document, as ``opened`` makes them from the shard files."""
    files = spark.read.parquet(path)
    kind = files.schema["keys"].dataType.elementType.simpleString()
    sizes = files.select("part", "serial", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row per partition of the writer: a count that its configuration bounds.
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("serial")) - F.col("n_ids")
    starts = sizes.select("part", "serial", within.alias("within")).join(before, "part").select("part", "serial", (F.col("before") + F.col("within")).alias("first"))
    rows = files.select("part", "serial", "keys", "blob").mapInArrow(opened, f"part int, serial int, key {kind}, at long, {columns}")
    return rows.join(starts, ["part", "serial"]).withColumn("start", F.col("first") + F.col("at"))


def read_shards(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key, start, ids`` of every document in the shard files at ``path``; ``start`` counts the ids of all before it."""
    return _placed(spark, path, _documents, "ids array<int>").select(F.col("key").alias(key), "start", "ids")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its place, length and checksum, straight from the expanded shard."""
    for batch in batches:
        for i in range(batch.num_rows):
            parts, terminals = unpack(batch.column(3)[i].as_py())
            ids = expand(parts["sequence"], parts, terminals).astype("<u4")
            n = parts["lengths"].astype(np.int64)
            ends = np.cumsum(n)
            whole = memoryview(ids.tobytes())
            sums = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
            each = lambda k, rows=len(n), row=i, b=batch: pa.array([b.column(k)[row].as_py()] * rows, pa.int32())
            yield pa.RecordBatch.from_arrays([each(0), each(1), batch.column(2)[i].values, pa.array(ends - n), pa.array(n), pa.array(sums, pa.int64())], ["part", "serial", "key", "at", "n_tokens", "ids_crc32"])


def document_digests(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """The contract's columns, from the shard files at ``path``."""
    return _placed(spark, path, _digests, "n_tokens long, ids_crc32 long").select(F.col("key").alias(key), "start", "n_tokens", "ids_crc32")
