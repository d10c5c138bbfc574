"""Byte-pair encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never end up within one token, so a text may be cut between
its two bytes: the merges on either side do not see each other.  Cuts are made where such a pair is a byte that is
no white space followed by white space, or a letter followed by a mark, because there the library's own pattern also ends
a piece whatever the context; and, in what is still long, between two letters, where its pattern takes either side as it
would the whole.  The fragments are encoded independently, each distinct short one once per worker, and their ids concatenated.

Null text is the empty text and gives no ids.  Repeated rows give repeated results, an empty table an empty one.  A very long
text is encoded whole, its fragments some at a time; a fragment that no cut divides is one call of the library.  Only the id
and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurigrade.llm.common import slices, small_batches, texts_of

#: Fragments of a generation that a worker remembers; a full generation becomes the old one, from which what is met again returns.
MEMO = 150_000
#: Bytes of the longest fragment that is remembered: so a generation has at most about 30 MB.
LONGEST = 64
#: New fragments that are encoded as one text, such texts handed to the library at once, and bytes of other fragments handed to it at once.
RUN, RUNS, ALONE = 256, 64, 1 << 18
#: Bytes of text whose fragments are told apart at once, and of different fragments above which they are not.
STEP, DISTINCT = 8 << 20, 4 << 20
_SPACE = b"\t\n\x0b\x0c\r "
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: ASCII marks but the apostrophe, which may begin a piece that goes on with letters.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Ranges that are gathered at once.
RANGES = 1 << 16
_APOSTROPHE = ord("'")
_loaded: dict[str, BytePairCodec] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, as character to byte."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def take_ranges(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``pool[start : start + length]`` of each range, one after the other; some ranges at a time, so that indexes stay small."""
    ends = np.cumsum(length)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=pool.dtype)
    shift = start - (ends - length)
    for i in range(0, len(ends), RANGES):
        a, b = int(ends[i - 1]) if i else 0, int(ends[min(i + RANGES, len(ends)) - 1])
        at = np.repeat(shift[i : i + RANGES], length[i : i + RANGES])
        at += np.arange(a, b)
        np.take(pool, at, out=out[a:b], mode="clip")
    return out


class Memory:
    """Ids of fragments, side by side in one array that grows."""

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {}
        self.pool, self.used = np.empty(1 << 20, dtype="<u4"), 0
        self.start, self.length = np.empty(1 << 16, dtype=np.int64), np.empty(1 << 16, dtype=np.int64)

    def add(self, fragments: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, m = len(self.index), len(fragments)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while n + m > len(self.start):
            self.start, self.length = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.length))
        self.pool[self.used : self.used + len(ids)] = ids
        self.length[n : n + m] = lengths
        self.start[n : n + m] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.index.update(zip(fragments, range(n, n + m), strict=True))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the fragments with these numbers, joined, and how many each has."""
        n = self.length[at]
        return take_ranges(self.pool, self.start[at], n), n


class BytePairCodec:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        tokens = {i: bytes(alphabet[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        tokens |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        ids = range(max(tokens) + 1)
        self.length = np.array([len(tokens.get(i, b"")) for i in ids], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in ids), dtype=np.uint8)
        self.inside = np.zeros((256, 256), dtype=bool)
        for token in tokens.values():
            pair = np.frombuffer(token, dtype=np.uint8)
            self.inside[pair[:-1], pair[1:]] = True
        white, letter, mark = (np.isin(np.arange(256), list(x)) for x in (_SPACE, _LETTERS, _MARKS))
        self.opens = (~self.inside & ((~white[:, None] & white[None, :]) | (letter[:, None] & mark[None, :]))).ravel()
        self.parts = (~self.inside & letter[:, None] & letter[None, :]).ravel()
        self.sticky = {b for b in range(256) if b in _SPACE or self.inside[b, list(_SPACE)].any()}
        self.memory, self.old = Memory(), Memory()

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Places of the certain cuts: between the two bytes of a forced boundary that also ends a piece in any context."""
        pair = data[:-1].astype(np.uint16) << 8
        pair |= data[1:]
        return np.flatnonzero(self.opens[pair]) + 1

    def finer(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Places of certain cuts between two letters, inside the fragments that are too long to be remembered."""
        found = []
        for i in np.flatnonzero(np.diff(edges) > LONGEST).tolist():
            a, b = int(edges[i]), int(edges[i + 1])
            own = data[a:b]
            at = np.flatnonzero(self.parts[own[:-1].astype(np.uint16) << 8 | own[1:]]) + 1
            # The letter after an apostrophe may be the first of an ending that the pattern takes as a piece.
            found.append(a + at[(at < 2) | (own[at - 2] != _APOSTROPHE)])
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)

    def _learn(self, missing: list[bytes], into: Memory) -> None:
        """Encode new fragments, joined into longer texts at their certain cuts and told apart by the bytes that the ids stand for."""
        joined, alone = [], []
        for f in missing:
            (joined if len(f) <= LONGEST and f[0] in _SPACE and f[-1] not in self.sticky else alone).append(f)
        for i in range(0, len(joined), RUN * RUNS):
            part = joined[i : i + RUN * RUNS]
            coded = self.library.encode_batch_fast([b"".join(part[j : j + RUN]).decode() for j in range(0, len(part), RUN)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in coded])
            stops = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(np.fromiter(map(len, part), dtype=np.int64, count=len(part)))) + 1
            into.add(part, ids, np.diff(stops, prepend=0))
        sizes = np.cumsum([len(f) for f in alone]) // ALONE
        for part in np.split(np.arange(len(alone)), np.flatnonzero(np.diff(sizes)) + 1) if alone else ():
            own = [alone[i] for i in part]
            ids = [np.array(e.ids, dtype="<u4") for e in self.library.encode_batch_fast([f.decode() for f in own], add_special_tokens=False)]
            into.add(own, np.concatenate(ids), np.array([len(x) for x in ids]))

    def _known(self, fragments: list[bytes]) -> np.ndarray:
        """The numbers of the fragments in memory, where those not met before come from the library."""
        missing = [f for f in fragments if f not in self.memory.index]
        if len(self.memory.index) + len(missing) > MEMO and self.memory.index:
            self.old, self.memory, missing = self.memory, Memory(), fragments
        before = self.old.index
        again = [f for f in missing if f in before]
        if again:
            self.memory.add(again, *self.old.take(np.array([before[f] for f in again])))
        if len(again) < len(missing):
            self._learn([f for f in missing if f not in before], self.memory)
        return np.fromiter(map(self.memory.index.__getitem__, fragments), dtype=np.int64, count=len(fragments))

    def _ids(self, fragments: list[bytes], sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct fragments in the order ``at``, joined, and how many each has; long ones are not remembered."""
        if not len(sizes) or sizes.max() <= LONGEST:
            number = self._known(fragments)
            return self.memory.take(number[at])
        long = np.flatnonzero(sizes > LONGEST)
        number = np.empty(len(fragments), dtype=np.int64)
        short = np.flatnonzero(sizes <= LONGEST)
        number[short] = self._known([fragments[i] for i in short])
        passing = Memory()
        self._learn([fragments[i] for i in long], passing)
        held = len(self.memory.index)
        number[long] = [held + passing.index[fragments[i]] for i in long]
        pool = np.concatenate([self.memory.pool[: self.memory.used], passing.pool[: passing.used]])
        start = np.concatenate([self.memory.start[:held], self.memory.used + passing.start[: len(long)]])
        length = np.concatenate([self.memory.length[:held], passing.length[: len(long)]])
        n = length[number[at]]
        return take_ranges(pool, start[number[at]], n), n

    def encode_flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and the places where each text's begin and the last one's end."""
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not len(data):
            return np.empty(0, dtype="<u4"), np.zeros(len(texts) + 1, dtype=np.int64)
        # Fragments of all texts together, some bytes at a time; texts begin anew, and empty ones have none.
        edges = np.sort(np.concatenate([self.cuts(data), bounds]), kind="stable")
        edges = edges[np.concatenate([[True], edges[1:] != edges[:-1]])]
        if len(more := self.finer(data, edges)):
            edges = np.sort(np.concatenate([edges, more]), kind="stable")
        steps = np.unique(np.append(np.searchsorted(edges, np.arange(0, len(data), STEP)), len(edges) - 1))
        ids, n = zip(*(self._fragments(data, edges[i : j + 1]) for i, j in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True)), strict=True)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(n))])[np.searchsorted(edges, bounds)]

    def _fragments(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the fragments between the edges, joined, and how many each has; where very many differ, in two halves."""
        split = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        if split.dictionary.nbytes > DISTINCT and len(edges) > 2:
            half = len(edges) // 2
            del split
            (a, n), (b, m) = self._fragments(data, edges[: half + 1]), self._fragments(data, edges[half:])
            return np.concatenate([a, b]), np.concatenate([n, m])
        _, offsets, content = split.dictionary.buffers()
        whole, to = content.to_pybytes(), np.frombuffer(offsets, dtype=np.int64, count=len(split.dictionary) + 1)
        sizes, to = np.diff(to), to.tolist()
        return self._ids([whole[a:b] for a, b in zip(to[:-1], to[1:], strict=True)], sizes, split.indices.to_numpy())

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, at = self.encode_flat(texts)
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for, special tokens kept."""
        return take_ranges(self.bytes, self.start[ids], self.length[ids]).tobytes()


def codec(path: str) -> BytePairCodec:
    """The codec of a vocabulary file, loaded once per worker."""
    if path not in _loaded:
        _loaded[path] = BytePairCodec(path)
    return _loaded[path]


def id_lists(ids: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), id_lists(*own.encode_flat(texts_of(batch.column(1))))], ["key", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in batches:
        lists = batch.column(1)
        flat, edge = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        texts = [own.decode(flat[a:b]).decode("utf-8", "replace") for a, b in zip(edge[:-1], edge[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["key", "ids", "decoded"])


def _keyed(docs: DataFrame, key: str, second: str) -> tuple[DataFrame, str]:
    small_batches(docs.sparkSession)
    return docs.select(F.col(key).alias("key"), F.col(second).alias("value")), docs.schema[key].dataType.simpleString()


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids``: the ids of each whole text, as the library gives them without added special tokens."""
    rows, kind = _keyed(docs, key, text)
    return rows.mapInArrow(lambda it: _encoded(it, tokenizer), f"key {kind}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, key: str = "key", ids: str = "ids") -> DataFrame:
    """``key, ids, decoded``: the text that the ids stand for; bytes that are no UTF-8 become U+FFFD.  A null list is an empty one."""
    rows, kind = _keyed(encoded, key, ids)
    rows = rows.withColumn("value", F.coalesce("value", F.array().cast("array<int>")))
    return rows.mapInArrow(lambda it: _decoded(it, tokenizer), f"key {kind}, ids array<int>, decoded string")


def round_trip(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`encode` and :func:`decode` of its ids, in one pass through the same worker."""
    rows, kind = _keyed(docs, key, text)
    return rows.mapInArrow(lambda it: _decoded(_encoded(it, tokenizer), tokenizer), f"key {kind}, ids array<int>, decoded string")


def digest(coded: DataFrame, key: str = "doc_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """The contract's columns of :func:`round_trip`'s rows, and more of theirs."""
    return coded.select(
        F.col("key").alias(key),
        *extra,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
