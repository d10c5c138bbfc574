"""Token counts by heap-and-linked-list byte-pair merging, without making ids.

The symbols of a text form a linked list.  A heap holds the adjacent pairs that are pieces, best rank first and the
leftmost of equals; popping one merges it and adds its new neighbours.  The count is the number of initial symbols less
the merges; a character that is no piece counts one for each of its bytes, as byte fallback has it.

Texts are first cut before each word mark that follows another character, where the vocabulary allows no piece to cross,
and fragments that are still long between any two characters that no piece has side by side.  Each distinct short fragment
is merged once per worker.  A model that normalises text, or has pieces of its users, is refused.

Null text is empty and has no tokens.  Repeated rows give repeated results, an empty table an empty one.  A very long text
is taken whole, its fragments some thousands at a time; one unbroken run that no cut divides needs about 40 bytes a character.
Only the id and text columns are read, so others may have any names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurigrade.llm.common import slices, small_batches, texts_of

#: Room for the fragments that a worker remembers, in bytes; beyond it forgets all and starts anew, which costs time only.
MEMO_BYTES = 96 << 20
#: Characters of the longest fragment that is remembered, and of a text whose fragments are listed at once.
LONGEST, SEGMENT = 48, 1 << 18
MARK = "▁"
_loaded: dict[str, MergeCounter] = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message; four-byte values as they stand."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        head = varint()
        kind = head & 7
        if kind == 0:
            yield head >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield head >> 3, data[at : at + size]
        at += size


def check_model(data: bytes) -> None:
    """Raise if a piece model does what the counter does not: it takes merges by rank, text as it stands, a mark before it and for each space, and bytes for unknown characters.

    Fixed values: field numbers and defaults of the public model format.
    """
    whole = list(_fields(data))
    trainer = dict(f for n, x in whole if n == 2 for f in _fields(x))
    normal = dict(f for n, x in whole if n == 3 for f in _fields(x))
    kinds = [dict(_fields(x)).get(3, 1) for n, x in whole if n == 1]
    wrong = {
        "its merges have no ranks": trainer.get(3, 1) != 2,
        "it has no bytes for unknown characters": not trainer.get(35, 0),
        "it marks white space behind words": bool(trainer.get(24, 0)),
        "it normalises characters": bool(normal.get(2, b"")),
        "it adds no mark before the text": not normal.get(3, 1),
        "it drops repeated white space": bool(normal.get(4, 1)),
        "it does not mark spaces": not normal.get(5, 1),
        "it has pieces that users defined": 4 in kinds,
    }
    if any(wrong.values()):
        raise ValueError("this piece model cannot be counted: " + ", ".join(k for k, v in wrong.items() if v))


class MergeCounter:
    """Counts the tokens that a byte-fallback piece model gives."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            check_model(f.read())
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = {i for i in range(model.vocab_size()) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        pieces = sorted((-model.get_score(i), i, model.id_to_piece(i)) for i in range(model.vocab_size()) if i not in special)
        self.rank = {p: r for r, (_, _, p) in enumerate(pieces)}
        self.pieces = [p for _, _, p in pieces]
        self.inside = inside = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        # Line ends and tabs in no longer piece stand alone; a mark after another character begins a fragment if no piece has that.
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in inside))
        if any(p[1] == MARK and p[0] != MARK for p in inside):
            self.fragment = re.compile(r"[\s\S]+")
        elif alone:
            self.fragment = re.compile(f"{MARK}*[^{MARK}{alone}]+|[{alone}]|{MARK}+")
        else:
            self.fragment = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.memo: dict[str, int] = {}
        self.room = MEMO_BYTES

    def merged(self, symbols: str) -> int:
        """Initial symbols less merges.

        The symbols are a list linked by two arrays.  The heap holds the pairs that merges make, as rank and place; those
        that stand at the beginning are sorted once and met in order beside it.
        """
        rank, pieces = self.rank, self.pieces
        get = rank.get
        n = len(symbols)
        bytewise = {c: len(c.encode()) for c in set(symbols) if c not in rank}
        total = n + sum((k - 1) * symbols.count(c) for c, k in bytewise.items()) if bytewise else n
        first = [r << 32 | i for i in range(n - 1) if (r := get(symbols[i : i + 2])) is not None] if n <= LONGEST else array("q", (r << 32 | i for i in range(n - 1) if (r := get(symbols[i : i + 2])) is not None))
        if not first:
            return total
        if n <= LONGEST:
            first.sort()
            text, before, after = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
        else:
            np.frombuffer(first, dtype=np.int64).sort()
            alike: dict[str, str] = {}
            text, before, after = [alike.setdefault(c, c) for c in symbols], array("i", range(-1, n - 1)), array("i", range(1, n + 1))
        heap: list[int] = []
        at, stop = 0, len(first)
        while True:
            if at < stop:
                entry = first[at]
                if heap and heap[0] < entry:
                    entry = heappop(heap)
                else:
                    at += 1
            elif heap:
                entry = heappop(heap)
            else:
                return total
            a = entry & 0xFFFFFFFF
            left, b = text[a], after[a]
            # What was merged away is empty; a pair that has changed since has another rank, or is met again in its place.
            if not left or b >= n:
                continue
            if get(left + text[b]) != entry >> 32:
                continue
            whole = pieces[entry >> 32]
            total -= 1 if not bytewise else bytewise.get(left, 1) + bytewise.get(text[b], 1) - 1
            text[a], text[b] = whole, ""
            after[a] = c = after[b]
            if c < n:
                before[c] = a
                r = get(whole + text[c])
                if r is not None:
                    heappush(heap, r << 32 | a)
            p = before[a]
            if p >= 0:
                r = get(text[p] + whole)
                if r is not None:
                    heappush(heap, r << 32 | p)

    def apart(self, part: str) -> list[str]:
        """A long fragment, cut between any two characters that no piece has side by side."""
        inside = self.inside
        cuts = [0, *(i for i in range(1, len(part)) if part[i - 1 : i + 1] not in inside), len(part)]
        return [part[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _counts(self, parts: list[str]) -> int:
        """The tokens of the fragments; short ones are remembered."""
        memo = self.memo
        try:
            return sum(map(memo.__getitem__, parts))
        except KeyError:
            pass
        total = 0
        for p in parts:
            n = memo.get(p)
            if n is None:
                if len(p) > LONGEST:
                    cut = self.apart(p)
                    n = self.merged(p) if len(cut) == 1 else sum(self._counts([x]) for x in cut)
                else:
                    n = self.merged(p)
                    size = 4 * len(p) + 150
                    if self.room < size:
                        memo.clear()
                        self.room = MEMO_BYTES
                    self.room -= size
                    memo[p] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        whole = MARK + text.replace(" ", MARK)
        if len(whole) <= SEGMENT:
            return self._counts(self.fragment.findall(whole))
        return sum(self._counts(list(x)) for x in batched((m[0] for m in self.fragment.finditer(whole)), 4096))


def counter(path: str) -> MergeCounter:
    """The counter of a model file, loaded once per worker."""
    if path not in _loaded:
        _loaded[path] = MergeCounter(path)
    return _loaded[path]


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = counter(path)
    for batch in slices(batches):
        texts = texts_of(batch.column(1))
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        counts = np.array([own.count(t.decode()) for t in texts], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(counts)], ["key", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, model: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of each whole text; ``over_limit`` if it has more than ``limit`` tokens."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("value"))
    return rows.mapInArrow(lambda it: _counted(it, model), f"key {kind}, n_bytes long, n_tokens long").select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
