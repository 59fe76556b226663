"""Names of grams counted in tasks: tallies, arrays that are dealt to shards, and sets and tables of names that tasks hold."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap, where its three probes are taken from a name, and rows a task counts before it hands them on, and at most as many of them in a batch.
BITS, PROBES, COUNTED, SENT = 27, (37, 27, 16), 1 << 19, 1 << 17
#: Tokens of the corpus for each shard.
SHARD = 1 << 22


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a gram by those of its first and last tokens: what xxhash64(a, b) is as a column."""
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    out = np.uint64(42)
    for x in (a, b):
        out = (out + p5 + np.uint64(8)) ^ turn(x * p2, 31) * p1
        out = turn(out, 27) * p1 + p4
        out = (out ^ (out >> np.uint64(33))) * p2
        out = (out ^ (out >> np.uint64(29))) * p3
        out ^= out >> np.uint64(32)
    return out


class Bitmap:
    """Whether a name may be one of a set: 2**BITS bits, whatever the set, of which a name has three.

    They are taken from the name's first 48 bits.
    """

    def __init__(self, names: DataFrame):
        name = names[names.columns[0]]
        places = F.array(*[F.shiftrightunsigned(name, s).bitwiseAND(F.lit((1 << BITS) - 1)) for s in PROBES])
        rows = names.select(F.explode(places).alias("place")).select(F.shiftright("place", 6).alias("at"), F.expr("1L").alias("one"), (F.col("place") % 64).cast("int").alias("bit"))
        rows = rows.groupBy("at").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).toArrow()  # 2**(BITS - 6) rows at most
        self.table = np.zeros(1 << (BITS - 6), dtype=np.uint64)
        self.table[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)

    def __getstate__(self) -> bytes:
        return zlib.compress(self.table.tobytes(), 1)  # a small set travels as a few bytes

    def __setstate__(self, raw: bytes) -> None:
        self.table = np.frombuffer(zlib.decompress(raw), dtype=np.uint64)

    def has(self, names: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(names), dtype=bool), np.arange(len(names))
        for s in PROBES:
            place = (names[todo] >> np.uint64(s)) & np.uint64((1 << BITS) - 1)
            todo = todo[(self.table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0]
        out[todo] = True
        return out


class Hot:
    """The place of each of some names in a sorted array, found by its first bits."""

    BITS = 21

    def __init__(self, names: np.ndarray):
        self.names, self.shift = names, np.uint64(64 - self.BITS)
        self.begin = np.searchsorted(names >> self.shift, np.arange((1 << self.BITS) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, names: np.ndarray) -> np.ndarray:
        """-1 where there is none."""
        first = (names >> self.shift).astype(np.int64)
        at, end = self.begin[first], self.begin[first + 1]
        out, todo = np.full(len(names), -1, dtype=np.int64), np.flatnonzero(at < end)
        at, end = at[todo], end[todo]
        while len(todo):
            same = self.names[at] == names[todo]
            out[todo[same]] = at[same]
            at = at + 1
            left = np.flatnonzero(~same & (at < end))
            todo, at, end = todo[left], at[left], end[left]
        return out


class Tally:
    """Times of rows by key within a task, handed on in batches when there are many."""

    def __init__(self, names: list[str]):
        self.names, self.parts, self.held, self.merged = names, [], 0, 0

    def _merge(self) -> None:
        key, n, *more = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(key)
        key = key[order]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        self.parts = [(key[heads], np.add.reduceat(n[order], heads), *[x[order[heads]] for x in more])]
        self.held = self.merged = len(heads)

    def put(self, key: np.ndarray, *more: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        if len(key):
            self.parts.append((key, np.ones(len(key), dtype=np.int64), *more))
            self.held += len(key)
            if self.held > self.merged + COUNTED:
                self._merge()
            if self.merged > COUNTED:
                yield from self.take()

    def take(self) -> Iterator[tuple[np.ndarray, ...]]:
        """All that is held: keys, times, and the other columns."""
        if self.held:
            self._merge()
            yield self.parts[0]
            self.parts, self.held, self.merged = [], 0, 0

    def _batches(self, parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        for _, n, *more in parts:
            columns = [*[x.view(np.int64) for x in more], n]
            for i in range(0, len(n), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in columns], self.names)

    def add(self, key: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from self._batches(self.put(key, *more))

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self._batches(self.take())


def dealt(parts: Iterator[tuple[np.ndarray, ...]], shards: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Counted rows (key, times, other columns) as arrays, one for each of shards ranges of keys: shard, names of the others, n.

    A shard's arrays are added up in one place; keys are alike in all shards, so a frequent one is a row a task there.
    """
    for key, n, *more in parts:
        shard = (key % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(shard[order]) != 0)), len(order))
        shard, columns = shard[order], [x[order] for x in (*more, n.astype(np.uint32))]
        first = 0
        while first < len(cuts) - 1:  # some shards at a time, so that no batch is large
            last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + SENT, side="right")) - 1)
            some = list(zip(cuts[first:last], cuts[first + 1 : last + 1]))
            yield pa.RecordBatch.from_arrays([pa.array(shard[cuts[first:last]]), *[pa.array([x[i:j].tobytes() for i, j in some], pa.binary()) for x in columns]], ["shard", *names, "n"])
            first = last


def dealt_schema(names: list[str]) -> str:
    return ", ".join(["shard int", *[f"{x} binary" for x in (*names, "n")]])


def gathered(table: pa.Table, names: list[str], key) -> list[np.ndarray]:
    """The arrays of a shard added up: times and columns of each key, in the keys' order.  key: columns to keys."""
    columns = [np.frombuffer(b"".join(table[c].to_pylist()), dtype=np.uint64) for c in names]
    n = np.frombuffer(b"".join(table["n"].to_pylist()), dtype=np.uint32).astype(np.int64)
    with np.errstate(over="ignore"):
        keys = key(*columns)
    order = np.argsort(keys)
    heads = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
    return [np.add.reduceat(n[order], heads), *[x[order[heads]] for x in columns]]
