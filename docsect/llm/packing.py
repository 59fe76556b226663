"""Best-fit packing: best-fit decreasing over all documents, with a segment tree over remaining capacities.

Piece lengths are whole numbers up to the sequence length, so the packing of any corpus follows from how
many pieces have each length.  The driver gets that histogram (at most `capacity` rows, whatever the
corpus) and runs best-fit decreasing on it: for each length, the segment tree finds in logarithmic time
the tightest remaining capacity that fits, and equal pieces go into equal bins as one run.  The outcome is
that of placing the pieces one by one.  Pieces then find their run from their rank among pieces of the same
length: a rank inside the task that cut them plus the counts of the tasks before it, so no length, however
common, meets in one task.

Nulls and empty texts are the one-token document [0].  Repeated rows are packed as often as they occur;
doc_id may be null or repeated.  Ties between equal lengths go by task and by row inside it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsect.llm.common import SPACE, Scratch, groups, text_bytes, with_clear_names, word_hashes

CAPACITY = 2048
END = b"\0\0\0\0"
#: Units whose ids a Python worker remembers at most, and bytes of text it works on at once.
REMEMBERED = 1_500_000
AT_ONCE = 4 << 20
#: Bytes that may follow a space where a text is cut: neither a space nor the lead byte of a multi-byte one.
VISIBLE = ~SPACE
VISIBLE[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = False
#: The pattern that byte-level pre-tokenisation splits by.
PATTERN = public_tokenizers.PATTERN
_encoders: dict[str, Encoder] = {}


class CapacityTree:
    """Which remaining capacities have open bins; find() gives the smallest one that fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.bins: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, first: int, count: int) -> None:
        if not count:
            return
        self.bins.setdefault(room, []).append((first, count))
        node = self.size + room
        while node and not self.any[node]:
            self.any[node] = True
            node //= 2

    def take(self, room: int) -> tuple[int, int]:
        ranges = self.bins[room]
        out = ranges.pop()
        if not ranges:
            node = self.size + room
            self.any[node] = False
            node //= 2
            while node and not (self.any[2 * node] or self.any[2 * node + 1]):
                self.any[node] = False
                node //= 2
        return out

    def find(self, length: int) -> int | None:
        """Smallest room >= length with an open bin: climb until a right neighbour has one, then descend leftmost."""
        node = self.size + length
        if self.any[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, pieces, first bin, pieces a bin, offset of the first) of best-fit decreasing, and no others."""
    tree, runs, opened = CapacityTree(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.find(length)
            if room is None:
                room, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            else:
                first, count = tree.take(room)
            each = room // length
            full = min(count, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - room))
                tree.add(room - each * length, first, full)
                tree.add(room, first + full, count - full) if room < capacity else None
                rank, left = rank + full * each, left - full * each
                if room == capacity and left:
                    runs.append((length, rank, left, first + full, left, 0))
                    tree.add(capacity - left * length, first + full, 1)
                    left = 0
            else:
                runs.append((length, rank, left, first, left, capacity - room))
                tree.add(room - left * length, first, 1)
                tree.add(room, first + 1, count - 1) if room < capacity else None
                left = 0
    return np.array(runs, dtype=np.int64).reshape(-1, 6)


class Encoder:
    """Ids of whole batches of texts.  Each distinct unit is encoded once and then remembered by its hash.

    A unit is a visible run with the one space before it, or a lone newline.  Byte-level pre-tokenisation never
    joins a space or a lone newline to what stands before it when a visible character follows, so the ids of a
    text are those of its units, one after the other.  Units go through tiktoken's merge loop with the ranks of
    the tokenizer file, which gives the ids of `tokenizers` in less time; those that may hold a special token go
    through `tokenizers` itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        to_byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        model = json.loads(self.whole.to_str())
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.merge = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.special = [t.encode() for t in special]
        self.clear()

    def clear(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.flat, self.used = np.zeros(1 << 16, dtype="<u4"), 0
        self.begin, self.length = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def encode(self, unit: bytes) -> list[int]:
        text = unit.decode("utf-8", "replace")
        if any(t in unit for t in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.merge(text)

    def entries(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each unit's entry; units not seen before are encoded and added."""
        found = np.full(len(keys), -1, dtype=np.int64)
        for known, entry in self.levels:
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            same = known[at] == keys
            found[same] = entry[at[same]]
        new = np.flatnonzero(found < 0)
        if len(new):
            raw = data.tobytes()
            ids = [self.encode(raw[a:b]) for a, b in zip(start[new].tolist(), end[new].tolist())]
            length = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            total = int(length.sum())
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), dtype="<u4", count=total)
            found[new] = len(self.begin) + np.arange(len(new))
            self.begin = np.concatenate([self.begin, self.used + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.used += total
            self.levels.append((keys[new], found[new]))
            if len(self.levels) > 6:
                known = np.concatenate([x for x, _ in self.levels])
                order = np.argsort(known)
                self.levels = [(known[order], np.concatenate([x for _, x in self.levels])[order])]
        return found

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin in them (one more at the end)."""
        if not len(data):
            return np.zeros(0, dtype="<u4"), np.zeros(len(offsets), dtype=np.int64)
        if len(self.begin) > REMEMBERED:
            self.clear()
        cuts = np.zeros(len(data) + 1, dtype=bool)
        cuts[:-2] |= (data[:-1] == 0x20) & VISIBLE[data[1:]]
        line = np.flatnonzero((data[1:-1] == 0x0A) & VISIBLE[data[2:]] & ~SPACE[data[:-2]] & ((data[:-2] < 0x1C) | (data[:-2] > 0x1F) & (data[:-2] < 0x80))) + 1
        cuts[line] = True
        cuts[line + 1] = True
        cuts[offsets] = True
        start = np.flatnonzero(cuts[:-1])
        end = np.append(start[1:], len(data))
        keys, first, of = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
        entry = self.entries(keys, data, start[first], end[first])[of]
        length = self.length[entry]
        after = np.cumsum(length)
        ids = self.flat[np.repeat(self.begin[entry] - after + length, length) + np.arange(after[-1])]
        return ids, np.append(0, after)[np.searchsorted(start, offsets)]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of each piece; only the first may be shorter than the capacity."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    bounds = [0, *range(first, n + 1, capacity)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long"


def tokenize_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents, with each one's rank among equally long ones of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = [0] * (capacity + 1), TaskContext.get().partitionId()
        coder = encoder(path)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank", "ids"]
        for batch in batches:
            docs, (data, offsets) = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for a, b in groups(offsets, AT_ONCE):
                rows = []
                all_ids, begin = coder.texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for doc, x, y in zip(docs[a:b], begin, begin[1:]):
                    ids = all_ids[x:y].tobytes() + END
                    for n, (start, length) in enumerate(cut(ids, capacity)):
                        part = ids[4 * start : 4 * (start + length)]
                        rows.append((doc, n, start, length, zlib.crc32(part), task, seen[length], part))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in list(zip(zip(*rows), kinds))[: 7 + keep_ids]], names[: 7 + keep_ids])

    return with_clear_names(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, PIECES + ", ids binary" * keep_ids)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset.  keep_ids: also the ids themselves, as little-endian 32-bit numbers.

    path: the tokenizer file, which every executor has to have at the same place.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = scratch.save(tokenize_pieces(docs, path or public_tokenizers.path("byte_bpe_50k.json"), capacity, keep_ids), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {int(r["length"]): int(r["n"]) for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length
    runs = plan_bins(counts, capacity)
    order = np.lexsort((runs[:, 1], runs[:, 0])) if len(runs) else []
    runs = runs[order]
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).select("task", "length", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["task", "length"]).withColumn("rank", F.col("before") + F.col("task_rank"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one sorted key for length and rank: ranks are below 2**48 and lengths small
        keys = (runs[:, 0] << 48) | runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = runs[np.searchsorted(keys, (length << 48) | rank, side="right") - 1] if batch.num_rows else runs[:0]
            inside = rank - run[:, 1]
            bins, offset = run[:, 3] + inside // np.maximum(run[:, 4], 1), run[:, 5] + inside % np.maximum(run[:, 4], 1) * length
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(bins, pa.int64()), pa.array(offset, pa.int64())], [*columns, "sequence_id", "offset"])

    kinds = dict(pieces.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInArrow(place, schema.replace("bigint", "long"))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
