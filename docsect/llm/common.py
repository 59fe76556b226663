"""Shared helpers: tables in the shared folder, and words of whole Arrow batches as numpy arrays.

A *word* is a maximal run of bytes other than space and 0x09-0x0D.  Those bytes never occur inside a
multi-byte UTF-8 sequence, so words can be cut on bytes.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PUNCT = np.zeros(256, dtype=bool)
PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
LONG_WORD = 256
SHINGLE = 5


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver see: spark.checkpoint.dir, or on one machine a new local one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            base = tempfile.mkdtemp(prefix="docsect-shared-")
            spark.sparkContext.setCheckpointDir(base)
            base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


#: What a finished statement has shuffled is deleted at its end; its result has been written.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one operator run, written to the shared folder: they cut lineage and outlive lost executors.

    Tables go as soon as they have been read for the last time (drop, leave); what an operator's result still reads
    stays until its caller, who knows when the result has been written, calls clear() on what collected() has gathered.
    """

    _thread = threading.local()  # lists that new ones of this thread are put on
    _cleaning, _lock = 0, threading.Lock()

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count, self.saved = spark, f"{shared_dir(spark)}/docsect-{name}-{uuid.uuid4().hex}", 0, []
        for each in getattr(self._thread, "lists", ()):
            each.append(self)

    @classmethod
    @contextlib.contextmanager
    def collected(cls):
        """Inside, every new Scratch is put on the list that this gives."""
        mine: list[Scratch] = []
        before = getattr(cls._thread, "lists", ())
        cls._thread.lists = (*before, mine)
        try:
            yield mine
        finally:
            cls._thread.lists = before

    def path(self, tag: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{tag}"

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        path = self.path(tag)
        with self._lock:  # the first of several threads turns it on, the last one puts it back
            if not Scratch._cleaning:
                Scratch._before = self.spark.conf.get(CLEAN_UP, "false")
                self.spark.conf.set(CLEAN_UP, "true")
            Scratch._cleaning += 1
        try:
            df.write.parquet(path)
        finally:
            with self._lock:
                Scratch._cleaning -= 1
                if not Scratch._cleaning:
                    self.spark.conf.set(CLEAN_UP, Scratch._before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.saved.append((out, path))
        return out

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *frames: DataFrame) -> None:
        """Deletes saved tables that no later step reads."""
        for df, path in self.saved:
            if any(df is x for x in frames):
                self._delete(path)
        self.saved = [x for x in self.saved if not any(x[0] is y for y in frames)]

    def leave(self, *frames: DataFrame) -> None:
        """Deletes all saved tables but these."""
        self.drop(*[df for df, _ in self.saved if not any(df is x for x in frames)])

    def clear(self) -> None:
        self._delete(self.root)
        self.saved = []


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, and each text's offsets in them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        offsets = np.zeros(1, dtype=np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, limit: int):
    """Ranges of texts with at most limit bytes, or one text, so that memory follows the longest text alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, trim: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the number of words before it (one more at the end).

    trim: leave out ASCII punctuation at a word's ends, and words made of nothing else.
    """
    full = ~SPACE[data]
    begins, ends = full.copy(), full.copy()
    begins[1:] &= ~full[:-1]
    ends[:-1] &= ~full[1:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    begins[inner] |= full[inner]
    ends[inner - 1] |= full[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if trim and len(start):
        while len(active := np.flatnonzero((start < end) & PUNCT[data[np.minimum(start, len(data) - 1)]])):
            start[active] += 1
        while len(active := np.flatnonzero((start < end) & PUNCT[data[end - 1]])):
            end[active] -= 1
        keep = start < end
        start, end = start[keep], end[keep]
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, eight bytes a step; very long words are hashed one by one."""
    length = end - start
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8), shape=(len(data) + 1, 8), strides=(1, 1))
    out = mix(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    at, todo = start.copy(), np.flatnonzero(length <= LONG_WORD)
    while len(todo):
        value = np.ascontiguousarray(eight[at[todo]]).view(np.uint64)[:, 0]
        left = end[todo] - at[todo]
        short = left < 8
        value[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        out[todo] = mix(out[todo] ^ value) + np.uint64(0x9E3779B97F4A7C15)
        at[todo] += 8
        todo = todo[left > 8]
    for i in np.flatnonzero(length > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of size words; those that cross from one text to the next have to be left out by the caller."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for i in range(1, size):
        out = (out << np.uint64(13) | out >> np.uint64(51)) * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return mix(out)


def with_clear_names(df: DataFrame, *needed: str) -> DataFrame:
    """Only the needed columns; a missing one is null."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).cast("string" if c in ("text", "role") else "long").alias(c) for c in needed])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of df is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
