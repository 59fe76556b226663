"""Phrase collocation mining: a minimal perfect hash over Apriori-safe candidates, counted in numpy arrays.

A phrase can only be frequent if its words are, and one of three words only if both its pairs are.  So words are counted
first; then pairs of frequent words, and triples of surviving pairs, are added up in buckets of 48 bits of their names
(a bucket holds at least as many as any phrase in it), and what stands in a bucket of LEAST is a candidate: never a
frequent phrase is missing.  The candidates, with their words and languages, get a minimal perfect hash that keeps every key
in its slot, so that strangers are told apart.  Each task counts its texts into one array by slot; the arrays are added up as a
tree, FAN at a time, and the counts of a candidate and of the parts of its cuts are read by slot.  A hash holds SLOTS keys
at most: more candidates take several rounds of count and read, so that memory is bounded at any size.  Names are 64-bit hashes
of language and words; phrases are spelled only for what can be among the first of a language.

Null texts are empty and have no words; a null language is und.  Repeated rows count as often as they occur.  Very long
texts are one row like others; a phrase never crosses from one text or piece to the next.  Ties of the score go by count, then by the phrase's bytes.  An empty table
has no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsect.llm.common import LOWER, Scratch, groups, mix, text_bytes, with_clear_names, word_hashes
from docsect.llm.tally import SHARD, Bitmap, Tally, dealt, dealt_schema, gathered, pair

LEAST, SHARE, FIRST = 10, 50, 2000
#: Keys of one hash, arrays added up at once, slots in a row, and bytes a task works on at once.
SLOTS, FAN, CHUNK, AT_ONCE = 1 << 22, 16, 1 << 16, 4 << 20
BREAK = np.zeros(256, dtype=bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
APART = BREAK.copy()
APART[[0x20, 0x09]] = True


class PerfectHash:
    """A slot for each of n keys, 0 to n - 1.

    A level gives each key a place; those alone at theirs stay, the others go on to the next level.  A key's slot is
    the number of taken places before its own.  The key in each slot is kept, so other keys have no slot (-1).
    """

    def __init__(self, keys: np.ndarray, room: float = 1.5):
        self.levels: list[np.ndarray] = []
        self.keys, used, left = np.zeros(len(keys), dtype=np.uint64), 0, np.unique(keys)
        with np.errstate(over="ignore"):
            while len(left):
                place = self.place(left, len(self.levels), size := int(room * len(left)) + 1)
                alone = np.bincount(place, minlength=size)[place] == 1
                slots = np.full(size, -1, dtype=np.int32)
                taken = np.sort(place[alone])
                slots[taken] = used + np.arange(len(taken))
                self.keys[slots[place[alone]]] = left[alone]
                used += len(taken)
                self.levels.append(slots)
                left = left[~alone]
        self.keys = self.keys[:used]

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        with np.errstate(over="ignore"):
            for level, slots in enumerate(self.levels):
                out[todo] = slots[self.place(keys[todo], level, len(slots))]
                todo = todo[out[todo] < 0]
        known = np.flatnonzero(out >= 0)
        out[known[self.keys[out[known]] != keys[known]]] = -1
        return out


def _texts(batches: Iterator[pa.RecordBatch]):
    """For stretches of each batch: bytes, starts and ends of words, their names, whether the next word follows in the same piece, and (language names, words of each)."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        lang = batch.column("lang_name").to_numpy(zero_copy_only=False).view(np.uint64)
        for a, b in groups(offsets, AT_ONCE):
            lower, bounds = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
            full = ~APART[lower]
            begins, ends = full.copy(), full.copy()
            begins[1:] &= ~full[:-1]
            ends[:-1] &= ~full[1:]
            inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(lower))]
            begins[inner] |= full[inner]
            ends[inner - 1] |= full[inner - 1]
            start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            first = np.searchsorted(start, bounds)
            text = np.repeat(np.arange(b - a), np.diff(first))
            breaks = np.cumsum(BREAK[lower])
            joined = (text[1:] == text[:-1]) & (breaks[start[1:]] == breaks[start[:-1]]) if len(start) else np.zeros(0, dtype=bool)
            with np.errstate(over="ignore"):
                names = pair(lang[a:b][text], word_hashes(lower, start, end)) if len(start) else np.zeros(0, dtype=np.uint64)
            yield batch, a + text, lower, start, end, names, joined, (lang[a:b], np.diff(first))


def _grams(names: np.ndarray, joined: np.ndarray, words: Bitmap, pairs: Bitmap | None = None):
    """Where pairs of known words begin, their names, and, of known pairs, where triples begin and theirs."""
    at = np.flatnonzero(joined)
    known = words.has(names)
    at = at[known[at] & known[at + 1]]
    with np.errstate(over="ignore"):
        two = pair(names[at], names[at + 1])
        if pairs is None:
            return at, two, at[:0], two[:0]
        keep = pairs.has(two)
        at, two = at[keep], two[keep]
        follows = np.flatnonzero(at[1:] == at[:-1] + 1) if len(at) else at
        return at, two, at[follows], pair(two[follows], two[follows + 1])


def count_words(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(["name", "n"])
        for *_, names, _, _ in _texts(batches):
            yield from tally.add(names, names)
        yield from tally.rest()

    return docs.mapInArrow(run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))


def full_buckets(docs: DataFrame, least: int, shards: int, words: Bitmap, pairs: Bitmap | None = None) -> DataFrame:
    """bucket: the buckets of pairs, or of triples of known pairs, with at least least occurrences."""
    sent = docs.sparkSession.sparkContext.broadcast((words, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = sent.value
        tally = Tally(["bucket"])
        for *_, names, joined, _ in _texts(batches):
            _, two, _, three = _grams(names, joined, words, pairs)
            bucket = (two if pairs is None else three) >> np.uint64(16)
            yield from dealt(tally.put(bucket, bucket), shards, tally.names)
        yield from dealt(tally.take(), shards, tally.names)

    def add(table: pa.Table) -> pa.Table:
        n, bucket = gathered(table, ["bucket"], lambda x: x)
        return pa.table({"bucket": bucket[n >= least].view(np.int64)})

    return docs.mapInArrow(run, dealt_schema(["bucket"])).groupBy("shard").applyInArrow(add, "bucket long")


def candidates(docs: DataFrame, shards: int, words: Bitmap, pairs: Bitmap, triples: Bitmap) -> DataFrame:
    """name, lang_name, size, head and tail (the names of the gram without its last and its first word) of what stands in full buckets, maybe with others."""
    sent = docs.sparkSession.sparkContext.broadcast((words, pairs, triples))
    arrays = ["head", "tail", "lang_name", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, triples = sent.value
        tally = Tally(arrays)
        for batch, text, _, _, _, names, joined, _ in _texts(batches):
            lang = batch.column("lang_name").to_numpy(zero_copy_only=False).view(np.uint64)
            at, two, at3, three = _grams(names, joined, words, pairs)
            keep = triples.has(three)
            at3, three = at3[keep], three[keep]
            with np.errstate(over="ignore"):
                parts = ((2, two, at, names[at], names[at + 1]), (3, three, at3, pair(names[at3], names[at3 + 1]), pair(names[at3 + 1], names[at3 + 2])))
            for size, name, where, head, tail in parts:
                yield from dealt(tally.put(name, head, tail, lang[text[where]], np.full(len(name), size, dtype=np.uint64)), shards, arrays)
        yield from dealt(tally.take(), shards, arrays)

    def add(table: pa.Table) -> pa.Table:
        _, head, tail, lang, size = gathered(table, arrays, lambda head, tail, *_: pair(head, tail))
        with np.errstate(over="ignore"):
            name = pair(head, tail)
        return pa.table({"name": name.view(np.int64), "lang_name": lang.view(np.int64), "size": size.astype(np.int32), "head": head.view(np.int64), "tail": tail.view(np.int64)})

    return docs.mapInArrow(run, dealt_schema(arrays)).groupBy("shard").applyInArrow(add, "name long, lang_name long, size int, head long, tail long")


def count_slots(docs: DataFrame, keys: PerfectHash, words: Bitmap, pairs: Bitmap) -> np.ndarray:
    """The occurrences of the key in each slot: an array a task, added up as a tree."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((keys, words, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words, pairs = sent.value
        counts = np.zeros(len(keys.keys) + 1, dtype=np.int64)  # the last for strangers
        for *_, names, joined, (lang, n) in _texts(batches):
            _, two, _, three = _grams(names, joined, words, pairs)
            for name in (names, two, three):
                counts += _tallied(keys.find(name), len(counts))
            np.add.at(counts, keys.find(lang), n)
        counts = counts[:-1]
        task = TaskContext.get().partitionId()
        for chunk in range(0, len(counts), CHUNK):
            part = counts[chunk : chunk + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([chunk // CHUNK], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["node", "chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), dtype=np.int64) for x in table["counts"])
        return pa.table({"node": table["node"][:1], "chunk": table["chunk"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "node int, chunk int, counts binary"
    rows, width = docs.mapInArrow(run, kind), docs.rdd.getNumPartitions()
    while width > 1:
        rows, width = rows.withColumn("node", (F.col("node") / FAN).cast("int")).groupBy("chunk", "node").applyInArrow(add, kind), -(-width // FAN)
    out = np.zeros(len(keys.keys), dtype=np.int64)
    for r in rows.toArrow().to_pylist():  # SLOTS numbers at most
        part = np.frombuffer(r["counts"], dtype=np.int64)
        out[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(part)] += part
    return out


def _tallied(slots: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(np.where(slots < 0, size - 1, slots), minlength=size)


PARTS = ("name", "lang_name", "head", "tail", "first", "last")


def read_slots(rows: DataFrame, keys: PerfectHash, counts: np.ndarray) -> DataFrame:
    """rows with f_x, the count of the key in column x, for each of PARTS whose key is in this hash."""
    sent = rows.sparkSession.sparkContext.broadcast((keys, counts))
    kept = [c for c in rows.columns if not c.startswith("f_")]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = sent.value
        for batch in batches:
            columns = [batch.column(c) for c in kept]
            for c in PARTS:
                slot = keys.find(batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64))
                before = batch.column(f"f_{c}").to_numpy(zero_copy_only=False)
                columns.append(pa.array(np.where(slot >= 0, counts[slot] if len(counts) else 0, before).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, [*kept, *[f"f_{c}" for c in PARTS]])

    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + "".join(f", f_{c} bigint" for c in PARTS))


def spell(docs: DataFrame, chosen: DataFrame, words: Bitmap) -> DataFrame:
    """name and phrase of the chosen names, with repetitions and maybe others.  chosen: name."""
    sent = docs.sparkSession.sparkContext.broadcast((words, Bitmap(chosen.select("name"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, some = sent.value
        seen = np.zeros(0, dtype=np.uint64)
        for _, _, lower, start, end, names, joined, _ in _texts(batches):
            at, two, _, _ = _grams(names, joined, words)
            follows = np.flatnonzero(at[1:] == at[:-1] + 1) if len(at) else at
            with np.errstate(over="ignore"):
                name, where, size = np.concatenate([two, pair(two[follows], two[follows + 1])]), np.concatenate([at, at[follows]]), np.repeat([2, 3], [len(two), len(follows)])
            keep = np.flatnonzero(some.has(name))
            new, first = np.unique(name[keep], return_index=True)
            fresh = ~np.isin(new, seen)
            new, first = new[fresh], keep[first[fresh]]
            seen = np.union1d(seen, new)
            spelled = [b" ".join(lower[start[i] : end[i]].tobytes() for i in range(where[j], where[j] + size[j])).decode("utf-8", "replace") for j in first]
            yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array(spelled, pa.string())], ["name", "phrase"])

    return docs.mapInArrow(run, "name long, phrase string")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, first: int = FIRST, slots: int = SLOTS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases of two or three words."""
    scratch = Scratch(docs.sparkSession, "phrases")
    lang = F.coalesce("lang", F.lit("und"))
    docs = with_clear_names(docs.withColumn("lang", F.col("lang").cast("string")) if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string")), "lang", "text").select("text", lang.alias("lang"), F.xxhash64(lang).alias("lang_name"))
    unfold = lambda buckets: buckets.select(F.shiftleft("bucket", 16).alias("name"))
    counted = scratch.save(count_words(docs), "words")
    words, shards = Bitmap(counted.filter(F.col("n") >= least).select("name")), 1 + int(counted.agg(F.sum("n")).first()[0] or 0) // SHARD
    two = scratch.save(full_buckets(docs, least, shards, words), "pairs")
    pairs = Bitmap(unfold(two))
    three = scratch.save(full_buckets(docs, least, shards, words, pairs), "triples")
    triples = Bitmap(unfold(three))
    found = candidates(docs, shards, words, pairs, triples)
    full = two.withColumn("size", F.lit(2)).unionByName(three.withColumn("size", F.lit(3)))
    found = scratch.save(found.withColumn("bucket", F.shiftrightunsigned("name", 16)).join(full, ["size", "bucket"], "left_semi").drop("bucket"), "candidates")
    scratch.drop(counted, two, three)
    known = found.filter("size = 2")
    # a triple's first and last words are those of its pairs; where a pair is no candidate the triple is not frequent
    a, b = known.select(F.col("name").alias("head"), F.col("head").alias("first")), known.select(F.col("name").alias("tail"), F.col("tail").alias("last"))
    longer = found.filter("size = 3").join(a, "head").join(b, "tail").select(*found.columns, "first", "last")
    rows = known.withColumns({"first": F.col("head"), "last": F.col("tail")}).unionByName(longer)
    rows = scratch.save(rows.withColumns({f"f_{c}": F.lit(0).cast("long") for c in PARTS}), "parts")
    every = scratch.save(rows.select(F.explode(F.array(*PARTS)).alias("name")).distinct(), "keys")
    rounds = max(1, -(-every.count() // slots))
    for k in range(rounds):
        mine = every.filter(F.pmod(F.xxhash64("name"), F.lit(rounds)) == k).toArrow()  # about slots rows
        keys = PerfectHash(mine["name"].to_numpy().view(np.uint64))
        counts = count_slots(docs, keys, words, pairs)
        before, rows = rows, scratch.save(read_slots(rows, keys, counts), "parts")
        scratch.drop(before)
    ratio = lambda l, r: F.expr(f"cast(cast(1000000 * cast(f_name as decimal(38,0)) * f_name as decimal(38,0)) div (cast(f_{l} as decimal(38,0)) * f_{r}) as bigint)")
    cut = lambda l, r, k: F.struct(ratio(l, r).alias("score"), F.lit(k).alias("k"), F.col(f"f_{l}").alias("l"), F.col(f"f_{r}").alias("r"))
    counted = rows.filter(F.col("f_name") >= least)
    lowest = F.when(F.col("size") == 2, cut("head", "tail", 1)).otherwise(F.least(cut("first", "tail", 1), cut("head", "last", 2)))
    counted = scratch.save(counted.select("name", "lang_name", "size", "head", "tail", F.col("f_name").alias("a"), F.col("f_lang_name").alias("n"), lowest.alias("cut")), "counted")
    inside = counted.filter("size = 3").select(F.explode(F.array_distinct(F.array("head", "tail"))).alias("name"), F.col("a").alias("longer")).groupBy("name").agg(F.max("longer").alias("longer"))
    left = counted.join(inside, "name", "left").filter(F.col("longer").isNull() | (F.lit(100).cast("decimal(38,0)") * F.col("longer") < F.lit(share) * F.col("a").cast("decimal(38,0)")))
    left = scratch.save(left.select("name", "lang_name", "a", "cut.l", "cut.r", "n", "cut.score"), "scored")
    # a language is ranked in parts first, so that no task gets all of it; ties at the end of the first are all kept until they are spelled
    part = F.pmod(F.xxhash64("name"), F.lit(64))
    order = [F.desc("score"), F.desc("a")]
    best = left.withColumn("rank", F.rank().over(Window.partitionBy("lang_name", part).orderBy(*order))).filter(F.col("rank") <= first)
    chosen = scratch.save(best.withColumn("rank", F.rank().over(Window.partitionBy("lang_name").orderBy(*order))).filter(F.col("rank") <= first).drop("rank"), "chosen")
    spelled = spell(docs, chosen, words).groupBy("name").agg(F.min("phrase").alias("phrase"))
    languages = docs.select("lang", "lang_name").distinct()
    named = scratch.save(chosen.join(spelled, "name").join(languages, "lang_name"), "spelled")
    scratch.leave(named)
    best = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang_name", part).orderBy(*order, "phrase"))).filter(F.col("rank") <= first)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang_name").orderBy(*order, "phrase")).cast("long")).filter(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_mining(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM pieces, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
found AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 10),
cuts AS (SELECT c.*, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail FROM found c, (SELECT unnest([1, 2]) AS j) WHERE j < size),
scored AS (SELECT c.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f * y.f) AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head AND x.k = j JOIN f y ON y.lang = c.lang AND y.phrase = c.tail AND y.k = size - j),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM found WHERE size = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM lowest c LEFT JOIN inside i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < 50 * c.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
