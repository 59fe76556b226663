"""MinHash near-dedup with min-max hashing.

Each hash function gives a document two signature values, the minimum and the maximum over its shingles, so 64
evaluations fill a signature of 128; matches of either are unbiased for the Jaccard similarity and their mean has
less variance than as many minima.  The signature is cut into 32 bands of two minima and two maxima.

Documents with equal shingle sets are one node from the start.  Nodes that share a band are candidates, but a
bucket never becomes all its pairs.  First, shingles that only one candidate has are counted: two sets share at most
the other ones, which bounds their similarity from above and rules out, without loss, most nodes that met by chance
and heavily edited copies.  What is left of a bucket is linked to its head, the node with the smallest share of shingles
of its own (of edited copies, the original), links are confirmed on the full sets, and the confirmed links' components
are found.  Where a bucket still spans several components, the nodes outside its most frequent component meet another
head of that component in each of STAR_ROUNDS rounds.  By then each node's intersection with its bucket's head is
known, and what it misses of the head and has besides, as bitmaps of hashed shingles.  Two nodes share what the head has and
neither misses, and what both have besides, which the bitmaps bound from above; only pairs of different components that
this bound lets through are compared.  So every pair that
shares a band is compared, or ruled out by a bound, or already belongs together, however large the bucket.

Null and empty texts have the empty set and are linked with nothing.  Texts under five words are one shingle.
Repeated rows fall together.  doc_id may be null or repeated: a group takes its smallest non-null doc_id, and a
row without doc_id is kept only if its whole group has none.  Ties go to the smallest digest.  Very long texts are worked
on one at a time.  Extra columns are ignored, or passed on by keep_first().  An empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsect.llm.common import LOWER, SHINGLE, Scratch, free_names, groups, mix, shingles, text_bytes, with_clear_names, word_hashes, words
from docsect.llm.graph import components

HASHES = 64
BANDS = 32
SIMILARITY = 75  # per cent
AT_ONCE = 2 << 20
LAST = 1 << 40  # more than any set has
CELL_BITS = 9  # of the bitmaps by which differences from a bucket's head are compared
CELLS = 1 << CELL_BITS
#: Rounds that link what is left of a bucket to one node of its main component, before the pairs that the bound lets through are compared.
STAR_ROUNDS = 1

_seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS = (_seeds[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
SHIFTS = (_seeds[HASHES:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    lower = LOWER[data]
    start, end, first = words(lower, offsets)
    hashes = word_hashes(lower, start, end)
    runs = shingles(hashes)
    for a, b in zip(first, first[1:]):
        if b - a >= SHINGLE:
            yield np.unique(runs[a : b - SHINGLE + 1])
        elif b > a:
            short = np.uint64(b - a)
            for h in hashes[a:b]:
                short = mix(np.array([short * np.uint64(31) + h]))[0]
            yield np.array([short], dtype=np.uint64)
        else:
            yield np.zeros(0, dtype=np.uint64)


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima and maxima of every hash function over a non-empty set."""
    low = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    least, most = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32), np.zeros(HASHES, dtype=np.uint32)
    for i in range(0, len(low), 2048):
        values = FACTORS[:, None] * low[None, i : i + 2048] + SHIFTS[:, None]
        np.minimum(least, values.min(axis=1), out=least)
        np.maximum(most, values.max(axis=1), out=most)
    return least, most


def band_keys(least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band: two minima and two maxima of the same two functions."""
    key = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for part in (least[0::2], least[1::2], most[0::2], most[1::2]):
        key = mix(key ^ part.astype(np.uint64))
    return key.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, digest of the set, and band keys.  docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            sizes, digests, keys = [], [], []
            with np.errstate(over="ignore"):
                for a, b in groups(offsets, AT_ONCE):
                    for found in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                        sizes.append(len(found))
                        digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                        keys.append(band_keys(*signature(found)) if len(found) else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_key", "n", "digest", "keys"])

    clean = with_clear_names(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return clean.mapInArrow(run, "doc_id long, text_key long, n long, digest binary, keys array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """digest and the sorted set, as little-endian 64-bit numbers.  docs: text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            with np.errstate(over="ignore"):
                for a, b in groups(offsets, AT_ONCE):
                    found = [x.tobytes() for x in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
                    yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in found], pa.binary()), pa.array(found, pa.binary())], ["digest", "members"])

    return docs.select("text").mapInArrow(run, "digest binary, members binary")


def own_shingles(sets: DataFrame) -> DataFrame:
    """node (a hash of the digest) and own, the number of its shingles that no other set has; nodes without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, which, parts, held = batch.column("node").to_numpy(zero_copy_only=False), [], [], 0
            for i, x in enumerate(batch.column("members")):
                parts.append(np.frombuffer(x.as_buffer(), dtype="<i8"))
                which.append(i)
                held += len(parts[-1])
                if held > 1 << 18 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes[which], [len(p) for p in parts])), pa.array(np.concatenate(parts))], ["node", "shingle"])
                    which, parts, held = [], [], 0

    each = sets.select(F.xxhash64("digest").alias("node"), "members").mapInArrow(run, "node long, shingle long")
    return each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1").groupBy("node").agg(F.count("*").alias("own"))


def cells(shingles: np.ndarray) -> tuple[np.ndarray, int]:
    """A bitmap of CELLS bits for some shingles, as 64-bit numbers, and how many shingles it shows less than there are."""
    bits = np.zeros(CELLS, dtype=np.uint8)
    bits[(shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64), len(shingles) - int(bits.sum())


APART = "missing array<bigint>, missing_more long, extra array<bigint>, extra_more long"


def intersections(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with same, the size of their full sets' intersection, both sizes, and bitmaps of what b misses of a and has besides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "same", "n_a", "n_b", "missing", "missing_more", "extra", "extra_more"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.int64()]
        for batch in batches:
            rows = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), dtype="<u8") for v in (x, y))
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = x[at] == y
                left = np.ones(len(x), dtype=bool)
                left[at[both]] = False
                (missing, more), (extra, most) = cells(x[left]), cells(y[~both])
                rows.append((int(both.sum()), len(x), len(y), missing, more, extra, most))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names)

    both = pairs.join(sets.select(F.col("digest").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("digest").alias("b"), F.col("members").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary, same long, n_a long, n_b long, " + APART)


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, text_key, n_shingles, digest, component_id and kept, a row for each row of docs."""
    scratch = Scratch(docs.sparkSession, "minhash")
    table = scratch.save(sketch(docs), "sketches")
    first = table.filter("n > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.min("doc_id").alias("least"))
    nodes = scratch.save(first.select("digest", "least", "first.doc_id", "first.text_key"), "nodes")
    # one row stands for each set; its bands go on
    same = (table["digest"] == nodes["digest"]) & (table["text_key"] == nodes["text_key"]) & table["doc_id"].eqNullSafe(nodes["doc_id"])
    alone = scratch.save(table.filter("n > 0").join(nodes, same, "left_semi").dropDuplicates(["digest"]).select("digest", "n", "keys"), "alone")
    bands = alone.select("digest", "n", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = scratch.save(bands.join(shared.select("key").hint("merge"), "key"), "members")
    scratch.drop(alone)
    wanted = members.select("digest").distinct().join(nodes, "digest").select("doc_id", "text_key")
    clean = with_clear_names(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    w = wanted.select(F.col("doc_id").alias("w_doc"), F.col("text_key").alias("w_key")).hint("merge")
    texts = clean.join(w, (clean["text_key"] == w["w_key"]) & clean["doc_id"].eqNullSafe(w["w_doc"]), "left_semi").dropDuplicates(["doc_id", "text_key"])
    sets = scratch.save(full_sets(texts).dropDuplicates(["digest"]), "sets")

    # m: the shingles that some other candidate has; two sets share at most the smaller m
    own = scratch.save(own_shingles(sets), "own")
    met = members.withColumn("node", F.xxhash64("digest")).join(own, "node", "left").withColumn("m", F.col("n") - F.coalesce("own", F.lit(0)))
    candidates = scratch.save(met.filter(100 * F.col("m") >= similarity * F.col("n")).select("key", "digest", "n", "m"), "candidates")
    scratch.drop(own, members)
    enough = lambda common, n, n2: (100 + similarity) * common >= similarity * (n + n2)
    share = F.floor(1000 * (F.col("n") - F.col("m")) / F.col("n")).alias("share")

    heads = candidates.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct(share, "digest", "n", "m")).alias("head")).filter("size > 1")
    members = scratch.save(candidates.join(heads.select("key", "head"), "key").select("key", "digest", "n", "m", F.col("head.digest").alias("head"), F.col("head.n").alias("head_n"), F.col("head.m").alias("head_m")), "members")
    scratch.drop(candidates)
    stars = members.filter(F.col("digest") != F.col("head")).filter(enough(F.least("m", "head_m"), F.col("n"), F.col("head_n")))
    tried = scratch.save(intersections(stars.select(F.col("head").alias("a"), F.col("digest").alias("b")).distinct(), sets), "tried")
    links = tried.filter(enough(F.col("same"), F.col("n_a"), F.col("n_b"))).select("a", "b")
    # i: shingles in common with the head; x: those shared with other candidates beyond it; bounds where the two were not compared
    apart = [c.split()[0] for c in APART.split(", ")]
    known = members.join(tried.select(F.col("a").alias("head"), F.col("b").alias("digest"), "same", *apart), ["head", "digest"], "left")
    itself = F.col("digest") == F.col("head")
    i = F.when(itself, F.col("n")).otherwise(F.coalesce("same", F.least("m", "head_m"))).alias("i")
    x = F.when(itself, 0).otherwise(F.coalesce(F.greatest(F.col("m") - F.col("same"), F.lit(0)), "m")).alias("x")
    members = scratch.save(known.select("key", "digest", "n", "m", i, x, "head_n", *apart), "places")
    found = components(links, scratch)
    for turn in range(STAR_ROUNDS + 1):
        now = members.join(found.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
        now = scratch.save(now, "now")
        # the most frequent component of each bucket that still spans several, and one of its nodes, another each turn
        order = F.struct(share, F.xxhash64("digest", F.lit(turn)).alias("order"), "digest", "n", "m")
        by = now.groupBy("key", "component").agg(F.count("*").alias("size"), F.min(order).alias("one"), F.min("n").alias("shortest"))
        main = by.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("size", "component", "one")).alias("main"), F.min("shortest").alias("shortest")).filter("parts > 1")
        main = main.select("key", F.col("main.component").alias("main"), F.col("main.one").alias("head"), "shortest")
        outside = scratch.save(now.join(main, "key").filter("component <> main").filter(enough(F.col("m"), F.col("n"), F.greatest("shortest", "m"))), "outside")
        if turn < STAR_ROUNDS:
            fresh = outside.filter(enough(F.least("m", "head.m"), F.col("n"), F.col("head.n"))).select(F.least("head.digest", "digest").alias("a"), F.greatest("head.digest", "digest").alias("b"))
        else:
            o, v = outside.alias("o"), now.alias("v")
            common = F.least(F.least("o.i", "v.i") + F.least("o.x", "v.x"), "o.m", "v.m")
            # what both miss of the head, and what both have besides: at most what their bitmaps share and do not show
            alike = lambda c: F.least(f"o.{c}_more", f"v.{c}_more") + reduce(lambda a, b: a + b, [F.bit_count(F.get(f"o.{c}", F.lit(k)).bitwiseAND(F.get(f"v.{c}", F.lit(k)))) for k in range(CELLS // 64)])
            nearer = F.col("o.i") + F.col("v.i") - F.col("o.head_n") + alike("missing") + alike("extra")
            apart = (F.col("o.key") == F.col("v.key")) & (F.col("o.component") != F.col("v.component")) & enough(common, F.col("o.n"), F.col("v.n")) & enough(F.coalesce(nearer, F.lit(LAST)), F.col("o.n"), F.col("v.n"))
            once = (F.col("v.component") == F.col("o.main")) | (F.col("o.digest") < F.col("v.digest"))
            fresh = o.join(v, apart & once).select(F.least("o.digest", "v.digest").alias("a"), F.greatest("o.digest", "v.digest").alias("b"))
        done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        fresh = scratch.save(intersections(fresh.distinct().join(done, ["a", "b"], "left_anti"), sets), "tried")
        new = fresh.filter(enough(F.col("same"), F.col("n_a"), F.col("n_b"))).select("a", "b")
        tried = tried.unionByName(fresh)
        scratch.drop(now, outside)
        if new.head(1):
            links = links.unionByName(new)
            found = components(links, scratch)
    # a component's id is the smallest doc_id of its sets
    named = found.join(nodes.select(F.col("digest").alias("node"), "least"), "node")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = named.join(least, "component").select(F.col("node").alias("digest"), "component_id")
    known = scratch.save(nodes.join(linked, "digest", "left").select("digest", F.coalesce("component_id", "least").alias("component_id")), "classes")
    scratch.leave(table, known)
    out = table.join(known, "digest", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "digest", "component_id", kept.alias("kept"))


def keep_first(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """One document of each near-duplicate group, with the columns it came with; of repeated rows, one."""
    scratch = Scratch(docs.sparkSession, "keep-first")
    key, kept_id, kept_key = free_names(docs, "_text_key", "_kept_id", "_kept_key")
    with Scratch.collected() as read:
        verdict = near_duplicates(docs, similarity).filter("kept").select(F.col("doc_id").alias(kept_id), F.col("text_key").alias(kept_key)).distinct()
    verdict = scratch.save(verdict, "kept")
    for x in read:
        x.clear()
    marked = docs.withColumn(key, F.xxhash64("text"))
    verdict = verdict.hint("merge")
    kept = marked.join(verdict, (marked[key] == verdict[kept_key]) & marked["doc_id"].cast("long").eqNullSafe(verdict[kept_id]), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).select(*docs.columns)


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")
