"""Toxicity: a factorization machine over hashed terms.

Terms are a text's words, lower-cased and stripped of outer punctuation, and the first four and five bytes of longer
words (so that inflected forms share a term), hashed into 2**BITS buckets; a document is the set of its buckets.  Each bucket has
a weight and FACTORS latent numbers, and the score adds to the weights the inner products of all pairs of buckets, so
that two terms can mean together what neither means alone.  The pair sum takes time linear in the document.

Learning uses at most MAX_TOXIC toxic and MAX_CLEAN other labelled documents, those with the smallest hashes of
their doc_id, and never those held out (crc32 of doc_id as text is a multiple of 5).  Of the sample's buckets those take
part that LEAST_DOCUMENTS documents have and that tell the classes apart by themselves (G2 of LEAST_ASSOCIATION): a term
that has no such mark alone gets no factors either.  The driver sees counts by bucket and, for each document of the
sample, the buckets that take part.  Every document is scored whole, a very long one by itself.  Repeated rows get equal
scores; extra columns are ignored; an empty table has no rows.

Null and empty texts have no terms and get the bias alone.  Labels may be missing, null or repeated (one toxic label
makes a document toxic); a labelled doc_id on several rows is learned from once; without both classes the score is the share of toxic labels.  A null doc_id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsect.llm.common import LOWER, Scratch, groups, text_bytes, with_clear_names, word_hashes, words

BITS = 22
FACTORS = 4
MAX_TOXIC, MAX_CLEAN = 4000, 8000
#: A bucket takes part if so many documents of the sample have it and if it tells the classes apart so well (G2).
LEAST_DOCUMENTS, LEAST_ASSOCIATION = 4, 12.0
EPOCHS, BATCH, RATE, DECAY, SPREAD = 8, 64, 0.15, 1e-5, 0.01
AT_ONCE = 2 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def terms(data: np.ndarray, offsets: np.ndarray, slots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket), each pair once, by text.  slots: numbers that stand for buckets; those of -1 are left out."""
    lower = LOWER[data]
    start, end, first = words(lower, offsets, trim=True)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    parts = []
    with np.errstate(over="ignore"):
        for size in (None, 4, 5):
            use = slice(None) if size is None else np.flatnonzero(end - start > size)
            s = start[use]
            bucket = (word_hashes(lower, s, end[use] if size is None else s + size) >> np.uint64(64 - BITS)).astype(np.int64)
            number = bucket if slots is None else slots[bucket]
            known = number >= 0
            parts.append(text[use][known] << 32 | number[known].astype(np.int64))
    pairs = np.unique(np.concatenate(parts))
    return pairs >> 32, pairs & 0xFFFFFFFF


def association(toxic: np.ndarray, both: np.ndarray, n1: float, n: float) -> np.ndarray:
    """The log-likelihood ratio (G2) of buckets with the label.  toxic, both: toxic documents, and all, that have each one; n1 of n documents are toxic."""

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12))

    return 2 * (part(toxic, both * n1 / n) + part(both - toxic, both * (n - n1) / n) + part(n1 - toxic, (n - both) * n1 / n) + part(n - n1 - both + toxic, (n - both) * (n - n1) / n))


def screen(documents: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The buckets that take part: in LEAST_DOCUMENTS documents and with an association of LEAST_ASSOCIATION."""
    bucket, both = np.unique(np.concatenate(documents), return_counts=True)
    some, seen = np.unique(np.concatenate([d for d, y in zip(documents, labels) if y > 0]), return_counts=True)
    toxic = np.zeros(len(bucket))
    toxic[np.searchsorted(bucket, some)] = seen
    return bucket[(both >= LEAST_DOCUMENTS) & (association(toxic, both.astype(float), labels.sum(), len(labels)) >= LEAST_ASSOCIATION)]


def gradient(slot: np.ndarray, text: np.ndarray, v: np.ndarray, sums: np.ndarray, error: np.ndarray, n: int) -> np.ndarray:
    """The loss's derivatives by the n weights (column 0) and factors, from each text's error; v: the factors of each slot, sums: of each text."""
    e, out = error[text], np.empty((n, 1 + v.shape[1]))
    out[:, 0] = np.bincount(slot, weights=e, minlength=n)
    for f in range(v.shape[1]):
        out[:, 1 + f] = np.bincount(slot, weights=e * (sums[text, f] - v[:, f]), minlength=n)
    return out


class FactorizationMachine:
    """Bias, and weights and factors of the buckets that take part."""

    def __init__(self, bias: float, buckets: np.ndarray, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.buckets, self.weights, self.factors = bias, buckets, weights, factors

    def slots(self) -> np.ndarray:
        """The place of each bucket in the arrays, or -1."""
        out = np.full(1 << BITS, -1, dtype=np.int32)
        out[self.buckets] = np.arange(len(self.buckets))
        return out

    def scores(self, text: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        total = self.bias + np.bincount(text, weights=self.weights[slot], minlength=n)
        for f in range(self.factors.shape[1]):
            v = self.factors[slot, f]
            total += 0.5 * (np.bincount(text, weights=v, minlength=n) ** 2 - np.bincount(text, weights=v * v, minlength=n))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))

    @classmethod
    def learn(cls, documents: list[np.ndarray], labels: np.ndarray, chosen: np.ndarray | None = None, seed: int = 7) -> FactorizationMachine:
        """documents: the buckets of each; labels: 0 or 1; chosen: the buckets that take part, sorted.  AdaGrad on the logistic loss, both classes weighing the same."""
        share = float(labels.mean()) if len(labels) else 0.0
        if not 0 < share < 1:
            return cls(float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((0, FACTORS)))
        often = screen(documents, labels) if chosen is None else chosen
        slots = np.full(1 << BITS, -1, dtype=np.int32)
        slots[often] = np.arange(len(often))
        found = [s[s >= 0] for s in (slots[d] for d in documents)]
        rng = np.random.default_rng(seed)
        n = len(often)
        table = np.zeros((n, 1 + FACTORS))
        table[:, 1:] = rng.normal(0, SPREAD, (n, FACTORS))
        seen, bias, bias_seen = np.full((n, 1 + FACTORS), 1e-8), 0.0, 1e-8
        weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
        for _ in range(EPOCHS):
            order = rng.permutation(len(found))
            for i in range(0, len(order), BATCH):
                chosen = order[i : i + BATCH]
                size = np.array([len(found[j]) for j in chosen])
                slot, text = np.concatenate([found[j] for j in chosen]), np.repeat(np.arange(len(chosen)), size)
                v = table[slot, 1:]
                sums = np.stack([np.bincount(text, weights=v[:, f], minlength=len(chosen)) for f in range(FACTORS)], axis=1)
                total = bias + np.bincount(text, weights=table[slot, 0], minlength=len(chosen)) + 0.5 * ((sums**2).sum(1) - np.bincount(text, weights=(v * v).sum(1), minlength=len(chosen)))
                error = (1 / (1 + np.exp(-np.clip(total, -40, 40))) - labels[chosen]) * weight[chosen] / len(chosen)
                grad = gradient(slot, text, v, sums, error, n) + DECAY * table
                seen += grad * grad
                table -= RATE * grad / np.sqrt(seen)
                bias_seen += float(error.sum()) ** 2
                bias -= RATE * float(error.sum()) / np.sqrt(bias_seen)
        return cls(bias, often, table[:, 0].copy(), table[:, 1:].copy())


def sample_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the documents to learn from: MAX_TOXIC + MAX_CLEAN rows at most."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    toxic = known.filter("toxic > 0").orderBy(order, "doc_id").limit(MAX_TOXIC)
    return toxic.unionByName(known.filter("toxic <= 0").orderBy(order, "doc_id").limit(MAX_CLEAN))


def learn(docs: DataFrame, labels: DataFrame) -> FactorizationMachine:
    """The model of docs (doc_id, text) and labels (doc_id, toxic).

    Buckets are counted and screened before any document's buckets come to the driver: a row a bucket, and then for each
    document of the sample those of its buckets that take part.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            buckets = []
            for a, b in groups(offsets, AT_ONCE):
                text, bucket = terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                buckets += [x.astype("<i4").tobytes() for x in np.split(bucket, np.searchsorted(text, np.arange(1, b - a)))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(buckets, pa.binary())], ["doc_id", "toxic", "buckets"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), dtype=np.int32)
        for batch in batches:
            for toxic, raw in zip(batch.column("toxic").to_pylist(), batch.column("buckets")):
                seen[toxic, np.frombuffer(raw.as_buffer(), dtype="<i4")] += 1
        some = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(x[some].astype(np.int64)) for x in seen]], ["bucket", "other", "toxic"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [x[np.isin(x, chosen)].astype("<i4").tobytes() for x in (np.frombuffer(raw.as_buffer(), dtype="<i4") for raw in batch.column("buckets"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(some, pa.binary())], ["doc_id", "toxic", "buckets"])

    sample = F.broadcast(sample_labels(labels).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")))
    # of several rows of a doc_id the one with the least hash is learned from, so that the sample's size bounds what comes to the driver
    mine = docs.join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = scratch.save(mine.mapInArrow(run, "doc_id long, toxic int, buckets binary"), "sample")
    counts = found.mapInArrow(count, "bucket long, other long, toxic long").groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    counts = counts.filter(F.col("other") + F.col("toxic") >= LEAST_DOCUMENTS).orderBy("bucket").toArrow()  # 2**BITS rows at most
    n = found.groupBy("toxic").count().collect()
    n1, n0 = (sum(r["count"] for r in n if r["toxic"] == x) for x in (1, 0))
    bucket, other, toxic = (counts[c].to_numpy() for c in ("bucket", "other", "toxic"))
    chosen = bucket[association(toxic.astype(float), (other + toxic).astype(float), n1, n0 + n1) >= LEAST_ASSOCIATION] if n0 and n1 else bucket[:0]
    rows = found.mapInArrow(keep, "doc_id long, toxic int, buckets binary").toArrow()  # as many rows as the sample
    scratch.clear()
    order = sorted(range(rows.num_rows), key=lambda i, x=rows["doc_id"].to_pylist(), y=rows["buckets"].to_pylist(): (x[i], y[i]))
    lists = rows["buckets"].to_pylist()
    return FactorizationMachine.learn([np.frombuffer(lists[i], dtype="<i4").astype(np.int64) for i in order], rows["toxic"].to_numpy().astype(float)[order] if rows.num_rows else np.zeros(0), chosen)


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id and the score of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = model.slots()
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in groups(offsets, AT_ONCE):
                text, slot = terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], slots)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(model.scores(text, slot, b - a))], ["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = with_clear_names(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
