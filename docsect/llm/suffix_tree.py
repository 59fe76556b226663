"""A probabilistic suffix tree of word contexts, and the probability of every text under it.

Tokens are words and one end a text.  A context of k words (1 to DEPTH) is a candidate state if it is seen at least LEAST
times and makes at least SHARE of all tokens (the method's least probability, which bounds the tree at any size of corpus).  Its
next-symbol distribution is smoothed towards that of its parent, the context without its oldest word, by Witten and
Bell's weights, with followers seen less than SEEN times left to the parent too: P(w | s) = (c(s, w) + B * P(w | parent)) / (n(s) + T(s)),
where c counts from SEEN, T is the number of distinct followers and B that and the occurrences of those that do not count; the
root's is (c(w) + 1) / (N + V + 1).  A state is kept if its distribution diverges from its parent's by more than chance:
the sum over followers of c * ln(P'(w | s) / P(w | parent)), where P' leaves the follower's own occurrence out (c - 1, and n + T - 1), is at least
DIVERGENCE nats, or if a longer kept context ends in it.  A token is scored in the longest kept state that ends before it.

The log-probability of a text is a sum over its grams (runs of 1 to DEPTH + 1 tokens): a gram that is a kept state adds
log(B / (n + T)) for the token after it, and one that was seen in a kept state adds the rest for its last token.  So the
tree is one table, gram to value, which every text's grams are joined with; the values of the HOT most frequent grams
travel to all tasks, the others by a shuffle.  Grams of m + 1 tokens are named by the names of their first and last m
tokens, in 64 bits.  Every level is one pass over the texts, with counts added up inside a task before they are shuffled.  Bitmaps
of a fixed size tell tasks which contexts may be worth a row; what they let through by chance is removed by an exact join.

Null texts are empty: one end.  A null doc_id is not held out.  Repeated rows count and are scored as often as they occur.
Very long texts are one row like others.  An empty table has no rows; without training rows every token has
probability one.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsect.llm.common import LOWER, Scratch, groups, text_bytes, with_clear_names, word_hashes, words
from docsect.llm.tally import SHARD, Bitmap, Hot, Tally, dealt, dealt_schema, gathered, pair

DEPTH, LEAST, SHARE, DIVERGENCE, SEEN = 3, 16, 1e-6, 3.0, 8
PARTS, HELD_OUT = 7, 2
#: Grams whose values go to every task, and bytes a task works on at once.
HOT, AT_ONCE = 1 << 17, 4 << 20
END = np.uint64(0x8F3B5C6D17A29E41)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % PARTS == HELD_OUT, F.lit(False))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all tokens of some texts, the text of each, and its place there."""
    lower, n = LOWER[data], len(offsets) - 1
    start, end, first = words(lower, offsets)
    text = np.repeat(np.arange(n), np.diff(first))
    out = np.full(len(start) + n, END, dtype=np.uint64)
    out[np.arange(len(start)) + text] = word_hashes(lower, start, end)
    text = np.repeat(np.arange(n), np.diff(first) + 1)
    return out, text, np.arange(len(out)) - (first[:-1] + np.arange(n))[text]


def _texts(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for a, b in groups(offsets, AT_ONCE):
            yield batch, a, b, *tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def count_words(docs: DataFrame) -> DataFrame:
    """word and n, its occurrences in all texts; the end is a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(["word", "n"])
        for _, _, _, names, _, _ in _texts(batches):
            yield from tally.add(names, names)
        yield from tally.rest()

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_followers(docs: DataFrame, level: int, contexts: Bitmap, shards: int, seen: int) -> DataFrame:
    """context, tail, c and types: grams whose context of level tokens may be in the bitmap, and their occurrences.

    tail: the gram without its first token, which says with the context what the gram is.  Grams seen less than SEEN times are only
    counted: they have no tail, and stand in some rows for each context, of types grams together.  A task sends what it has counted as arrays, one for each of
    shards ranges of names; a shard's arrays are added up in one place.
    """
    sent = docs.sparkSession.sparkContext.broadcast(contexts)
    arrays = ["context", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, tally = sent.value, Tally(["context", "tail", "n"])

        with np.errstate(over="ignore"):
            for _, _, _, names, _, place in _texts(batches):
                for _ in range(level):
                    before, names = names[:-1], names[1:]
                    after, names = names, pair(before, names)
                at = np.flatnonzero((place[level:] >= level) & some.has(before))
                yield from dealt(tally.put(names[at], before[at], after[at]), shards, arrays)
            yield from dealt(tally.take(), shards, arrays)

    def add(table: pa.Table) -> pa.Table:
        c, context, tail = gathered(table, arrays, pair)
        often = c >= seen
        lone, of, times = np.unique(context[~often], return_inverse=True, return_counts=True)
        less = np.bincount(of, weights=c[~often], minlength=len(lone)).astype(np.int64)
        return pa.table({
            "context": np.concatenate([context[often], lone]).view(np.int64), "tail": pa.concat_arrays([pa.array(tail[often].view(np.int64)), pa.nulls(len(lone), pa.int64())]),
            "c": np.concatenate([c[often], less]), "types": np.concatenate([np.ones(often.sum(), dtype=np.int64), times]),
        })

    rows = docs.select("text").mapInArrow(run, dealt_schema(arrays))
    return rows.groupBy("shard").applyInArrow(add, "context long, tail long, c long, types long")


def judge(docs: DataFrame, vocabulary: DataFrame, tokens_seen: int, distinct: int, scratch: Scratch, depth: int, least: int, divergence: float, seen: int) -> list[tuple[DataFrame, DataFrame]]:
    """For each level its kept states (context, up, n, rest), and its grams seen SEEN times or more (gram, context, c, p, p_up)."""
    total, shards = float(tokens_seen + distinct + 1), 1 + tokens_seen // SHARD
    frequent = vocabulary.filter((F.col("n") >= least) & (F.col("word") != int(END.astype(np.int64)))).select(F.col("word").alias("context"), F.lit(None).cast("long").alias("up"), "n")
    above = vocabulary.filter(F.col("n") >= seen).select(F.col("word").alias("tail"), ((F.col("n") + 1) / total).alias("p_up"))
    levels = []
    for level in range(1, depth + 1):
        rows = scratch.save(count_followers(docs, level, Bitmap(frequent.select("context")), shards, seen), "followers")
        stats = rows.groupBy("context").agg(F.sum("types").alias("followers"), F.sum(F.when(F.col("tail").isNull(), F.col("c")).otherwise(0)).alias("seldom"))
        stats = scratch.save(frequent.join(stats, "context"), "contexts")
        n, c, up = F.col("n"), F.col("c"), F.col("p_up")
        all_, back = n + F.col("followers"), F.col("seldom") + F.col("followers")
        more = rows.filter("tail is not null").join(stats.select("context", "n", "followers", "seldom"), "context").join(above, "tail")
        gain = (c * F.ln((c - 1 + back * up) / ((all_ - 1) * up))).cast("float").alias("gain")
        more = scratch.save(more.select(F.xxhash64("context", "tail").alias("gram"), "context", F.when(c >= least, F.col("tail")).alias("tail"), "c", ((c + back * up) / all_).alias("p"), up, gain), "grams")
        gains = more.groupBy("context").agg(F.sum("gain").alias("gain"))
        gain = F.coalesce("gain", F.lit(0.0)) + F.when(F.col("seldom") > 0, F.col("seldom") * F.ln(back / (all_ - 1))).otherwise(0.0)
        judged = scratch.save(stats.join(gains, "context", "left").select("context", "up", "n", F.log10(back / all_).alias("rest"), (gain >= divergence).alias("diverges")), "judged")
        levels.append((judged, more))
        scratch.drop(rows, stats)
        frequent = more.filter("tail is not null").select(F.col("gram").alias("context"), F.col("tail").alias("up"), F.col("c").alias("n"))
        above = more.select(F.col("gram").alias("tail"), F.col("p").alias("p_up"))
    kept: list[tuple[DataFrame, DataFrame]] = []
    for judged, more in reversed(levels):
        keep = judged.filter("diverges")
        if kept:
            needed = kept[0][0].select(F.col("up").alias("context")).distinct()
            keep = judged.join(needed.withColumn("needed", F.lit(True)), "context", "left").filter(F.col("diverges") | F.col("needed").isNotNull())
        kept.insert(0, (scratch.save(keep.select("context", "up", "n", "rest"), "states"), more))
        scratch.drop(judged)
    return kept


def grow(docs: DataFrame, scratch: Scratch, depth: int = DEPTH, least: int = LEAST, divergence: float = DIVERGENCE, seen: int = SEEN, share: float = SHARE) -> tuple[DataFrame, int, int]:
    """The tree of docs as (gram, n, known, base, value), and the numbers of tokens and of distinct ones.

    A text's log10 probability is the sum of its grams' values less log10(N + V + 1) for each token; base gives that of the root alone.
    """
    vocabulary = scratch.save(count_words(docs), "words")
    total, distinct = (int(x or 0) for x in vocabulary.agg(F.sum("n"), F.count("*")).first())
    own, none = F.log10(F.col("n") + 1.0), (F.lit(0).alias("known"), F.lit(0.0).alias("base"))
    values = vocabulary.select(F.col("word").alias("gram"), "n", F.lit(1).alias("known"), own.alias("base"), own.alias("value"))
    for states, more in judge(docs, vocabulary, total, distinct, scratch, depth, max(least, math.ceil(share * total)), divergence, seen):
        entries = more.join(states.select("context", "rest"), "context").select("gram", F.col("c").alias("n"), *none, (F.log10("p") - F.log10("p_up") - F.col("rest")).alias("value"))
        values = values.unionByName(entries).unionByName(states.select(F.col("context").alias("gram"), "n", *none, F.col("rest").alias("value")))
    tree = values.groupBy("gram").agg(F.max("n").alias("n"), F.max("known").alias("known"), F.sum("base").alias("base"), F.sum("value").alias("value"))
    tree = scratch.save(tree, "tree")
    scratch.leave(tree)
    return tree, total, distinct


def most_frequent(tree: DataFrame, limit: int = HOT) -> pa.Table:
    """The rows of the most frequent grams, by a least frequency: at most limit."""
    size = F.floor(F.log2("n") * 8).cast("int")
    cut, total = None, 0
    for r in sorted(tree.groupBy(size.alias("size")).count().collect(), reverse=True):  # a row for each eighth of a power of two
        total += r["count"]
        if total > limit:
            break
        cut = r["size"]
    return tree.filter(size >= cut if cut is not None else F.lit(False)).toArrow()


SCORED = "row long, doc_id long, n_tokens long, gram long, times long, known long, base double, value double"


def score(docs: DataFrame, tree: DataFrame, depth: int = DEPTH) -> DataFrame:
    """row, doc_id, n_tokens, n_known, base and value: sums over each text's grams.  docs: doc_id, text."""
    hot = most_frequent(tree)
    sent = docs.sparkSession.sparkContext.broadcast((Bitmap(tree.filter("known = 0").select("gram")), *[hot[c].to_numpy() for c in ("gram", "known", "base", "value")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, hot_gram, *hot_values = sent.value
        order = np.argsort(hot_gram.view(np.uint64))
        hot, hot_values = Hot(hot_gram.view(np.uint64)[order]), [x[order] for x in hot_values]
        row = TaskContext.get().partitionId() << 40
        for batch, a, b, names, text, place in _texts(batches):
            n = b - a
            sums = [np.zeros(n), np.zeros(n), np.zeros(n)]
            out = []
            size = np.bincount(text, minlength=n)
            with np.errstate(over="ignore"):
                for m in range(1, depth + 2):
                    if m > 1:
                        names, place, text = pair(names[:-1], names[1:]), place[1:], text[1:]
                    at = np.flatnonzero((place >= m - 1) & some.has(names)) if m > 1 else np.arange(len(names))
                    gram, of = names[at], text[at]
                    slot = hot.find(gram)
                    found = slot >= 0
                    for k, (s, v) in enumerate(zip(sums, hot_values)):
                        if m == 1 or k == 2:  # longer grams have only values
                            s += np.bincount(of[found], weights=v[slot[found]], minlength=n)
                    gram, of = gram[~found], of[~found]
                    order = np.lexsort((gram, of))
                    gram, of = gram[order], of[order]
                    heads = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (of[1:] != of[:-1]))) if len(gram) else np.zeros(0, dtype=np.int64)
                    out.append((of[heads], gram[heads], np.diff(np.append(heads, len(gram)))))
                # a row of the text itself: it meets no gram, as it has none of it
                rows = row + np.arange(n)
                yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column("doc_id").slice(a, n), pa.array(size.astype(np.int64)), pa.array(pair(rows.astype(np.uint64), rows.astype(np.uint64)).view(np.int64)), pa.array(np.zeros(n, dtype=np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], [x.split()[0] for x in SCORED.split(", ")])
            of, gram, times = (np.concatenate(x) for x in zip(*out))
            for i in range(0, len(of), 1 << 16):
                o, g, k = of[i : i + (1 << 16)], gram[i : i + (1 << 16)], times[i : i + (1 << 16)]
                none = pa.nulls(len(o), pa.int64())
                zero = np.zeros(len(o))
                yield pa.RecordBatch.from_arrays([pa.array(row + o), none, none, pa.array(g.view(np.int64)), pa.array(k.astype(np.int64)), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(zero)], [x.split()[0] for x in SCORED.split(", ")])
            row += n

    rows = docs.select("doc_id", "text").mapInArrow(run, SCORED)
    values = tree.select("gram", F.col("known").alias("g_known"), F.col("base").alias("g_base"), F.col("value").alias("g_value"))
    both = rows.join(values.hint("merge"), "gram", "left")
    add = lambda c: F.sum(F.col(c) + F.col("times") * F.coalesce(f"g_{c}", F.lit(0))).alias(c)
    return both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), add("known"), add("base"), add("value"))


def score_all(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, divergence: float = DIVERGENCE, seen: int = SEEN, share: float = SHARE) -> DataFrame:
    """Every text's log10 probability, by a tree of those that are not held out."""
    scratch = Scratch(docs.sparkSession, "suffix-tree")
    docs = with_clear_names(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    tree, total, distinct = grow(docs.filter(~held_out(F.col("doc_id"))), scratch, depth, least, divergence, seen, share)
    each = math.log10(total + distinct + 1)
    less = lambda c: (F.col(c) - F.col("n_tokens") * each)
    found = score(docs, tree, depth)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), less("base").alias("base_score"), less("value").alias("score"))


def op11_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_all(spark.read.parquet(f"{sf_dir}/documents.parquet"))
