"""The suffix tree against a naive one."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from docsect.llm import suffix_tree as S
from docsect.llm import tally

END = "\0end"


def naive(rows, depth, least, divergence, seen):
    """The tree's definition, with dictionaries; scores of all rows."""
    cut = lambda t: [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if w] + [END]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    train = [cut(t) for d, t in rows if not held(d)]
    words = Counter(w for t in train for w in t)
    n, v = sum(words.values()), len(words)
    followers = defaultdict(Counter)
    for t in train:
        for i, w in enumerate(t):
            for k in range(1, min(i, depth) + 1):
                followers[tuple(t[i - k : i])][w] += 1

    def back(f):
        return len(f) + sum(c for c in f.values() if c < seen)

    def p(s, w):
        if not s:
            return (words[w] + 1) / (n + v + 1)
        f = followers[s]
        return ((f.get(w, 0) if f.get(w, 0) >= seen else 0) + back(f) * p(s[1:], w)) / (sum(f.values()) + len(f))

    def diverges(s):
        f = followers[s]
        b, m = back(f), sum(f.values()) + len(f) - 1
        return sum(c * math.log(((c - 1) * (c >= seen) + b * p(s[1:], w)) / (m * p(s[1:], w))) for w, c in f.items()) >= divergence

    kept = set()
    for s in [s for s, f in followers.items() if sum(f.values()) >= least]:
        if diverges(s):
            kept |= {s[i:] for i in range(len(s))}

    def longest(before):
        for k in range(min(len(before), depth), 0, -1):
            if tuple(before[-k:]) in kept:
                return tuple(before[-k:])
        return ()

    out = []
    for d, t in rows:
        x = cut(t)
        out.append((d, held(d), len(x), sum(words[w] > 0 for w in x), n, sum(math.log10(p((), w)) for w in x), sum(math.log10(p(longest(x[:i]), w)) for i, w in enumerate(x))))
    return out, kept


def corpus():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdEé") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    line = [rng.choice(vocabulary) for _ in range(12)]
    rows = []
    for i in range(150):
        body = [rng.choice(vocabulary[: 5 + i % 55]) for _ in range(rng.randint(0, 60))]
        rows.append((i, " \n".join(body + line * (i % 3 == 0) + body[:7] * (i % 5 == 0))))
    return [*rows, rows[3], rows[3], (None, "abc d"), (None, None), (500, ""), (501, " \t\n"), (502, "neverseen words only"), (503, " ".join(line * 3000))]


def test_scores_are_those_of_a_naive_tree(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], "doc_id long, text string, gram long, value int, row string").repartition(3)
    for depth, least, divergence, seen, share in ((3, 4, 3.0, 2, 0.0), (1, 3, 0.0, 3, 0.0), (2, 6, 20.0, 4, 1e-3)):
        n = naive(rows, 1, 1, 0.0, 1)[0][0][4]
        want, kept = naive(rows, depth, max(least, math.ceil(share * n)), divergence, seen)
        assert any(len(s) == depth for s in kept) and len(kept) > 3
        got = [tuple(r) for r in S.score_all(df, depth, least, divergence, seen, share).collect()]
        key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
        got, want = sorted(got, key=key), sorted(want, key=key)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)
    assert sum(w[6] for w in want if w[1]) != sum(w[5] for w in want if w[1])


def test_values_travel_either_way_alike(spark, monkeypatch):
    """Grams whose values go to all tasks, and those that are joined, give the same sums."""
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    first = sorted((tuple(r) for r in S.score_all(df, 2, 4).collect()), key=key)
    for limit in (0, 40):
        monkeypatch.setattr(S.most_frequent, "__defaults__", (limit,))
        again = sorted((tuple(r) for r in S.score_all(df, 2, 4).collect()), key=key)
        assert np.allclose([r[5:] for r in first], [r[5:] for r in again])


def test_names_of_grams(spark):
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-(2**63), 2**63 - 1, 200) for _ in range(2))
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long")
    with np.errstate(over="ignore"):
        assert [r[0] for r in df.select(F.xxhash64("a", "b")).collect()] == tally.pair(a.view(np.uint64), b.view(np.uint64)).view(np.int64).tolist()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.score_all(none).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = S.score_all(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert row["held_out"] and (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0) and row["score"] == row["base_score"] == 0
