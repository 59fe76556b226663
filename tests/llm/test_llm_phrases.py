"""Phrases against a naive count, and the hash against a dictionary."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from docsect.llm import phrases as P


def naive(rows, least, share, first):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = tuple(x for x in re.split("[\x20\x09]+", piece) if x)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang][w[i : i + k]] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= share * a and p in (q[:-1], q[1:]) for q, b in found.items()):
                rows.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, x, y, n[lang], score) for i, (score, a, p, x, y) in enumerate(rows[:first])]
    return out


def corpus():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcDé<") for _ in range(rng.randint(1, 3))) for _ in range(40)]
    rows = []
    for i in range(160):
        body = [rng.choice(vocabulary[: 4 + i % 36]) + rng.choice(("", "", "", ".", ",", "\t", "\n", " \x0b")) for _ in range(rng.randint(0, 40))]
        rows.append((("en", "fr", None, "und")[min(i % 5, 3)], " ".join(body) + " tail of it" * (i % 4 == 0)))
    return [*rows, rows[0], rows[0], ("en", None), ("fr", ""), ("en", "tail"), ("en", "of it " * 30_000), ("xx", "one two"), (None, " . , "), ("en", "aa aa aa aa aa")]


def test_phrases_are_those_of_a_naive_count(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, lang, 1, "x", 3) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, name int, head string, n long").repartition(5)
    for least, first, slots in ((10, 2000, 1 << 22), (3, 7, 50)):
        got = [tuple(r) for r in P.collocations(df, least, first=first, slots=slots).collect()]
        assert sorted(got) == sorted(naive(rows, least, 50, first)) and len(got) > 20


def test_products_beyond_64_bits(spark):
    big = 3_000_000_019
    rows = spark.createDataFrame([(big, 2 * big, 3 * big)], "f_name long, f_head long, f_tail long")
    got = rows.selectExpr("cast(cast(1000000 * cast(f_name as decimal(38,0)) * f_name as decimal(38,0)) div (cast(f_head as decimal(38,0)) * f_tail) as bigint)").first()[0]
    assert got == 1000000 * big * big // (6 * big * big)


def test_empty_tables(spark):
    assert P.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
    assert P.collocations(spark.createDataFrame([(1, None, "en"), (2, "a b", None)], "doc_id long, text string, lang string")).collect() == []


def test_the_hash_is_minimal_and_tells_strangers():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        h = P.PerfectHash(keys)
        assert sorted(h.find(keys).tolist()) == list(range(len(keys))) and (h.keys[h.find(keys)] == keys).all()
        others = rng.integers(2**63, 2**64 - 1, 1000, dtype=np.uint64)
        assert (h.find(others) == -1).all()
