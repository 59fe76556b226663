"""Substring dedup and the terms of the PII operator against brute force, on tables with many holders of one thing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsect.llm import pii, substrings
from docsect.llm.common import Scratch

random.seed(21)
VOCABULARY = ["".join(random.choice("abcdefghij") for _ in range(random.randint(3, 8))) for _ in range(3000)]


def prose(n):
    return [random.choice(VOCABULARY) for _ in range(n)]


def brute_covered(rows):
    """For each document the places of its words that lie in a run of 50 words which an earlier document has."""
    grams = {d: [tuple(w[i : i + 50]) for i in range(len(w) - 49)] for d, w in rows}
    out = {}
    for d, w in rows:
        early = {g for e, _ in rows if e < d for g in grams[e]}
        out[d] = {j for i, g in enumerate(grams[d]) if g in early for j in range(i, i + 50)}
    return out


def covered(df):
    out = {}
    for r in substrings.repeated_passages(df).filter("first").collect():
        out.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    return out


@pytest.fixture(scope="module")
def many(spark):
    ids, rows = random.sample(range(1000), 60), []
    for p in range(6):  # six passages, each in ten texts
        passage = prose(70)
        rows += [(ids.pop(), prose(random.randint(60, 90)) + passage + prose(random.randint(60, 90))) for _ in range(10)]
    return rows, spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(3).cache()


def test_later_holders_of_a_passage_find_an_earlier_one(many):
    rows, df = many
    want, got = brute_covered(rows), covered(df)
    assert all(want[d] <= got.get(d, set()) for d, _ in rows)
    assert {d for d, _ in rows if want[d]} == set(got)


def test_only_the_earliest_holder_keeps_a_passage(many):
    rows, df = many
    want, texts = brute_covered(rows), dict(rows)
    for r in substrings.remove_repeats(df).collect():
        left, w = r["text"].split(), texts[r["doc_id"]]
        assert len(left) <= len(w) - len(want[r["doc_id"]])
        assert want[r["doc_id"]] or left == w


def test_a_line_common_to_many_texts_does_not_hide_a_passage(spark):
    random.seed(22)
    line, rows = prose(46), []
    ids = random.sample(range(1000), 120)
    rows.append((-1, prose(70) + line + prose(70)))  # the earliest text has the line alone
    for p in range(30):  # passages of 52 words that hold the line, each in four texts
        passage = prose(3) + line + prose(3)
        rows += [(ids.pop(), prose(random.randint(60, 90)) + passage + prose(random.randint(60, 90))) for _ in range(4)]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(3)
    want, got = brute_covered(rows), covered(df)
    lost = sum(not want[d] <= got.get(d, set()) for d, _ in rows)
    assert lost == 0


def edited(words, kind, n, rng):
    """A copy with n words replaced, put in, taken out, or moved elsewhere, at places apart."""
    out = list(words)
    for i, at in enumerate(sorted(rng.sample(range(4, len(words) - 4), n), reverse=True)):
        if kind == "replaced":
            out[at] = f"new{i}"
        elif kind == "inserted":
            out.insert(at, f"new{i}")
        elif kind == "deleted":
            del out[at]
        else:
            word = out.pop(at)
            out.insert(rng.randrange(4, len(out) - 4), word)
    return out


def alike(x, y):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x, y))
    return len(a & b) / len(a | b)


EDITS = [(size, kind, n) for size in (55, 60, 80, 120, 200) for kind in ("replaced", "inserted", "deleted", "moved") for n in (1, 2)]


def test_equal_bytes_are_counted(spark):
    rng = random.Random(9)
    rows = [(0, 0), (-1, -1), (1, 0), (-(2**63), -(2**63)), (2**63 - 1, -1)]
    for _ in range(200):
        x, y = ([rng.choice((0, 1, 128, 255, rng.randint(0, 255))) for _ in range(8)] for _ in range(2))
        y = [a if rng.random() < 0.5 else b for a, b in zip(x, y)]
        rows.append(tuple(int.from_bytes(bytes(v), "little", signed=True) for v in (x, y)))
    got = [r[0] for r in spark.createDataFrame(rows, "x long, y long").select(substrings.equal_runs(F.col("x"), F.col("y"))).collect()]
    bytes_of = lambda v: v.to_bytes(8, "little", signed=True)
    assert got == [sum(a == b != 0 for a, b in zip(bytes_of(x), bytes_of(y))) for x, y in rows]


def test_edited_passages_are_found(spark):
    """Of each edit 200 pairs of passages of 0.78 or more, in 60 words of other text; those that no such pair has are passed over."""
    random.seed(23)
    rng, rows, of = random.Random(5), [], {}
    for size, kind, n in EDITS:
        made = tries = 0
        while made < 200 and tries < 2000:
            tries += 1
            passage = prose(size)
            other = edited(passage, kind, n, rng)
            if len(other) >= 50 and alike(passage, other) >= 0.78:
                made += 1
                d = 2 * len(of)
                of[d + 1] = (size, kind, n)
                rows += [(d, prose(60) + passage + prose(60)), (d + 1, prose(60) + other + prose(60))]
    got = covered(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(8))
    assert all(d % 2 for d in got)
    share = {e: (sum(of[d] == e for d in got), sum(x == e for x in of.values())) for e in dict.fromkeys(of.values())}
    print(share)
    # two edits leave 53 or so of 55 words, little more than the shortest passage
    assert len(share) == len(EDITS) and all(found >= (0.9 if e[0] == 55 else 0.95) * total for e, (found, total) in share.items()), share


def test_disclosing_terms_are_found_and_masked_in_the_whole_document(spark):
    random.seed(24)
    common = prose(60)

    def filler(n):
        return " ".join(random.choice(common) for _ in range(n))

    # zebra stands far from the address, and twice
    rows = [(i, f"x@y.org {filler(30)} zebra {filler(40)} Zebra, end") for i in range(6)] + [(10 + i, filler(80)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["terms"] for r in pii.find_all(df, Scratch(spark, "test")).collect()}
    texts = dict(rows)
    for i in range(6):
        assert [texts[i][t["start"] : t["end"]] for t in found[i]][:2] == ["zebra", "Zebra"]
    assert all(not found[10 + i] for i in range(80))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert all("zebra" not in clean[i].lower() and "x@y.org" not in clean[i] for i in range(6))


def test_a_pair_meets_although_neither_is_like_the_groups_earliest_text(spark):
    """Three texts or more share a block, but only the later ones a passage."""
    random.seed(25)
    rng, rows, later = random.Random(6), [], []
    for _ in range(40):
        block, n = prose(30), len(rows)
        passage = prose(25) + block + prose(25)
        other = edited(passage, "replaced", 2, rng)
        rows += [(n, prose(70) + block + prose(70)), (n + 1, prose(60) + passage + prose(60)), (n + 2, prose(60) + other + prose(60))]
        if alike(passage, other) >= substrings.SIMILARITY:
            later.append((n + 2, n + 1))
    got = {(r["doc_id"], r["partner_id"]) for r in substrings.repeated_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(4)).filter("first").collect()}
    assert len(later) > 30 and got == set(later)


def test_edited_passages_in_a_large_group_are_found(spark):
    """A line of 20 words that 150 texts have is in 30 pairs of passages, edited on both sides of it and near it."""
    random.seed(26)
    line, rows, later = prose(20), [(i, prose(60)) for i in range(150)], []
    rows = [(i, w[:30] + line + w[30:]) for i, w in rows]
    for i in range(30):
        passage, n = prose(40) + line + prose(40), 1000 + 2 * i
        other = [*passage[:36], "one", *passage[37:64], "two", *passage[65:]]
        assert alike(passage, other) >= substrings.SIMILARITY
        rows += [(n, prose(60) + passage + prose(60)), (n + 1, prose(60) + other + prose(60))]
        later.append((n + 1, n))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(4)
    found = substrings.repeated_passages(df).filter("first").collect()
    assert {(r["doc_id"], r["partner_id"]) for r in found} == set(later)
    assert all(r["start_word"] <= 64 and r["end_word"] >= 155 for r in found)


def test_classes_of_what_many_share(spark):
    """A line of 46 words that 80 texts have, and 20 of them with 4 more: too few shingles are left to be seen alone."""
    random.seed(27)
    line, more = prose(46), prose(4)
    rows = [(i, prose(60) + line + (more if i % 4 == 3 else []) + prose(60)) for i in range(80)]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(4)
    want, got = brute_covered(rows), covered(df)
    assert sum(map(bool, want.values())) == 19 and all(want[d] <= got.get(d, set()) for d, _ in rows)


def test_every_passage_of_a_pair_that_is_alike_enough():
    """Words put in in a row, edits beside an edge, and a part that is not alike."""
    hashes = {}

    def coded(words):
        return np.array([hashes.setdefault(tuple(words[i : i + 5]), len(hashes)) for i in range(len(words) - 4)], dtype=np.uint64)

    random.seed(28)
    a, b, c = prose(45), prose(45), prose(60)
    one, two = prose(60) + a + b + prose(60), prose(60) + a + prose(12) + b + prose(60)
    assert alike(a + b, two[60:162]) >= substrings.SIMILARITY
    (found,) = substrings.passages(coded(one), coded(two), [(0, 60, 100)])
    assert found[:4] == (60, 145, 60, 157)
    edge = c[:4] + ["new", "er"] + c[6:55]
    assert len(edge) == 55 and alike(c[:55], edge) >= substrings.SIMILARITY
    ((x, y, *_),) = substrings.passages(coded(prose(60) + c[:55] + prose(60)), coded(prose(60) + edge + prose(60)), [(0, 70, 100)])
    assert (x, y) == (66, 110)
    # two parts with a wide gap, and a part that is not alike: no cut at the widest gap
    places = np.r_[0:41, 57:98, 110:200:7]
    first, last = substrings.longest(places, places, 46, 0.7)
    assert (first[0], last[0]) == (0, 81)


def test_edited_passages_of_three_holders_are_cut(spark):
    """The later two say a passage with words replaced on both sides of what all three share."""
    random.seed(29)
    rows = []
    for i in range(0, 30, 3):
        block = prose(24)
        passage = prose(40) + block + prose(40)
        other = [*passage[:39], "one", *passage[40:64], "two", *passage[65:]]
        assert alike(passage, other) >= substrings.SIMILARITY
        rows += [(i, prose(70) + block + prose(70)), (i + 1, prose(60) + passage + prose(60)), (i + 2, prose(60) + other + prose(60))]
    texts = {d: " ".join(w) for d, w in rows}
    left = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()}
    assert all(len(left[d].split()) <= 130 if d % 3 == 2 else left[d] == texts[d] for d in texts)


def test_a_passage_with_words_put_in_in_a_row_is_cut(spark):
    random.seed(30)
    rows = []
    for i in range(0, 20, 2):
        a, b = prose(45), prose(45)
        assert alike(a + b, (other := a + prose(12) + b)) >= substrings.SIMILARITY
        rows += [(i, prose(60) + a + b + prose(60)), (i + 1, prose(60) + other + prose(60))]
    left = {r["doc_id"]: len(r["text"].split()) for r in substrings.remove_repeats(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")).collect()}
    assert left == {d: 120 if d % 2 else len(w) for d, w in rows}


def test_a_pair_whose_class_has_an_earliest_text_unlike_both(spark):
    """34 texts say the same two halves with seven words of their own between them; two say them with none and with one."""
    random.seed(31)
    rows, later = [], []
    for i in range(0, 1200, 100):
        a, b = prose(25), prose(25)
        rows += [(i + k, prose(50) + a + prose(7) + b + prose(50)) for k in range(34)]
        assert alike(a + b, a + ["one"] + b) >= substrings.SIMILARITY > alike(a + b, a + prose(7) + b)
        rows += [(i + 50, prose(50) + a + b + prose(50)), (i + 51, prose(50) + a + ["one"] + b + prose(50))]
        later.append((i + 51, i + 50))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(4)
    assert {(r["doc_id"], r["partner_id"]) for r in substrings.repeated_passages(df).filter("first").collect()} == set(later)


def test_words_said_again_and_again_have_few_windows(spark):
    """2,000 places that differ in alignment alone, between other words, and the same of a phrase of three words."""
    random.seed(32)
    rows = [(1, prose(60) + ["of"] * 2000 + prose(60)), (2, prose(60) + prose(3) * 700 + prose(60)), (3, prose(120))]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "text_key long, text string")
    found = substrings.windows(df).filter("near is not null").groupBy("text_key").count().collect()
    few = {r["text_key"]: r["count"] for r in found}
    assert few[1] < few[3] + 2000 / substrings.EVERY + 30 and few[2] < few[3] + 2100 / substrings.EVERY + 60


def test_a_windows_shingles_are_told_once(spark):
    words = ["of"] * 60 + "a b c d e f g h".split()
    row = (5, 1, 1, 20, 0, True, False, 10, " ".join(words).encode(), [{"start": 10, "end": 60}])
    parts = spark.createDataFrame([row], f"{substrings.WINDOW}, from int, words binary, spans array<struct<start:bigint,end:bigint>>")
    got = sorted((r["many"], r["open"], r["place"], r["last"]) for r in substrings.contexts(parts).collect())
    # the span holds the places 10 to 55, the run begins at 10 and goes on to 69
    assert got == sorted([(56, True, 56, 65), *[(1, True, p, p) for p in range(66, 74)]])


def test_runs_of_one_word_in_many_texts_are_found(spark):
    """40 texts say one word 60 to 300 times in a row; pairs of them say the same words before and after it too."""
    random.seed(33)
    rows = []
    for i in range(20):
        before, after, ids = prose(45), prose(45), random.sample(range(100), 2)
        for k in ids:
            n = random.randint(60, 300)
            rows.append((100 * i + k, prose(60) + before + ["of"] * n + after + prose(60)))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(4)
    want, got = brute_covered(rows), covered(df)
    assert sum(map(bool, want.values())) == 39 and all(want[d] <= got.get(d, set()) for d, _ in rows)
