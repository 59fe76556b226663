"""Learned parts, disclosing terms and the whole pipeline against naive versions."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docsect.llm import packing, pii, quality, substrings, toxicity
from docsect.llm.common import Scratch

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    return lambda k: [rng.choice(vocabulary) for _ in range(k)]


def test_scores_and_gradients_are_those_of_all_pairs():
    rng = np.random.default_rng(5)
    n, k = 12, toxicity.FACTORS
    weights, factors, bias = rng.normal(size=n), rng.normal(size=(n, k)), 0.3
    docs = [np.array(sorted(rng.choice(n, size, replace=False))) for size in (0, 1, 4, 9)]
    text, slot = np.repeat(np.arange(4), [len(d) for d in docs]), np.concatenate(docs).astype(int)

    def total(d, w, v):
        return bias + sum(w[i] for i in d) + sum(v[i] @ v[j] for a, i in enumerate(d) for j in d[a + 1 :])

    model = toxicity.FactorizationMachine(bias, np.arange(n), weights, factors)
    assert np.allclose(model.scores(text, slot, 4), [1 / (1 + math.exp(-total(d, weights, factors))) for d in docs])
    labels = np.array([0.0, 1.0, 1.0, 0.0])

    def loss(w, v):
        return sum(math.log(1 + math.exp(z)) - y * z for z, y in zip((total(d, w, v) for d in docs), labels))

    v = factors[slot]
    sums = np.stack([np.bincount(text, weights=v[:, f], minlength=4) for f in range(k)], axis=1)
    error = model.scores(text, slot, 4) - labels
    got, step = toxicity.gradient(slot, text, v, sums, error, n), 1e-6
    for i in range(n):
        for f in range(1 + k):
            w2, v2 = weights.copy(), factors.copy()
            if f == 0:
                w2[i] += step
            else:
                v2[i, f - 1] += step
            assert abs((loss(w2, v2) - loss(weights, factors)) / step - got[i, f]) < 1e-3


def test_toxicity_of_odd_rows(spark):
    prose = words_of(0, 31)
    rows = [(i, " ".join(prose(30) + (["numskull"] * (i % 4 == 0))), 1, "x") for i in range(300)]
    rows += [rows[3], (None, "numskull", 2, "y"), (901, "word " * 400_000 + "numskull", 2, "y"), (902, None, 2, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic long, buckets string").select("doc_id", "text", "toxic", "buckets")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.learn(df.select("doc_id", "text"), labels)
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(df.select("doc_id", "text"), model).collect()]
    assert len(got) == 304 and len({s for d, s in got if d == 3}) == 1 and dict(got)[None] > 0.5 and 0 <= dict(got)[902] <= 1


def naive_list(rows, cuts):
    """Sequential covering, over lists: rows of (values by feature, bad, part)."""
    meets = lambda v, rule: all(v[f] <= t if op == "<=" else v[f] > t for f, op, t in rule)
    rules = []
    while len(rules) < quality.MAX_RULES:
        left = [r for r in rows if not any(meets(r[0], x) for x in rules)]
        rule = []
        while len(rule) < quality.MAX_TERMS:
            grown = [r for r in left if r[2] != 0 and meets(r[0], rule)]
            p0 = sum(r[1] for r in grown)
            n0 = len(grown) - p0
            best = (0.0, None)
            if p0 and n0:
                for f in quality.FEATURES:
                    for t in cuts[f]:
                        for op in ("<=", ">"):
                            met = [r for r in grown if meets(r[0], [(f, op, t)])]
                            p = sum(r[1] for r in met)
                            best = max(best, (quality._gain(p, len(met) - p, p0, n0), (f, op, t)), key=lambda x: x[0])
            if best[1] is None or best[0] < 1e-9:
                break
            rule.append(best[1])
        if not rule:
            break
        worth = []
        for i in range(len(rule)):
            met = [r for r in left if r[2] == 0 and meets(r[0], rule[: i + 1])]
            p = sum(r[1] for r in met)
            worth.append((p, len(met) - p))
        i = max(range(len(rule)), key=lambda i: ((worth[i][0] - worth[i][1]) / max(sum(worth[i]), 1), worth[i][0]))
        p, n = worth[i]
        if p < quality.MIN_COVER or p < quality.MIN_PRECISION * (p + n):
            break
        rules.append(rule[: i + 1])
    return rules


def test_rules_are_those_of_naive_sequential_covering(spark):
    rng = random.Random(12)
    rows = []
    for i in range(400):
        v = {f: float(rng.randint(0, 9)) for f in quality.FEATURES}
        bad = (v["upper_share"] > 6 and v["n_words"] <= 5) or v["mark_share"] > 8
        rows.append((v, bool(bad) ^ (rng.random() < 0.01), i % 3))
    df = spark.createDataFrame([(*[v[f] for f in quality.FEATURES], bad, part) for v, bad, part in rows], ", ".join(f"{f} double" for f in quality.FEATURES) + ", bad boolean, part int")
    found = quality.learn(df, Scratch(spark, "test"))
    cuts = {}
    for f in quality.FEATURES:
        asked = df.agg(*[F.percentile_approx(F.when(F.col("bad") == bad, F.col(f)), [i / quality.BINS for i in range(quality.BINS)] + [0.99, 1.0], 2000) for bad in (True, False)]).first()
        cuts[f] = sorted({float(x) for x in [*asked[0], *asked[1]]})
    same = lambda rules: [{tuple(v[f] <= t if op == "<=" else v[f] > t for f, op, t in rule) == (True,) * len(rule) for rule in rules} for v, _, _ in rows]
    assert found.rules and same(found.rules) == same(naive_list(rows, cuts))


def test_quality_of_very_long_and_repeated_rows(spark):
    prose = words_of(0, 33)
    rows = [(1, " ".join(prose(200_000)), "a"), (2, "same words here " * 100_000, "b"), (3, " ".join(prose(20)), "c"), (3, None, "d")]
    rows += [(4, " ".join(prose(20)), "e")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, words string")
    kept = quality.keep_good(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert sorted((r["doc_id"], r["words"]) for r in kept.select("doc_id", "words").collect()) == [(1, "a"), (3, "c"), (4, "e"), (4, "e")]


def naive_terms(rows):
    """(doc, word) for each word that discloses an entity of its document, by counting over all documents."""
    found = {}
    for d, t in rows:
        spans = pii.base_spans(t)
        held = {pii.entity(k, t[a:b]) for k, a, b in spans}
        bare = t
        for _, a, b in spans:
            bare = bare[:a] + " " * (b - a) + bare[b:]
        strip = lambda x: {w for w in (y.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for y in x.lower().split()) if w}
        found[d] = (held, strip(bare), strip(t))
    n, out = len(rows), set()
    count = lambda f: sum(f(x) for x in found.values())
    for d, (held, words, _) in found.items():
        for e in held:
            n_e = count(lambda x: e in x[0])
            for w in words:
                n_w, both = count(lambda x: w in x[2]), count(lambda x: e in x[0] and w in x[1])
                ic = math.log2(n / n_e)
                part = lambda x, a, b: x * math.log(x * n / (a * b)) if x else 0
                all_w = max(n_w, both)
                g2 = 2 * (part(both, n_e, all_w) + part(n_e - both, n_e, n - all_w) + part(all_w - both, n - n_e, all_w) + part(n - n_e - all_w + both, n - n_e, n - all_w))
                if n_e >= pii.SUPPORT and both >= pii.SUPPORT and g2 >= pii.SIGNIFICANT and ic > 0 and math.log2(both * n / (n_e * max(n_w, both))) >= pii.GENERALISE * ic:
                    out.add((d, w))
    return out


def test_terms_against_counting_over_all_documents(spark):
    prose = words_of(0, 34)
    rng = random.Random(34)
    common = prose(40)
    rows = []
    for i in range(90):
        w = [rng.choice(common) for _ in range(rng.randint(5, 25))]
        if i % 5 == 0:
            w.insert(rng.randint(0, 4), f"u{i % 15}@site.org")
            w += [f"code{i % 15}", f"Often{i % 10}."]
        elif i % 7 == 0:
            w.append("often0")
        rows.append((i, " ".join(w)))
    got = {(r["doc_id"], dict(rows)[r["doc_id"]][t["start"] : t["end"]].lower()) for r in pii.find_all(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "test")).collect() for t in r["terms"]}
    assert got == naive_terms(rows) and got


def test_terms_of_an_entity_in_many_documents(spark):
    """Random words next to an address in a third of all documents disclose nothing; one that goes with it does.  A very long text among them."""
    rng = random.Random(35)
    vocabulary = [f"w{i}" for i in range(1500)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(20)) + " a@b.org" * (i % 3 == 0) + " insider" * (i % 6 == 0)) for i in range(600)]
    rows.append((900, " ".join(rng.choice(vocabulary) for _ in range(60_000)) + " a@b.org insider"))
    got = {(r["doc_id"], dict(rows)[r["doc_id"]][t["start"] : t["end"]]) for r in pii.find_all(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "test")).collect() for t in r["terms"]}
    assert got == {(i, "insider") for i in [*range(0, 600, 6), 900]}


def test_a_labelled_document_on_many_rows_is_learned_from_once(spark, monkeypatch):
    prose, seen = words_of(0, 36), []
    rows = [(i, " ".join(prose(20) + ["numskull"] * (i % 4 == 0))) for i in range(1, 80)]
    df = spark.createDataFrame(rows + [(4, f"numskull copy {i}") for i in range(3000)] + [(4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1, 80)], "doc_id long, toxic int")
    learn = toxicity.FactorizationMachine.learn
    monkeypatch.setattr(toxicity.FactorizationMachine, "learn", classmethod(lambda cls, documents, *a: (seen.append(len(documents)), learn(documents, *a))[1]))
    toxicity.learn(df, labels)
    assert seen == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(1, 80))]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    prose = words_of(0, 41)
    passage, base, sf = prose(60), prose(80), str(tmp_path_factory.mktemp("sf"))
    rows = [(i, " ".join(prose(60) + passage + prose(40))) for i in range(6)]  # a passage in six documents
    rows += [(10 + i, " ".join([*base[:40], f"edit{i}", *base[41:]])) for i in range(4)]  # near copies
    rows += [(20 + i, " ".join(prose(70))) for i in range(20)] + [(50, "Write to a.b@c.de or call +44 20 7946 0958. " + " ".join(prose(50)))]
    rows += [(60, None), (61, ""), (62, "too short"), (63, "again and again " * 30), (None, " ".join(prose(45))), rows[30], (70, " ".join(prose(5000)))]
    kind = f"{KIND}, text_key string, component_id long"
    spark.createDataFrame([(d, t, "en", "s", len(t or ""), "k", 7) for d, t in rows], kind).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(20, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf, rows, passage


def test_pipeline(spark, corpus):
    sf, rows, passage = corpus
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        path = f"{sf}/{name.replace(' ', '-')}"
        out.write.parquet(path)
        columns, docs = docs.columns, spark.read.parquet(path)
        assert name == "best-fit packing" or docs.columns == columns
        seen[name] = docs
    ids = {n: sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in d.select("doc_id").collect()) for n, d in seen.items()}
    rejected = {60, 61, 62, 63}
    assert ids["quality rules"] == sorted(d if d is not None else -1 for d, _ in rows if d not in rejected)
    assert ids["MinHash near-dedup"] == sorted({d if d is not None else -1 for d, _ in rows} - rejected - {11, 12, 13})
    left = {r["doc_id"]: r["text"] for r in seen["substring dedup"].collect()}
    assert set(left) == {None if d == -1 else d for d in ids["MinHash near-dedup"]}
    assert [d for d, t in left.items() if " ".join(passage) in t] == [0]
    clean = {r["doc_id"]: r for r in seen["PII"].collect()}
    assert "[EMAIL]" in clean[50]["text"] and "[PHONE]" in clean[50]["text"] and clean[50]["n_chars"] == len(clean[50]["text"])
    assert all(clean[d]["text"] == t for d, t in left.items() if d != 50)
    places = [r.asDict() for r in seen["best-fit packing"].collect()]
    assert {r["doc_id"] for r in places} == set(left)
    for s in {r["sequence_id"] for r in places}:
        at = 0
        for r in sorted((r for r in places if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
    every = lambda df: sorted(map(repr, ((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())))
    assert every(corpus_pipeline.run(spark, sf)) == every(seen["best-fit packing"])


def test_interleaved_and_retried_stages(spark, corpus, tmp_path):
    """A stage that is called for another table, or again, takes nothing away from a result that is still to be read."""
    sf, _, _ = corpus
    (_, rules), (_, near), *_ = corpus_pipeline.STAGES
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, two = rules(spark, docs, sf), rules(spark, docs.filter("doc_id < 40"), sf)
    one.write.parquet(str(tmp_path / "one"))
    first = near(spark, spark.read.parquet(str(tmp_path / "one")), sf)
    assert two.count() > 0
    two.write.parquet(str(tmp_path / "two"))
    second = near(spark, spark.read.parquet(str(tmp_path / "two")), sf)
    again = near(spark, spark.read.parquet(str(tmp_path / "two")), sf)
    assert first.count() > 0 and second.count() == again.count() > 0


def test_pipeline_of_nothing(spark, corpus, tmp_path):
    sf, _, _ = corpus
    spark.read.parquet(f"{sf}/documents.parquet").filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").filter("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_only_what_a_result_reads_is_left(spark, corpus):
    sf, _, _ = corpus
    with Scratch.collected() as made:
        out = substrings.repeated_passages(spark.read.parquet(f"{sf}/documents.parquet"))
    read = {f.rsplit("/", 1)[0] for f in out.inputFiles() if "docsect-" in f}
    held = {p if ":" in p else f"file://{p}" for x in made for _, p in x.saved}
    assert {p.replace("file:///", "file:/") for p in held} == {p.replace("file:///", "file:/") for p in read}
