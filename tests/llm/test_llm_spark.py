"""Each operator on small tables: nulls, empty and repeated rows, extra columns, and brute force."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from docsect.llm import chat, media, minhash, packing, pieces, pii, quality, substrings, toxicity, urls
from docsect.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long, key string, rank long, _spans string"
random.seed(11)
VOCABULARY = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


BASE = prose(120)
LONG = prose(30000)
EDITED = " ".join([*BASE.split()[:60], "changed", *BASE.split()[61:]])
TEXTS = [BASE, BASE, EDITED, None, "", "one two", "one two", prose(80) + "\n" + BASE, LONG, "mail a.b@c.de or +44 20 7946 0958", "  \n\t ", prose(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "k", 1, "x") for i, t in enumerate(TEXTS)]
    rows += [rows[0], (None, prose(50), None, None, None, None, None, None)]  # a repeated row, and one of nulls
    return spark.createDataFrame(rows, KIND).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def test_media(spark, docs, empty, tmp_path):
    scratch = Scratch(spark, "test")
    manifest = scratch.save(media.write_shards(docs, scratch.root + "/shards", 1 << 12), "m")
    got = media.read_features(media.fill_metadata(manifest, scratch.root + "/shards"), scratch.root + "/shards").collect()
    assert len(got) == 14
    texts = dict(enumerate(TEXTS))
    for r in got:
        if r["doc_id"] is not None:
            raw = (texts[r["doc_id"]] or "").encode()
            padded = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
            assert r["height"] * 64 == len(padded)
    one = media.compact(manifest)
    assert one.count() == 14 and one.select("digest").distinct().count() == one.select("digest", "shard", "offset").distinct().count()
    assert media.write_shards(empty, scratch.root + "/none").count() == 0


def brute_paths(rows):
    """Best path of each tree, by walking up from every leaf."""
    by = {(t, i): (p, s) for t, i, p, s in rows}
    best = {}
    for t, i in by:
        if any(t2 == t and p == i for (t2, _), (p, _) in by.items()):
            continue
        path, total, at = [], 0.0, i
        while at is not None and at not in path and (t, at) in by:
            path.append(at)
            total += by[t, at][1]
            at = by[t, at][0]
        if at in path:
            continue
        rank = (total, len(path), -i)
        if t not in best or rank > best[t][0]:
            best[t] = (rank, path[::-1])
    return {t: p for t, (_, p) in best.items()}


def test_reply_trees(spark):
    random.seed(4)
    rows = []
    for t in "abcd":
        for i in range(1, 40):
            rows.append((t, i, random.choice([None, 99, *range(1, i)]) if i % 9 == 0 else (random.randint(max(1, i - 4), i - 1) if i > 1 else None), float(random.randint(-2, 5))))
    rows += [("c", 50, 51, 1.0), ("c", 51, 50, 1.0)]  # a cycle
    rows += [("chain", i, i - 1 if i else None, 1.0) for i in range(70)]
    df = spark.createDataFrame([(*r, "user", f"t{r[1]}") for r in rows], "tree string, id long, parent long, score double, role string, text string")
    got = {}
    for r in chat.choose_branches(df, Scratch(spark, "test")).collect():
        got.setdefault(r["tree"], {})[r["place"]] = r["id"]
    assert {t: [p[i] for i in sorted(p, reverse=True)] for t, p in got.items()} == brute_paths(rows)


def test_chat_formatting_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "a\\b <|end|> \\<s>", None, "", "line\nline <", "<|turn|>x<|text|>y<|end|>"]
    rows = [(1, i, ["user", "assistant", "<|end|>r", None][i % 4], t, "extra") for i, t in enumerate(said)] + [(None, 0, "assistant", "n", "e"), (2, 1, "user", "same", "e"), (2, 1, "user", "same", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree string")
    scratch = Scratch(spark, "test")
    formatted = chat.format_conversations(scratch.save(chat.turns_as_replies(df), "m"), scratch)
    out = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    whole = "".join((r[2] or "") + "\n" + (r[3] or "") + "\n" for r in rows[:6])
    assert out[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and out[1]["n_turns"] == 6
    learned = "".join(t or "" for i, t in enumerate(said) if i % 4 == 1)
    assert out[1]["loss_chars"] == len(learned) and out[1]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert out[2]["n_turns"] == 2 and out[None]["loss_chars"] == 1
    for r in formatted.collect():
        assert sum(x["n"] for x in r["loss_runs"]) == len(r["formatted"]) and "</s>" not in r["formatted"] and "[INST]" not in r["formatted"]
        at, under = 0, ""
        for x in r["loss_runs"]:
            under += r["formatted"][at : at + x["n"]] if x["learned"] else ""
            at += x["n"]
        if r["tree"] == "1":
            assert re.sub(r"(?s)\\(.)", r"\1", under) == learned
    flipped = formatted.withColumn("loss_runs", F.transform("loss_runs", lambda r: r.withField("learned", ~r["learned"])))
    other = {r["conv_id"]: r["loss_sha256"] for r in chat.digests(flipped).collect()}
    assert all(other[c] != out[c]["loss_sha256"] for c in (1, None))  # the digests are those of the mask
    long = spark.createDataFrame([(5, 0, "user", "é" * 3_000_000), (5, 1, "assistant", "<|end|>" * 500_000)], "conv_id long, turn long, role string, text string")
    (r,) = chat.digests(chat.format_conversations(scratch.save(chat.turns_as_replies(long), "m"), scratch)).collect()
    assert r["loss_sha256"] == hashlib.sha256(b"<|end|>" * 500_000).hexdigest() and r["n_turns"] == 2
    assert chat.digests(chat.format_conversations(scratch.save(chat.turns_as_replies(df.filter("false")), "m"), scratch)).count() == 0


def test_packing(docs, empty):
    got = [r.asDict() for r in packing.pack(docs, keep_ids=True).collect()]
    total, bins = {}, {}
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-sum(r["length"] for r in got) // 2048)
    pieces_of = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == 8)
    assert len(pieces_of) > 10 and all(p[2] == 2048 for p in pieces_of[1:]) and pieces_of[1][1] == pieces_of[0][2]
    assert sum(r["doc_id"] == 0 for r in got) == 2 and [r["length"] for r in got if r["doc_id"] in (3, 4)] == [1, 1]
    assert packing.pack(empty).count() == 0 and total == {}


def test_pii(spark, docs, empty):
    found = {r["doc_id"]: r for r in pii.find_all(docs, Scratch(spark, "test")).collect()}
    assert found[9]["n_email"] == 1 and found[9]["n_phone"] == 1 and found[9]["base"] == "email:5:13,phone:17:33" and found[3]["base"] == ""
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == 14
    assert [r["text"] for r in clean.filter("doc_id = 9").collect()] == ["mail [EMAIL] or [PHONE]"]
    assert pii.sanitise(empty).count() == 0
    # a code word that stands only beside one address gives it away; words that stand everywhere do not
    rows = [(i, f"write to secret project zebra{'' if i % 2 else '!'} x@y.org now and then") for i in range(6)] + [(10 + i, f"write now and then {prose(20)}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {r["doc_id"]: r["terms"] for r in pii.find_all(df, Scratch(spark, "test")).collect()}
    named = {rows[0][1][t["start"] : t["end"]] for t in terms[0]}
    assert "zebra" in named and "now" not in named and "write" not in named and terms[12] == []
    assert "zebra" not in pii.sanitise(df).filter("doc_id = 0").first()["text"]


def test_toxicity(spark, empty):
    random.seed(8)
    rows = [(i, prose(40) + (" you utter numskull" if i % 4 == 0 else "")) for i in range(400)] + [(1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(0, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.learn(df, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in held) and 0 <= got[1000] < 0.5 and got[1000] == got[1001]
    used = {r["doc_id"] for r in toxicity.sample_labels(labels).collect()}
    assert not used & set(held)
    assert toxicity.score(empty.select("doc_id", "text"), model).count() == 0
    flat = toxicity.learn(df, labels.filter("false"))
    assert toxicity.score(df, flat).first()["score"] < 0.5


def test_substrings(spark, docs, empty):
    got = {(r["doc_id"], r["partner_id"], r["start_word"], r["end_word"]) for r in substrings.repeated_passages(docs).collect()}
    assert {(a, b) for a, b, _, _ in got} >= {(0, 1), (1, 0), (2, 0), (7, 0)} and {a for a, *_ in got} == {0, 1, 2, 7}
    assert any(a == 7 and s == 80 and e == 200 for a, _, s, e in got)
    left = {r["doc_id"]: r for r in substrings.remove_repeats(docs).collect()}
    assert left[0]["text"] == BASE and 1 not in left and left[7]["text"] == TEXTS[7][: -len(BASE)] and left[7]["n_chars"] == len(left[7]["text"])
    assert left[3]["text"] is None and left[8]["text"] == LONG
    assert substrings.repeated_passages(empty).count() == 0


def test_outside_spans(spark):
    df = spark.createDataFrame([("abédefgh", [(5, 6), (2, 4), (3, 5), (8, 9)]), ("x", [(0, 1)]), ("", [(0, 0)])], "text string, spans array<struct<start_byte: bigint, end_byte: bigint>>")
    assert [r[0] for r in df.select(substrings.outside_spans(F.col("text"), F.col("spans"))).collect()] == ["abfg", "", ""]


def brute_statistics(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark):
    texts = [None, "", " \n\t", "a b", "x y z\nx y z\nq", "é# *|<>", "r r r r r r r r r", "a b c d e f a b c d e g", "\n\nl\nl\n \nl"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counted, name = quality.with_statistics(df)
    for r in counted.collect():
        assert tuple(r[name[k]] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_statistics(texts[r["doc_id"]])


def test_quality_rules_are_learned(spark, empty):
    random.seed(9)
    rows = [(i, prose(50) if i % 3 else " ".join(w + "!!!" for w in prose(50).upper().split()), "x") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(1, None), (None, 0)], "doc_id long, quality int")
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i in range(600) if i % 3}
    assert quality.keep_good(df, labels.filter("false")).count() == 600 and quality.keep_good(empty, labels).count() == 0


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(s), find(d) if s else d) for d, s in sets.items()}


def test_near_duplicates(spark, docs, empty):
    random.seed(10)
    rows, base = [], prose(100).split()
    for i in range(150):  # a large group whose members are seldom similar to each other but to the less edited ones
        w = list(base)
        for _ in range(random.randint(0, 7)):
            w[random.randrange(100)] = random.choice(VOCABULARY) + str(i)
        rows.append((i, " ".join(w)))
    rows += [(200 + i, prose(70)) for i in range(40)] + [(300, None), (301, ""), (302, "a b"), (303, "A b"), (304, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components(rows)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())
    kept = minhash.keep_first(docs)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.select("doc_id").collect())
    assert kept.columns == docs.columns and ids == [(False, i) for i in (0, 3, 4, 5, 7, 8, 9, 10, 11)] + [(True, 0)]
    assert minhash.near_duplicates(empty).count() == 0


def test_urls(spark):

    entries = spark.createDataFrame([("bad.com", "add", "2021-01-10"), ("bad.com", "add", "2021-01-10"), ("bad.com", "remove", "2021-02-01"), ("bad.com", "add", "2021-03-01"), ("a.bad.com", "add", "2021-01-20"), ("x.org", "add", "2021-01-01"), ("x.org", "remove", "2021-01-01"), (None, "add", "2021-01-01")], "pattern string, action string, day string").withColumn("day", F.to_date("day"))
    asked = [("https://u@a.bad.com:80/x", "2021-01-15"), ("http://a.bad.com", "2021-01-25"), ("http://bad.com/?q", "2021-02-01"), ("http://BAD.com#f", "2021-03-01"), ("http://notbad.com", "2021-01-15"), ("http://x.org", "2021-06-01"), (None, "2021-01-15"), ("nonsense", "2021-01-15"), ("http://bad.com", None)]
    df = spark.createDataFrame([(i, u, d) for i, (u, d) in enumerate(asked)], "page_id long, url string, d string")
    captures = df.select("page_id", urls.host_of(F.col("url")).alias("host"), F.to_date("d").alias("fetched_on"))
    got = {r["page_id"]: r["pattern"] for r in urls.as_of(captures, entries).collect()}
    assert got == {0: "bad.com", 1: "a.bad.com", 2: None, 3: "bad.com", 4: None, 5: None, 6: None, 7: None, 8: None}
    assert not urls.as_of(captures, entries.filter("false")).filter("blocked").count() and urls.as_of(captures.filter("false"), entries).count() == 0


def test_pieces(docs, empty):
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["ids"])
    got = sorted(pieces.encode(docs, chunk=500, keep_ids=True).collect(), key=key)
    other = sorted(pieces.encode(docs, keep_ids=True).collect(), key=key)
    assert len(got) == 14 and all(r["round_trip"] for r in got) and got == other
    for r in got:
        if r["doc_id"] is not None:
            assert r["decoded_sha256"] == hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest() and zlib.crc32(r["ids"]) == r["ids_crc32"]
    assert pieces.encode(empty).count() == 0
