"""The parts of the operators that need no Spark, against brute force."""

import bisect
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from docsect.llm import common, media, minhash, packing, pieces, pii, substrings, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_and_hashes():
    texts = ["", " a  bb\n", "é word " + "x" * 300, "\t\n ", "a bb", None]
    data, offsets = common.text_bytes(pa.array(texts))
    start, end, first = common.words(data, offsets)
    for i, t in enumerate(texts):
        assert [data[a:b].tobytes().decode() for a, b in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]])] == WORD.findall(t or "")
    h = common.word_hashes(data, start, end)
    assert h[0] == h[first[4]] and len(set(h.tolist())) == 5


def test_media_round_trip():
    for raw in (b"", b"a", b"x" * 64, "é".encode() * 1000):
        payload = media.pad(raw)
        png = media.encode_png(payload)
        assert len(payload) % 64 == 0 and payload and media.decode_png(png) == payload
        assert media.read_header(png[: media.HEADER]) == {"width": 64, "height": len(payload) // 64, "bit_depth": 8, "channels": 1}


def test_bins_are_those_of_best_fit_decreasing():
    random.seed(1)
    for _ in range(60):
        counts = {random.randint(1, 2048): random.randint(1, 30) for _ in range(random.randint(1, 60))}
        rooms = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                i = bisect.bisect_left(rooms, length)
                room = rooms.pop(i) if i < len(rooms) else 2048
                bisect.insort(rooms, room - length)
        used = {}
        for length, _, n, first, each, at in packing.plan_bins(counts):
            for j in range(n):
                used.setdefault(first + j // each, []).append((at + j % each * length, length))
        for parts in used.values():
            parts.sort()
            assert [a for a, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist()
        assert sorted(2048 - sum(n for _, n in v) for v in used.values()) == rooms


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, coder = Tokenizer.from_file(path), packing.encoder(path)
    random.seed(3)
    texts = ["", "a<|endoftext|> b", "don't  'll 　 z"] + ["".join(random.choice([" ", "\n", "a", "é", "　", "1", "'s", "\t", ".", "\x1c", "日"]) for _ in range(random.randint(0, 12))) for _ in range(3000)]
    ids, begin = coder.texts(*common.text_bytes(pa.array(texts)))
    for t, a, b in zip(texts, begin, begin[1:]):
        assert ids[a:b].tolist() == whole.encode(t, add_special_tokens=False).ids


def test_cut_leaves_only_the_first_short():
    assert packing.cut(b"\0" * 4 * 5, 2) == [(0, 1), (1, 2), (3, 2)] and packing.cut(b"\0" * 8, 2) == [(0, 2)] and packing.cut(b"\0" * 4, 2) == [(0, 1)]


#: The patterns of the contract (fixed values).
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1]))
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]:
                yield kind, *m.span()


def test_spans_against_the_patterns():
    random.seed(1)
    parts = ["a", "@", ".", "b-", "1", "255", "256", "0007", " ", "-", "+", "(", ")", "12", "4111111111111111", "é", "%", "10.0.0.1", "x@y.z", "+44 20 7946 0958"]
    for _ in range(8000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        assert pii.base_spans(text) == list(brute_spans(text)), text
    assert pii.mask("é a@b.c x 10.0.0.1", "email:2:7,ip:10:18", [{"start": 8, "end": 9, "action": "remove"}]) == "é [EMAIL]  [IP]"


def test_min_max_estimates_without_bias():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        base = rng.integers(0, 2**63, 400, dtype=np.uint64)
        x, y = np.unique(base[:350]), np.unique(base[50:])
        (a, b), (c, d) = minhash.signature(x), minhash.signature(y)
        errors.append(((a == c).mean() + (b == d).mean()) / 2 - len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
    assert abs(np.mean(errors)) < 0.02


def test_compact_windows_cover_every_subsequence_once():
    rng = np.random.default_rng(2)
    first = np.array([0, 60, 70, 130])
    runs = rng.integers(0, 40, 126, dtype=np.uint64)  # many ties
    text, at, lo, hi = substrings.compact_windows(runs, first, np.uint64(5), 10)
    bits = np.uint64(len(runs).bit_length())
    with np.errstate(over="ignore"):
        value = (common.mix(runs ^ np.uint64(5)) >> bits << bits) | np.arange(len(runs), dtype=np.uint64)
    for t in range(3):
        mine = [(a, x, y) for u, a, x, y in zip(text, at, lo, hi) if u == t]
        n = first[t + 1] - first[t] - 4
        for i in range(n):
            for j in range(i + 9, n):
                least = int(np.argmin(value[first[t] + i : first[t] + j + 1])) + i
                assert [a for a, x, y in mine if x <= i <= a <= j <= y] == [least]


def test_passages():
    rng = np.random.default_rng(3)
    a, b, shared = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (300, 200, 80))
    x, y = np.concatenate([a, shared]), np.concatenate([b[:100], shared, b[100:]])
    (found,) = substrings.passages(x, y, [(100 - 300, 300, 379)])
    assert found[:4] == (300, 379, 100, 179) and found[4] == 1.0
    assert substrings.passages(a, b, [(0, 0, 9)]) == []


def test_pairs_mean_what_single_terms_do_not():
    rng = np.random.default_rng(4)
    docs, labels = [], []
    for i in range(1200):
        kind = i % 4  # insult and group together are toxic, either alone is not
        docs.append(np.unique(np.concatenate([rng.integers(1000, 1400, 20), [1] if kind & 1 else [], [2] if kind & 2 else []]).astype(np.int64)))
        labels.append(float(kind == 3))
    m = toxicity.FactorizationMachine.learn(docs, np.array(labels))
    slots = m.slots()
    text, slot = np.array([0, 1, 2, 2]), slots[[1, 2, 1, 2]]
    one, two, both = m.scores(text, slot, 3)
    assert one < 0.5 and two < 0.5 and both > 0.5


def test_one_class_has_a_constant_score():
    m = toxicity.FactorizationMachine.learn([np.array([1]), np.array([2])], np.zeros(2))
    assert m.scores(np.zeros(0, int), np.zeros(0, int), 1)[0] < 0.01


@pytest.fixture(scope="module")
def coder():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.model(path), sentencepiece.SentencePieceProcessor(model_file=path)


def whole(m, text):
    return np.frombuffer(m.words(pieces.stretches(pieces.marked(text))), dtype="<u4").tolist()


def chunked(m, text, size, block=3):
    t = pieces.marked(text)
    borders = [*range(0, len(t), size), len(t)]
    if len(borders) > 2 and borders[-1] - borders[-2] < m.longest:
        del borders[-2]
    parts = [(t[a - min(a, m.longest) : b + m.longest], min(a, m.longest), b - a) for a, b in zip(borders, borders[1:])]
    found = [pieces.transfer(m, p, a, a + n) for p, a, n in parts]
    states = pieces.scan(found)
    blocks = [found[i : i + block] for i in range(0, len(found), block)]
    products = []
    for x in blocks:
        products.append(x[0])
        for y in x[1:]:
            products[-1] = pieces.combine(products[-1], y)
    ends = pieces.scan(products)
    assert [s for x, p, q in zip(blocks, ends, ends[1:]) for s in pieces.scan(x, p, q)[:-1]] == states[:-1]
    return np.frombuffer(b"".join(pieces.trace_chunk(m, p, a, a + n, x, y) for (p, a, n), x, y in zip(parts, states, states[1:])), dtype="<u4").tolist()


def random_texts():
    random.seed(5)
    texts = [" ".join("".join(random.choice(["th", "er", "on", "ing", "a", "wh"]) for _ in range(random.randint(1, 5))) for _ in range(60)) for _ in range(40)]
    texts += ["".join(random.choice([" ", "  ", "a", "the", "\n", "é", "日", "𝄞", "ing", "Hello", "1", "\t", "\x00"]) for _ in range(random.randint(0, 90))) for _ in range(80)]
    return texts + ["therein" * 40, " " * 70, "a" + " " * 50 + "b", "hello world", "token", ""]


def test_pieces_are_those_of_the_library(coder):
    m, library = coder
    for t in random_texts():
        assert whole(m, t) == library.encode(t), t
        assert pieces.decode(m, np.array(whole(m, t), dtype="<u4").tobytes()) == t
        words = pieces.stretches(pieces.marked(t))
        assert all(m.many(words).get(w, m.spell(m.cuts(w))) == m.spell(m.cuts(w)) for w in words)


def test_the_scan_gives_the_same_ids_whatever_the_chunks(coder):
    m, _ = coder
    for t in random_texts():
        for size in (17, 40, 64, 500):
            assert not t or chunked(m, t, size) == whole(m, t), (t, size)


def test_crc_of_ids_is_little_endian():
    assert zlib.crc32(np.array([1, 2], dtype="<u4").tobytes()) == zlib.crc32(b"\1\0\0\0\2\0\0\0")
