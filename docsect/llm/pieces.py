"""SentencePiece encoding and decoding by a max-plus parallel scan.

The vocabulary is one of merges: the pair of neighbours whose union is the best scored piece is merged first, the
leftmost of equal ones.  A row of pieces is the encoding of its text exactly if each two neighbours are the encoding of
what they spell together.  So the encoding is a path over the text, on which neighbouring pieces have to agree (weight 0,
else minus infinity), and a chunk of a text acts on the paths that reach its left border as a matrix in the (max, +)
semiring.  The state at a border is the piece that reaches over it or ends there.  Chunks yield their matrices
independently, the matrices of a text are combined by an associative scan, in blocks of BLOCK chunks and then over the
blocks, which gives each border its state on the one path that goes through, and every chunk then traces its own part
back between the states at its ends.  A text of any length is thus worked on by many tasks at once, and its ids
are the same for all sizes of chunks.

Pieces hold the space mark only at their start, so at each space mark that follows another character no piece passes.
Between the first and last such joint of a chunk the words are encoded one by one (and remembered, many at a time, as
arrays); only the ends of a chunk need the paths.  Runs of spaces are words of their own.

The vocabulary file gives pieces and scores; the ids are those of the library (tested).  Unknown characters are spelt as
bytes.  Decoding joins the pieces, so any text comes back exactly, save that a string may hold no U+2581, which stands
for the space.

Null and empty texts have no pieces.  Repeated rows are encoded each; doc_id may be null or repeated.  Extra columns are
ignored.  An empty table has no rows.  No ties are left open: of equal scores the leftmost pair is merged.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsect.llm.common import Scratch, with_clear_names

SPACE = "▁"
CHUNK = 1 << 14  # characters
BLOCK = 256  # chunks
REMEMBERED = 700_000
LOW = float("-inf")
SHORT = 40  # characters of a word that is worked on together with others
AT_ONCE = 1 << 20  # characters
#: Before a run of space marks that follows another character.
JOINT = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")
_models: dict[str, Model] = {}


class Model:
    """Pieces, merges and bytes of a SentencePiece file."""

    def __init__(self, path: str):
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=path)
        n = file.get_piece_size()
        usable = [i for i in range(n) if not (file.is_control(i) or file.is_unknown(i) or file.is_byte(i) or file.is_unused(i))]
        self.names = [file.id_to_piece(i) for i in range(n)]
        self.ids = {self.names[i]: i for i in usable}
        if any(JOINT.search(x) for x in self.ids):
            raise ValueError("pieces of this model pass from one word to the next")
        self.byte = {int(self.names[i][1:-1], 16): i for i in range(n) if file.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.longest = max(map(len, self.ids))
        # what two pieces merge to, and the place of that merge: the best score is 0
        order = {score: r for r, score in enumerate(sorted({file.get_score(i) for i in usable}, reverse=True))}
        place = {i: order[file.get_score(i)] for i in usable}
        self.merge = {(self.ids[x[:k]], self.ids[x[k:]]): (place[i], i) for x, i in self.ids.items() for k in range(1, len(x)) if x[:k] in self.ids and x[k:] in self.ids}
        keys = np.array([a * n + b for a, b in self.merge], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.places, self.goals = keys[order], *(np.array([x[i] for x in self.merge.values()], dtype=np.int64)[order] for i in (0, 1))
        letters = sorted((ord(x), i) for x, i in self.ids.items() if len(x) == 1)
        self.letters, self.letter_ids = (np.array([x[i] for x in letters], dtype=np.int64) for i in (0, 1))
        self.known: dict[str, bytes] = {}
        self.agreed: dict[tuple[str, str], bool] = {}
        self.text = [x.replace(SPACE, " ") for x in self.names]
        for byte, i in self.byte.items():
            self.text[i] = chr(byte) if byte < 0x80 else None
        self.high = np.array([x is None for x in self.text])

    def cuts(self, text: str) -> list[str]:
        """The pieces of one stretch, an unknown character each as itself: merges from a heap, best first."""
        parts, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        ids = [self.ids.get(c, -1) for c in parts]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < len(parts) and (m := self.merge.get((ids[i], ids[j]))):
                heapq.heappush(heap, (m[0], i, j, ids[i], ids[j]))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, j, x, y = heapq.heappop(heap)
            if after[i] != j or ids[i] != x or ids[j] != y:  # one of them was merged meanwhile
                continue
            parts[i] += parts[j]
            ids[i], ids[j], after[i] = self.merge[x, y][1], -2, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [parts[i] for i in range(len(parts)) if ids[i] != -2]

    def agree(self, x: str, y: str) -> bool:
        """Whether two neighbouring pieces stay as they are; an empty x stands before the text."""
        if (known := self.agreed.get((x, y))) is None:
            if len(self.agreed) > REMEMBERED:
                self.agreed.clear()
            known = self.agreed[x, y] = self.cuts(x + y) == [z for z in (x, y) if z]
        return known

    def piece(self, x: str) -> bool:
        return x in self.ids or len(x) == 1

    def spell(self, parts: list[str]) -> bytes:
        """Ids of pieces; unknown ones as bytes."""
        out = array("I")
        for x in parts:
            if (i := self.ids.get(x)) is not None:
                out.append(i)
            else:
                out.extend(self.byte[b] for b in x.encode("utf-8", "surrogatepass"))
        return out.tobytes()

    def words(self, words: list[str]) -> bytes:
        """Ids of stretches between joints, one after the other."""
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            self.learn(words)
            return b"".join(map(self.known.__getitem__, words))

    def learn(self, words) -> None:
        """Makes sure that the ids of all words are remembered: short words at once, as arrays, others one by one."""
        words = set(words)
        new = words.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = words
        short = sorted((w for w in new if len(w) <= SHORT), key=len)
        if len(short) >= 64:
            for i in range(0, len(short), 16384):
                self.known.update(self.many(short[i : i + 16384]))
        for w in new:
            if w not in self.known:
                self.known[w] = self.spell(self.cuts(w))

    def many(self, words: list[str]) -> dict[str, bytes]:
        """The same for many words side by side, a merge a word and turn; words with unknown characters are left out."""
        size = np.array([len(w) for w in words])
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.letters, text), len(self.letters) - 1)
        found = np.where(self.letters[at] == text, self.letter_ids[at], -1)
        table = np.full((len(words), int(size.max()) + 1), -1, dtype=np.int64)
        inside = np.arange(table.shape[1]) < size[:, None]
        table[inside] = found
        good = ~((table < 0) & inside).any(axis=1)
        never, n = np.int64(1 << 40), len(self.names)

        def places(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = left * n + right
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (left >= 0) & (right >= 0) & (self.keys[at] == key)
            return np.where(hit, self.places[at], never), self.goals[at]

        active = np.flatnonzero(good & (size > 1))
        rows = table[active]
        rank, goal = places(rows[:, :-1], rows[:, 1:])
        while len(active):
            best = rank.argmin(axis=1)  # the leftmost of the best
            each = np.arange(len(active))
            going = rank[each, best] < never
            if not going.all():
                table[active[~going]] = rows[~going]
                active, rows, rank, goal, best = active[going], rows[going], rank[going], goal[going], best[going]
                each = np.arange(len(active))
                if not len(active):
                    break
            rows[each, best] = goal[each, best]
            # close the gap behind the merged pair
            columns = np.arange(rows.shape[1])
            behind = np.minimum(columns + (columns > best[:, None]), rows.shape[1] - 1)
            rows = np.take_along_axis(rows, behind, axis=1)
            rows[:, -1] = -1
            behind = np.minimum(behind[:, :-1], rank.shape[1] - 1)
            rank, goal = np.take_along_axis(rank, behind, axis=1), np.take_along_axis(goal, behind, axis=1)
            rank[:, -1] = never
            for i in (best, best - 1):  # the merged piece with its neighbours
                ok = np.flatnonzero((i >= 0) & (i < rank.shape[1]))
                rank[ok, i[ok]], goal[ok, i[ok]] = places(rows[ok, i[ok]], rows[ok, i[ok] + 1])
        full = table >= 0
        raw, ends = table[full].astype("<u4").tobytes(), (4 * np.append(0, np.cumsum(full.sum(axis=1)))).tolist()
        return {w: raw[a:b] for w, a, b, x in zip(words, ends, ends[1:], good.tolist()) if x}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def marked(text: str) -> str:
    """The text as the pieces spell it: one space before it, and marks for spaces."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def joints(text: str, begin: int, end: int) -> list[int]:
    """The first and last place in begin..end that every path passes: where a run of space marks begins after another character."""
    at = text.find(SPACE, max(begin, 1), end)
    while at >= 0 and text[at - 1] == SPACE:
        at = text.find(SPACE, at + 1, end)
    if at < 0:
        return []
    last = text.rfind(SPACE, at, end)
    while text[last - 1] == SPACE:
        last = text.rfind(SPACE, at, last)
    return [at, last]


def stretches(text: str) -> list[str]:
    """The text between its joints."""
    parts = text.split(SPACE)
    if "" not in parts[1:]:
        return [*([parts[0]] if parts[0] else []), *[SPACE + p for p in parts[1:]]]
    return [x for x in JOINT.split(text) if x]


def states_at(m: Model, text: str, border: int) -> list[tuple[int, int]]:
    """Begin and end of every piece that reaches over a border or ends there; before the text, an empty one."""
    if border == 0:
        return [(0, 0)]
    spans = ((x, y) for x in range(max(0, border - m.longest), border) for y in range(border, min(len(text), x + m.longest) + 1))
    return [(x, y) for x, y in spans if m.piece(text[x:y]) and m.agree("", text[x:y])]


def follow(m: Model, text: str, entry: tuple[int, int], stop: int) -> dict[int, int]:
    """The pieces that can come after entry, each by its end: where it begins.  Up to one beginning before stop."""
    last = {entry[1]: entry[0]}
    for at in range(entry[1], stop):
        if at in last:
            before = text[last[at] : at]
            for end in range(at + 1, min(len(text), at + m.longest) + 1):
                if m.piece(text[at:end]) and m.agree(before, text[at:end]):
                    last[end] = at
    return last


def back(m: Model, text: str, last: dict[int, int], begin: int, end: int) -> bytes:
    """Ids of the pieces from begin to end by what follow() has found."""
    cuts = [end]
    while cuts[-1] > begin:
        cuts.append(last[cuts[-1]])
    return m.spell([text[a:b] for a, b in zip(cuts[:0:-1], cuts[-2::-1])])


def transfer(m: Model, text: str, begin: int, end: int) -> np.ndarray:
    """The max-plus matrix of the characters begin..end: 0 from each state at begin to each at end that it can lead to, else minus infinity."""
    rows, columns = states_at(m, text, begin), states_at(m, text, end)
    out = np.full((len(rows), len(columns)), LOW)
    stops = joints(text, begin + 1, end)

    def reached(last: dict[int, int], entry: tuple[int, int]) -> list[bool]:
        # a piece that reaches over both borders stays as it is
        return [last.get(y) == x if x >= entry[1] else (x, y) == entry for x, y in columns]

    tail = reached(follow(m, text, (stops[-1], stops[-1]), end), (stops[-1], stops[-1])) if stops else None
    for i, entry in enumerate(rows):
        if stops:
            if entry[1] <= stops[0] and stops[0] in follow(m, text, entry, stops[0]):
                out[i, tail] = 0.0
        else:
            out[i, reached(follow(m, text, entry, end), entry)] = 0.0
    return out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product: first a, then b."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1, initial=LOW)


def scan(matrices: list[np.ndarray], entry: int = 0, leaving: int | None = None) -> list[int]:
    """The state at every border of the best path from entry to leaving, by prefix products (Hillis and Steele)."""
    n, prefix, step = len(matrices), [matrices[0][entry : entry + 1], *matrices[1:]], 1
    while step < n:
        prefix = [combine(prefix[i - step], prefix[i]) if i >= step else prefix[i] for i in range(n)]
        step *= 2
    states = [int(np.argmax(prefix[-1][0])) if leaving is None else leaving]
    for i in range(n - 1, 0, -1):
        states.append(int(np.argmax(prefix[i - 1][0] + matrices[i][:, states[-1]])))
    return [entry, *states[::-1]]


def trace_chunk(m: Model, text: str, begin: int, end: int, entry: int, leaving: int) -> bytes:
    """Ids of the pieces after the entry-th state at begin, up to the leaving-th at end."""
    first, goal = states_at(m, text, begin)[entry], states_at(m, text, end)[leaving]
    if goal[1] <= first[1]:
        return b""
    stops = joints(text, begin + 1, end)
    if not stops:
        return back(m, text, follow(m, text, first, end), first[1], goal[1])
    out = back(m, text, follow(m, text, first, stops[0]), first[1], stops[0]) + m.words(stretches(text[stops[0] : stops[1]]))
    return out + back(m, text, follow(m, text, (stops[1], stops[1]), end), stops[1], goal[1])


def decode(m: Model, raw: bytes) -> str:
    """The text of ids: pieces joined, bytes read as UTF-8, marks made spaces, and the first space taken away."""
    ids = np.frombuffer(raw, dtype="<u4")
    if m.high[ids].any():
        out = b"".join([m.text[i].encode() if m.text[i] is not None else bytes([m.of_byte[i]]) for i in ids.tolist()]).decode("utf-8", "surrogatepass")
    else:
        out = "".join(map(m.text.__getitem__, ids.tolist()))
    return out[1:]


CODED = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def _coded(doc, raw: bytes, m: Model, text: str) -> tuple:
    back = decode(m, raw)
    return doc, len(raw) // 4, zlib.crc32(raw), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text, raw


def _rows(rows: list[tuple], keep: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()][: 5 + keep]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip", "ids"][: 5 + keep])


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, crc32 of the ids, digest of the decoded text, and whether it equals the text; keep_ids: the ids too.

    Texts of one chunk are done where they are.  Longer ones are cut into chunks that are dealt out to all tasks.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    scratch = Scratch(docs.sparkSession, "pieces")
    clean = with_clear_names(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = CODED + ", ids binary" * keep_ids

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            rows, names, texts, at = [], batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), 0
            while at < len(texts):
                parts, held, first = [], 0, at
                while at < len(texts) and held < AT_ONCE:
                    parts.append(stretches(marked(texts[at])))
                    held += len(texts[at])
                    at += 1
                m.learn(chain.from_iterable(parts))
                rows += [_coded(names[first + i], m.words(p), m, texts[first + i])[: 5 + keep_ids] for i, p in enumerate(parts)]
            if rows:
                yield _rows(rows, keep_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = model(path).longest
        kinds = {"row": pa.string(), "doc_id": pa.int64(), "digest": pa.string(), "i": pa.int32(), "lead": pa.int32(), "size": pa.int32(), "part": pa.string()}
        for batch in batches:
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                whole, digest = marked(text), hashlib.sha256(text.encode()).hexdigest()
                borders = [*range(0, len(whole), chunk), len(whole)]
                if len(borders) > 2 and borders[-1] - borders[-2] < reach:
                    del borders[-2]  # no piece may reach over two borders
                for i, (a, b) in enumerate(zip(borders, borders[1:])):
                    # a piece's reach before and after, so that a chunk knows the states at its borders
                    lead = min(a, reach)
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((row, doc, digest, i, lead, b - a, whole[a - lead : b + reach]), kinds.values())], list(kinds))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            found = [transfer(m, p, a, a + n) for p, a, n in zip(*(batch.column(c).to_pylist() for c in ("part", "lead", "size")))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("i"), pa.array([len(x) for x in found], pa.int32()), pa.array([x.tobytes() for x in found], pa.binary())], ["row", "i", "height", "matrix"])

    def read(table: pa.Table) -> list[np.ndarray]:
        return [np.frombuffer(x).reshape(n, -1) for n, x in zip(table["height"].to_pylist(), table["matrix"].to_pylist())]

    def product(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        found = read(table)
        out = found[0]
        for x in found[1:]:
            out = combine(out, x)
        return pa.table({"row": table["row"][:1], "block": table["block"][:1], "height": pa.array([len(out)], pa.int32()), "matrix": pa.array([out.tobytes()], pa.binary())})

    def over_blocks(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        found = scan(read(table))
        return pa.table({"row": table["row"], "block": table["block"], "first": pa.array(found[:-1], pa.int32()), "last": pa.array(found[1:], pa.int32())})

    def within(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        found = scan(read(table), table["first"][0].as_py(), table["last"][0].as_py())
        return pa.table({"row": table["row"], "i": table["i"], "entry": pa.array(found[:-1], pa.int32()), "leaving": pa.array(found[1:], pa.int32())})

    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            found = [trace_chunk(m, p, a, a + n, x, y) for p, a, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("part", "lead", "size", "entry", "leaving")))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "doc_id", "digest", "i")], pa.array(found, pa.binary())], ["row", "doc_id", "digest", "i", "ids"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            rows = []
            for doc, parts, digest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "parts", "digest"))):
                found = _coded(doc, b"".join([p["ids"] for p in parts]), m, "")
                rows.append((*found[:4], found[3] == digest, found[5])[: 5 + keep_ids])
            if rows:
                yield _rows(rows, keep_ids)

    ordinary = clean.filter(F.length("text") < chunk).mapInArrow(short, schema)
    giant = clean.filter(F.length("text") >= chunk).withColumn("row", F.expr("uuid()"))
    dealt = giant.mapInArrow(cut, "row string, doc_id long, digest string, i int, lead int, size int, part string").repartition("row", "i")
    chunks = scratch.save(dealt, "chunks")
    each = scratch.save(chunks.mapInArrow(matrices, "row string, i int, height int, matrix binary").withColumn("block", F.expr(f"i div {BLOCK}").cast("int")), "matrices")
    blocks = each.groupBy("row", "block").applyInArrow(product, "row string, block int, height int, matrix binary")
    ends = blocks.groupBy("row").applyInArrow(over_blocks, "row string, block int, first int, last int")
    borders = each.join(ends, ["row", "block"]).groupBy("row", "block").applyInArrow(within, "row string, i int, entry int, leaving int")
    borders = scratch.save(borders, "borders")
    scratch.drop(each)
    # borders grow with the corpus, so they are never sent to all tasks
    traced = chunks.join(borders.hint("merge"), ["row", "i"]).mapInArrow(backtrace, "row string, doc_id long, digest string, i int, ids binary")
    joined = traced.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.sort_array(F.collect_list(F.struct("i", "ids"))).alias("parts"))
    return ordinary.unionByName(joined.select("doc_id", "parts", "digest").mapInArrow(finish, schema))


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
