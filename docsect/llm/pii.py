"""Personal data: fixed patterns, and terms that disclose a protected entity (information-theoretic sanitisation).

The protected entities are what the patterns find: e-mail and IP addresses, card and phone numbers.  A word of a
document with an entity discloses it if knowing the word makes the entity nearly certain.  With document frequencies over the whole
corpus, PMI(entity; word) = log2(n(both) * N / (n(entity) * n(word))) is held against the entity's information
IC = log2(N / n(entity)): a word whose PMI reaches REMOVE of the IC is removed, one that reaches GENERALISE is
replaced by its kind, at every place in the documents that hold the entity.  n(both) counts documents with both
anywhere.  A high PMI may be chance where counts are low, so the pair's log-likelihood ratio (G2) has to reach SIGNIFICANT
too: of an entity in a third of all documents a word in three of them says nothing.  As n(both) <= n(entity), only words with n(word) <= n(entity) * (N / n(entity)) ** (1 - GENERALISE) can reach
the threshold; pairs are made of those alone.  Pairs in fewer than SUPPORT documents are chance and are not judged.
Word frequencies are counted on hashes inside each task before anything is shuffled.

Each pattern is scanned in time linear in the text.  Null texts are empty.  An empty table has no rows; extra columns are
ignored, or passed on by sanitise().  Repeated rows get the same spans (they
count as one document where their doc_id and text are equal).  Very long texts are one row like others, with a row for each
distinct word while terms are sought.  Overlapping spans are sanitised as one, named by the first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsect.llm.common import LOWER, Scratch, free_names, groups, text_bytes, with_clear_names, word_hashes, words

KINDS = ("email", "ip", "card", "phone")
REMOVE, GENERALISE = 0.95, 0.8
SUPPORT = 3
#: G2 that independent words reach once in a million.
SIGNIFICANT = 24.0
AT_ONCE = 4 << 20
#: Distinct words that a task counts before it hands the counts on.
COUNTED = 1 << 20

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """The local part is the whole run before an @: all shorter ones end at the same @ and begin later."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and LOCAL.match(text[begin - 1]):
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Every four numbers in a row of a dotted run, from its left."""
    out = []
    for m in DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = len(".".join(four))
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                out.append((at, at + size))
            at += size + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All pattern spans in code points, by kind as in KINDS and then by start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", a, b) for a, b in addresses(text)]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entity(kind: str, text: str) -> str:
    """One name for all spellings of an entity."""
    return f"{kind}:{text.lower() if kind in ('email', 'ip') else digits_of(text)}"


def trimmed_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in code points, outer punctuation left out, and its hash."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    lower = LOWER[data]
    start, end, _ = words(lower, np.array([0, len(data)]), trim=True)
    with np.errstate(over="ignore"):
        hashes = word_hashes(lower, start, end).view(np.int64)
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    return points[start], points[end], hashes


def outside(text: str, base: str) -> list[tuple[int, list[tuple[int, int]]]]:
    """Each word hash and the places (start, end) of that word, outside all spans."""
    start, end, hashes = trimmed_words(text)
    taken = np.zeros(len(start), dtype=bool)
    for s in base.split(","):
        _, a, b = s.split(":")
        taken[np.searchsorted(end, int(a), side="right") : np.searchsorted(start, int(b))] = True
    out: dict[int, list[tuple[int, int]]] = {}
    for h, a, b in zip(hashes[~taken].tolist(), start[~taken].tolist(), end[~taken].tolist()):
        out.setdefault(h, []).append((a, b))
    return list(out.items())


FOUND = "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<string>, held string"


def find_base(docs: DataFrame) -> DataFrame:
    """Pattern spans of each row, its entities, and its text if it has any.  docs: doc_id, text_key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, entities, held = {k: [] for k in KINDS}, [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                spans = base_spans(text)
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in spans))
                base.append(join_spans(spans))
                entities.append(sorted({entity(k, text[a:b]) for k, a, b in spans}))
                held.append(text if spans else None)
            columns = [batch.column("doc_id"), batch.column("text_key"), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(base, pa.string()), pa.array(entities, pa.list_(pa.string())), pa.array(held, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FOUND.split(", ")])

    return docs.mapInArrow(run, FOUND)


def words_outside(held: DataFrame) -> DataFrame:
    """A row for each word of each document, with its places.  held: doc, base, held."""
    places = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, base, text in zip(*(batch.column(c) for c in ("doc", "base", "held"))):
                found = outside(text.as_py(), base.as_py())
                at = [[{"start": a, "end": b} for a, b in x] for _, x in found]
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(found), pa.int64()), pa.array([h for h, _ in found], pa.int64()), pa.array(at, places)], ["doc", "word", "places"])

    return held.mapInArrow(run, "doc long, word long, places array<struct<start:int,end:int>>")


def word_counts(docs: DataFrame) -> DataFrame:
    """word hash and the number of documents with it, in parts to be added up; over every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in groups(offsets, AT_ONCE):
                lower = LOWER[data[offsets[a] : offsets[b]]]
                start, end, first = words(lower, offsets[a : b + 1] - offsets[a], trim=True)
                with np.errstate(over="ignore"):
                    hashes = word_hashes(lower, start, end).view(np.int64)
                text = np.repeat(np.arange(b - a), np.diff(first))
                order = np.lexsort((hashes, text))
                text, hashes = text[order], hashes[order]
                once = hashes[np.append(True, (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1]))] if len(hashes) else hashes
                new, n = np.unique(once, return_counts=True)
                keys, of = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(of, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
                if len(keys) > COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["word", "n"])
                    keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long")


def association(both: Column, one: Column, other: Column, total: Column) -> Column:
    """The log-likelihood ratio (G2) of two things that are in one and other of total documents, and in both together."""

    def part(seen: Column, a: Column, b: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen * total / (a * b))).otherwise(0.0)

    return 2 * (part(both, one, other) + part(one - both, one, total - other) + part(other - both, total - one, other) + part(total - one - other + both, total - one, total - other))


def find_all(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_key, counts by kind, base spans, terms (start, end, action) that disclose an entity of the row, and held: the text if it has spans."""
    clean = with_clear_names(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    found = scratch.save(find_base(clean), "base")
    # a document, however often its row is repeated
    doc = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_key").alias("doc")
    held = found.filter("held is not null").select(doc, "doc_id", "text_key", "base", "entities", "held").dropDuplicates(["doc"])
    held = scratch.save(held, "held")
    total = F.lit(float(found.count()))
    holders = held.select("doc", F.explode("entities").alias("entity"))
    having = holders.groupBy("entity").agg(F.count("*").alias("n_entity")).filter(F.col("n_entity") >= SUPPORT)
    # the most documents that a word may be in to reach the lower threshold, with room for rounding
    most = F.col("n_entity") * F.pow(total / F.col("n_entity"), F.lit(1 - GENERALISE)) * 1.001
    holders = scratch.save(holders.join(having.withColumn("most", most), "entity"), "holders")
    limit = holders.agg(F.max("most")).first()[0] or 0.0
    able = holders.select("doc").distinct()
    counted = word_counts(clean).groupBy("word").agg(F.sum("n").alias("n_word")).filter((F.col("n_word") >= SUPPORT) & (F.col("n_word") <= limit))
    met = scratch.save(words_outside(held.join(able, "doc", "left_semi").select("doc", "base", "held")).join(counted, "word"), "met")
    both = met.select("doc", "word", "n_word").join(holders, "doc").filter(F.col("n_word") <= F.col("most"))
    both = both.groupBy("entity", "word", "n_word", "n_entity").agg(F.count("*").alias("both")).filter(F.col("both") >= SUPPORT)
    ic = F.log2(total / F.col("n_entity"))
    pmi = F.log2(F.col("both") * total / (F.col("n_entity") * F.greatest("n_word", "both")))
    both = both.filter(association(F.col("both"), F.col("n_entity"), F.greatest("n_word", "both"), total) >= SIGNIFICANT)
    judged = both.select("entity", "word", F.when((ic > 0) & (pmi >= REMOVE * ic), "remove").when((ic > 0) & (pmi >= GENERALISE * ic), "generalise").alias("action")).filter("action is not null")
    judged = scratch.save(judged, "judged")
    # words that are in a document meet its entities, not every word that an entity has anywhere; few words are judged at all
    some = met.select("doc", "word").join(judged.select("word").distinct(), "word", "left_semi")
    verdicts = some.join(holders.select("doc", "entity"), "doc").join(judged, ["entity", "word"]).select("doc", "word", "action").distinct()
    places = met.join(verdicts, ["doc", "word"]).select("doc", "action", F.explode("places").alias("p"))
    terms = places.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("p.start", "p.end", "action"))).alias("terms"))
    terms = terms.join(held.select("doc", "doc_id", "text_key"), "doc")
    terms = scratch.save(terms.select(F.col("doc_id").alias("t_doc"), F.col("text_key").alias("t_key"), "terms"), "terms")
    scratch.leave(found, terms)
    same = (found["text_key"] == terms["t_key"]) & found["doc_id"].eqNullSafe(terms["t_doc"])
    none = F.array().cast("array<struct<start:int,end:int,action:string>>")
    return found.join(terms, same, "left").select("doc_id", "text_key", *[f"n_{k}" for k in KINDS], "base", F.coalesce("terms", none).alias("terms"), "held")


def mask(text: str, base: str, terms: list[dict]) -> str:
    """The text with its spans replaced: by their kind, by nothing, or by what kind of word they were."""
    marks = [(int(a), int(b), f"[{k.upper()}]") for k, a, b in (s.split(":") for s in base.split(",") if s)]
    for t in terms:
        word = text[t["start"] : t["end"]]
        marks.append((t["start"], t["end"], "" if t["action"] == "remove" else "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[WORD]"))
    out, at = [], 0
    for a, b, name in sorted(marks):
        if a >= at:
            out += [text[at:a], name]
        at = max(at, b)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with personal data taken out of text, and n_chars as it is then; rows without any stay as they are."""
    scratch = Scratch(docs.sparkSession, "sanitise")
    key, pii_id, pii_key, pii_text = free_names(docs, "_text_key", "_pii_id", "_pii_key", "_pii_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("held", "base", "terms")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array([mask(*x) for x in rows], pa.string())], [pii_id, pii_key, pii_text])

    held = find_all(docs, scratch).filter("held is not null").dropDuplicates(["doc_id", "text_key"])  # only texts with spans have terms
    masked = scratch.save(held.select("doc_id", "text_key", "held", "base", "terms").mapInArrow(run, f"`{pii_id}` long, `{pii_key}` long, `{pii_text}` string"), "masked")
    scratch.leave(masked)
    masked = masked.hint("merge")  # texts with spans grow with the corpus
    marked = docs.withColumn(key, F.xxhash64("text"))
    both = marked.join(masked, (marked[key] == masked[pii_key]) & marked["doc_id"].cast("long").eqNullSafe(masked[pii_id]), "left")
    out = both.withColumn("text", F.coalesce(pii_text, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(pii_text).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    found = find_all(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pii"))
    extra = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["end"].cast("string")))
    every = F.concat(F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.array("base")), F.array_distinct(extra))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"))
