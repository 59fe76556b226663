"""Reading a section index: filters, tables of contents, search, trees, and sections by key."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsect.functions import safety
from docsect.operators.sections import scan


def filter_sections(sections: DataFrame, path_prefix: str | None = None, max_depth: int | None = None, file_pattern: str | None = None) -> DataFrame:
    """An empty prefix or pattern filters nothing; depth 0 is a limit like any other."""
    out = sections
    if path_prefix:
        out = out.filter(F.col("file").startswith(path_prefix))
    if max_depth is not None:
        out = out.filter(F.col("depth") <= max_depth)
    if file_pattern:
        out = out.filter(safety.glob_match(F.col("file"), file_pattern))
    return out


def toc(sections: DataFrame, include_summaries: bool = True) -> DataFrame:
    columns = ["repo", "file", "seq", "id", "title", "depth", "parent"]
    return sections.select(*columns, *([F.when(F.col("summary") != "", F.col("summary")).alias("summary")] if include_summaries else []))


def score(query: str):
    """The rank of a section: the query in title or summary, each word in title or summary, words that are keywords."""
    q = query.lower()
    words = sorted(set(q.split()))
    title, summary = F.lower("title"), F.lower("summary")
    hit = lambda text, part, points: F.when(text.contains(part), points).otherwise(0)
    out = hit(title, q, 10) + hit(summary, q, 5)
    for w in words:
        out = out + hit(title, w, 3) + hit(summary, w, 1)
    if words:
        out = out + 2 * F.size(F.array_intersect("keywords", F.array(*map(F.lit, words))))
    return out.cast("long")


def search(sections: DataFrame, query: str, max_results: int = 10, **filters) -> DataFrame:
    """The best sections; ties in index order."""
    if max_results < 0:
        raise ValueError("max_results is negative")
    found = filter_sections(sections, **filters).withColumn("score", score(query))
    columns = ["repo", "id", "file", "path", "title", "depth", "summary", F.slice("keywords", 1, 5).alias("keywords"), "score", "seq"]
    # hits come before all others, so they are told apart after the limit: a filter below would compute every score twice
    return found.select(*columns).orderBy(F.desc("score"), "repo", "file", "seq").limit(max_results).filter("score > 0")


#: Postings: byte triples of titles (field 0) and of summaries (1), and digests of keywords (2), with the sections that have them.
GRAMS = "at string, field int, gram int, ords array<int>"
SECTIONS_AT_ONCE, FEW = 1 << 17, 1000


def _keyword(word: str) -> int:
    return zlib.crc32(word.encode()) & 0x7FFFFFFF


def _triples(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
    return b[:-2] << 16 | b[1:-1] << 8 | b[2:] if len(b) > 2 else b[:0]


def grams(sections: DataFrame) -> DataFrame:
    """The postings of sections (at, ord, title, summary, keywords), leaf by leaf; a gram has a row for each SECTIONS_AT_ONCE sections, or more."""

    def posted(at: str, ords: np.ndarray, columns: list[list]) -> pa.RecordBatch:
        field, gram, of = [], [], []
        for f in (0, 1):
            raw = [(x or "").encode() for x in columns[f]]
            size = np.array([len(x) for x in raw])
            data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
            if len(data) > 2:
                text = np.repeat(np.arange(len(raw)), size)
                inside = text[:-2] == text[2:]
                pairs = np.unique(((data[:-2] << 16 | data[1:-1] << 8 | data[2:])[inside] << 32) | text[:-2][inside])
                field.append(np.full(len(pairs), f)), gram.append(pairs >> 32), of.append(pairs & 0xFFFFFFFF)
        words = [(_keyword(w), i) for i, x in enumerate(columns[2]) for w in x or ()]
        pairs = np.unique(np.array([(w << 32) | i for w, i in words], dtype=np.int64))
        field.append(np.full(len(pairs), 2)), gram.append(pairs >> 32), of.append(pairs & 0xFFFFFFFF)
        field, gram, of = np.concatenate(field), np.concatenate(gram), ords[np.concatenate(of).astype(np.int64)]
        heads = np.flatnonzero(np.append(True, (np.diff(field) != 0) | (np.diff(gram) != 0))) if len(gram) else np.zeros(0, dtype=np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(of)), pa.int32()), pa.array(of, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([at] * len(heads), pa.string()), pa.array(field[heads], pa.int32()), pa.array(gram[heads], pa.int32()), lists, pa.array([f"r{at}"] * len(heads), pa.string())], ["at", "field", "gram", "ords", "leaf"])

    def run(batches):
        held, at, rows = [], None, 0
        for batch in batches:
            leaf = batch.column("at").to_pylist()
            cuts = [0, *(i for i in range(1, len(leaf)) if leaf[i] != leaf[i - 1]), len(leaf)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if held and (leaf[i] != at or rows >= SECTIONS_AT_ONCE):
                    yield posted(at, *_gathered(held))
                    held, rows = [], 0
                at, rows = leaf[i], rows + j - i
                held.append(batch.slice(i, j - i))
        if held:
            yield posted(at, *_gathered(held))

    rows = sections.select("at", "ord", F.lower("title").alias("title"), F.lower("summary").alias("summary"), "keywords")
    return rows.mapInArrow(run, GRAMS + ", leaf string")


def _gathered(held: list) -> tuple[np.ndarray, list[list]]:
    table = pa.Table.from_batches(held)
    return table["ord"].to_numpy(), [table[c].to_pylist() for c in ("title", "summary", "keywords")]


def bounds(postings: DataFrame, query: str) -> tuple[DataFrame, int]:
    """(at, ord, bound): no section's score is above its bound, and those not there have at most the number given."""
    q = query.lower()
    words = sorted(set(q.split()))
    needles = [(0, q, 10), (1, q, 5), *[(f, w, p) for w in words for f, p in ((0, 3), (1, 1))]]
    places: dict[tuple[int, int], int] = {}
    needs, least = [], 0
    for field, text, points in needles:
        found = sorted(set(_triples(text.encode()).tolist()))
        if found:
            needs.append((points, [places.setdefault((field, g), len(places)) for g in found]))
        else:  # too short to have any: it may be anywhere
            least += points
    needs += [(2, [places.setdefault((2, _keyword(w)), len(places))]) for w in words]
    spark, width = postings.sparkSession, 62
    wanted = F.lit(False)
    for f in (0, 1, 2):
        if mine := [g for x, g in places if x == f]:
            wanted = wanted | ((F.col("field") == f) & F.col("gram").isin(mine))
    table = F.broadcast(spark.createDataFrame([(f, g, i // width, 1 << i % width) for (f, g), i in places.items()], "field int, gram int, word int, flag long"))  # as many rows as the query has letters
    hits = postings.filter(wanted).join(table, ["field", "gram"]).select("at", F.explode("ords").alias("ord"), "word", "flag")
    masks = hits.groupBy("at", "ord").agg(*[F.bit_or(F.when(F.col("word") == k, F.col("flag")).otherwise(0)).alias(f"m{k}") for k in range(len(places) // width + 1)])
    bound = F.lit(least)
    for points, bits in needs:
        has = F.lit(True)
        for k in {i // width for i in bits}:
            need = sum(1 << i % width for i in bits if i // width == k)
            has = has & (F.col(f"m{k}").bitwiseAND(F.lit(need)) == need)
        bound = bound + F.when(has, points).otherwise(0)
    return masks.select("at", "ord", bound.alias("bound")), least


def search_grams(sections: DataFrame, postings: DataFrame, query: str, max_results: int = 10, **filters) -> DataFrame:
    """The same rows as search(), with scores told only of sections whose postings allow a place among the first.

    Those of the highest bounds are scored; no section whose bound is under the last of their scores can do better.  Where that
    leaves nothing out (words of one or two letters, or fewer hits than asked for) all sections are scored.
    """
    if max_results <= 0 or not query.split():
        return search(sections, query, max_results, **filters)
    bounded, least = bounds(postings, query)
    levels = sorted(((r["bound"], r["count"]) for r in bounded.filter("bound > 0").groupBy("bound").count().collect()), reverse=True)  # a row for each sum of points
    cut = total = 0
    for cut, n in levels:
        total += n
        if total >= max_results:
            break
    best = [r["score"] for r in search(_bounded(sections, bounded, cut), query, max_results, **filters).select("score").collect()] if levels else []
    last = best[-1] if len(best) == max_results else 0
    if last <= least:
        if least:
            return search(sections, query, max_results, **filters)
        last = 1
    return search(_bounded(sections, bounded, last), query, max_results, **filters)


def _bounded(sections: DataFrame, bounded: DataFrame, least: int) -> DataFrame:
    """Sections whose bound is at least least; a few are asked for by value, so that other row groups are not read."""
    some = bounded.filter(F.col("bound") >= least).select("at", "ord")
    few = some.limit(FEW + 1).collect()
    if len(few) > FEW:
        return sections.join(some, ["at", "ord"], "left_semi")
    own = F.lit(False)
    for at in {r["at"] for r in few}:
        own = own | ((F.col("at") == at) & F.col("ord").isin([r["ord"] for r in few if r["at"] == at]))
    return sections.filter(own)


def first_by_id(sections: DataFrame) -> DataFrame:
    """Ids are not quite unique: each id means the first section that has it."""
    order = Window.partitionBy("repo", "id").orderBy("file", "seq")
    return sections.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


REQUESTS = 1024  # sections that are cut from one copy of a file


def cut(places: DataFrame, files: DataFrame) -> DataFrame:
    """places (repo, file, byte_offset, byte_length and others) with content, the text of that range; null without a file.

    A file meets REQUESTS of its ranges at a time, not each of them.
    """
    own = [c for c in places.columns if c not in ("repo", "file")]
    part = F.when(F.col("file").isNull(), F.monotonically_increasing_id()).otherwise(F.pmod(F.xxhash64("byte_offset"), F.lit(1 << 40)))
    counted = places.groupBy("repo", "file").agg(F.ceil(F.count("*") / REQUESTS).alias("_parts"))
    dealt = places.join(counted, ["repo", "file"], "left").withColumn("_part", F.when(F.col("file").isNull(), part).otherwise(F.pmod(part, F.col("_parts"))))
    lists = dealt.groupBy("repo", "file", "_part").agg(F.collect_list(F.struct(*own)).alias("_places"))
    text = files.select("repo", "file", F.encode("content", "UTF-8").alias("_raw"))
    cut_out = lambda raw, x: F.decode(F.substring(raw, (x["byte_offset"] + 1).cast("int"), x["byte_length"].cast("int")), "UTF-8")
    # the bytes are bound as an array's one element, so that they are made once a row
    each = lambda raw: F.transform("_places", lambda x: F.struct(x.alias("p"), cut_out(raw, x).alias("content")))
    rows = lists.join(text, ["repo", "file"], "left").select("repo", "file", F.explode(F.flatten(F.transform(F.array("_raw"), each))).alias("_x"))
    return rows.select("repo", "file", "_x.p.*", "_x.content")


def fetch(requests: DataFrame, sections: DataFrame, files: DataFrame) -> DataFrame:
    """The text of sections asked for by (pos, repo, id), by their byte ranges; a miss has an error instead."""
    found = requests.join(first_by_id(sections), ["repo", "id"], "left").select("pos", "repo", "id", "file", "title", "depth", "byte_offset", "byte_length")
    error = F.when(F.col("file").isNull(), F.concat(F.lit("Section not found: "), "id"))
    return cut(found, files).select("pos", "repo", "id", "file", "title", "depth", "byte_offset", "byte_length", "content", error.alias("error"))


def texts(places: DataFrame, files: DataFrame) -> DataFrame:
    """places (sections by pos, repo and id; without a file where there is none) with their text, and an error for those without."""
    error = F.when(F.col("file").isNull(), F.concat(F.lit("Section not found: "), "id"))
    return cut(places, files).withColumn("error", error)


def tree_edges(sections: DataFrame) -> DataFrame:
    """Each section with its parent's place in the file; roots and unknown parents have none."""
    s = sections.select("repo", "file", "seq", "id", "parent", "title", "depth")
    p = s.groupBy("repo", "file", F.col("id").alias("parent")).agg(F.max("seq").alias("parent_seq"))
    return s.join(p, ["repo", "file", "parent"], "left").select("repo", "file", "seq", "id", "title", "depth", "parent", "parent_seq")


def nested(sections: DataFrame, columns: list[str]) -> DataFrame:
    """(repo, file, tree): each file's sections as JSON, those under a section among its children; one file a group.

    A parent that is not in the file makes a root; of sections with one id the last is the parent.
    """
    names = list(dict.fromkeys([*columns, "id", "parent", "seq"]))

    def run(key, table):
        rows = sorted(table.select(names).to_pylist(), key=lambda r: r["seq"])
        nodes = [{c: r[c] for c in columns} | {"children": []} for r in rows]
        node, roots = {r["id"]: x for r, x in zip(rows, nodes)}, []
        for r, x in zip(rows, nodes):
            above = node.get(r["parent"]) if r["parent"] else None
            (above["children"] if above else roots).append(x)
        return pa.table({"repo": [key[0].as_py()], "file": [key[1].as_py()], "tree": [json.dumps(roots, separators=(",", ":"), ensure_ascii=False)]})

    return sections.select("repo", "file", *[c for c in names if c not in ("repo", "file")]).groupBy("repo", "file").applyInArrow(run, "repo string, file string, tree string")


def ancestor_paths(sections: DataFrame) -> DataFrame:
    """Ids from root to section.

    A section's parent is one of those that are open where it stands, so one pass over a file, with the open ones as state,
    gives all paths.  An unknown parent makes a root.
    """
    files = sections.groupBy("repo", "file").agg(F.sort_array(F.collect_list(F.struct("seq", "id", "parent"))).alias("rows"))
    path = lambda s, x: F.concat(F.slice(s, F.lit(1), F.size(s) - F.coalesce(F.nullif(F.array_position(F.reverse(s), x["parent"]), F.lit(0)) - 1, F.size(s).cast("long")).cast("int")), F.array(x["id"]))
    out = files.withColumn("paths", scan(F.col("rows"), F.array().cast("array<string>"), "array<string>", path, path))
    rows = out.select("repo", "file", F.explode(F.arrays_zip("rows", "paths")).alias("x"))
    return rows.select("repo", "file", "x.rows.seq", "x.rows.id", F.col("x.paths").alias("ancestors"), (F.size("x.paths") - 1).cast("long").alias("level"))


def catalog(sections: DataFrame, files: DataFrame) -> DataFrame:
    s = sections.groupBy("repo").agg(F.count("*").alias("section_count"))
    return files.groupBy("repo").agg(F.count_distinct("file").alias("file_count")).join(s, "repo", "left").select("repo", F.coalesce("section_count", F.lit(0)).alias("section_count"), "file_count")


def resolve(repos: DataFrame, name: str) -> DataFrame:
    """A full name, or the first repository whose last part it is."""
    out = repos.filter(F.col("repo") == name) if "/" in name else repos.filter(F.col("repo").endswith("/" + name))
    return out.orderBy("repo").limit(1)
