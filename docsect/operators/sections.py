"""Markdown, MDX and reStructuredText files to sections.

A file is one row, and all its sections come out of one array that is exploded once: the source is read once, nothing is
shuffled and the work stays in the JVM.  Markdown is cut by one pattern over the whole text, and what follows works on
an element a section.  Sequential rules (parents, offsets, the greedy scans of headingless and RST files) are folds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsect.functions import text as X

#: The section rules (fixed values): headings, lines under or over titles, and the sizes of chunks of headingless files.
HEADING = r"(?d)^(#{1,6})[^\S\n]+(.+)"
NEXT_HEADING = r"(?d)\n(?=#{1,6}[^\S\n]+.)"
UNDERLINE = r"""^([=\-~^"+`:#'._*])\1+\z"""
MAX_LINES = 200
CHUNK_LINES = 20
#: Elements that a fold appends to one array before it begins another.
BLOCK = 256

FILES = "repo string, file string, content string"
SECTIONS = ("repo", "file", "seq", "id", "path", "title", "depth", "parent", "keywords", "summary", "line_count", "byte_offset", "byte_length", "content", "hash")
#: A section before its place is known.  fixed: kept even if blank, with base as its id.
PART = "struct<title: string, depth: int, slug: string, base: string, content: string, fixed: boolean>"


def strip_front_matter(content):
    """(body, title) of a text: front matter ends at a line of three hyphens; without an end the text stays whole."""
    tail = F.substring(content, F.lit(4), F.length(content))
    end = F.regexp_instr(tail, F.lit(r"\n---\s*\n"))
    has = content.startswith("---") & (end > 0)
    mark = F.regexp_extract(tail, r"(\n---\s*\n)", 1)
    head = F.substring(tail, F.lit(1), end - 1)
    found = r"""(?dm)^title:\s*["']?(.+?)["']?\s*$"""
    title = F.when(has & head.rlike(found), X.strip(F.regexp_extract(head, found, 1)))
    return F.when(has, F.substring(tail, end + F.length(mark), F.length(tail))).otherwise(content), title


def clean_mdx(content):
    """MDX as Markdown: front matter, imports, exports and component tags are taken out, what tags enclose stays."""
    out, _ = strip_front_matter(content)
    for pattern in (r"(?dm)^import\s+.*$", r"(?dm)^export\s+(?:default\s+)?.*$", r"<[A-Z][a-zA-Z]*\b[^>]*/>", r"<[A-Z][a-zA-Z]*\b[^>]*>", r"</[A-Z][a-zA-Z]*>"):
        out = F.regexp_replace(out, pattern, "")
    return out


def scan(items: Column, state: Column, kind: str, step: Callable, out: Callable) -> Column:
    """An array with out(state, item) for each of items, of type kind, where step(state, item) leads on to the next state.

    Appending copies an array, so elements go to blocks and blocks to the whole: the time follows the items.
    """
    none, nothing = (F.array().cast(f"array<{t}>") for t in (kind, f"array<{kind}>"))
    pair = lambda s, o: F.struct(s.alias("s"), o.alias("out"))

    def block(done: Column, b: Column) -> Column:
        mine = F.aggregate(F.slice(items, b * BLOCK + 1, F.lit(BLOCK)), pair(done["s"], none), lambda u, x: pair(step(u["s"], x), F.array_append(u["out"], out(u["s"], x))))
        return F.aggregate(F.array(mine), done, lambda v, w: pair(w["s"], F.array_append(v["out"], w["out"])))

    blocks = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.aggregate(blocks, pair(state, nothing), block)["out"])


def _part(title: Column, depth: Column, slug: Column, base: Column, content: Column, fixed: bool = False) -> Column:
    return F.struct(title.alias("title"), depth.cast("int").alias("depth"), slug.alias("slug"), base.alias("base"), content.alias("content"), F.lit(fixed).alias("fixed"))


def _lead(content: Column) -> Column:
    """What stands before the first heading."""
    return _part(F.col("file"), F.lit(0), F.lit("root"), F.concat("prefix", F.lit("-root")), content)


def _whole(title: Column) -> Column:
    return F.array(_part(title, F.lit(0), F.lit("root"), F.concat("prefix", F.lit("-root")), F.col("content"), True))


def _headed(title: Column, depth: Column, content: Column) -> Column:
    slug = X.slugify(title)
    return _part(title, depth, slug, F.concat("prefix", F.lit("-"), slug), content)


def _markdown_parts() -> Column:
    """Sections between headings.  Columns: file, prefix, texts."""
    headed = lambda t: _headed(X.strip(F.regexp_extract(t, HEADING, 2)), F.length(F.regexp_extract(t, HEADING, 1)), t)
    return F.transform("texts", lambda t: F.when(t.rlike(HEADING), headed(t)).otherwise(_lead(t)))


def _headingless(files: DataFrame, chunked: bool) -> DataFrame:
    """Adds bare: files without headings as one section, or, if chunked and long, in chunks that end at two blank lines after CHUNK_LINES lines or more.

    Columns: file, prefix, content, lines (none where there are headings).
    """
    _, named = strip_front_matter(F.col("content"))
    candidate = F.filter(F.transform("lines", X.strip), lambda x: (x != "") & ~x.startswith("---") & (F.length(x) < 100))
    out = files.withColumn("title", F.coalesce(F.when(named != "", named), F.try_element_at(candidate, F.lit(1)), F.col("file")))
    if not chunked:
        return out.withColumn("bare", _whole(F.col("title")))
    out = out.withColumn("blank", F.when(F.size("lines") > MAX_LINES, F.transform("lines", lambda x: X.strip(x) == "")).otherwise(F.array().cast("array<boolean>")))
    # each line: whether a chunk ends with it
    state = F.struct(F.lit(0).alias("held"), F.lit(0).alias("blank"))
    cut = lambda s, x: x & (s["blank"] >= 1) & (s["held"] + 1 >= CHUNK_LINES)
    step = lambda s, x: F.when(cut(s, x), state).otherwise(F.struct((s["held"] + 1).alias("held"), F.when(x, s["blank"] + 1).otherwise(0).alias("blank")))
    out = out.withColumn("cuts", scan(F.col("blank"), state, "boolean", step, cut))
    out = out.withColumn("ends", F.filter(F.transform("cuts", lambda c, i: F.when(c, i + 1)), lambda i: i.isNotNull()))
    out = out.withColumn("last", F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)))
    out = out.withColumn("tail", F.exists(F.slice("blank", F.col("last") + 1, F.size("blank") - F.col("last")), lambda b: ~b))
    out = out.withColumn("ends", F.when(F.col("tail"), F.array_append("ends", F.size("lines"))).otherwise(F.col("ends")))
    out = out.withColumn("begins", F.concat(F.array(F.lit(0)), F.col("ends")))
    pieces = F.zip_with("ends", F.slice("begins", F.lit(1), F.size("ends")), lambda b, a: F.array_join(F.slice("lines", a + 1, b - a), "\n"))
    out = out.withColumn("pieces", pieces)
    chunk = lambda title, k, t: _part(title, F.lit(0), F.lit("root"), F.concat("prefix", F.lit("-part-"), k.cast("string")), t, True)

    def told(t: Column, k: Column) -> Column:
        line = X._first_line(t, "(?!)")
        head = F.concat(F.substring(line, 1, 80), F.when(F.length(line) < 100, "").otherwise("..."))
        more = F.concat("title", F.lit(" (continued "), (k + 1).cast("string"), F.lit(")"))
        return F.when(k == 0, F.col("title")).when((F.col("tail") & (k == F.size("ends") - 1)) | line.isNull(), more).otherwise(head)

    chunks = F.transform("pieces", lambda t, k: chunk(told(t, k), k, t))
    return out.withColumn("bare", F.when(F.size("pieces") > 0, chunks).otherwise(_whole(F.col("title"))))


def _rst(files: DataFrame) -> DataFrame:
    """Adds titled: sections under over- and underlined titles, depths by first appearance of their style.  Columns: file, prefix, content, rows (lines)."""
    out = files.withColumn("cut", F.transform("rows", lambda x: F.rtrim(x, F.lit(X.BLANKS))))
    out = out.withColumn("marks", F.transform("cut", lambda x: F.when(x.rlike(UNDERLINE), F.substring(x, 1, 1))))
    size, at = lambda i: F.length(F.get("cut", i)), lambda i: F.get("marks", i)

    def key(line: Column, i: Column) -> Column:
        over = at(i).isNotNull() & (at(i + 2) == at(i)) & (X.strip(F.get("rows", i + 1)) != "") & (size(i) >= size(i + 1))
        under = at(i + 1).isNotNull() & (X.strip(line) != "") & ~line.startswith(" ") & (size(i + 1) >= size(i))
        return F.when(over, F.concat(F.lit("over"), at(i))).when(under, at(i + 1))

    found = F.filter(F.transform("rows", lambda x, i: F.struct(i.alias("i"), key(x, i).alias("key"))), lambda x: x["key"].isNotNull())
    out = out.withColumn("found", found)
    free = lambda s, x: F.when(x["i"] < s, s).otherwise(x["i"] + F.when(F.length(x["key"]) > 1, 3).otherwise(2))
    heads = scan(F.col("found"), F.lit(0), "struct<i: int, key: string>", free, lambda s, x: F.when(x["i"] >= s, x))
    out = out.withColumn("heads", F.filter(heads, lambda h: h.isNotNull())).withColumn("styles", F.array_distinct("heads.key"))
    out = out.withColumn("edges", F.concat(F.when(F.get("heads.i", F.lit(0)) > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.col("heads.i"), F.array(F.size("rows"))))
    texts = F.zip_with(F.slice("edges", F.lit(1), F.size("edges") - 1), F.slice("edges", F.lit(2), F.size("edges") - 1), lambda a, b: F.array_join(F.slice("rows", a + 1, b - a), "\n"))
    out = out.withColumn("shift", F.size("edges") - 1 - F.size("heads")).withColumn("texts", texts)
    title = lambda h: X.strip(F.get("rows", h["i"] + F.when(F.length(h["key"]) > 1, 1).otherwise(0)))
    headed = lambda h, t: _headed(title(h), F.array_position("styles", h["key"]), t)
    parts = F.transform("texts", lambda t, i: F.when(i < F.col("shift"), _lead(t)).otherwise(headed(F.get("heads", i - F.col("shift")), t)))
    return out.withColumn("titled", F.when(F.size("heads") > 0, parts).otherwise(_whole(F.col("file"))))


def _place(files: DataFrame) -> DataFrame:
    """Sections with ids, parents and places.  files: repo, file, parts."""
    out = files.withColumn("ranked", F.array_sort(F.transform("parts", lambda p, i: F.struct(p["base"].alias("base"), i.alias("i")))))
    # whether a base stood before in its file: equal neighbours after sorting, then back in their places
    again = F.transform("ranked", lambda r, j: F.struct(r["i"].alias("i"), ((j > 0) & (F.get("ranked", j - 1)["base"] == r["base"])).alias("again")))
    out = out.withColumn("again", F.array_sort(again))
    named = lambda p, i: F.when((p["depth"] > 0) & F.get("again", i)["again"], F.concat(p["base"], F.lit("-"), X.content_suffix(p["content"]))).otherwise(p["base"])
    out = out.withColumn("ids", F.transform("parts", named))
    sized = F.transform("parts", lambda p: F.struct(F.octet_length(p["content"]).cast("long").alias("size"), p["depth"].alias("depth"), (p["fixed"] | (p["depth"] > 0) | (X.strip(p["content"]) != "")).alias("keep")))
    out = out.withColumn("sized", sized)
    # last: for each depth the number of the last section kept there, counted from 1
    state = F.struct(F.lit(1).alias("i"), F.lit(0).cast("long").alias("at"), F.array_repeat(F.lit(0), F.array_max(F.col("sized.depth")) + 1).alias("last"))
    step = lambda s, x: F.struct((s["i"] + 1).alias("i"), (s["at"] + x["size"] + 1).alias("at"), F.when(x["keep"], F.transform(s["last"], lambda v, k: F.when(k == x["depth"], s["i"]).otherwise(v))).otherwise(s["last"]).alias("last"))
    place = lambda s, x: F.struct(s["at"].alias("at"), F.when(x["depth"] > 0, F.array_max(F.slice(s["last"], F.lit(1), x["depth"]))).otherwise(0).alias("up"))
    out = out.withColumn("places", scan(F.col("sized"), state, "struct<at: bigint, up: int>", step, place))
    out = out.withColumn("parents", F.transform("places", lambda p: F.when(p["up"] > 0, F.get("ids", p["up"] - 1))))
    row = lambda p, i: F.struct(p.alias("p"), F.get("ids", i).alias("id"), F.get("places", i)["at"].alias("at"), F.get("parents", i).alias("parent"), F.get("sized", i)["keep"].alias("keep"))
    rows = out.select("repo", "file", F.posexplode(F.transform("parts", row)).alias("seq", "s")).filter("s.keep")
    lines = F.length("s.p.content") - F.length(F.replace("s.p.content", F.lit("\n"), F.lit(""))) + 1
    return rows.select(
        "repo", "file", F.col("seq").cast("long").alias("seq"), "s.id",
        F.when(F.col("s.p.depth") == 0, F.col("file")).otherwise(F.concat("file", F.lit("#"), "s.p.slug")).alias("path"), "s.p.title", "s.p.depth",
        "s.parent", lines.cast("int").alias("line_count"), F.col("s.at").alias("byte_offset"), "s.p.content",
    )


def _parse(files: DataFrame, is_rst: Column, chunked: bool = True) -> DataFrame:
    """Sections of files by one pass; is_rst tells which are reStructuredText, the others are Markdown.

    Long files without headings are cut into chunks, or else are one section as short ones are.
    """
    no_lines = F.array().cast("array<string>")
    out = files.select("repo", "file", "content", is_rst.alias("is_rst"), X.file_prefix(F.col("file")).alias("prefix"))
    out = out.withColumn("texts", F.when(F.col("is_rst"), no_lines).otherwise(F.split("content", NEXT_HEADING)))
    out = out.withColumn("headed", (F.size("texts") > 1) | F.coalesce(F.get("texts", F.lit(0)).rlike(HEADING), F.lit(False)))
    out = out.withColumn("cut", F.when(F.col("headed"), _markdown_parts()))
    lines = F.split("content", "\n")
    out = out.withColumns({"lines": F.when(F.col("is_rst") | F.col("headed"), no_lines).otherwise(lines), "rows": F.when(F.col("is_rst"), lines).otherwise(no_lines)})
    out = _rst(_headingless(out.select("repo", "file", "prefix", "content", "is_rst", F.col("cut").alias("md"), "lines", "rows"), chunked))
    return _place(out.select("repo", "file", F.when(F.col("is_rst"), F.col("titled")).otherwise(F.coalesce("md", "bare")).alias("parts")))


def markdown(files: DataFrame, chunked: bool = True) -> DataFrame:
    """Sections of Markdown files (repo, file, content)."""
    return _parse(files, F.lit(False), chunked)


def mdx(files: DataFrame) -> DataFrame:
    """Sections of MDX files; byte ranges are those of the cleaned text, which is what has to be stored."""
    return markdown(files.withColumn("content", clean_mdx(F.col("content"))))


def rst(files: DataFrame) -> DataFrame:
    """Sections of reStructuredText files."""
    return _parse(files, F.lit(True))


def parse(files: DataFrame) -> DataFrame:
    """Sections of all files by their suffix, with keywords, summary and byte length; content is kept for the caller to drop."""
    return parse_stored(stored_text(files))


def parse_stored(files: DataFrame, chunked: bool = True) -> DataFrame:
    """The same for files whose text is the stored one, in which .mdx files are clean."""
    return complete(cut_stored(files, chunked))


def cut_stored(files: DataFrame, chunked: bool = True) -> DataFrame:
    """The same before keywords and summary are told from each section's text."""
    return _parse(files, F.lower("file").endswith(".rst"), chunked)


def complete(sections: DataFrame) -> DataFrame:
    out = sections.withColumns({"keywords": X.keywords(F.col("content")), "summary": X.simple_summary(F.col("title"), F.col("content")), "byte_length": F.octet_length("content").cast("long")})
    return out.withColumn("hash", F.sha2("content", 256)).select(*SECTIONS)


def stored_text(files: DataFrame) -> DataFrame:
    """The text that byte ranges refer to."""
    return files.withColumn("content", F.when(F.lower("file").endswith(".mdx"), clean_mdx(F.col("content"))).otherwise(F.col("content")))
