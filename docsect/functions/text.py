"""Scalar functions on text as columns: slugs, keywords, hashes, summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a Unicode-aware strip() sees it, and as a class of patterns without the newline.
BLANKS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
INLINE = r"[\t\x0B\f\r\x1c-\x20\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: Technical terms that count as keywords (fixed values).
TERMS = (
    "install", "setup", "config", "api", "auth", "oauth", "token", "key", "secret",
    "import", "export", "module", "package", "dependency",
    "error", "debug", "log", "test", "build", "deploy",
)
MAX_KEYWORDS = 20


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def slugify(text: Column) -> Column:
    """Lower case, trimmed, only letters, digits, underscores and single hyphens."""
    return F.regexp_replace(F.regexp_replace(strip(F.lower(text)), r"[^\p{L}\p{N}_\s-]", ""), r"[-\s]+", "-")


def file_prefix(file: Column) -> Column:
    """The slug of a path's stem, followed by its folders."""
    parts = F.split(file, "/")
    name = F.element_at(parts, -1)
    stem = F.when(name.rlike(r"^.+\.[^.]+\z"), F.regexp_replace(name, r"\.[^.]+\z", "")).otherwise(name)
    folders = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "-")
    return slugify(F.when(F.size(parts) > 1, F.concat(stem, F.lit("-"), folders)).otherwise(stem))


def keywords(content: Column) -> Column:
    """Code spans, identifiers and technical terms: lower case, 3 to 29 characters, sorted, the first 20."""
    whole = lambda words: F.lit(r"(?<![\p{L}\p{N}_])(?:" + words + r")(?![\p{L}\p{N}_])")
    spans = F.regexp_extract_all(content, F.lit("`([^`]+)`"), F.lit(1))
    names = F.regexp_extract_all(content, whole("[a-z]+[A-Z][a-zA-Z]*|[a-z]+_[a-z_]+"), F.lit(0))
    terms = F.regexp_extract_all(F.lower(content), whole("|".join(TERMS)), F.lit(0))
    every = F.transform(F.array_distinct(F.concat(spans, names, terms)), lambda w: strip(F.lower(w)))
    return F.slice(F.array_sort(F.array_distinct(F.filter(every, lambda w: F.length(w).between(3, 29)))), 1, MAX_KEYWORDS)


def content_suffix(content: Column) -> Column:
    """Six hex digits of the MD5 of the first 200 characters."""
    return F.substring(F.md5(F.substring(content, 1, 200)), 1, 6)


def _first_line(content: Column, refuse: str) -> Column:
    """The first line that is not blank and does not begin with refuse; null where there is none."""
    line = F.regexp_extract(content, rf"(?:^|\n){INLINE}*(?!{refuse})((?!{INLINE})[^\n]+)", 1)
    return F.nullif(strip(line), F.lit(""))


def simple_summary(title: Column, content: Column) -> Column:
    """The first line of prose, at most 120 characters, or else the title."""
    line = _first_line(content, "#|```")
    cut = F.when(F.length(line) > 120, F.concat(F.substring(line, 1, 120), F.lit("..."))).otherwise(line)
    return F.coalesce(cut, title)


def fallback_summary(title: Column, content: Column) -> Column:
    """The first line that is no heading, cut at 100 characters, or else the title."""
    return F.coalesce(F.substring(_first_line(content, "#"), 1, 100), title)


def short_summary(content: Column, line_count: Column) -> Column:
    """For sections that need no summarizer: blank ones and those under three lines; else null."""
    text = strip(content)
    return F.when(text == "", "").when(line_count < 3, F.substring(text, 1, 100))


def prompt(title: Column, content: Column) -> Column:
    return F.format_string("Summarize this documentation section in one sentence.\nTitle: %s\n\n%s", title, F.substring(content, 1, 2000))


def approx_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def read_text(content: Column) -> Column:
    """Text of raw bytes: damaged UTF-8 becomes replacement marks, every newline is \\n."""
    return normalise_newlines(F.make_valid_utf8(content.cast("string")))


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def parse_repository(url: Column) -> Column:
    """owner and name of a repository address or owner/name; null where it is neither.  ".git" is taken out anywhere."""
    clean = F.regexp_replace(strip(url), "/+\\z", "")
    far, near = r"github\.com/([^/]+)/([^/]+)", r"^([^/]+)/([^/]+)\z"
    pick = lambda i: F.when(clean.rlike(far), F.regexp_extract(clean, far, i)).when(clean.rlike(near), F.regexp_extract(clean, near, i))
    return F.struct(pick(1).alias("owner"), F.replace(pick(2), F.lit(".git"), F.lit("")).alias("name"))
