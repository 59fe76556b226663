"""Documentation corpora derived from the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown file a document: every ninth line a heading of level 1, 2 or 3; each fourth document without headings."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 9 == 0, F.concat(F.lit("# "), x)).when(i % 9 == 3, F.concat(F.lit("## "), x)).when(i % 9 == 6, F.concat(F.lit("### "), x)).otherwise(x))
    return table(spark, sf_dir, "documents").filter("text is not null").select(
        F.concat(F.lit("docs/"), "lang").alias("repo"),
        F.concat("lang", F.lit("/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"),
        F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(F.array_join(lines, "\n")).alias("content"),
        "doc_id",
    )


PAGES_SQL = """
pages_ AS (
  SELECT 'docs/' || lang AS repo, lang || '/' || source || '/doc_' || doc_id || '.md' AS file, doc_id,
    CASE WHEN doc_id % 4 = 0 THEN text ELSE array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
      CASE (i - 1) % 9 WHEN 0 THEN '# ' || x WHEN 3 THEN '## ' || x WHEN 6 THEN '### ' || x ELSE x END), chr(10)) END AS content
  FROM documents WHERE text IS NOT NULL)"""


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown file a conversation: user turns under level 1, assistant turns under level 2, system turns bare."""
    head = F.when(F.col("role") == "user", F.format_string("# turn %d\n", "turn")).when(F.col("role") == "assistant", F.format_string("## turn %d\n", "turn")).otherwise("")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(head, F.coalesce("text", F.lit(""))).alias("part"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "part"))).alias("x"))
    return gathered.select(F.lit("chat/threads").alias("repo"), F.format_string("threads/conv_%d.md", "conv_id").alias("file"), F.array_join(F.col("x.part"), "\n").alias("content"))


THREADS_SQL = """
pages_ AS (
  SELECT 'chat/threads' AS repo, 'threads/conv_' || conv_id || '.md' AS file, string_agg(
    CASE role WHEN 'user' THEN '# turn ' || turn || chr(10) WHEN 'assistant' THEN '## turn ' || turn || chr(10) ELSE '' END || coalesce(text, ''), chr(10) ORDER BY turn) AS content
  FROM conversations GROUP BY conv_id)"""



def fill(sql: str, value: str) -> str:
    """SQL with its {0} filled in; other braces stay."""
    return sql.replace("{0}", value)


SLUG = r"regexp_replace(regexp_replace(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '[^\p{L}\p{N}_\s-]', '', 'g'), '[-\s]+', '-', 'g')"
PREFIX = SLUG.replace("{0}", "CASE WHEN contains({0}, '/') THEN regexp_extract({0}, '([^/]+)\\.[^./]+$', 1) || '-' || replace(regexp_extract({0}, '^(.*)/[^/]*$', 1), '/', '-') ELSE regexp_extract({0}, '([^/]+)\\.[^./]+$', 1) END")
WORDS = r"regexp_split_to_array({0}, '[^\p{L}\p{N}_]+')"
TERMS = "['install','setup','config','api','auth','oauth','token','key','secret','import','export','module','package','dependency','error','debug','log','test','build','deploy']"
KEYWORDS = (
    "list_sort(list_distinct(list_filter(list_transform(list_concat(list_concat(regexp_extract_all({0}, '`([^`]+)`', 1), "
    + "list_filter(" + WORDS + ", lambda w: regexp_full_match(w, '[a-z]+[A-Z][a-zA-Z]*|[a-z]+_[a-z_]+'))), "
    + "list_filter(list_transform(" + WORDS + ", lambda w: lower(w)), lambda w: list_contains(" + TERMS + ", w))), lambda w: regexp_replace(lower(w), '^\\s+|\\s+$', '', 'g')), lambda w: length(w) BETWEEN 3 AND 29)))[1:20]"
)
STRIPPED = r"list_transform(string_split({0}, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))"
PROSE = "list_filter(" + STRIPPED + ", lambda x: x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '```'))[1]"
SUMMARY = "coalesce(CASE WHEN length({p}) > 120 THEN substr({p}, 1, 120) || '...' ELSE {p} END, {t})"

#: Sections of the files in pages_.
SECTIONS_SQL = r"""
lines_ AS (SELECT repo, file, i, ls[i] AS line FROM (SELECT repo, file, string_split(content, chr(10)) AS ls FROM pages_), unnest(range(1, len(ls) + 1)) AS t(i)),
marked_ AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,6}\s+.+$') THEN 1 ELSE 0 END) OVER (PARTITION BY repo, file ORDER BY i) AS g FROM lines_),
cut_ AS (SELECT repo, file, g, arg_min(line, i) AS head, count(*) AS line_count, string_agg(line, chr(10) ORDER BY i) AS content FROM marked_ GROUP BY repo, file, g),
placed_ AS (SELECT *, max(g) OVER f > 0 AS headed, g - min(g) OVER f AS seq, coalesce(sum(strlen(content) + 1) OVER (PARTITION BY repo, file ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS byte_offset FROM cut_ WINDOW f AS (PARTITION BY repo, file)),
titled_ AS (
  SELECT *, CASE WHEN g = 0 THEN 0 ELSE length(regexp_extract(head, '^(#{1,6})\s', 1)) END AS depth, PREFIX AS prefix,
    CASE WHEN g > 0 THEN regexp_replace(regexp_extract(head, '^#{1,6}\s+(.+)$', 1), '^\s+|\s+$', '', 'g')
         WHEN headed THEN file ELSE coalesce(list_filter(LINES, lambda x: x <> '' AND NOT starts_with(x, '---') AND length(x) < 100)[1], file) END AS title
  FROM placed_ WHERE g > 0 OR NOT headed OR regexp_matches(content, '\S')),
based_ AS (SELECT *, SLUG AS slug, prefix || '-' || CASE WHEN g = 0 THEN 'root' ELSE SLUG END AS base FROM titled_),
named_ AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY repo, file, base ORDER BY g) > 1 AND g > 0 THEN base || '-' || substr(md5(substr(content, 1, 200)), 1, 6) ELSE base END AS id FROM based_),
above_ AS (SELECT *, greatest(CASE WHEN depth > 0 THEN max(CASE WHEN depth = 0 THEN g END) OVER w END, CASE WHEN depth > 1 THEN max(CASE WHEN depth = 1 THEN g END) OVER w END, CASE WHEN depth > 2 THEN max(CASE WHEN depth = 2 THEN g END) OVER w END) AS up
  FROM named_ WINDOW w AS (PARTITION BY repo, file ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sections_ AS (
  SELECT a.repo, a.file, a.seq::BIGINT AS seq, a.id, CASE WHEN a.g = 0 THEN a.file ELSE a.file || '#' || a.slug END AS path, a.title, a.depth::INTEGER AS depth, p.id AS parent,
    a.line_count::INTEGER AS line_count, a.byte_offset::BIGINT AS byte_offset, strlen(a.content)::BIGINT AS byte_length, a.content, KEYWORDS AS keywords, SUMMARY AS summary
  FROM above_ a LEFT JOIN named_ p ON a.repo = p.repo AND a.file = p.file AND a.up = p.g)"""
SECTIONS_SQL = SECTIONS_SQL.replace("PREFIX", fill(PREFIX, "file")).replace("LINES", fill(STRIPPED, "content")).replace("SLUG", fill(SLUG, "title")).replace("KEYWORDS", fill(KEYWORDS, "a.content")).replace("SUMMARY", SUMMARY.replace("{t}", "a.title").replace("{p}", fill(PROSE, "a.content")))
