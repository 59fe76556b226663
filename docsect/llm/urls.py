"""URL filters: a dated block list joined to captures as of the time each page was fetched.

List entries are dated additions and removals of a host or a parent domain.  They become validity intervals, and
every capture is held against the entries that were active on its day.  Captures are first reduced to their distinct
(host, day), so a host with a third of all pages brings a row a day; intervals and captures meet on (pattern, month),
which spreads a pattern that covers many hosts over the months.  Only DataFrame functions are used.

A null or unparsable URL has no host and is not blocked.  Of several active entries the most specific decides.  On the
day an entry is removed it no longer counts, and a removal beats an addition of the same day.  Repeated list rows
change nothing; repeated captures are answered one by one.  An empty list blocks nothing, and an empty table has no
rows.  Captures keep their columns; an added column whose name one of them has gets underscores at its end.  Very long
URLs are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsect.llm.common import free_names

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.lower(url), HOST, 1)
    return F.when(found != "", F.rtrim(found))


def suffixes(host: Column) -> Column:
    """The host and each of its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity(entries: DataFrame) -> DataFrame:
    """(pattern, listed_on, until): when each pattern is listed.  entries: pattern, action ("add", "remove"), day."""
    clean = entries.filter("pattern is not null and day is not null and action in ('add', 'remove')")
    last = clean.groupBy("pattern", "day").agg(F.max("action").alias("action"))  # "remove" is the greater
    ahead = Window.partitionBy("pattern").orderBy("day")
    changes = last.withColumn("before", F.lag("action").over(ahead)).filter("before is null or before <> action")
    return changes.withColumn("until", F.lead("day").over(ahead)).filter("action = 'add'").select("pattern", F.col("day").alias("listed_on"), "until")


def as_of(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures with blocked, pattern, listed_on and until.  captures: host, fetched_on and others."""
    entry, blocked, pattern, listed_on, until = free_names(captures, "entry", "blocked", "pattern", "listed_on", "until")
    # an open entry holds until the day after the last capture
    horizon = captures.agg(F.date_add(F.max("fetched_on"), 1)).first()[0]
    open_end = F.coalesce("until", F.lit(horizon).cast("date"))
    months = F.sequence(F.trunc("listed_on", "month"), F.trunc(open_end, "month"), F.expr("interval 1 month"))
    spans = validity(entries).filter(F.col("listed_on") < open_end).withColumn("month", F.explode(months))
    days = captures.select("host", "fetched_on").filter("host is not null and fetched_on is not null").distinct()
    asked = days.select("host", "fetched_on", F.trunc("fetched_on", "month").alias("month"), F.explode(suffixes(F.col("host"))).alias("pattern"))
    hits = asked.join(spans, ["pattern", "month"]).filter((F.col("listed_on") <= F.col("fetched_on")) & (F.col("until").isNull() | (F.col("fetched_on") < F.col("until"))))
    best = hits.groupBy("host", "fetched_on").agg(F.max_by(F.struct("pattern", "listed_on", "until"), F.length("pattern")).alias(entry))
    found = F.col(entry)
    return captures.join(best, ["host", "fetched_on"], "left").select(*captures.columns, found.isNotNull().alias(blocked), found["pattern"].alias(pattern), found["listed_on"].alias(listed_on), found["until"].alias(until))


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages table as captures; it has no fetch times, so page numbers stand for days from 2021 to 2024."""
    day = F.date_add(F.to_date(F.lit("2021-01-01")), F.pmod(F.col("page_id") * 7919, F.lit(1461)).cast("int"))
    return pages.select("page_id", host_of(F.col("url")).alias("host"), day.alias("fetched_on"))


def history_of(captures: DataFrame) -> DataFrame:
    """A dated list over the hosts and domains of the captures, drawn from their digests."""
    names = captures.filter("host is not null").select("host").distinct().select(F.explode(F.slice(suffixes(F.col("host")), 1, 2)).alias("pattern")).distinct()
    v = F.conv(F.substring(F.md5("pattern"), 1, 4), 16, 10).cast("int")
    day = lambda n: F.date_add(F.to_date(F.lit("2021-01-01")), n.cast("int"))
    rows = F.array(
        F.struct(F.lit("add").alias("action"), day(v % 700).alias("day"), (v % 4 == 0).alias("used")),
        F.struct(F.lit("remove").alias("action"), day(v % 700 + 200).alias("day"), (v % 12 == 0).alias("used")),
        F.struct(F.lit("add").alias("action"), day(v % 700 + 500).alias("day"), (v % 20 == 0).alias("used")),
    )
    return names.select("pattern", F.inline(rows)).filter("used").drop("used")


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    captures = captures_of(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return as_of(captures, history_of(captures))


OP9_SQL = r"""
WITH captures AS (
  SELECT page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '') AS host,
         (DATE '2021-01-01' + ((page_id * 7919) % 1461)::INTEGER)::DATE AS fetched_on FROM pages),
parts AS (SELECT DISTINCT host, string_split(host, '.') AS labels FROM captures WHERE host IS NOT NULL),
suffix AS (SELECT host, array_to_string(labels[i:], '.') AS pattern, i FROM parts, unnest(range(1, len(labels) + 1)) AS t(i)),
drawn AS (SELECT DISTINCT pattern, ('0x' || substr(md5(pattern), 1, 4))::INTEGER AS v FROM suffix WHERE i <= 2),
listed AS (
  SELECT pattern, 'add' AS action, DATE '2021-01-01' + v % 700 AS day FROM drawn WHERE v % 4 = 0
  UNION ALL SELECT pattern, 'remove', DATE '2021-01-01' + (v % 700 + 200) FROM drawn WHERE v % 12 = 0
  UNION ALL SELECT pattern, 'add', DATE '2021-01-01' + (v % 700 + 500) FROM drawn WHERE v % 20 = 0),
daily AS (SELECT pattern, day, max(action) AS action FROM listed GROUP BY ALL),
changed AS (SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY pattern ORDER BY day) AS before FROM daily) WHERE before IS NULL OR before <> action),
spans AS (SELECT * FROM (SELECT pattern, action, day AS listed_on, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS until FROM changed) WHERE action = 'add'),
hits AS (
  SELECT c.page_id, s.pattern, s.listed_on, s.until, row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.pattern) DESC) AS n
  FROM captures c JOIN suffix x ON c.host = x.host JOIN spans s ON s.pattern = x.pattern
   AND s.listed_on <= c.fetched_on AND (s.until IS NULL OR c.fetched_on < s.until))
SELECT c.page_id, c.host, c.fetched_on, h.pattern IS NOT NULL AS blocked, h.pattern, h.listed_on, h.until
FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id AND h.n = 1
"""
