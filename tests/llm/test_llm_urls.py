"""The as-of join has no last day of its own."""

from pyspark.sql import functions as F

from docsect.llm import urls


def test_open_entries_hold_until_the_last_capture(spark):
    entries = spark.createDataFrame([("bad.com", "add", "2021-01-10"), ("new.com", "add", "2036-05-01")], "pattern string, action string, day string").withColumn("day", F.to_date("day"))
    asked = [("bad.com", "2035-02-01"), ("bad.com", "2041-12-31"), ("new.com", "2036-05-01"), ("new.com", "2036-04-30"), ("bad.com", "2021-01-09")]
    captures = spark.createDataFrame([(i, *x) for i, x in enumerate(asked)], "page_id long, host string, d string").select("page_id", "host", F.to_date("d").alias("fetched_on"))
    assert {r["page_id"] for r in urls.as_of(captures, entries).filter("blocked").collect()} == {0, 1, 2}


def test_names_that_clash_long_urls_and_repeats(spark):
    entries = spark.createDataFrame([("bad.com", "add", "2021-01-10")], "pattern string, action string, day string").withColumn("day", F.to_date("day"))
    far = "http://" + ".".join(["a"] * 300) + ".bad.com/" + "x" * 100_000
    rows = [(1, far, "e", "b", "p"), (1, far, "e", "b", "p"), (2, "http://ok.com", None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, entry string, blocked string, pattern string")
    captures = pages.select("page_id", urls.host_of(F.col("url")).alias("host"), F.lit("2021-02-01").cast("date").alias("fetched_on"), "entry", "blocked", "pattern")
    got = urls.as_of(captures, entries)
    assert got.columns == [*captures.columns, "blocked_", "pattern_", "listed_on", "until"]
    assert sorted((r["page_id"], r["blocked_"], r["pattern_"], r["pattern"]) for r in got.collect()) == [(1, True, "bad.com", "p"), (1, True, "bad.com", "p"), (2, False, None, None)]
