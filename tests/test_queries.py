"""Registered queries against their SQL, over tables with texts that the small scales do not have."""

import pytest

import __spark_entry__ as entry

#: Texts of over 200 lines: with no place to cut, with one, and with blank lines only.
LONG = ["\n".join(f"line {i} of the token guide" for i in range(260)), "\n\n\n".join(f"part {i}\n" + "words\n" * 30 for i in range(9)), "\n" * 230]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents and conversations, each text with headings (of C.pages) and without."""
    base = str(tmp_path_factory.mktemp("long"))
    texts = [*LONG, "short\ntext", "", None]
    docs = [(d + 4 * i + k, t, lang, f"src{1 - k}") for d, lang in ((0, "en"), (100, "de")) for i, t in enumerate(texts) for k in (0, 1)]
    spark.createDataFrame([(d, t, lang, s, len(t or "")) for d, t, lang, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    turns = [(i, 0, "system", t) for i, t in enumerate(texts)] + [(9, 0, "user", LONG[1]), (9, 1, "assistant", "yes")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{base}/conversations.parquet")
    return base


def agrees(spark, tables, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
    found = entry.queries()[name](spark, tables)
    want = con.execute(entry.oracle_sql()[name])
    assert found.columns == [c[0] for c in want.description]
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.parametrize("name", ["md_sections", "md_preamble", "sections_batch", "toc", "toc_filtered", "index_roundtrip", "updated_sections", "incremental_merge", "section_changes"])
def test_long_files_without_headings_are_one_section(spark, tables, name):
    agrees(spark, tables, name)
