import pytest
from pyspark.sql import functions as F

from docsect.functions import safety as S
from docsect.functions import text as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text, slug", [("Hello World", "hello-world"), ("API Reference (v2)", "api-reference-v2"), ("  extra   spaces  ", "extra-spaces"), ("( foo )", "-foo-"), ("!!!", ""), ("Été déjà", "été-déjà")])
def test_slugify(spark, text, slug):
    assert one(spark, text, X.slugify) == slug


@pytest.mark.parametrize("file, prefix", [("README.md", "readme"), ("docs/api.md", "api-docs"), ("a/b/c.d.rst", "cd-a-b")])
def test_file_prefix(spark, file, prefix):
    assert one(spark, file, X.file_prefix) == prefix


def test_keywords(spark):
    found = one(spark, "Run `pip install`, then use function_name and camelCase to Deploy. `ab`", X.keywords)
    assert found == ["camelcase", "deploy", "function_name", "install", "pip install"]
    assert len(one(spark, " ".join(f"`word{i}`" for i in range(40)), X.keywords)) == 20


def test_summaries(spark):
    row = spark.createDataFrame([("T", "# T\n```\nfenced\n" + "x" * 130, 4)], "t string, c string, n int")
    got = row.select(X.simple_summary(F.col("t"), F.col("c")).alias("a"), X.fallback_summary(F.col("t"), F.col("c")).alias("b"), X.short_summary(F.col("c"), F.col("n")).alias("c")).first()
    assert got["a"] == "fenced" and got["b"] == "```" and got["c"] is None
    assert one(spark, "y" * 121, lambda c: X.simple_summary(F.lit("T"), c)) == "y" * 120 + "..."


def test_damaged_bytes_and_newlines(spark):
    got = spark.createDataFrame([(bytearray(b"a\r\nb\rc\xff"),)], "v binary").select(X.read_text(F.col("v")).alias("r")).first()["r"]
    assert got == "a\nb\nc�"


@pytest.mark.parametrize("url, want", [("https://github.com/o/r", ("o", "r")), ("o/my.github.io", ("o", "myhub.io")), ("nothing", (None, None))])
def test_parse_repository(spark, url, want):
    assert tuple(one(spark, url, X.parse_repository)) == want


@pytest.mark.parametrize("name, bad", [(".env", True), ("a/.ENV", True), ("x.pem", True), ("X.PEM", False), ("id_rsa.pub", True), ("README.md", False), ("package.json", False)])
def test_sensitive_names(spark, name, bad):
    assert one(spark, name, S.sensitive_name) is bad


def test_secrets(spark):
    assert one(spark, "key AKIA" + "A" * 16 + " and ghp_" + "a" * 36, S.secrets) == ["AWS access key", "GitHub personal access token"]
    assert one(spark, "clean", S.secrets) == []


@pytest.mark.parametrize("pattern, name, hit", [("docs/*.md", "docs/a/b.md", True), ("*.md", "a.mdx", False), ("doc_[!0-4].md", "doc_7.md", True), ("a?c", "abc", True), ("a.c", "abc", False)])
def test_globs(spark, pattern, name, hit):
    assert one(spark, name, lambda c: S.glob_match(c, pattern)) is hit


@pytest.mark.parametrize("lines, path, hit", [(["build/"], "build/x.md", True), (["build/"], "src/build/x.md", True), (["/build"], "src/build/x.md", False), (["*.log"], "a/b.log", True), (["*.md", "!keep.md"], "keep.md", False), (["docs/api*"], "docs/api.md", True), (["a/**/z.md"], "a/b/c/z.md", True), (["# note", ""], "x.md", False)])
def test_ignore_rules(lines, path, hit):
    assert S.IgnoreRules(lines).match(path) is hit
