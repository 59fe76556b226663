import random

from docsect.operators import merge as M
from docsect.operators import navigate as N
from docsect.operators import sections as P


def files(spark, *rows):
    return spark.createDataFrame([("r/r", f, c) for f, c in rows], P.FILES)


def rows(df):
    return [r.asDict() for r in df.orderBy("file", "seq").collect()]


SAMPLE = "intro\n# Start\n\ntext `code_x`\n## Sub\nmore\n### Deep\n## Sub\nother\n# End\n"


def test_markdown_places(spark):
    got = rows(P.complete(P.markdown(files(spark, ("docs/a.md", SAMPLE)))))
    assert [(r["title"], r["depth"]) for r in got] == [("docs/a.md", 0), ("Start", 1), ("Sub", 2), ("Deep", 3), ("Sub", 2), ("End", 1)]
    assert got[0]["id"] == "a-docs-root" and got[1]["id"] == "a-docs-start" and got[1]["parent"] == "a-docs-root" and got[3]["parent"] == got[2]["id"]
    assert got[4]["id"].startswith("a-docs-sub-") and len({r["id"] for r in got}) == 6 and got[1]["path"] == "docs/a.md#start"
    raw = SAMPLE.encode()
    for r in got:
        assert raw[r["byte_offset"] : r["byte_offset"] + r["byte_length"]].decode() == r["content"]
        assert r["line_count"] == r["content"].count("\n") + 1


def brute_parents(depths):
    out, stack = [], []
    for i, d in enumerate(depths):
        while stack and depths[stack[-1]] >= d:
            stack.pop()
        out.append(stack[-1] if stack else None)
        stack.append(i)
    return out


def test_parents_against_a_stack(spark):
    random.seed(1)
    for n in range(3):
        depths = [random.randint(1, 6) for _ in range(40)]
        text = "\n".join("#" * d + f" h{i}" for i, d in enumerate(depths))
        got = rows(P.markdown(files(spark, ("x.md", text))))
        assert [r["parent"] for r in got] == [None if p is None else f"x-h{p}" for p in brute_parents(depths)]


def test_blank_lead_is_dropped_and_fences_count(spark):
    got = rows(P.markdown(files(spark, ("x.md", "\n \n# A\n```\n# not a comment\n```"))))
    assert [r["title"] for r in got] == ["A", "not a comment"] and got[0]["byte_offset"] == 3


def brute_chunks(lines):
    out, start, blank = [], 0, 0
    for i, line in enumerate(lines):
        blank = blank + 1 if not line.strip() else 0
        if blank >= 2 and i + 1 - start >= 20:
            out.append((start, i + 1))
            start, blank = i + 1, 0
    if start < len(lines) and any(x.strip() for x in lines[start:]):
        out.append((start, len(lines)))
    return out


def test_headingless(spark):
    short = rows(P.markdown(files(spark, ("s.md", "\n first line \nsecond"), ("t.md", "---\ntitle: My Doc\n---\nbody"))))
    assert [(r["id"], r["title"]) for r in short] == [("s-root", "first line"), ("t-root", "My Doc")]
    random.seed(2)
    lines = [random.choice(["", "", "word", "two words"]) for _ in range(700)]
    got = rows(P.markdown(files(spark, ("l.md", "\n".join(lines)))))
    want = brute_chunks(lines)
    assert [r["line_count"] for r in got] == [b - a for a, b in want]
    assert [r["content"] for r in got] == ["\n".join(lines[a:b]) for a, b in want]
    raw = "\n".join(lines).encode()
    assert all(raw[r["byte_offset"] : r["byte_offset"] + len(r["content"].encode())].decode() == r["content"] for r in got)
    assert got[-1]["title"].endswith(f"(continued {len(want)})")


def test_mdx(spark):
    text = "---\ntitle: T\n---\nimport A from 'a'\n\n# Guide\n<Callout type='x'>kept</Callout>\n<Button />\nexport default A\n"
    got = rows(P.mdx(files(spark, ("g.mdx", text))))
    whole = "\n".join(r["content"] for r in got)
    assert [r["title"] for r in got] == ["Guide"] and "kept" in whole and "Callout" not in whole and "import" not in whole and "export" not in whole


def test_rst(spark):
    text = "=====\nGuide\n=====\n\nInstall\n=======\ntext\n\nBasic\n-----\nSub\n~~~\nMore\n-----\nNope\n--\n"
    got = rows(P.rst(files(spark, ("g.rst", text), ("n.rst", "plain"))))
    assert [(r["title"], r["depth"]) for r in got] == [("Guide", 1), ("Install", 2), ("Basic", 3), ("Sub", 4), ("More", 3), ("n.rst", 0)]
    raw = text.encode()
    assert all(raw[r["byte_offset"] : r["byte_offset"] + len(r["content"].encode())].decode() == r["content"] for r in got[:-1])


def test_search_and_filters(spark):
    s = P.complete(P.markdown(files(spark, ("a.md", "# Installation\nhow to install\n# Usage\ninstall first"), ("b/c.md", "# Other\nnothing")))).cache()
    got = N.search(s, "install").collect()
    assert [r["title"] for r in got] == ["Installation", "Usage"] and got[0]["score"] == 10 + 3 + 2 + 5 + 1
    assert [r["score"] for r in N.search(s, "", 10).collect()] == [15, 15, 15]
    assert N.filter_sections(s, path_prefix="b/").count() == 1 and N.filter_sections(s, max_depth=0).count() == 0 and N.filter_sections(s, file_pattern="*.md").count() == 3


def test_ancestors(spark):
    s = P.complete(P.markdown(files(spark, ("a.md", "# A\n## B\n### C\n## D"))))
    got = {r["id"]: (r["ancestors"], r["level"]) for r in N.ancestor_paths(s).collect()}
    assert got["a-c"] == (["a-a", "a-b", "a-c"], 2) and got["a-d"] == (["a-a", "a-d"], 1) and got["a-a"] == (["a-a"], 0)


def test_changes(spark):
    t = "repo string, file string, hash string"
    old, new = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", "3")], t), spark.createDataFrame([("r", "a", "1"), ("r", "b", "9"), ("r", "d", "4")], t)
    changes = M.change_set(old, new)
    assert {(r["file"], r["change"]) for r in changes.collect()} == {("b", "changed"), ("c", "deleted"), ("d", "added")}
    assert {(r["file"], r["hash"]) for r in M.merge_files(old, changes, new).collect()} == {("a", "1"), ("b", "9"), ("d", "4")}
