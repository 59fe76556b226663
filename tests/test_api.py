import json
import pathlib
import random
import urllib.error

import pytest

from docsect.operators import merkle, summarize
from docsect.operators.navigate import nested
from docsect.plans import tools
from docsect.plans.api import Tools
from docsect.sources import github, local
from docsect.streaming import landing


@pytest.fixture(autouse=True)
def no_clients(monkeypatch):
    monkeypatch.setenv("USE_OLLAMA", "false")
    monkeypatch.delenv("ANTHROPIC_API_KEY", raising=False)


@pytest.fixture
def tree(tmp_path):
    base = tmp_path / "proj"
    for name, text in {"README.md": "# Project\nAbout.\n## Installation\nRun `pip install`.\nmore\nlines\n", "docs/api.md": "# API\r\ntext\r\n## Auth\r\ntoken\r\n", "docs/_index.md": "# Under\n", "B.MD": "# Upper\n", "g.mdx": "import X from 'x'\n# Guide\n<A>kept</A>\n", "s.rst": "Title\n=====\nbody\n", ".hidden/x.md": "# no", "node_modules/y.md": "# no", "build/z.md": "# no", "config.md": "AKIA" + "B" * 16, ".gitignore": "build/\n*.log\n"}.items():
        p = base / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())
    return base


def test_discovery(tree, tmp_path):
    assert local.discover(str(tree)) == ["B.MD", "README.md", "config.md", "docs/_index.md", "docs/api.md", "g.mdx", "s.rst"]
    assert "docs/api.md" not in local.discover(str(tree), extra_ignore_patterns=["docs/api*"])
    assert ".hidden/x.md" in local.discover(str(tree), include_hidden=True)
    assert local.discover(str(tree), max_depth=0) == ["B.MD", "README.md", "config.md", "g.mdx", "s.rst"]
    (tmp_path / "far.md").write_text("# far")
    (tree / "out.md").symlink_to(tmp_path / "far.md")
    (tree / "in.md").symlink_to(tree / "README.md")
    assert "in.md" not in local.discover(str(tree))
    assert "in.md" in local.discover(str(tree), follow_symlinks=True) and "out.md" not in local.discover(str(tree), follow_symlinks=True)
    with pytest.raises(ValueError):
        local.discover(str(tree / "nope"))


def test_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The same names as one walk, from few folders near the root or many; the driver lists no folder below those."""
    base = tmp_path / "deep"
    for i in range(6):
        for j in range(5):
            for k in range(2):
                p = base / f"a{i}" / f"b{j}" / f"c{k}" / f"f{i}{j}{k}.md"
                p.parent.mkdir(parents=True, exist_ok=True)
                p.write_text("# T\n")
        (base / f"a{i}" / ("top.md" if i % 2 else ".hidden.md")).write_text("x")
    (base / ".gitignore").write_text("a3/\nc1/f*0*\n!a5/b0/c1/f501.md\n")
    for tasks in (1, 4, 20, 1000):
        monkeypatch.setattr(local, "TASKS", tasks)
        for more in ({}, {"max_depth": 2}, {"extra_ignore_patterns": ["b2/"]}):
            want = local.discover(str(base), **more)
            assert sorted(r["file"] for r in local.read_local(spark, str(base), **more).select("file").collect()) == want and want
            files, folders = local.Tree(str(base), **more).parts(tasks)
            assert set(files) <= set(want) and (len(folders) >= tasks or not folders)
    with pytest.raises(ValueError):
        local.Tree(str(base / "a0" / "top.md"))


def test_tools(spark, tree, tmp_path):
    t = Tools(spark, str(tmp_path / "store"))
    done = t.index_local(str(tree))
    assert done["success"] and done["repo"] == "local/proj" and done["file_count"] == 7 and done["skipped_secrets"] == ["config.md"]
    assert t.list_repos()["count"] == 1
    toc = t.get_toc("proj")
    assert toc["section_count"] == 9 - 1 and all("summary" in s for s in toc["sections"])
    assert t.get_toc("proj", max_depth=1, path_prefix="docs/")["section_count"] == 2
    assert [n["title"] for n in t.get_document_outline("proj", "README.md")["tree"][0]["children"]] == ["Installation"]
    assert "error" in t.get_document_outline("proj", "nope.md") and "error" in t.get_toc("other")
    assert t.get_section("local/proj", "readme-installation")["content"].startswith("## Installation\nRun")
    assert t.get_section("proj", "g-guide")["content"] == "# Guide\nkept\n" and t.get_section("proj", "api-docs-auth")["content"] == "## Auth\ntoken\n"
    many = t.get_sections("proj", ["s-title", "nope", "s-title"])
    assert [s["id"] for s in many["sections"]] == ["s-title", "s-title"] and many["errors"][0]["id"] == "nope" and t.get_sections("proj", ["s-title"])["errors"] is None
    assert t.search_sections("proj", "install")["results"][0]["title"] == "Installation"
    assert "error" in t.search_sections("proj", "x", -1)
    (tree / "README.md").write_text("# Project\n## Changed\n")
    (tree / "s.rst").unlink()
    assert t.index_local(str(tree), incremental=True)["success"]
    ids = {s["id"] for s in t.get_toc("proj")["sections"]}
    assert "readme-changed" in ids and "readme-installation" not in ids and "s-title" not in ids and "api-docs-auth" in ids
    assert t.delete_index("proj")["success"] and not t.delete_index("proj")["success"]


def test_summarizer(spark, tree, tmp_path):
    t = Tools(spark, str(tmp_path / "store"), ask=lambda p: "told" if "Installation" in p else "")
    assert t.index_local(str(tree))["success"]
    got = {s["id"]: s.get("summary") for s in t.get_toc("proj")["sections"]}
    assert got["readme-installation"] == "told" and got["readme-project"] == "# Project\nAbout."


def fake():
    """A transport that travels to the executors by value."""

    def transport(url, headers):
        if "missing" in url:
            raise urllib.error.HTTPError(url, 404, "", {}, None)
        if "/git/trees/" in url:
            return json.dumps({"tree": [{"path": p, "type": "blob", "sha": f"s-{p}"} for p in ("a.md", "id_rsa.md", "x.py", "bad.md")]}).encode()
        if "/commits/" in url:
            return b'{"sha": "abc"}'
        if "bad" in url:
            raise OSError("gone")
        return b"# Far\r\ntext\r\n"

    return transport


def counting(folder):
    """The same, with a file for each request."""
    inner = fake()

    def transport(url, headers):
        import uuid

        (folder / uuid.uuid4().hex).write_text(url)
        return inner(url, headers)

    return transport


def test_each_file_is_fetched_once(spark, tmp_path):
    (tmp_path / "asked").mkdir()
    t = Tools(spark, str(tmp_path / "store"), get=counting(tmp_path / "asked"))
    for incremental in (False, True):
        assert t.index_repo("o/r", incremental=incremental)["success"]
        asked = [p.read_text() for p in (tmp_path / "asked").iterdir()]
        assert sum("/git/trees/" in x for x in asked) == 1 and sum(x.endswith("/contents/a.md") for x in asked) == 1
        for p in (tmp_path / "asked").iterdir():
            p.unlink()


def test_an_update_writes_touched_leaves_only(spark, tree, tmp_path):
    for i in range(40):
        (tree / f"n{i}.md").write_text(f"# N{i}\n")
    t = Tools(spark, str(tmp_path / "store"))
    t.store.target = 30
    assert t.index_local(str(tree))["success"]
    before = t.store.meta("local/proj")
    (tree / "n7.md").write_text("# Other\n")
    held = t.store.sections("local/proj")
    assert t.index_local(str(tree), incremental=True)["success"]
    after = t.store.meta("local/proj")
    changed = {k for k in after["leaves"] if after["leaves"][k] != before["leaves"].get(k)}
    assert len(changed) == 1 and len(after["leaves"]) == len(before["leaves"]) > 8
    assert "N7" in {r["title"] for r in held.collect()}  # a reader of the snapshot before
    assert t.get_section("proj", "n7-other")["content"] == "# Other\n" and after["section_count"] == before["section_count"]


def test_calls_by_name(spark, tree, tmp_path):
    t = Tools(spark, str(tmp_path / "store"))
    given = {x["name"]: x["inputSchema"] for x in tools.declared()}
    assert len(given) == 10 and given["search_sections"]["required"] == ["repo", "query"] and given["search_sections"]["properties"]["max_results"] == {"type": "integer", "default": 10}
    assert given["get_sections"]["properties"]["section_ids"] == {"type": "array", "items": {"type": "string"}} and "required" not in given["list_repos"]
    ask = lambda name, **a: json.loads(tools.call(t, name, a))
    assert ask("index_local", path=str(tree))["success"] and ask("list_repos")["count"] == 1
    assert ask("get_section", repo="proj", section_id="g-guide")["content"] == "# Guide\nkept\n"
    assert ask("search_sections", repo="proj", query="install", path_prefix=None)["result_count"] > 0
    assert "missing" in ask("get_section", repo="proj")["error"] and "no integer" in ask("search_sections", repo="proj", query="x", max_results="1")["error"] and "Unknown" in ask("nope")["error"]
    assert ask("get_toc", repo="proj")["files"].count("config.md") == 1 and ask("list_repos")["repos"][0]["file_count"] == 7


def test_summary_clients():
    sent = []

    def send(url, headers, body):
        sent.append((url, headers, body))
        if "11434" in url:
            raise OSError("not there")
        return {"content": [{"text": " told "}]}

    ask = summarize.default_client({"ANTHROPIC_API_KEY": "k", "ANTHROPIC_MODEL": "m"}, send)
    assert [ask("p") for _ in range(5)] == ["told"] * 5
    assert sum("11434" in u for u, _, _ in sent) == 3 and sent[-1][1]["x-api-key"] == "k" and sent[-1][2] == {"model": "m", "max_tokens": 100, "messages": [{"role": "user", "content": "p"}]}
    assert summarize.ollama("u", "m", lambda u, h, b: {"response": b["prompt"] + b["model"]})("p") == "pm"
    assert summarize.default_client({"USE_OLLAMA": "no"}) is None


def test_calls_are_paced():
    clock, slept = [0.0], []

    def sleep(x):
        slept.append(x)
        clock[0] += x

    ask = summarize.Pace(4, lambda: clock[0], sleep)(lambda p: p)
    assert [ask(str(i)) for i in range(5)] == list("01234") and slept == [0.0, 0.25, 0.25, 0.25, 0.25]
    clock[0] += 10  # time in which nobody has asked is not saved up
    assert ask("x") == "x" and ask("y") == "y" and slept[-2:] == [0.0, 0.25]


def test_all_tasks_share_a_limit(spark, tree, tmp_path):
    t = Tools(spark, str(tmp_path / "store"), ask=lambda p: "told", calls_a_second=100.0)
    assert t.index_local(str(tree))["success"]
    assert "told" in {s.get("summary") for s in t.get_toc("proj")["sections"]}


def test_a_failing_client_leaves_the_plain_summary(spark, tree, tmp_path):
    def ask(prompt):
        raise OSError("gone")

    t = Tools(spark, str(tmp_path / "store"), ask=ask)
    assert t.index_local(str(tree))["success"]
    assert {s["id"]: s.get("summary") for s in t.get_toc("proj")["sections"]}["readme-installation"] == "Run `pip install`."


def test_github(spark, tmp_path, monkeypatch):
    assert github.parse_url("https://github.com/o/r.git/") == ("o", "r")
    assert list(github.list_tree("o", "r", get=fake())) == ["a.md", "bad.md"] and github.list_tree("o", "missing", get=fake()) == {}
    t = Tools(spark, str(tmp_path / "store"), get=fake())
    done = t.index_repo("o/r")
    assert done["success"] and done["commit_hash"] == "abc" and done["section_count"] == 1
    assert t.get_section("o/r", "a-far")["content"] == "# Far\ntext\n"
    monkeypatch.setenv("DOCSECT_LOCAL_ONLY", "Yes")
    assert not t.index_repo("o/r")["success"]


def test_old_index_is_refused(spark, tree, tmp_path):
    t = Tools(spark, str(tmp_path / "store"))
    t.index_local(str(tree))
    (manifest,) = pathlib.Path(t.store.folder("local/proj")).glob("generation-*.json")
    manifest.write_text(json.dumps({k: v for k, v in json.loads(manifest.read_text()).items() if k != "index_version"}))
    assert "error" in t.get_toc("proj") and t.list_repos()["repos"][0]["index_version"] == 0


def land(spark, tmp_path, store, rows, mode="append"):
    spark.createDataFrame(rows, landing.LANDED).coalesce(1).write.mode(mode).parquet(str(tmp_path / "in"))
    landing.follow(spark, str(tmp_path / "in"), store, "o/r", str(tmp_path / "cp")).awaitTermination()


def test_landing(spark, tmp_path):
    store = Tools(spark, str(tmp_path / "store")).store
    land(spark, tmp_path, store, [("a.md", "# A\n", False, None), ("b.md", "# B\n", False, None), ("config.md", "# C AKIA" + "B" * 16, None, 1), ("id_rsa.md", "# no", False, 1), ("x.py", "# no", False, 1), ("node_modules/y.md", "# no", False, 1)])
    land(spark, tmp_path, store, [("a.md", None, True, None), ("c.md", "# C\r\nx\n", False, None)])
    assert sorted(r["title"] for r in store.sections("o/r").collect()) == ["B", "C"]
    assert {r["file"]: r["content"] for r in store.files("o/r").collect()} == {"b.md": "# B\n", "c.md": "# C\nx\n", "config.md": None}


def test_the_latest_version_wins_in_any_order(spark, tmp_path):
    versions = [("a.md", f"# A{v}\n", False, v) for v in range(4)] + [("a.md", None, True, 4), ("a.md", "# A5\n", False, 5), ("b.md", "# B1\n", False, 1), ("b.md", None, True, 2), ("c.md", "# C9\n", False, 9), ("c.md", None, True, 8)]
    for k in range(2):
        here, rows = tmp_path / str(k), versions[:]
        random.Random(k).shuffle(rows)
        store = Tools(spark, str(here / "store")).store
        for part in (rows[:4], rows[4:7], rows[7:]):
            land(spark, here, store, part)
        assert sorted(r["title"] for r in store.sections("o/r").collect()) == ["A5", "C9"]
        # a version that comes late is refused
        land(spark, here, store, [("b.md", "# B0\n", False, 0), ("a.md", None, True, 3), ("c.md", "# C10\n", False, 10)])
        assert sorted(r["title"] for r in store.sections("o/r").collect()) == ["A5", "C10"]


def cut_off(calls):
    """A repository whose listing is cut off at two levels; every third answer fails once."""
    tree = {"HEAD": [("docs", "tree", "t1"), ("top.md", "blob", "b0"), ("small", "tree", "t3")], "t1": [("deep", "tree", "t2"), ("one.md", "blob", "b1")], "t2": [("two.md", "blob", "b2"), ("x.py", "blob", "b3"), ("more/three.rst", "blob", "b4")], "t3": [("four.md", "blob", "b5")]}

    def get(url, headers):
        sha, _, recursive = url.rsplit("/", 1)[1].partition("?")
        seen = pathlib.Path(calls) / url.rsplit("/", 1)[1].replace("?", "_")
        if not seen.exists():
            seen.write_text("")
            if sha in ("t1", "t2"):
                raise urllib.error.HTTPError(url, 503, "", {}, None)
        entries = [{"path": p, "type": k, "sha": s} for p, k, s in tree[sha]]
        return json.dumps({"truncated": True, "tree": entries[:1]} if recursive and sha in ("HEAD", "t1") else {"tree": entries}).encode()

    return get


def test_listings_that_are_cut_off_are_walked(spark, tmp_path):
    for k, session in enumerate((None, spark)):
        calls = tmp_path / str(k)
        calls.mkdir()
        found = github.list_tree("o", "r", get=cut_off(str(calls)), spark=session, pause=0.01)
        assert found == {"docs/deep/more/three.rst": "b4", "docs/deep/two.md": "b2", "docs/one.md": "b1", "small/four.md": "b5", "top.md": "b0"}
    with pytest.raises(urllib.error.HTTPError):
        github.list_tree("o", "r", get=lambda u, h: (_ for _ in ()).throw(urllib.error.HTTPError(u, 401, "", {}, None)), pause=0.01)


def test_trees_by_file_are_those_of_the_sections(spark):
    """Unknown parents make roots; of sections with one id the last is the parent."""
    rows = [("o/r", "a", 0, "x", None), ("o/r", "a", 1, "y", "x"), ("o/r", "a", 2, "x", None), ("o/r", "a", 3, "z", "nope"), ("o/r", "b", 0, "y", "x")]
    df = spark.createDataFrame(rows, "repo string, file string, seq long, id string, parent string")
    got = {r["file"]: json.loads(r["tree"]) for r in nested(df, ["id"]).collect()}
    leaf = lambda i: {"id": i, "children": []}
    assert got == {"a": [leaf("x"), {"id": "x", "children": [leaf("y")]}, leaf("z")], "b": [leaf("y")]}


def test_changes_inside_files(spark):
    """Against a comparison of all sections."""
    rng = random.Random(6)
    kind = "repo string, file string, seq long, id string, depth int, hash string"
    make = lambda f: [("o/r", f, i, f"i{rng.randint(0, 5)}", rng.randint(0, 4), rng.choice("abc")) for i in range(rng.randint(1, 12))]
    old = [x for f in "abcdefgh" for x in make(f)]
    new = [x for x in old if x[1] in "abcd"] + [x[:5] + ("d",) if rng.random() < 0.2 else x for x in old if x[1] in "ef"] + make("g") + make("new")

    def keyed(rows):
        seen, out = {}, {}
        for _, f, _, i, _, h in rows:
            n = seen[f, i] = seen.get((f, i), 0) + 1
            out[f, i, n] = h
        return out

    a, b = keyed(old), keyed(new)
    want = {(*k, "added" if k not in a else "deleted" if k not in b else "changed") for k in {*a, *b} if a.get(k) != b.get(k)}
    got = {(r["file"], r["id"], r["nth"], r["change"]) for r in merkle.changes(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind)).collect()}
    assert got == want and {x[3] for x in want} == {"added", "deleted", "changed"}
