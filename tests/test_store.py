"""Leaves by size, several writers, point reads, search by postings, and answers that are kept."""

import json
import random
import re
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docsect.operators import navigate as N
from docsect.operators import sections as P
from docsect.operators.summarize import Parser
from docsect.plans import layout as L
from docsect.plans.store import Conflict, IndexStore

KIND = "repo string, file string, content string"


def files(spark, texts):
    return spark.createDataFrame([("o/r", f, t) for f, t in texts.items()], KIND).withColumn("hash", F.sha2("content", 256))


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "token", "in", "the", "Größe", "é", "install", "x1", "theta", "entropy", "auth_key"]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    return {f"d{i % 7}/f{i}.md": "".join(f"{'#' * rng.randint(1, 3)} {line(3)}\n{line(9)}\n`{line(1)}`\n" for _ in range(1 + i % 4)) for i in range(n)}


def rows(df):
    return sorted(map(str, df.collect()))


def test_leaves_are_split_by_bytes_and_updates_rewrite_their_own(spark, tmp_path):
    store, texts = IndexStore(spark, str(tmp_path / "s"), target=600), corpus(80)
    store.save("o/r", files(spark, texts), P.parse_stored)
    meta = store.meta("o/r")
    assert len(meta["leaves"]) > 8 and sum(x["files"] for x in meta["leaves"].values()) == 80
    assert all(x["bytes"] <= 600 or x["files"] == 1 for x in meta["leaves"].values())
    prefixes = sorted(meta["leaves"])
    assert sum(2.0 ** -len(p) for p in prefixes) == 1.0 and not any(b.startswith(a) for a, b in zip(prefixes, prefixes[1:]))
    assert rows(store.sections("o/r")) == rows(P.parse_stored(files(spark, texts)).select(*[c for c in store.sections("o/r").columns]))
    for p, x in meta["leaves"].items():  # one file a leaf: one task has written it
        assert len(list(Path(store.folder("o/r"), x["write"], "files", f"leaf=r{p}").glob("*.parquet"))) == (1 if x["files"] else 0)
    # a file that grows splits its leaf, and nothing else is written
    new = {**texts, "d0/f0.md": "# Big\n" + "word " * 400, "d0/new.md": "# New\n"}
    del new["d1/f1.md"]
    store.update("o/r", files(spark, new), P.parse_stored)
    after = store.meta("o/r")
    touched = {L.leaf_of(f, meta["leaves"]) for f in ("d0/f0.md", "d0/new.md", "d1/f1.md")}
    assert {p for p in meta["leaves"] if after["leaves"].get(p) == meta["leaves"][p]} == set(meta["leaves"]) - touched
    assert len(after["leaves"]) > len(meta["leaves"]) and after["generation"] == 2 and after["file_count"] == 80
    assert rows(store.sections("o/r")) == rows(P.parse_stored(files(spark, new)).select(*store.sections("o/r").columns))
    # the generation before is still there for its readers, the one before that is not
    store.update("o/r", files(spark, {**new, "d0/new.md": "# Newer\n"}), P.parse_stored)
    assert {r["title"] for r in store._table("o/r", "sections", "title string", {L.leaf_of("d0/new.md", after["leaves"]): after["leaves"][L.leaf_of("d0/new.md", after["leaves"])]}).collect()} >= {"New"}
    held = {w for name in (store.meta("o/r"), after) for w in store._writes(name)}
    assert {p.name for p in Path(store.folder("o/r")).iterdir() if p.is_dir()} == held


def test_an_empty_table_and_one_huge_file(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "s"), target=100)
    store.save("o/r", files(spark, {"a.md": "# A\n"}).filter("false"), P.parse_stored)
    assert store.meta("o/r")["file_count"] == 0 and store.sections("o/r").count() == 0 and store.fetch("o/r", ["x"]).first()["error"]
    store.update("o/r", files(spark, {"a.md": "# A\n" + "b " * 5000, "c.md": "# C\n"}), P.parse_stored)
    assert store.meta("o/r")["section_count"] == 2 and store.fetch("o/r", ["c-c"]).first()["content"] == "# C\n"


def test_point_reads_read_one_leaf(spark, tmp_path):
    store, texts = IndexStore(spark, str(tmp_path / "s"), target=600), corpus(80)
    texts["z/same.md"] = texts["y/z-same.md"] = "# One\nother\n"
    store.save("o/r", files(spark, texts), P.parse_stored)
    every = store.sections("o/r").collect()
    for r in random.Random(2).sample(every, 4):
        got = store.fetch("o/r", [r["id"]])
        read = {re.search(r"/(files|sections|ids|grams)/(leaf|slot)=(\w+)", f)[3] for f in got.inputFiles()}
        assert read == {"r" + L.leaf_of(r["file"], store.meta("o/r")["leaves"])} or len(store.holding("o/r", [r["id"]])[0]) > 1
        one = got.first()
        first = min((x for x in every if x["id"] == r["id"]), key=lambda x: (x["file"], x["seq"]))
        assert one["file"] == first["file"] and one["content"].encode() == texts[first["file"]].encode()[first["byte_offset"] : first["byte_offset"] + first["byte_length"]]
    ids = [r["id"] for r in every[:5]] + ["nope", every[0]["id"]]
    got = sorted(store.fetch("o/r", ids).collect(), key=lambda r: r["pos"])
    assert [r["id"] for r in got] == ids and [r["error"] for r in got] == [None] * 5 + ["Section not found: nope", None]
    # ids that a file has lost, or another has got, in later runs
    name, gone = every[0]["file"], every[0]["id"]
    for k in range(10):  # more than RUNS
        store.update("o/r", files(spark, {**texts, name: f"# Later {k}\n"}), P.parse_stored)
    left = [x for x in every if x["id"] == gone and x["file"] != name]
    assert len(store.meta("o/r")["ids"]) <= 8 and (store.fetch("o/r", [gone]).first()["error"] is None) == bool(left)
    later = [r["id"] for r in store.sections("o/r").filter(F.col("file") == name).collect()]
    assert store.fetch("o/r", later).first()["content"] == "# Later 9\n"


def test_search_by_postings_gives_the_same_rows(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "s"), target=3000)
    texts = corpus(300, 5) | {f"rare{i}.md": "# Zebra crossing\nstripes of zebra\n" for i in range(4)}
    store.save("o/r", files(spark, texts), P.parse_stored)
    plain = store.sections("o/r")
    for q, k, more in (("zebra", 3, {}), ("zebra crossing", 10, {}), ("the token", 10, {}), ("Größe", 5, {}), ("in", 7, {}), ("é install", 4, {"path_prefix": "d3/"}), ("entropy alpha theta", 5, {"max_depth": 1}), ("nothinglikeit", 5, {}), ("", 5, {}), ("  ", 5, {}), ("auth_key", 0, {}), ("stripes of zebra", 2, {"file_pattern": "*9.md"})):
        assert [tuple(r) for r in store.search("o/r", q, k, **more).collect()] == [tuple(r) for r in N.search(plain, q, k, **more).collect()], q
    with pytest.raises(ValueError):
        store.search("o/r", "x", -1)
    # few sections are scored where the query is about few
    scored = []
    told, N.search = N.search, lambda s, *a, **b: (scored.append(s.count()), told(s, *a, **b))[1]
    try:
        store.search("o/r", "zebra crossing", 4)
    finally:
        N.search = told
    assert sum(scored) <= 0.1 * plain.count()


def test_two_writers(spark, tmp_path):
    store, texts = IndexStore(spark, str(tmp_path / "s"), target=600), corpus(30)
    store.save("o/r", files(spark, texts), P.parse_stored)
    change = lambda f: spark.createDataFrame([("o/r", f, "added")], "repo string, file string, change string")
    failed = []

    def add(k):
        try:
            IndexStore(spark, store.base, target=600).apply("o/r", files(spark, {f"n{k}.md": f"# N{k}\n"}), change(f"n{k}.md"), P.parse_stored)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and {r["title"] for r in store.sections("o/r").collect()} >= {"N0", "N1", "N2"} and store.meta("o/r")["generation"] == 4
    # a full index that began before another writer's change is refused, and what it has written goes

    def parse(x):
        if not failed:
            failed.append(1)
            add(9)
        return P.parse_stored(x)

    with pytest.raises(Conflict):
        store.save("o/r", files(spark, texts), parse)
    assert "N9" in {r["title"] for r in store.sections("o/r").collect()}


def test_unfinished_writes_are_spared_until_their_lease_ends(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "s"), lease=3.0)
    texts = corpus(5)
    store.save("o/r", files(spark, texts), P.parse_stored)
    folder = Path(store.folder("o/r"))
    with store._write("o/r") as write:
        (folder / write / "files").mkdir(parents=True)
        time.sleep(4)  # longer than the lease, which is renewed meanwhile
        store.update("o/r", files(spark, {**texts, "n.md": "# N\n"}), P.parse_stored)
        assert (folder / write).exists()
    (folder / "dead").mkdir()
    (folder / f"lease-dead-{int((time.time() + 3600) * 1000)}").write_text("")
    store.update("o/r", files(spark, {**texts, "n.md": "# M\n"}), P.parse_stored)
    assert (folder / "dead").exists() and not (folder / write).exists()
    next(folder.glob("lease-dead-*")).rename(folder / "lease-dead-1000")
    store.update("o/r", files(spark, texts), P.parse_stored)
    assert not (folder / "dead").exists() and not list(folder.glob("lease-*"))


def test_only_changed_sections_are_asked_about(spark, tmp_path):
    (tmp_path / "asked").mkdir()
    at = str(tmp_path / "asked")

    def ask(prompt):
        import uuid

        Path(at, uuid.uuid4().hex).write_text(prompt)
        return "" if "Title: S7\n" in prompt else "told " + prompt.split("Title: ")[1].split("\n")[0]

    def asked():
        found = [p.read_text() for p in Path(at).iterdir()]
        for p in Path(at).iterdir():
            p.unlink()
        return found

    section = lambda i, more="": f"# S{i}\nline\nmore {more}\n"
    text = "".join(section(i) for i in range(1000))
    store, parser = IndexStore(spark, str(tmp_path / "s")), Parser(ask, "m")
    store.save("o/r", files(spark, {"a.md": text, "b.md": "# B\nx\ny\n"}), parser)
    assert len(asked()) == 1001
    store.update("o/r", files(spark, {"a.md": text.replace(section(500), section(500, "new")), "b.md": "# B\nx\ny\n"}), parser)
    got = asked()
    assert len(got) == 2 and sum("more new" in x for x in got) == 1  # and once more the one that nobody has answered for
    told = {r["title"]: r["summary"] for r in store.sections("o/r").collect()}
    assert told["S500"] == "told S500" and told["S3"] == "told S3" and told["S7"] == "line"
    store.save("o/r", files(spark, {"moved/a.md": text, "b.md": "# B\nx\ny\n"}), parser)
    assert [x for x in asked() if "S7" not in x and "S500" not in x] == []
    store.save("o/r", files(spark, {"b.md": "# B\nx\ny\n"}), Parser(ask, "another"))
    assert len(asked()) == 1


def test_manifests_are_json(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "s"))
    store.save("o/r", files(spark, corpus(3)), P.parse_stored, "abc")
    (name,) = Path(store.folder("o/r")).glob("generation-*.json")
    assert json.loads(name.read_text())["commit_hash"] == "abc" and store.list()[0]["file_count"] == 3
    for bad in ("o/..", "./x", "o/", "o/a\\b"):
        with pytest.raises(ValueError):
            store.folder(bad)


def test_small_leaves_share_tasks_and_paths(spark, tmp_path):
    store, texts = IndexStore(spark, str(tmp_path / "s"), target=100), corpus(200)
    meta = store.save("o/r", files(spark, texts), P.parse_stored)
    tasks = {p.name.split("-")[1] for p in Path(store.folder("o/r")).glob("*/files/leaf=*/part-*.parquet")}
    assert len(meta["leaves"]) > 200 and len(tasks) <= 2 * spark.sparkContext.defaultParallelism + 1
    assert sorted(r["file"] for r in store.files("o/r").collect()) == sorted(texts)
    # a write of which a leaf has been replaced is read leaf by leaf
    after = store.update("o/r", files(spark, {**texts, "d0/f0.md": "# Other\n"}), P.parse_stored)
    assert {r["content"] for r in store.files("o/r").filter("file = 'd0/f0.md'").collect()} == {"# Other\n"} and store.files("o/r").count() == 200 and after["file_count"] == 200


@pytest.mark.parametrize("at_once", [4, 1 << 16])
def test_leaves_are_split_by_tasks(spark, monkeypatch, at_once):
    monkeypatch.setattr(L, "FILES_AT_ONCE", at_once)
    sizes = {f"f{i}": 1 + (i * 7) % 50 + 900 * (i == 3) for i in range(120)}
    rows = spark.createDataFrame(list(sizes.items()), "file string, size long").withColumn("number", L.number("file"))
    for regions in ([""], ["0", "100", "1010000000", "1010000001", "10110"]):
        mine = {f: n for f, n in sizes.items() if any(format(L.number_of(f), "060b").startswith(r) for r in regions)}
        table = rows.filter(F.col("file").isin(list(mine)))
        found = L.leaves(table, regions, 100)
        assert sum(2.0 ** -len(p) for p in found) == sum(2.0 ** -len(r) for r in regions)
        want: dict[str, list[int]] = {p: [] for p in found}
        for f, n in mine.items():
            want[L.leaf_of(f, found)].append(n)
        assert {p: sum(x) for p, x in want.items()} == found and all(n <= 100 or len(want[p]) == 1 for p, n in found.items())
        assert all(p in regions or sum(want[p]) + sum(sum(x) for q, x in want.items() if q.startswith(p[:-1]) and q != p) > 100 for p in found)
        met, tasks = L.dealt(table, found, "file", 150)
        got = met.select("file", "leaf", "task").collect()
        assert {r["file"]: r["leaf"] for r in got} == {f: L.leaf_of(f, found) for f in mine} and {r["task"] for r in got} <= set(range(tasks))
