"""A repository on GitHub as a table.  The transport is a parameter, so that tests need no network."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsect.functions.safety import DOC_SUFFIXES, SENSITIVE_GLOBS, SENSITIVE_NAMES, glob_regex

Transport = Callable[[str, dict], bytes]


def http_get(url: str, headers: dict) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=30) as r:
        return r.read()


#: An address anywhere in the text, or owner/name alone.
ADDRESS = re.compile(r"github\.com/(?P<owner>[^/]+)/(?P<name>[^/]+)|\A(?P<owner_alone>[^/]+)/(?P<name_alone>[^/]+)\Z")


def parse_url(url: str) -> tuple[str, str]:
    """owner and name; the same rule as text.parse_repository, for the driver."""
    found = ADDRESS.search(url.strip().rstrip("/"))
    if not found:
        raise ValueError(f"neither a repository's address nor owner/name: {url}")
    return found["owner"] or found["owner_alone"], (found["name"] or found["name_alone"]).replace(".git", "")


def _headers(token: str | None, kind: str) -> dict:
    return {"Accept": f"application/vnd.github.v3{kind}", "User-Agent": "docsect"} | ({"Authorization": f"token {token}"} if token else {})


def sensitive(path: str) -> bool:
    name = path.rsplit("/", 1)[-1]
    return name.lower() in SENSITIVE_NAMES or any(re.match(glob_regex(g).replace("\\z", "\\Z"), name) for g in SENSITIVE_GLOBS)


TRIES, PAUSE = 4, 1.0


def fetch_tree(owner: str, name: str, sha: str, recursive: bool, token: str | None, get: Transport, pause: float = PAUSE) -> dict:
    """One answer of the listing; one that fails for now is asked for again, after a longer pause each time."""
    url = f"https://api.github.com/repos/{owner}/{name}/git/trees/{sha}" + "?recursive=1" * recursive
    for again in range(TRIES):
        try:
            return json.loads(get(url, _headers(token, "+json")))
        except (OSError, ValueError) as e:
            if again == TRIES - 1 or isinstance(e, urllib.error.HTTPError) and e.code not in (403, 408, 429) and e.code < 500:
                raise
            time.sleep(pause * 2**again)
    raise AssertionError


def _walk(owner: str, name: str, path: str, sha: str, token: str | None, get: Transport, pause: float) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Files (path, hash) under a folder, and folders (path, hash) to walk: none, unless the answer about all below was cut off."""
    found = fetch_tree(owner, name, sha, True, token, get, pause)
    deeper = bool(found.get("truncated"))
    if deeper:
        found = fetch_tree(owner, name, sha, False, token, get, pause)
    rows = lambda kind: [(path + x["path"] + "/" * (kind == "tree"), x.get("sha", "")) for x in found.get("tree", []) if x.get("type") == kind]
    return rows("blob"), rows("tree") if deeper else []


def list_tree(owner: str, name: str, token: str | None = None, get: Transport = http_get, spark: SparkSession | None = None, pause: float = PAUSE) -> dict[str, str]:
    """Documentation files and their blob hashes; a repository that is not there has none.

    A listing that the server cuts off is walked folder by folder, level by level; with spark the folders of a level are
    asked for by its tasks.  Names come to the driver.
    """
    try:
        rows, folders = _walk(owner, name, "", "HEAD", token, get, pause)
    except urllib.error.HTTPError as e:
        if e.code == 404:
            return {}
        raise

    def run(batches):
        for pdf in batches:
            for path, sha in zip(pdf["path"], pdf["sha"]):
                found = _walk(owner, name, path, sha, token, get, pause)
                yield pd.DataFrame([(*x, kind) for kind, part in enumerate(found) for x in part], columns=["path", "sha", "kind"])

    while folders:
        if spark is None:
            level = [(*x, kind) for path, sha in folders for kind, part in enumerate(_walk(owner, name, path, sha, token, get, pause)) for x in part]
        else:
            todo = spark.createDataFrame(folders, "path string, sha string").repartition(min(len(folders), 64))
            level = [tuple(r) for r in todo.mapInPandas(run, "path string, sha string, kind int").collect()]
        rows += [(path, sha) for path, sha, kind in level if kind == 0]
        folders = [(path, sha) for path, sha, kind in level if kind == 1]
    return {path: sha for path, sha in sorted(rows) if path.lower().endswith(DOC_SUFFIXES) and not sensitive(path)}


def head_commit(owner: str, name: str, token: str | None = None, get: Transport = http_get) -> str:
    try:
        return json.loads(get(f"https://api.github.com/repos/{owner}/{name}/commits/HEAD", _headers(token, "+json"))).get("sha", "")
    except Exception:  # the commit is only a note on the index
        return ""


def read_github(spark: SparkSession, url: str, token: str | None = None, get: Transport = http_get, listed: dict[str, str] | None = None) -> DataFrame:
    """repo, file, content, blob: files are fetched by the executors, each time this is read; those that fail are left out.  listed: what list_tree() gave."""
    owner, name = parse_url(url)
    files = list_tree(owner, name, token, get) if listed is None else listed
    paths = spark.createDataFrame(list(files.items()) or [("", "")], "file string, blob string").filter("file <> ''")

    def fetch(batches):
        for pdf in batches:
            rows = []
            for file, blob in zip(pdf["file"], pdf["blob"]):
                try:
                    rows.append((file, get(f"https://api.github.com/repos/{owner}/{name}/contents/{urllib.parse.quote(file)}", _headers(token, ".raw")), blob))
                except Exception:
                    continue
            yield pd.DataFrame(rows, columns=["file", "content", "blob"])

    parts = max(1, min(len(files) // 20, 64))
    return paths.repartition(parts, "file").mapInPandas(fetch, "file string, content binary, blob string").select(F.lit(f"{owner}/{name}").alias("repo"), "file", "content", "blob")
