"""The ten tools over an index store.  Results are plain dictionaries; errors are returned, not raised."""

from __future__ import annotations

import functools
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsect.operators import navigate as N
from docsect.operators.prepare import prepare
from docsect.operators.summarize import Parser, default_client, model_name
from docsect.plans.store import IndexStore
from docsect.sources import github, local


def _told(f):
    @functools.wraps(f)
    def run(*a, **b):
        try:
            return f(*a, **b)
        except Exception as e:
            return {"error": str(e)}

    return run


def local_only() -> bool:
    return os.environ.get("DOCSECT_LOCAL_ONLY", "").lower() in ("true", "1", "yes")


#: Answers that clients know (fixed values).
NOTHING = "No documentation files found"
#: Files that the answer of an index run names (fixed value).
SHOWN = 20


class Tools:
    """spark, base: where indexes are kept.  ask: a summarizer for index tools, prompt to answer; calls_a_second: of all its tasks together."""

    def __init__(self, spark: SparkSession, base: str, ask=None, get=github.http_get, calls_a_second: float | None = None):
        self.spark, self.store, self.ask, self.get, self.calls_a_second = spark, IndexStore(spark, base), ask, get, calls_a_second

    # --- indexing ---

    def _parser(self, use_ai: bool) -> Parser:
        ask = (self.ask or default_client()) if use_ai and not local_only() else None
        return Parser(ask, "given" if self.ask else model_name(), self.calls_a_second)

    def _index(self, repo: str, raw: DataFrame, commit: str, use_ai: bool, incremental: bool) -> dict:
        files, parse = prepare(raw), self._parser(use_ai)
        meta = self.store.update(repo, files, parse, commit) if incremental else None
        meta = meta or self.store.save(repo, files, parse, commit)
        names = [r["file"] for r in self.store.files(repo).select("file").orderBy("file").limit(SHOWN).collect()]
        bad = [r["file"] for r in self.store.files(repo).filter("content is null").select("file").orderBy("file").collect()]
        out = {"success": True, "repo": repo, "indexed_at": meta["indexed_at"], "file_count": meta["file_count"], "section_count": meta["section_count"], "files": names, "commit_hash": commit}
        return out | ({"skipped_secrets": bad} if bad else {})

    def index_local(self, path: str, use_ai_summaries: bool = True, max_depth: int = 5, include_hidden: bool = False, follow_symlinks: bool = False, extra_ignore_patterns=None, incremental: bool = False) -> dict:
        try:
            base = str(Path(path).expanduser().resolve())
            if not any(local.Tree(base, max_depth, include_hidden, follow_symlinks, extra_ignore_patterns).walk()):
                return {"success": False, "error": NOTHING}
            raw = local.read_local(self.spark, base, max_depth, include_hidden, follow_symlinks, extra_ignore_patterns)
            return self._index(local.repository_name(base), raw, local.head_commit(base), use_ai_summaries, incremental)
        except Exception as e:
            return {"success": False, "error": str(e)}

    def index_repo(self, url: str, use_ai_summaries: bool = True, github_token: str | None = None, incremental: bool = False) -> dict:
        if local_only():
            return {"success": False, "error": "Remote indexing is disabled in local-only mode"}
        try:
            owner, name = github.parse_url(url)
            token = github_token or os.environ.get("GITHUB_TOKEN")
            listed = github.list_tree(owner, name, token, self.get, self.spark)
            if not listed:
                return {"success": False, "error": NOTHING}
            return self._index(f"{owner}/{name}", github.read_github(self.spark, url, token, self.get, listed), github.head_commit(owner, name, token, self.get), use_ai_summaries, incremental)
        except Exception as e:
            return {"success": False, "error": str(e)}

    # --- reading ---

    def _open(self, repo: str) -> tuple[str, dict]:
        if "/" not in repo:
            repo = next((x["repo"] for x in self.store.list() if x["repo"].endswith("/" + repo)), repo)
        meta = self.store.meta(repo) if "/" in repo else None
        if not meta:
            raise LookupError(f"Repository not found: {repo}")
        return repo, {k: meta[k] for k in ("index_version", "indexed_at", "commit_hash")}

    @_told
    def list_repos(self) -> dict:
        found = self.store.list()
        return {"count": len(found), "repos": found}

    @_told
    def get_toc(self, repo: str, include_summaries: bool = True, path_prefix: str | None = None, max_depth: int | None = None, file_pattern: str | None = None) -> dict:
        repo, meta = self._open(repo)
        rows = N.toc(N.filter_sections(self.store.sections(repo), path_prefix, max_depth, file_pattern), include_summaries).orderBy("file", "seq").drop("repo", "seq").collect()
        files = [r["file"] for r in self.store.files(repo).select("file").orderBy("file").collect()]
        return {"repo": repo, "indexed_at": meta["indexed_at"], "files": files, "section_count": len(rows), "sections": [{k: v for k, v in r.asDict().items() if v is not None} for r in rows], "_meta": meta}

    @staticmethod
    def _tree(sections: DataFrame, columns: list[str]) -> list[dict]:
        """Trees are made by file where the sections are; the driver gets one file after the other."""
        return [root for r in N.nested(sections, columns).orderBy("file").toLocalIterator() for root in json.loads(r["tree"])]

    @_told
    def get_toc_tree(self, repo: str) -> dict:
        repo, meta = self._open(repo)
        return {"repo": repo, "tree": self._tree(self.store.sections(repo), ["id", "title", "depth", "file", "summary"]), "_meta": meta}

    @_told
    def get_document_outline(self, repo: str, file_path: str) -> dict:
        repo, meta = self._open(repo)
        found = self.store.sections(repo).filter(F.col("file") == file_path)
        tree = self._tree(found, ["id", "title", "depth", "path", "summary", "keywords", "line_count", "byte_length"])
        if not tree:
            return {"error": f"File not found: {file_path}"}
        return {"repo": repo, "file": file_path, "tree": tree, "_meta": meta}

    def _fetch(self, repo: str, ids: list[str]) -> list[dict]:
        return [r.asDict() for r in self.store.fetch(repo, ids).orderBy("pos").collect()]

    _SECTION = ("id", "file", "path", "title", "depth", "parent", "summary", "keywords", "line_count", "content")

    @_told
    def get_section(self, repo: str, section_id: str) -> dict:
        repo, meta = self._open(repo)
        row = self._fetch(repo, [section_id])[0]
        return {"error": row["error"]} if row["error"] else {k: row[k] for k in self._SECTION} | {"_meta": meta}

    @_told
    def get_sections(self, repo: str, section_ids: list[str]) -> dict:
        repo, meta = self._open(repo)
        rows = self._fetch(repo, section_ids) if section_ids else []
        errors = [{"id": r["id"], "error": r["error"]} for r in rows if r["error"]]
        good = [{k: r[k] for k in self._SECTION} | {"_meta": meta} for r in rows if not r["error"]]
        return {"repo": repo, "sections": good, "errors": errors or None}

    @_told
    def search_sections(self, repo: str, query: str, max_results: int = 10, path_prefix: str | None = None, max_depth: int | None = None, file_pattern: str | None = None) -> dict:
        repo, meta = self._open(repo)
        rows = self.store.search(repo, query, max_results, path_prefix=path_prefix, max_depth=max_depth, file_pattern=file_pattern).drop("seq", "repo").collect()
        return {"repo": repo, "query": query, "result_count": len(rows), "results": [r.asDict() for r in rows], "_meta": meta}

    @_told
    def delete_index(self, repo: str) -> dict:
        if "/" not in repo:
            repo = next((x["repo"] for x in self.store.list() if x["repo"].endswith("/" + repo)), repo)
        gone = self.store.delete(repo) if "/" in repo else False
        return {"success": gone, "repo": repo} if gone else {"success": False, "error": f"Repository not found: {repo}"}
