"""A local documentation tree as a table: the files that may be indexed, with their bytes.

Spark's own listing passes hidden and underscored names over.  The driver lists the folders near the root alone; from
there each folder is a task's, which lists and reads what is below, so executors have to see the same folder.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docsect.functions.safety import DOC_SUFFIXES, SKIP_FOLDERS, IgnoreRules

FILES_A_TASK, TASKS = 200, 32


class Tree:
    """A documentation tree and the rules by which it is walked: skipped, hidden and ignored folders are not entered."""

    def __init__(self, base: str, max_depth: int = 5, include_hidden: bool = False, follow_symlinks: bool = False, extra_ignore_patterns=None):
        root = Path(base)
        if not root.exists():
            raise ValueError(f"no such path: {base}")
        if not root.is_dir():
            raise ValueError(f"no folder: {base}")
        self.root, self.max_depth, self.include_hidden, self.follow_symlinks = root.resolve(), max_depth, include_hidden, follow_symlinks
        ignore = self.root / ".gitignore"
        self.rules = [IgnoreRules(ignore.read_text(errors="replace").splitlines())] if ignore.is_file() else []
        if extra_ignore_patterns:
            self.rules.append(IgnoreRules(extra_ignore_patterns))

    def _inside(self, path: Path) -> bool:
        return path.resolve().is_relative_to(self.root)

    def entries(self, folder: str, depth: int) -> tuple[list[str], list[str]]:
        """Files to index and folders to enter of one folder, all as paths from the root; depth: the folder's own."""
        files, folders = [], []
        if depth > self.max_depth:
            return files, folders
        try:
            found = sorted(os.scandir(self.root / folder), key=lambda e: e.name)
        except OSError:
            return files, folders
        for e in found:
            path, name = Path(e.path), f"{folder}/{e.name}" if folder else e.name
            if e.is_symlink() and (not self.follow_symlinks or not self._inside(path)):
                continue
            if e.is_dir():
                if not (e.name in SKIP_FOLDERS or (e.name.startswith(".") and not self.include_hidden) or any(r.match(name + "/") for r in self.rules)):
                    folders.append(name)
            elif e.is_file() and path.suffix.lower() in DOC_SUFFIXES and self._inside(path) and not any(r.match(name) for r in self.rules):
                files.append(name)
        return files, folders

    def walk(self, folder: str = "", depth: int = 0, seen: set | None = None) -> Iterator[str]:
        """The files below a folder, one after the other; a folder that links lead to twice is entered once."""
        seen = set() if seen is None else seen
        if (real := (self.root / folder).resolve()) in seen:
            return
        seen.add(real)
        files, folders = self.entries(folder, depth)
        yield from files
        for x in folders:
            yield from self.walk(x, depth + 1, seen)

    def parts(self, least: int) -> tuple[list[str], list[tuple[str, int]]]:
        """Files near the root, and folders, with their depths, whose files nobody has listed yet: least of them if the tree has as many."""
        files, level = [], [("", 0)]
        if self.follow_symlinks:  # only one walk can tell which folders it has been to
            return list(self.walk()), []
        while level and len(level) < least:
            found = [(depth, *self.entries(folder, depth)) for folder, depth in level]
            files += [x for _, mine, _ in found for x in mine]
            level = [(x, depth + 1) for depth, _, folders in found for x in folders]
        return files, level


def discover(base: str, max_depth: int = 5, include_hidden: bool = False, follow_symlinks: bool = False, extra_ignore_patterns=None) -> list[str]:
    """Relative paths of documentation files, sorted."""
    return sorted(Tree(base, max_depth, include_hidden, follow_symlinks, extra_ignore_patterns).walk())


def head_commit(base: str) -> str:
    """The commit a working copy stands at, or an empty string."""
    try:
        out = subprocess.run(["git", "-C", base, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5)
    except (OSError, subprocess.TimeoutExpired):
        return ""
    return out.stdout.strip() if out.returncode == 0 else ""


def repository_name(base: str) -> str:
    return f"local/{Path(base).resolve().name}"


class _Part(InputPartition):
    def __init__(self, files: list[str], folders: list[tuple[str, int]]):
        self.files, self.folders = files, folders


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def _tree(self) -> Tree:
        o = self.options
        flag = lambda k: o.get(k, "false").lower() == "true"
        return Tree(o["path"], int(o.get("maxdepth", "5")), flag("includehidden"), flag("followsymlinks"), [x for x in o.get("extraignorepatterns", "").split("\n") if x])

    def partitions(self):
        """Files near the root in lots, and one folder a task from where there are TASKS of them: tasks list what is below."""
        files, folders = self._tree().parts(TASKS)
        return [_Part(files[i : i + FILES_A_TASK], []) for i in range(0, len(files), FILES_A_TASK)] + [_Part([], [x]) for x in folders] or [_Part([], [])]

    def read(self, partition):
        tree = self._tree() if partition.folders else None
        for name in (*partition.files, *(x for folder, depth in partition.folders for x in tree.walk(folder, depth))):
            try:
                with open(os.path.join(self.options["path"], name), "rb") as f:
                    yield name, f.read()
            except OSError:
                continue


class LocalDocs(DataSource):
    """format("docs_local"): file, content.  Options: path, maxDepth, includeHidden, followSymlinks, extraIgnorePatterns (by line)."""

    @classmethod
    def name(cls):
        return "docs_local"

    def schema(self):
        return "file string, content binary"

    def reader(self, schema):
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_local(spark: SparkSession, base: str, max_depth: int = 5, include_hidden: bool = False, follow_symlinks: bool = False, extra_ignore_patterns=None) -> DataFrame:
    spark.dataSource.register(LocalDocs)
    reader = spark.read.format("docs_local").option("path", base).option("maxDepth", max_depth).option("includeHidden", include_hidden).option("followSymlinks", follow_symlinks)
    df = reader.option("extraIgnorePatterns", "\n".join(extra_ignore_patterns or [])).load()
    return df.select(F.lit(repository_name(base)).alias("repo"), "file", "content")
