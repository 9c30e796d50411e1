"""Source trees as tables. Spark's own file sources pass over names that begin with a dot, so a lister finds the paths and
the executors read them."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.sources.ignore import IgnoreRule, classify, configured, kind_of, parse_ignore_file

SCHEMA = "repo string, file_path string, is_script boolean, text string, mode int, size long, error string"


def walk(root: str, patterns: tuple[str, ...] = (), include_ignored: bool = False) -> tuple[list[str], list[tuple[str, str, str]]]:
    """Paths below a root in order, and what was left out as (path, source, pattern). Symbolic links are not followed."""
    found: list[str] = []
    skipped: list[tuple[str, str, str]] = []

    def visit(folder: str, rules: list[IgnoreRule]) -> None:
        at = os.path.join(root, folder) if folder else root
        ignore = os.path.join(at, ".gitignore")
        if os.path.isfile(ignore):
            with open(ignore, encoding="utf-8", errors="replace") as lines:
                rules = [*rules, *parse_ignore_file(lines.read(), folder)]
        for entry in sorted(os.scandir(at), key=lambda e: e.name):
            path = f"{folder}/{entry.name}" if folder else entry.name
            if entry.is_symlink():
                continue
            is_folder = entry.is_dir(follow_symlinks=False)
            hit = classify(path + "/x" if is_folder else path, rules, patterns)
            if hit and not include_ignored:
                skipped.append((path, *hit))
            elif is_folder:
                visit(path, rules)
            elif kind_of(path):
                found.append(path)

    visit("", [])
    return found, skipped


def inputs(root: str, paths: list[str], patterns: tuple[str, ...] = (), include_ignored: bool = False) -> tuple[list[str], list[tuple[str, str, str]], list[str]]:
    """(files, what was left out, inputs that do not exist) of several inputs below a root. A file that is named itself is
    left out by the configuration only; a folder is walked."""
    found: set[str] = set()
    skipped: dict[str, tuple[str, str, str]] = {}
    missing = []
    for given in paths or ["."]:
        at = os.path.join(root, given)
        shown = os.path.relpath(at, root).replace(os.sep, "/")
        if not os.path.exists(at):
            missing.append(given)
        elif os.path.isfile(at):
            hit = configured(patterns, shown)
            if hit:
                skipped[shown] = (shown, "config", hit)
            elif kind_of(shown):
                found.add(shown)
        else:
            files, left = walk(root, patterns, include_ignored)
            inside = (lambda p: True) if shown == "." else (lambda p: p == shown or p.startswith(f"{shown}/"))  # noqa: B023
            found |= {p for p in files if inside(p)}
            skipped |= {p[0]: p for p in left if inside(p[0])}
    return sorted(found), [skipped[p] for p in sorted(skipped)], missing


def ignored(path: str, root: str = ".", patterns: tuple[str, ...] = ()) -> tuple[str, str] | None:
    """(source, pattern) of what leaves a path out when its tree is walked; ignore files of all folders above it count."""
    rules: list[IgnoreRule] = []
    parts = path.split("/")
    for i in range(len(parts)):
        folder = "/".join(parts[:i])
        at = os.path.join(root, folder, ".gitignore")
        if os.path.isfile(at):
            with open(at, encoding="utf-8", errors="replace") as lines:
                rules += parse_ignore_file(lines.read(), folder)
    return classify(path, rules, patterns)


def files_of(spark: SparkSession, root: str, patterns: tuple[str, ...] = (), repo: str = ".", include_ignored: bool = False, paths: list[str] | None = None) -> DataFrame:
    """The files of a tree that all executors can read, one row each: text (null and an error if it cannot be read),
    mode and size. Only the list of paths is made on the driver; the texts are read by the tasks."""
    paths, _, _ = inputs(root, paths or ["."], patterns, include_ignored)
    listed = spark.createDataFrame([(p,) for p in paths], "file_path string")
    tasks = max(1, min(len(paths) // 64 + 1, spark.sparkContext.defaultParallelism * 4))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                at = os.path.join(root, path)
                try:
                    with open(at, encoding="utf-8") as f:
                        text, error = f.read(), None
                    stat = os.stat(at)
                    rows.append((repo, path, kind_of(path) == "script", text, stat.st_mode & 0o7777, stat.st_size, None))
                except (OSError, UnicodeDecodeError) as x:
                    error = str(x)[:200]
                    rows.append((repo, path, kind_of(path) == "script", None, None, None, error))
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return listed.repartition(tasks).mapInArrow(read, SCHEMA)


def text_as_files(documents: DataFrame, key: str = "doc_id", scope: str = "source") -> DataFrame:
    """Any table of texts as files, so that the rules run on it."""
    return documents.select(F.coalesce(scope, F.lit(".")).alias("repo"), F.concat(F.col(key).cast("string"), F.lit(".txt")).alias("file_path"), F.lit(False).alias("is_script"), "text", F.lit(None).cast("int").alias("mode"))
