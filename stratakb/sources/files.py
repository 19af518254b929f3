"""A file tree as a table, through Spark's binary-file reader."""

from __future__ import annotations

import fnmatch
import re
import subprocess

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import is_minified
from .languages import detect

MAX_FILE = 8 * 1024 * 1024
# Directories of generated or foreign files; the last one is our own.
SKIPPED = "node_modules vendor target dist build .git __pycache__ .venv venv .mypy_cache .pytest_cache .ruff_cache .tox Pods .gradle .next .nuxt .svelte-kit bower_components coverage .terraform .stratakb".split()


def ignore_pattern(line: str) -> tuple[re.Pattern, bool] | None:
    """A line of an ignore file as (pattern over the path from the ignore file's folder, whether it takes back)."""
    line = line.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[back:].removeprefix("\\")
    rooted = "/" in line.rstrip("/")
    folder = line.endswith("/")
    parts = []
    for part in line.strip("/").split("/"):
        parts.append("(?:.*)" if part == "**" else fnmatch.translate(part).replace("(?s:", "").replace(r")\Z", "").replace(r")\z", "").replace(".*", "[^/]*"))
    body = "/".join(parts).replace("(?:.*)/", "(?:.*/)?")
    return re.compile(f"{'' if rooted else '(?:.*/)?'}{body}{'/.*' if folder else '(?:/.*)?'}", re.S), back


def ignored(path: str, lines: list[str]) -> bool:
    """By an ignore file at the root: the last line that fits decides."""
    out = False
    for line in lines:
        if (p := ignore_pattern(line)) and p[0].fullmatch(path):
            out = not p[1]
    return out


def walkable(path: Column, size: Column) -> Column:
    skip = "|".join(re.escape(s) for s in SKIPPED)
    return ~path.rlike(rf"(?:^|/)(?:{skip})/") & ~is_minified(path) & (size <= MAX_FILE)


def scan(spark: SparkSession, root: str, *, ignore: list[str] | None = None, exclude: str | None = None, overrides: dict[str, str] | None = None, content: bool = True) -> DataFrame:
    """(path, mtime_ns, size, lang, content) below root, paths with / and relative to it. Hidden files count; content is read only if asked for."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = F.lit(re.sub(r"^[a-z]+:/*", "/", root.rstrip("/")) + "/")
    full = F.regexp_replace("path", "^[a-z]+:/*", "/")
    rel = F.translate(F.expr("substring_index(full, prefix, -1)"), "\\", "/")
    rows = raw.withColumns({"full": full, "prefix": prefix}).withColumn("rel", rel)
    rows = rows.where(walkable(F.col("rel"), F.col("length")))
    if exclude:
        rows = rows.where(~F.col("rel").startswith(exclude.rstrip("/") + "/"))
    if ignore:
        drop = F.pandas_udf(lambda paths: pd.Series([ignored(p, ignore) for p in paths]), "boolean")
        rows = rows.where(~drop(F.col("rel")))
    cols = [F.col("rel").alias("path"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"), detect(F.col("rel"), overrides).alias("lang")]
    return rows.select(*cols, *[F.col("content")] * content)


def git_status_paths(output: str) -> list[str]:
    """Changed paths of `git status --porcelain -z`: each record from its fourth character, sorted, once."""
    return sorted({r[3:] for r in output.split("\0") if len(r) > 3})


def _git(root: str, *args: str) -> str:
    try:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True, timeout=60).stdout
    except (OSError, subprocess.SubprocessError):
        return ""


def changed_files(spark: SparkSession, root: str) -> DataFrame:
    """(file) of a working tree's changes; none if git fails."""
    return spark.createDataFrame([(p,) for p in git_status_paths(_git(root, "status", "--porcelain", "-z", "--untracked-files=all"))], "file string")


def branch(root: str) -> str | None:
    return _git(root, "rev-parse", "--abbrev-ref", "HEAD").strip() or None


def origin(root: str) -> str | None:
    return _git(root, "remote", "get-url", "origin").strip() or None
