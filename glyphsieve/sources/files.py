"""Tables (file, text) from folders, from Parquet, and from git."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterable, Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.functions import globs
from glyphsieve.functions.globs import normalized, to_posix
from glyphsieve.plans.planner import DEFAULT_IGNORE

FILES = "file string, text string"
GIT_BYTES = 64 << 20


class GitError(RuntimeError):
    """git failed."""


def decoded(content: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def relative(path: Column, root: str) -> Column:
    """Paths below the root, with forward slashes."""
    below = root.split("://", 1)[1] if "://" in root else to_posix(os.path.abspath(root))
    head = "^(?:[a-z][a-z0-9+.-]*:)?/*" + re.escape(below.strip("/")) + "/"
    return F.regexp_replace(F.url_decode(F.replace(F.replace(path, F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B"))), head, "")


def walked(root: str, ignore: Iterable[str] = DEFAULT_IGNORE) -> list[str]:
    """Paths of the files below a folder of this machine. Folders that are ignored whole are never entered, links to folders neither."""
    skip = [globs.for_python(globs.to_regex(p, dots=True)) for p in ignore]
    found, todo = [], [""]
    while todo:
        at = todo.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, at)), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            name = f"{at}/{e.name}" if at else e.name
            if e.is_dir(follow_symlinks=False):
                # no name below it can be wanted if one that nobody names isn't
                if not any(s.search(f"{name}/\1") for s in skip):
                    todo.append(name)
            elif not os.path.isdir(e.path) and not any(s.search(name) for s in skip):
                found.append(name)
    return sorted(found)


def _open(batches: Iterator[pa.RecordBatch], root: str, content: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name in b.column("file").to_pylist():
            text = error = None
            try:
                with open(os.path.join(root, name), "rb") as f:
                    text = f.read().decode("utf-8", "replace") if content else ""
            except (FileNotFoundError, IsADirectoryError):
                continue
            except OSError as cause:
                error = cause.strerror or str(cause)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([text], pa.string()), pa.array([error], pa.string())], ["file", "text", "error"])


def read_files(spark: SparkSession, root: str, names: Iterable[str], content: bool = True) -> DataFrame:
    """(file, text, error) of files below a folder that all executors see: a file that can't be read has an error and no
    text, one that isn't there any more, or is a folder, has no row."""
    names = [(normalized(n),) for n in names]
    parts = max(1, min(len(names), 4 * spark.sparkContext.defaultParallelism))
    listed = spark.createDataFrame(names, "file string").repartition(parts)
    return listed.mapInArrow(lambda batches: _open(batches, root, content), "file string, text string, error string")


def folder(spark: SparkSession, root: str, pattern: str | None = None, ignore: Iterable[str] = DEFAULT_IGNORE) -> DataFrame:
    """(file, text) of the files below a folder. On this machine's disk, or one that is mounted everywhere, ignored folders are
    never entered and files that can't be read are left out (``unreadable`` names them). A folder with a scheme is read by
    Spark, on any storage that it knows; files that vanish or break are left out."""
    if "://" not in root:
        names = [n for n in walked(root, ignore) if pattern is None or fnmatch(n.rsplit("/", 1)[-1], pattern)]
        return read_files(spark, os.path.abspath(root), names).filter("error is null").select("file", "text")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root).select(relative(F.col("path"), root).alias("file"), decoded(F.col("content")).alias("text"))


def unreadable(spark: SparkSession, root: str, ignore: Iterable[str] = DEFAULT_IGNORE) -> DataFrame:
    """(file, error) of the files below a folder of this machine that can't be opened."""
    return read_files(spark, os.path.abspath(root), walked(root, ignore), content=False).filter("error is not null").select("file", "error")


def table(df: DataFrame, file: str | Column, text: str = "text") -> DataFrame:
    """(file, text) of any table; file is a column or its name."""
    return df.select((F.col(file) if isinstance(file, str) else file).alias("file"), F.col(text).alias("text"))


def _git(cwd: str, *args: str) -> bytes:
    try:
        done = subprocess.run(["git", *args], cwd=cwd, capture_output=True, check=False)
    except OSError as cause:
        raise GitError(f"git can't be run: {cause}") from cause
    if done.returncode:
        raise GitError(f"git {args[0]}: {done.stderr.decode('utf-8', 'replace').strip()}")
    if len(done.stdout) > GIT_BYTES:
        raise GitError(f"git {args[0]} wrote more than {GIT_BYTES} bytes")
    return done.stdout


def repo_root(cwd: str) -> str:
    return os.path.realpath(_git(cwd, "rev-parse", "--show-toplevel").decode().rstrip("\n"))


def _names(cwd: str, *args: str) -> list[str]:
    return [x.decode("utf-8", "replace") for x in _git(cwd, "diff", *args, "--name-only", "-z").split(b"\0") if x]


def staged_files(cwd: str) -> list[str]:
    return _names(cwd, "--cached", "--diff-filter=ACMR")


def dirty_files(cwd: str) -> list[str]:
    """Files whose working copy isn't what is staged."""
    return _names(cwd)


def staged_content(cwd: str, path: str) -> str:
    return _git(cwd, "show", f":{path}").decode("utf-8", "replace")


def staged(spark: SparkSession, cwd: str) -> DataFrame:
    """(file, text) of what is staged, text as it is in the index."""
    root = repo_root(cwd)
    return spark.createDataFrame([(p, staged_content(root, p)) for p in staged_files(root)], FILES)


def stage(cwd: str, paths: list[str]) -> None:
    if paths:
        _git(cwd, "add", "--", *paths)


def comment_char(cwd: str, message: str) -> str:
    """git's comment sign; "auto" is found at the scissors line."""
    try:
        sign = _git(cwd, "config", "core.commentChar").decode().strip()
    except GitError:
        return "#"
    if sign != "auto":
        return sign or "#"
    m = re.search(r"^(\S) -{4,} >8 -{4,}", message, re.M)
    return m[1] if m else "#"
