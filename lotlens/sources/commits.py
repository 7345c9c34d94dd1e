"""Versions of a folder's content: numbered commits, each one small file that appears at once or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{path}/_commits")
    return hadoop, folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def commit_numbers(spark: SparkSession, path: str) -> list[int]:
    """The commits that are there, oldest first."""
    _, fs, folder = _folder(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n) for n in names if n.isdigit())


def commit(spark: SparkSession, path: str, content: str, after: int) -> int:
    """Make ``content`` the commit that follows number ``after`` (0: the first); an error if another writer has made that one.

    The content is written beside the commits and put in its place by one rename: a failure before that changes nothing.
    """
    hadoop, fs, folder = _folder(spark, path)
    fs.mkdirs(folder)
    fresh, place = hadoop.Path(folder, f"_{uuid.uuid4().hex}"), hadoop.Path(folder, str(after + 1))
    out = fs.create(fresh, True)
    out.write(content.encode())
    out.close()
    if fs.exists(place) or not fs.rename(fresh, place):
        fs.delete(fresh, False)
        raise RuntimeError(f"{path} has a commit {after + 1} already: another writer was first")
    return after + 1


def committed(spark: SparkSession, path: str, number: int | None = None) -> str:
    """The content of a commit, by default the last one."""
    numbers = commit_numbers(spark, path)
    number = (numbers[-1] if numbers else None) if number is None else number
    if number not in numbers:
        raise LookupError(f"{path} has no commit {number}" if number else f"{path} has no commits")
    return spark.read.format("binaryFile").load(f"{path}/_commits/{number}").select(F.col("content").cast("string")).first()[0]


def forget(spark: SparkSession, path: str, keep: int, used, prefix: str = "v-", minutes: float = 60) -> list[str]:
    """Delete all but the last ``keep`` commits, and the version folders that no commit left uses; returns the folders' names.

    used: the folder names in a commit's content. Folders younger than so many minutes stay: their writer may be about to commit.
    """
    hadoop, fs, folder = _folder(spark, path)
    numbers = commit_numbers(spark, path)
    left = {name for n in numbers[-keep:] for name in used(committed(spark, path, n))}
    for n in numbers[:-keep]:
        fs.delete(hadoop.Path(folder, str(n)), False)
    now, gone = spark._jvm.java.lang.System.currentTimeMillis(), []
    for f in fs.listStatus(hadoop.Path(path)):
        name = f.getPath().getName()
        if name.startswith(prefix) and name not in left and now - f.getModificationTime() >= minutes * 60_000:
            fs.delete(f.getPath(), True)
            gone.append(name)
    return sorted(gone)
