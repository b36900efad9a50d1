"""A commit log beside a table: what is not named by the newest commit isn't read.

A writer puts its files under a new version first and commits last, by renaming one small file.  A run
that dies in between leaves the version before it readable; its files are removed by the
next commit.  One writer at a time; a second one that commits the same number fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing where there is none."""
    folder, files = _files(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(folder)) if files.exists(folder) else []


def remove(spark: SparkSession, path: str) -> None:
    folder, files = _files(spark, path)
    files.delete(folder, True)


def committed(spark: SparkSession, path: str) -> dict | None:
    """The newest commit, or None."""
    found = [int(n.removesuffix(".json")) for n in names(spark, f"{path}/commits") if n.endswith(".json")]
    if not found:
        return None
    return json.loads(spark.read.text(f"{path}/commits/{max(found)}.json", wholetext=True).first()[0]) | {"version": max(found)}


def commit(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """Makes ``version`` the newest; fails if it is there already."""
    waiting, files = _files(spark, f"{path}/commits/{uuid.uuid4().hex}.waiting")
    out = files.create(waiting)
    out.writeBytes(json.dumps(content))
    out.close()
    final = _files(spark, f"{path}/commits/{version}.json")[0]
    if files.exists(final) or not files.rename(waiting, final):
        files.delete(waiting, False)
        raise RuntimeError(f"version {version} of {path} has been committed by another writer")


def tidy(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Removes commits but the newest ``keep``, and versions of folders that none of these names."""
    found = sorted(int(n.removesuffix(".json")) for n in names(spark, f"{path}/commits") if n.endswith(".json"))
    for old in found[:-keep]:
        remove(spark, f"{path}/commits/{old}.json")
    kept = [json.loads(spark.read.text(f"{path}/commits/{v}.json", wholetext=True).first()[0]) for v in found[-keep:]]
    for table in [n for n in names(spark, path) if n != "commits"]:
        used = {int(v) for c in kept for v in c.get(table, {}).values()}
        for name in names(spark, f"{path}/{table}"):
            if name.startswith("version=") and int(name.split("=")[1]) not in used and int(name.split("=")[1]) <= found[-1]:
                remove(spark, f"{path}/{table}/{name}")
