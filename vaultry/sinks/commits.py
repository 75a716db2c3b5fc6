"""Versions of a folder: data is staged beside what is there and becomes visible by the name of one small file.

``<folder>/_versions/<number>.json`` holds what belongs to a version.  The file is written under another name and renamed; the rename fails where the
number is taken, so of two writers one is told.  Readers take the highest number.  Data of earlier versions stays: it is the backup.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer published this version first."""


def _context(spark: SparkSession, folder: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    conf = spark._jsc.hadoopConfiguration()
    qualified = path.getFileSystem(conf).makeQualified(path)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), conf), qualified


def _name(number: int) -> str:
    return f"_versions/{number:012d}.json"


def _numbers(context, path, jvm) -> list[int]:
    folder = jvm.org.apache.hadoop.fs.Path(path, "_versions")
    if not context.util().exists(folder):
        return []
    names = (s.getPath().getName() for s in context.util().listStatus(folder))
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:12].isdigit())


def _read(context, path, jvm, number: int) -> dict:
    stream = context.open(jvm.org.apache.hadoop.fs.Path(path, _name(number)))
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def current(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """Number and content of the latest version; 0 and nothing where there is none."""
    context, path = _context(spark, folder)
    numbers = _numbers(context, path, spark._jvm)
    return (numbers[-1], _read(context, path, spark._jvm, numbers[-1])) if numbers else (0, {})


def at(spark: SparkSession, folder: str, number: int) -> dict:
    """Content of a version: an earlier one is a backup."""
    context, path = _context(spark, folder)
    return _read(context, path, spark._jvm, number)


def staged(folder: str) -> str:
    """A new data folder below ``folder``; nothing refers to it until a version does."""
    return f"{folder.rstrip('/')}/data-{uuid.uuid4().hex}"


def publish(spark: SparkSession, folder: str, number: int, content: dict) -> int:
    """Make ``content`` version ``number``; raises :class:`Conflict` where that number exists.

    ``content`` is a small dictionary of names and totals, never rows.
    """
    jvm = spark._jvm
    context, path = _context(spark, folder)
    fs_path = jvm.org.apache.hadoop.fs.Path
    target, partial = fs_path(path, _name(number)), fs_path(path, f"_versions/.{uuid.uuid4().hex}.partial")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target.getParent())
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(partial, True)
    try:
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        stream.close()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(partial, target, none)  # without the option to overwrite it fails on a taken name
    except Exception as error:
        context.delete(partial, False)
        if context.util().exists(target):
            raise Conflict(f"version {number} of {folder} is there already") from error
        raise
    return number


def once(spark: SparkSession, folder: str, operation: str, write, tries: int = 10) -> int:
    """Run ``write(previous content) -> content`` and publish what it returns, unless a version of ``operation`` is there.

    So a driver that starts again after it published does nothing, and one that died before stages anew.  After a conflict the
    work is repeated on the version that won.
    """
    for _ in range(tries):
        number, content = current(spark, folder)
        if operation in content.get("operations", []):
            return number
        # names of the last operations are enough for a repeated driver
        done = [*content.get("operations", []), operation][-1000:]
        new = write({k: v for k, v in content.items() if k != "operations"})
        try:
            return publish(spark, folder, number + 1, new | {"operations": done})
        except Conflict:
            continue
    raise Conflict(f"{folder} was changed by others {tries} times in a row")
