"""Numbered commits of a directory: one JSON file each, through Hadoop's file systems.

A commit is written beside its place and moved there by a rename that fails if the place is taken, so of two writers of one number
one succeeds and the other gets `Conflict`, and a writer that ends in between leaves a file that no reader sees.
Stores whose rename is not atomic (some object stores) need one writer at a time.
"""

from __future__ import annotations

import json
import re
import threading
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Local file systems look for the target before they rename; this makes it one step among the threads of a driver.
_one_step = threading.Lock()


class Conflict(RuntimeError):
    """Another writer has made the commit of this number."""


def filesystem(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def listed(spark: SparkSession, path: str) -> dict[str, int]:
    """Names in a directory, with the time of their last change in seconds; empty if it is not there."""
    fs, at = filesystem(spark, path)
    return {s.getPath().getName(): s.getModificationTime() // 1000 for s in fs.listStatus(at)} if fs.exists(at) else {}


def remove(spark: SparkSession, path: str) -> None:
    fs, at = filesystem(spark, path)
    fs.delete(at, True)


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The finished commits, ascending."""
    return sorted(int(found[1]) for name in listed(spark, f"{root}/commits") if (found := re.fullmatch(r"(\d+)\.json", name)))


def read(spark: SparkSession, root: str, n: int) -> dict:
    fs, at = filesystem(spark, f"{root}/commits/{n}.json")
    stream = fs.open(at)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write(spark: SparkSession, root: str, n: int, state: dict) -> None:
    """Makes commit n, or raises Conflict if there is one."""
    jvm = spark.sparkContext._jvm
    fs, place = filesystem(spark, f"{root}/commits/{n}.json")
    beside = jvm.org.apache.hadoop.fs.Path(f"{root}/commits/.{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    try:
        out.write(bytearray(json.dumps(state).encode()))
    finally:
        out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    never_over = spark.sparkContext._gateway.new_array(kind, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        with _one_step:
            context.rename(fs.makeQualified(beside), fs.makeQualified(place), never_over)
    except Py4JJavaError as error:
        fs.delete(beside, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            raise Conflict(f"commit {n} of {root}") from error
        raise
