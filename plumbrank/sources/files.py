"""Small files of the driver, through the file system that Spark itself uses for a path.

Whatever scheme Spark can read and write works here too; without one a path is local.
"""

from __future__ import annotations

import os
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(path: str) -> tuple[Any, Any]:
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    where = spark._jvm.org.apache.hadoop.fs.Path(path if "://" in path else f"file://{os.path.abspath(path)}")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def is_dir(path: str) -> bool:
    fs, at = _at(path)
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def is_file(path: str) -> bool:
    fs, at = _at(path)
    return fs.exists(at) and fs.getFileStatus(at).isFile()


def names(path: str) -> list[str]:
    """What a folder holds, sorted, without what is hidden; nothing where there is no folder."""
    fs, at = _at(path)
    if not fs.exists(at):
        return []
    return sorted(x for x in (s.getPath().getName() for s in fs.listStatus(at)) if not x.startswith("."))


def make_dir(path: str) -> None:
    fs, at = _at(path)
    fs.mkdirs(at)


def remove(path: str) -> None:
    fs, at = _at(path)
    fs.delete(at, True)


def read(path: str) -> bytes:
    fs, at = _at(path)
    try:
        stream = fs.open(at)
    except Py4JJavaError as error:
        raise FileNotFoundError(f"{path}: {error.java_exception}") from None
    try:
        return bytes(SparkSession.getActiveSession()._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write(path: str, content: bytes) -> None:
    _put(path, content, True)


def _put(path: str, content: bytes, anew: bool) -> None:
    fs, at = _at(path)
    stream = fs.create(at, anew)
    stream.write(bytearray(content))
    stream.close()


def create(path: str, content: bytes) -> bool:
    """Write a file only if there is none of this name; says whether this call did.

    Exclusive creation is a promise of HDFS and of stores with conditional writes. The local file
    system of Hadoop looks before it writes, so there a whole file is linked to the name, which is exclusive.
    """
    fs, at = _at(path)
    if at.toUri().getScheme() in (None, "file") and fs.getScheme() == "file":
        local = at.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        scratch = os.path.join(os.path.dirname(local), f".{uuid.uuid4().hex}")
        with open(scratch, "wb") as f:
            f.write(content)
        try:
            os.link(scratch, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(scratch)
        return True
    if fs.exists(at):
        return False
    try:
        _put(path, content, False)
    except Py4JJavaError:
        if not fs.exists(at):
            raise
        return False
    return True
