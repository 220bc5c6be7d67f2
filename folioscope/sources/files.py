"""Small files and folders through Hadoop's file systems: any URI that Spark reads and writes."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import SparkSession


def _at(path: str) -> tuple[Any, Any, Any]:
    """(file system, path, JVM) of a URI or plain path."""
    spark = SparkSession.active()
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(str(path))
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target, jvm


def exists(path: str) -> bool:
    fs, target, _ = _at(path)
    return fs.exists(target)


def is_folder(path: str) -> bool:
    fs, target, _ = _at(path)
    return fs.exists(target) and fs.getFileStatus(target).isDirectory()


def is_file(path: str) -> bool:
    fs, target, _ = _at(path)
    return fs.exists(target) and fs.getFileStatus(target).isFile()


def folders(path: str) -> list[str]:
    """Names of the folders directly in a folder."""
    fs, target, _ = _at(path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory()) if fs.exists(target) else []


def remove(path: str) -> None:
    fs, target, _ = _at(path)
    fs.delete(target, True)


def read_text(path: str) -> str:
    fs, target, jvm = _at(path)
    stream = fs.open(target)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """A small file, complete or not there at all: written beside its place, then renamed."""
    fs, target, jvm = _at(path)
    part = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        fs.delete(part, False)
        raise OSError(f"{path} could not be written")


def move(source: str, target: str) -> None:
    """A file or folder to a place, whatever stood there."""
    fs, old, _ = _at(source)
    _, new, _ = _at(target)
    fs.delete(new, True)
    if not fs.rename(old, new):
        raise OSError(f"{source} could not be moved to {target}")


def copy(source: str, target: str) -> None:
    """A file beside its new place, then renamed; a file onto itself does nothing."""
    fs, old, jvm = _at(source)
    other, new, _ = _at(target)
    if fs.makeQualified(old).equals(other.makeQualified(new)):
        return
    part = jvm.org.apache.hadoop.fs.Path(new.getParent(), f".{new.getName()}.{uuid.uuid4().hex}")
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, old, other, part, False, other.getConf())
    other.delete(new, True)
    other.rename(part, new)
