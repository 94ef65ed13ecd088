"""Numbered commit files: small JSON objects, each created only if it is absent."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


def unique() -> str:
    return uuid.uuid4().hex


def filesystem(spark: SparkSession, path: str) -> tuple:
    """The file system of a path and the path as it knows it."""
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, here.makeQualified(fs.getUri(), fs.getWorkingDirectory())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    fs, here = filesystem(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(here)) if fs.exists(here) else []


def path_of(folder: str, number: int) -> str:
    return f"{folder}/{number:020d}.json"


def read(spark: SparkSession, folder: str, number: int) -> dict:
    fs, here = filesystem(spark, path_of(folder, number))
    stream = fs.open(here)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def newest(spark: SparkSession, folder: str) -> dict | None:
    numbers = [int(n[:20]) for n in names_in(spark, folder) if n.endswith(".json") and n[:20].isdigit()]
    return read(spark, folder, max(numbers)) if numbers else None


def create(spark: SparkSession, folder: str, number: int, entry: dict) -> bool:
    """Creates a commit file whole, or says that there is one: by a link on a local disk, else by a rename that does not replace."""
    path = path_of(folder, number)
    fs, here = filesystem(spark, path)
    jvm = spark._jvm
    temporary = jvm.org.apache.hadoop.fs.Path(f"{path}.{unique()}")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    if fs.getScheme() == "file":
        try:
            os.link(f"{here.getParent().toUri().getPath()}/{temporary.getName()}", here.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(temporary, False)
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    none = spark.sparkContext._gateway.new_array(kind, 1)
    none[0] = kind.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(here.toUri(), spark._jsc.hadoopConfiguration()).rename(temporary, here, none)
        return True
    except Exception as e:
        fs.delete(temporary, False)
        if "FileAlreadyExists" not in str(e):
            raise
        return False
