"""Shared scratch storage: where lineage is cut and intermediate tables live.

A cluster names its shared folder in ``spark.checkpoint.dir``; that folder is read from the
session. Only where it is unset (local tests) a folder of our own is made. Tables are Parquet,
so they are columnar, compressed and survive the loss of any executor.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MADE: set[str] = set()


def root(spark: SparkSession) -> str:
    """Folder of this application below the shared checkpoint folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/driftline-{spark.sparkContext.applicationId}"
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="driftline-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return f"file://{_LOCAL['dir']}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    folder = root(spark)
    if folder not in _MADE:  # gone with the application, as nothing else reads it
        _MADE.add(folder)
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._driftline_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete a table written by :func:`table` once nothing reads it any more."""
    path = getattr(df, "_driftline_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def move(spark: SparkSession, src: str, dst: str) -> None:
    """Swap a finished folder into place."""
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(src), jvm.org.apache.hadoop.fs.Path(dst)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(b, True)
    if not fs.rename(a, b):
        raise OSError(f"cannot move {src} to {dst}")


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written beside its place, then renamed."""
    jvm = spark.sparkContext._jvm
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, jvm.org.apache.hadoop.fs.Path(path)):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    got = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(got.readAllBytes()).decode()
    finally:
        got.close()


def local(path: str) -> str:
    return path[7:] if path.startswith("file://") else os.fspath(path)
