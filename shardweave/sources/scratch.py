"""Folders for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session.

    Where the setting is absent a local session gets a folder of its own; a cluster
    session is an error, because a machine-local folder would be lost with its machine.
    """
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="shardweave-")
    return _local[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"



def folder_of(spark: SparkSession, path: str):
    """A path of any file system that Spark writes, and that file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def save_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> bool:
    """A small file that appears whole: it is written beside and renamed.  False if it is there and not to be replaced."""
    draft, system = folder_of(spark, f"{path}.draft")
    final, _ = folder_of(spark, path)
    if system.exists(final) and not replace:
        return False
    stream = system.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if replace:
        system.delete(final, False)
    return system.rename(draft, final)


def last_text(spark: SparkSession, folder: str, ending: str) -> str | None:
    """The text of the last file by name in a folder; None if there is none."""
    path, system = folder_of(spark, folder)
    found = [e.getPath() for e in system.listStatus(path)] if system.exists(path) else []
    found = [p for p in found if p.getName().endswith(ending)]
    if not found:
        return None
    stream = system.open(max(found, key=lambda p: p.getName()))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
