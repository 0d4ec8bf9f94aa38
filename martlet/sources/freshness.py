"""Stored results that are used as long as their input has not changed.

A version of the results lies in a folder of its own. A pointer file names the current
one and the fingerprint of the input it was made from; it is replaced last, in one
step. A writer that dies leaves a folder that nothing points to, readers never see
half a result, and unchanged input starts no job.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

POINTER = "current.json"


def _path(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, inputs: Iterable[str]) -> str:
    """Digest of names, lengths and times of all files below the inputs. No file is opened."""
    files = []
    for name in inputs:
        path, system = _path(spark, name)
        found = system.listFiles(path, True)
        while found.hasNext():
            f = found.next()
            files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(files)).encode()).hexdigest()


def current(spark: SparkSession, root: str) -> dict[str, str] | None:
    """Folder and fingerprint of the current results, or None if there are none."""
    path, system = _path(spark, f"{root}/{POINTER}")
    if not system.exists(path):
        return None
    stream = system.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _point(spark: SparkSession, root: str, content: dict[str, str]) -> None:
    """Replace the pointer in one step."""
    fresh, system = _path(spark, f"{root}/.{POINTER}-{uuid.uuid4().hex}")
    stream = system.create(fresh)
    stream.write(json.dumps(content).encode())
    stream.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    option = getattr(jvm, "Options$Rename")
    overwrite = spark.sparkContext._gateway.new_array(option, 1)
    overwrite[0] = option.OVERWRITE
    context = jvm.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    target = jvm.Path(f"{root}/{POINTER}")
    context.rename(system.makeQualified(fresh), system.makeQualified(target), overwrite)


def refresh(spark: SparkSession, inputs: Iterable[str], root: str, write: Callable[[str], None]) -> str:
    """Folder of results that fit the inputs; ``write(folder)`` is called only if they have changed.

    The fingerprint is taken before the inputs are read: if they change meanwhile, the
    next call sees another one and writes again.
    """
    now = fingerprint(spark, inputs)
    known = current(spark, root)
    if known and known["fingerprint"] == now:
        return known["folder"]
    folder = f"{root}/version-{uuid.uuid4().hex}"
    write(folder)
    _point(spark, root, {"folder": folder, "fingerprint": now})
    return folder


def drop_old_versions(spark: SparkSession, root: str) -> list[str]:
    """Delete the versions that the pointer does not name. Call it when no one reads them or writes."""
    known = current(spark, root)
    path, system = _path(spark, root)
    dropped = []
    for status in system.listStatus(path) if system.exists(path) else []:
        name = status.getPath().getName()
        if name.startswith("version-") and not (known and known["folder"].endswith(name)):
            system.delete(status.getPath(), True)
            dropped.append(name)
    return dropped
