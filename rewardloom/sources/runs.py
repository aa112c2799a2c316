"""Writes that can be repeated: a folder per attempt, and a manifest per run that readers obey.

A run is named by its caller (a step range, an epoch, a job id). Its rows go to a folder of this attempt; then one small
file, ``_runs/<name>``, is put in place by an atomic rename and says which folder holds the run. A writer that fails
leaves a folder that no manifest names; a run that is written again is read from its last complete attempt. A manifest
may also say which runs it replaces, so that many small runs can become one in a single step; what it replaces stays
replaced when one of these is written again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_runs"


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def write_run(df: DataFrame, path: str, run: str, save: Callable[[DataFrame, str], None], replaces: list[str] | None = None) -> None:
    """Save ``df`` as the run's rows and commit it, in place of an earlier attempt of the same run."""
    spark = df.sparkSession
    name = quote(run, safe="")
    if not name or name.startswith((".", "_")):
        raise ValueError(f"a run cannot be named {run!r}")
    attempt = f"attempt={name}-{uuid.uuid4().hex}"  # partitions of the table, for readers with ``basePath``
    save(df, f"{path}/{attempt}")
    text = json.dumps({"folder": attempt, "replaces": sorted(replaces or [])})
    draft, fs = _path(spark, f"{path}/{MANIFESTS}/.{attempt}")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    overwrite = gateway.new_array(kind, 1)
    overwrite[0] = kind.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    files.rename(draft, _path(spark, f"{path}/{MANIFESTS}/{name}")[0], overwrite)


def manifests(spark: SparkSession, path: str) -> dict[str, dict] | None:
    """The manifest of every run by its quoted name; None where the folder was not written by ``write_run``."""
    folder, fs = _path(spark, f"{path}/{MANIFESTS}")
    if not fs.exists(folder):
        return None
    found = {}
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if not name.startswith("."):
            stream = fs.open(status.getPath())
            try:
                found[name] = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
    return found


def committed(spark: SparkSession, path: str) -> list[str] | None:
    """Folders of the committed runs in order of their names; None for a plain folder."""
    found = manifests(spark, path)
    if found is None:
        return None
    gone = {quote(run, safe="") for m in found.values() for run in m["replaces"]}
    return [f"{path}/{found[name]['folder']}" for name in sorted(found) if name not in gone]


def read_runs(spark: SparkSession, path: str, load: Callable[[list[str]], DataFrame], schema: str) -> DataFrame:
    """The rows of all committed runs; a plain folder, as others write it, is read as it is."""
    folders = committed(spark, path)
    if folders is None:
        return load([path])
    return load(folders) if folders else spark.createDataFrame([], schema)


def merge_runs(spark: SparkSession, path: str, run: str, load: Callable[[list[str]], DataFrame], save: Callable[[DataFrame, str], None]) -> None:
    """Make one run of all that are committed. Names of replaced runs are kept, so that a late repeat changes nothing."""
    found = manifests(spark, path) or {}
    gone = {old for m in found.values() for old in m["replaces"]}
    folders = committed(spark, path)
    if folders:
        from urllib.parse import unquote

        names = gone | {unquote(name) for name in found}
        write_run(load(folders), path, run, save, replaces=sorted(names - {run}))


def remove_leftovers(spark: SparkSession, path: str) -> int:
    """Delete the folders that no manifest names, while no writer is at work; their number."""
    kept = set(committed(spark, path) or [])
    root, fs = _path(spark, path)
    removed = 0
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if status.isDirectory() and name != MANIFESTS and f"{path}/{name}" not in kept:
            fs.delete(status.getPath(), True)
            removed += 1
    return removed
