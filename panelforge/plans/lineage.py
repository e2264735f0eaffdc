"""Cutting lineage, and folders every executor can reach."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent and Spark runs in one process (tests) is a temporary folder made; a cluster
    without the setting is an error, as its machines have no folder in common that we know of.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="panelforge-"))


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder for an intermediate table; it is deleted when this process ends."""
    path = f"{shared_folder(spark).rstrip('/')}/panelforge-{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def local_uri(spark: SparkSession, path: str) -> str:
    """``path`` as a Python worker opens it: with the scheme of its file system, or plain where that is the local one."""
    at, fs = _hadoop(spark, path)
    whole = fs.makeQualified(at).toString()
    return whole.removeprefix("file://").removeprefix("file:") if whole.startswith("file:") else whole


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _hadoop(spark, path)
    return fs.exists(at)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file in the shared folder: written beside its place, then renamed, so a reader sees all of it or none."""
    at, fs = _hadoop(spark, path)
    fresh = at.suffix(f".{uuid.uuid4().hex}.new")
    out = fs.create(fresh, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    if fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(fresh, at):
        raise OSError(f"can't write {path}")


def read_bytes(spark: SparkSession, path: str) -> bytes:
    at, fs = _hadoop(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder of the shared folder; none if there is no such folder."""
    at, fs = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def file_states(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of change of a file, or of the files in a folder."""
    at, fs = _hadoop(spark, path)
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at)))


@atexit.register
def _clean() -> None:
    """Deletes the tables of ``new_table_path``: through Spark where it still runs, else where the folder is a local one."""
    for spark, path in _MADE:
        try:
            if path.startswith(("/", "file:")):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
            elif spark.sparkContext._jsc is not None:
                at, fs = _hadoop(spark, path)
                fs.delete(at, True)
        except Exception:  # noqa: BLE001, S110  # the process ends anyway; what can't be deleted stays
            pass


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and written to reliable storage.

    What follows doesn't run the plan again, and the loss of an executor doesn't lose the rows.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
