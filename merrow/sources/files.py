"""Paths through Hadoop's file system, whatever store they are in."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _system(spark, path)
    return bool(system.exists(place))


def remove(spark: SparkSession, path: str) -> None:
    system, place = _system(spark, path)
    system.delete(place, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new small file."""
    system, place = _system(spark, path)
    out = system.create(place, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    system, place = _system(spark, path)
    size, stream = system.getFileStatus(place).getLen(), system.open(place)
    try:
        return bytes(stream.readNBytes(size)).decode()
    finally:
        stream.close()


def folders(spark: SparkSession, path: str, lead: str) -> list[str]:
    """The names of what is in a folder and starts with ``lead``, without it."""
    system, place = _system(spark, path)
    names = [status.getPath().getName() for status in system.listStatus(place)] if system.exists(place) else []
    return sorted(n.removeprefix(lead) for n in names if n.startswith(lead))


def _beside(path: str, mark: str) -> str:
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/.{name}.{mark}"


def staging(path: str) -> str:
    """A new hidden folder beside a path, on the same store, so that it can be renamed to it."""
    return _beside(path, f"stage-{uuid.uuid4().hex}")


@contextmanager
def locked(spark: SparkSession, path: str) -> Iterator[None]:
    """Hold the lock file of a path, which only one writer can create."""
    system, lock = _system(spark, _beside(path, "lock"))
    try:
        system.create(lock, False).close()
    except Exception as error:
        raise FileExistsError(f"another writer is at {path}") from error
    try:
        yield
    finally:
        system.delete(lock, False)


def promote(spark: SparkSession, staged: str, path: str) -> None:
    """Rename a finished folder to its path, where nothing may be. Of several writers one wins: the
    path's lock guards the check and the rename."""
    system, target = _system(spark, path)
    with locked(spark, path):
        if system.exists(target):
            raise FileExistsError(f"{path} exists")
        if not system.rename(_system(spark, staged)[1], target):
            raise OSError(f"{staged} could not be renamed to {path}")


def abandoned(spark: SparkSession, path: str, older_than: float = 86_400.0) -> list[str]:
    """Remove stages and locks beside a path that nothing has touched for some seconds, which
    writers left that ended before their end; their paths."""
    system, target = _system(spark, path)
    gone, before = [], (time.time() - older_than) * 1000
    parent = target.getParent()
    for status in system.listStatus(parent) if system.exists(parent) else []:
        name, own = status.getPath().getName(), target.getName()
        if (name.startswith(f".{own}.stage-") or name == f".{own}.lock") and status.getModificationTime() <= before:
            system.delete(status.getPath(), True)
            gone.append(status.getPath().toString())
    return gone
