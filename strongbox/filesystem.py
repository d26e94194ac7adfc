"""Looking up and deleting files. The driver asks the session's own file systems; tasks open URIs.

A path without a scheme means to both what it means to Spark: a path on the default file system.
"""

import re

from py4j.java_gateway import JavaObject
from pyarrow import fs
from pyspark.sql import SparkSession


def _store(path: str) -> tuple[JavaObject, JavaObject]:
    """The session's file system for a path, and the path."""
    spark = SparkSession.active()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def qualified(path: str) -> str:
    """A path with the scheme and authority that Spark gives it."""
    store, place = _store(path)
    return store.makeQualified(place).toString()


def exists(path: str) -> bool:
    store, place = _store(path)
    return store.exists(place)


def folders(path: str) -> list[str]:
    """The URIs of the folders inside a folder; none if it is not there."""
    store, place = _store(path)
    if not store.exists(place):
        return []
    return sorted(f.getPath().toString() for f in store.listStatus(place) if f.isDirectory())


def delete_folder(path: str) -> None:
    store, place = _store(path)
    store.delete(place, True)


def within(base: str, path: str) -> str:
    """A path as a URI; ``base`` is the root of the default file system as the driver qualified it."""
    return path if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:/", path) else base.rstrip("/") + "/" + path.lstrip("/")


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """In a task: the file system of a URI and the path within it."""
    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    if "://" not in uri:
        raise ValueError(f"{uri}: a task needs a URI")
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def children(folder: str) -> list[tuple[str, bool, int | None, int | None]]:
    """In a task: what a folder holds, empty and hidden files too: URI, whether it is a folder, length,
    time of change in microseconds. A folder that is not there holds nothing."""
    folder = folder.rstrip("/")
    store, inner = resolve(folder)
    prefix = folder.removesuffix(inner)
    found = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return [
        (prefix + f.path, f.type == fs.FileType.Directory, f.size, f.mtime_ns // 1000 if f.mtime_ns else None) for f in found
    ]
