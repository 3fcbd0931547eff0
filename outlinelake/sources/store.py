"""Files of shared folders, by URI: what sources and sinks need of a file system, on the driver and in tasks."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import suppress
from urllib.parse import quote

from pyarrow import fs as pafs
from pyspark.sql import SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a local temporary one only where that is unset and all runs on this machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints/outlinelake"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def of(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it. Names in the path stand as they are, not escaped, whatever their characters."""
    scheme, apart, rest = uri.partition("://")
    if not apart or scheme == "file":
        return pafs.LocalFileSystem(), (rest if apart else uri.removeprefix("file:"))
    return pafs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe='/:@,')}")


def read(uri: str) -> bytes:
    store, path = of(uri)
    with store.open_input_file(path) as f:
        return f.read()


def write(uri: str, raw: bytes) -> None:
    store, path = of(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as f:
        f.write(raw)


def exists(uri: str) -> bool:
    store, path = of(uri)
    return store.get_file_info(path).type == pafs.FileType.File


def move(old: str, new: str) -> None:
    """Give a file its name; one that has that name already is replaced."""
    store, a = of(old)
    b = of(new)[1]
    store.create_dir(b.rpartition("/")[0], recursive=True)
    try:
        store.move(a, b)
    except OSError:  # some stores don't replace
        if store.get_file_info(b).type != pafs.FileType.File or store.get_file_info(a).type != pafs.FileType.File:
            raise
        store.delete_file(b)
        store.move(a, b)


def delete(uri: str) -> None:
    """Delete a file, or a folder with all that is in it; nothing if there is none."""
    store, path = of(uri)
    with suppress(FileNotFoundError):
        if store.get_file_info(path).type == pafs.FileType.Directory:
            store.delete_dir(path)
        else:
            store.delete_file(path)


def below(folder: str) -> list[tuple[str, int]]:
    """Path below the folder, size, of all its files, at any depth."""
    store, base = of(folder)
    infos = store.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted((i.path[len(base.rstrip("/")) + 1 :], i.size) for i in infos if i.type == pafs.FileType.File)
