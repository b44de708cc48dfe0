"""Files on shared storage.

The driver asks Hadoop's file system, so every path is understood as Spark understands it.
Tasks read ranges of bytes by Arrow's file systems; ``readable`` says which schemes they know.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

# Schemes of Hadoop's object stores by the name Arrow has for them.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfss", "gs": "gs", "hdfs": "hdfs", "s3": "s3"}


@dataclass(frozen=True)
class Child:
    name: str
    path: str
    is_folder: bool
    length: int


def is_log(name: str) -> bool:
    """The name rule of ``functions.text.is_log_name`` for listings on the driver."""
    found, dot_log, suffix = name.rpartition(".log")
    return bool(dot_log) and (suffix == "" or (suffix[0] == "." and len(suffix) > 1))


# ------------------------------------------------------------------------- on the driver


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for any path Spark takes. Needs a classic session."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def literal(path: str) -> str:
    """The path as a pattern that matches nothing else."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme; one without a scheme is under ``fs.defaultFS``."""
    files, target = _hadoop(spark, path)
    return files.makeQualified(target).toString().rstrip("/")


def kind_of(spark: SparkSession, path: str) -> str | None:
    """``file``, ``folder`` or None."""
    files, target = _hadoop(spark, path)
    if not files.exists(target):
        return None
    return "file" if files.getFileStatus(target).isFile() else "folder"


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files of a folder."""
    files, target = _hadoop(spark, path)
    return files.getContentSummary(target).getLength()


def list_children(spark: SparkSession, path: str, below: str | None = None) -> list[Child]:
    """The visible children of a folder, or the files in those of its folders that match
    ``below``; names as Spark's scan sees them."""
    files, target = _hadoop(spark, path)
    if below:
        pattern = f"{literal(path)}/{below}/*"
        found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(pattern)) or []
    else:
        found = files.listStatus(target) if files.exists(target) else []
    children = []
    for status in found:
        where = status.getPath()
        name = where.getName()
        if not name.startswith(("_", ".")) and not (below and status.isDirectory()):
            children.append(Child(name, where.toString(), status.isDirectory(), status.getLen()))
    return children


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole: written beside its place and renamed."""
    files, target = _hadoop(spark, path)
    beside = target.suffix(".new")
    out = files.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(target, False)
    files.rename(beside, target)


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole under a name that must be free."""
    files, target = _hadoop(spark, path)
    if files.exists(target):
        raise FileExistsError(path)
    beside = target.suffix(f".{uuid.uuid4().hex}.new")
    out = files.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not files.rename(beside, target):
        raise FileExistsError(path)


def create_empty(spark: SparkSession, path: str) -> None:
    files, target = _hadoop(spark, path)
    files.create(target, True).close()


def delete_folder(spark: SparkSession, path: str) -> None:
    files, target = _hadoop(spark, path)
    files.delete(target, True)


# ---------------------------------------------------------------------------- in the tasks


def readable(uri: str) -> bool:
    """Whether ``read_range`` knows the scheme of a qualified path."""
    scheme = uri.partition(":")[0] if ":/" in uri else "file"
    return scheme == "file" or scheme in ARROW_SCHEMES


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = uri[len("file:"):]  # Spark writes local paths with one slash
    if uri.startswith("file://"):
        return pafs.LocalFileSystem(), uri[len("file://"):]
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    scheme, _, rest = uri.partition("://")
    if scheme not in ARROW_SCHEMES:
        raise ValueError(f"no byte access to {scheme}://; known are {sorted(ARROW_SCHEMES)}")
    return pafs.FileSystem.from_uri(f"{ARROW_SCHEMES[scheme]}://{rest}")


def list_folder_times(uri: str) -> list[tuple[str, bool, int, int]]:
    """(name, is it a folder, bytes, time of change) of the visible children."""
    files, path = locate(uri)
    found = files.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return [
        (f.base_name, f.type == pafs.FileType.Directory, f.size or 0, f.mtime_ns or 0)
        for f in found
        if not f.base_name.startswith(("_", "."))
    ]


def read_range(uri: str, start: int, length: int) -> bytes:
    files, path = locate(uri)
    with files.open_input_file(path) as source:
        source.seek(start)
        return source.read(length)


def read_text(uri: str) -> str:
    files, path = locate(uri)
    with files.open_input_file(path) as source:
        return source.read().decode()
