"""Files that tasks write and read themselves through Arrow's file systems, in the shared scratch folder."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.session import stage


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a Spark path (``file:/x`` and ``file:///x`` alike)."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def publish(system: fs.FileSystem, temporary: str, name: str) -> None:
    """Give a whole file its name. An earlier attempt's file of that name has the same content and stays."""
    if system.get_file_info(name).type != fs.FileType.NotFound:
        system.delete_file(temporary)
        return
    try:
        system.move(temporary, name)
    except OSError:
        # Another attempt may have come first on a store that refuses to replace a file.
        if system.get_file_info(name).type == fs.FileType.NotFound:
            raise
        system.delete_file(temporary)


def listing(spark: SparkSession, folder: str, label: str) -> tuple[DataFrame, int]:
    """``path, length`` of a folder's files, stored, and the sum of the lengths; names with ``_`` are not whole."""
    files = stage(spark.read.format("binaryFile").load(folder).select("path", "length"), label)
    return files, files.agg(F.sum("length")).first()[0] or 0
