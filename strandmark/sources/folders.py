"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir; on a single machine without that setting, below a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp()}"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


class Files:
    """The file system of a path, through Hadoop's own interface."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        """What lies in a folder; nothing if there is none."""
        at = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, path: str) -> str:
        held = self._fs.open(self._path(path))
        try:
            return bytes(held.readAllBytes()).decode()
        finally:
            held.close()

    def write_new(self, path: str, text: str) -> bool:
        """Writes a whole file under a name of its own, then gives it ``path`` in one step; false if that name is taken."""
        draft = self._path(f"{path}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(self._path(path)) or not self._fs.rename(draft, self._path(path)):
            self._fs.delete(draft, False)
            return False
        return True

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
