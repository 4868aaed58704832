"""Notes of finished work in a shared folder, so that work that is tried again skips it."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Ledger:
    """Entries below ``folder``; an entry is there or not, and appears at once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self._conf), path

    def has(self, name: str) -> bool:
        files, path = self._at(name)
        return files.exists(path)

    def note(self, name: str) -> None:
        files, path = self._at(name)
        files.create(path, True).close()

    def drop(self, name: str) -> None:
        files, path = self._at(name)
        files.delete(path, True)

    def names(self) -> list[str]:
        files, path = self._at("")
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []
