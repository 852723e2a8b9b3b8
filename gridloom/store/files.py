"""Small files on any Hadoop file system, published whole or not at all."""

from __future__ import annotations

from pyspark.sql import SparkSession


class SharedFiles:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        """Sorted names in a folder, without those that start with a dot."""
        at = self._path(folder)
        if not self.fs.exists(at):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self.fs.listStatus(at)) if not n.startswith("."))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Writes beside and renames; False if the name is taken already (somebody else was first)."""
        target = self._path(name)
        folder, _, last = name.rpartition("/")
        beside = self._path(f"{folder}/.{last}.{self.jvm.java.util.UUID.randomUUID()}" if folder else f".{last}.{self.jvm.java.util.UUID.randomUUID()}")
        self.fs.mkdirs(target.getParent())
        stream = self.fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.fs.exists(target) or not self.fs.rename(beside, target):
            self.fs.delete(beside, False)
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
