"""Small texts (registry, catalogs) on whatever file system a path names, replaced as a whole."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path(name))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def read(self, name: str) -> str | None:
        """None if there is none. A writer that died between removing the old and naming the new file left a whole new one."""
        if not self.exists(name):
            if not self.exists(f"{name}.new"):
                return None
            name = f"{name}.new"
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """To a new file first, which then takes the old one's place."""
        new = self._path(f"{name}.new")
        stream = self.fs.create(new, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        old = self._path(name)
        if self.fs.exists(old):
            self.fs.delete(old, False)
        if not self.fs.rename(new, old):
            raise OSError(f"{name} could not be replaced")

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self._path(old), self._path(new)):
            raise OSError(f"{old} could not become {new}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
