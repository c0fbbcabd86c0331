"""Small files and folders of the history, through the file system that holds them."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder that Spark's file system reaches; only names and small texts pass through the driver."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark._jvm
        self.path = path.rstrip("/")
        here = self._path()
        self._fs = here.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """What lies in the folder, or in one below it; nothing where there is none."""
        at = self._path(name)
        if not self._fs.exists(at):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at))

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def move(self, name: str, to: str) -> bool:
        """Give a file its final name in one step; false if another file has that name already."""
        if self._fs.exists(self._path(to)):
            return False
        self._fs.mkdirs(self._path(to).getParent())
        return self._fs.rename(self._path(name), self._path(to))

    def remove(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)

    def write(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str:
        given = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(given, "UTF-8")
        finally:
            given.close()
