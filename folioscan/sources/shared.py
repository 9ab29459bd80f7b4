"""A folder that all machines share, by the Hadoop file systems: a mounted path, HDFS or an object store."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Shared:
    """Names are relative to the folder; missing ones are no error to read, list or delete."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._overwrite = spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._overwrite[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/") or "/")

    def place(self, name: str) -> str:
        return f"{self.root}/{name}"

    def is_dir(self, name: str) -> bool:
        return self._fs.exists(self._path(name)) and self._fs.getFileStatus(self._path(name)).isDirectory()

    def folders(self, name: str = "") -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(name)) if s.isDirectory()] if self.is_dir(name) else []

    def size(self, name: str) -> int:
        """Bytes of all files below."""
        return self._fs.getContentSummary(self._path(name)).getLength() if self._fs.exists(self._path(name)) else 0

    def read(self, name: str) -> str | None:
        if not self._fs.exists(self._path(name)):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The whole file at once: readers see the old text or the new one."""
        stream = self._fs.create(self._path(name + ".new"), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.rename(name + ".new", name)

    def rename(self, name: str, to: str) -> None:
        self._fs.mkdirs(self._path(to).getParent())
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(self._path(name), self._path(to), self._overwrite)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
