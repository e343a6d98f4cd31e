"""Files through Hadoop's file systems, so that a catalog may live in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """Small text files and folders below a root URI."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.gateway = spark.sparkContext._gateway
        self.root = root.rstrip("/")
        path = self.jvm.org.apache.hadoop.fs.Path(self.root)
        conf = spark._jsc.hadoopConfiguration()
        self.fs = path.getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf) if path.toUri().getScheme() else self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def uri(self, name: str) -> str:
        return self.fs.makeQualified(self._path(name)).toString()

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Writes beside and renames over: readers see the old text or the new one."""
        temporary = self._path(f"{name}.new")
        stream = self.fs.create(temporary, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self.context.rename(temporary, self._path(name), options)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def folders(self, name: str) -> list[str]:
        if not self.fs.exists(self._path(name)):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(name))]
