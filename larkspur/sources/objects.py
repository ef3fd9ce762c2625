"""Objects in any store that Hadoop's file systems reach (s3a, abfs, hdfs, file)."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


class ObjectStore:
    """Puts and gets single objects under a root; the root is made if it isn't there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(""))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def put(self, local: str, name: str) -> str:
        """Uploads a local file; a missing one is an error. Returns the object's address."""
        if not os.path.isfile(local):
            raise FileNotFoundError(local)
        self._fs.copyFromLocalFile(False, True, self.spark._jvm.org.apache.hadoop.fs.Path(f"file://{os.path.abspath(local)}"), self._path(name))
        return f"{self.root}/{name}"

    def get(self, name: str) -> bytes:
        """Content of one object; a missing one is an error."""
        if not self._fs.exists(self._path(name)):
            raise FileNotFoundError(f"{self.root}/{name}")
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def download(self, name: str, local: str) -> None:
        content = self.get(name)
        with open(local, "wb") as f:
            f.write(content)
