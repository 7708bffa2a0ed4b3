"""Small control files in whatever store Spark can reach, each whole or not there, created at most once."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Exists(FileExistsError):
    """Somebody else was first."""


class Store:
    """Files under ``root`` by relative key; keys may not leave the root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._hadoop = self._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        base = self._hadoop.Path(self.root)
        self._fs = base.getFileSystem(conf)
        self._base = self._fs.makeQualified(base)
        self._files = self._hadoop.FileContext.getFileContext(self._base.toUri(), conf)

    def path(self, key: str) -> str:
        if key.startswith("/") or ".." in key.split("/"):
            raise ValueError(f"unsafe key: {key}")
        return f"{self.root}/{key}"

    def _path(self, key: str):
        return self._hadoop.Path(self.path(key))

    def exists(self, key: str) -> bool:
        return self._fs.exists(self._path(key))

    def read(self, key: str) -> bytes:
        if not self.exists(key):
            raise FileNotFoundError(key)
        stream = self._fs.open(self._path(key))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def _put(self, key: str, content: bytes, how: str) -> None:
        """Writes beside and renames, so that a file is never seen in part and never missing in between."""
        folder, _, name = key.rpartition("/")
        beside = f"{folder}/.{name}.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(beside), False)
        out.write(bytearray(content))
        out.close()
        kind = getattr(self._hadoop, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.valueOf(how)
        try:
            self._files.rename(self._fs.makeQualified(self._path(beside)), self._fs.makeQualified(self._path(key)), options)
        except Py4JJavaError as error:
            self._fs.delete(self._path(beside), False)
            if how == "NONE" and self.exists(key):
                raise Exists(key) from error
            raise

    def create(self, key: str, content: bytes) -> None:
        """Writes a new file; raises ``Exists`` if there is one."""
        self._put(key, content, "NONE")

    def create_same(self, key: str, content: bytes) -> bool:
        """Whether a new file was written; the same content again is none, other content raises ``Exists``."""
        try:
            self.create(key, content)
        except Exists:
            if self.read(key) != content:
                raise
            return False
        return True

    def replace(self, key: str, content: bytes) -> None:
        """Writes a file in place of the one there, in one step."""
        self._put(key, content, "OVERWRITE")

    def rename(self, old: str, new: str) -> bool:
        return self._fs.rename(self._path(old), self._path(new))

    def delete(self, key: str) -> None:
        self._fs.delete(self._path(key), True)

    def size(self, key: str) -> int:
        """Bytes of a file, or of all files in a folder."""
        return self._fs.getContentSummary(self._path(key)).getLength()

    def names(self, folder: str) -> list[str]:
        """What lies in a folder, sorted; hidden files are left out, and a folder that is not there is empty."""
        if not self.exists(folder):
            return []
        found = (entry.getPath().getName() for entry in self._fs.listStatus(self._path(folder)))
        return sorted(n for n in found if not n.startswith("."))

    def list(self, prefix: str, name: str) -> list[str]:
        """Keys of files called ``name`` below ``prefix``, sorted."""
        if not self.exists(prefix):
            return []
        found, files = [], self._fs.listFiles(self._path(prefix), True)
        while files.hasNext():
            at = files.next().getPath()
            if at.getName() == name:
                found.append(at.toString()[len(self._base.toString()) + 1 :])
        return sorted(found)
