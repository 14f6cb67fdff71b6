"""Files of any store that Spark reaches, through Hadoop's file system: heads, listings, small writes."""

from __future__ import annotations

import tempfile

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

from ..errors import SourceError


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Only a local session gets a temporary one
    where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None and context.master.split("[")[0] != "local":
            raise SourceError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(place or tempfile.mkdtemp(prefix="tallyspark-"))
    return context.getCheckpointDir()


class Files:
    """The files under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(str(path))
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def is_dir(self) -> bool:
        return self.exists() and self.fs.getFileStatus(self.path).isDirectory()

    def listed(self) -> list[tuple[str, int]]:
        """(path, bytes) of the file, or of a folder's files in the order of their names; hidden ones don't count."""
        if not self.exists():
            raise SourceError(f"{self.path.toString()} does not exist")
        found = [(s.getPath(), s.getLen()) for s in self.fs.listStatus(self.path) if s.isFile()]
        return sorted((p.toString(), n) for p, n in found if p.getName()[0] not in "._")

    def identity(self) -> list[tuple[str, int, int]]:
        """(path, bytes, time of the last change) of each file: what tells whether an input is still the same."""
        return [(p, n, self.fs.getFileStatus(self.jvm.org.apache.hadoop.fs.Path(p)).getModificationTime()) for p, n in self.listed()]

    def head(self, size: int) -> bytes:
        """The first bytes of the file, or of a folder's first file."""
        files = self.listed()
        if not files:
            raise SourceError(f"{self.path.toString()} has no files")
        stream = self.fs.open(self.jvm.org.apache.hadoop.fs.Path(files[0][0]))
        try:
            return bytes(stream.readNBytes(size))
        finally:
            stream.close()

    def read(self) -> bytes:
        """A small file whole."""
        try:
            stream = self.fs.open(self.path)
            try:
                return bytes(stream.readAllBytes())
            finally:
                stream.close()
        except Py4JError as error:
            raise OSError(f"{self.path.toString()} can't be read: {str(error)[:300]}") from error

    def write(self, data: bytes) -> None:
        """A small file, there in whole or not at all: written beside its place, then renamed."""
        part = self.jvm.org.apache.hadoop.fs.Path(self.path.toString() + ".part")
        stream = self.fs.create(part, True)
        try:
            stream.write(data)
        finally:
            stream.close()
        if self.exists():
            self.fs.delete(self.path, False)
        if not self.fs.rename(part, self.path):
            raise OSError(f"{self.path.toString()} can't be written")

    def sha256(self) -> str:
        """The SHA-256 of one file's bytes, streamed through the driver's JVM."""
        digest = self.jvm.java.security.MessageDigest.getInstance("SHA-256")
        stream = self.jvm.java.security.DigestInputStream(self.fs.open(self.path), digest)
        try:
            stream.transferTo(self.jvm.java.io.OutputStream.nullOutputStream())
        finally:
            stream.close()
        return bytes(digest.digest()).hex()

    def delete(self) -> None:
        self.fs.delete(self.path, True)


__all__ = ["Files", "SourceError", "shared_folder"]
