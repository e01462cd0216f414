"""Small documents on whatever file system a path names, by Spark's own access to it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under ``spark.checkpoint.dir``, which executors share. Without that setting a temporary one of this machine, which
    only local mode can read."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError(f"{name} on a cluster needs spark.checkpoint.dir")
    if not root:
        folder = tempfile.mkdtemp(prefix="flowsieve-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self.conf)
        fs.setWriteChecksum(False)
        return fs, at

    def qualified(self, path: str) -> str:
        """A path's whole address, as all nodes know it."""
        fs, at = self._at(path)
        return fs.makeQualified(at).toUri().toString()

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def read(self, path: str) -> str:
        """Text of a file; empty where there is none."""
        fs, at = self._at(path)
        if not fs.exists(at):
            return ""
        stream = fs.open(at)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Puts ``text`` in place of the file at once: no reader sees half of it."""
        fs, at = self._at(path)
        part = self.jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.part")
        stream = fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf)
        context.rename(fs.makeQualified(part), fs.makeQualified(at), how)

    def append_chunks(self, path: str, chunks) -> None:
        """Writes byte chunks to a new file, one in memory at a time."""
        fs, at = self._at(path)
        stream = fs.create(at, True)
        for chunk in chunks:
            stream.write(bytearray(chunk))
        stream.close()

    def names(self, folder: str) -> list[str]:
        fs, at = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)
