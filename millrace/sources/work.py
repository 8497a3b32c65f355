"""Shared folders and Hadoop file access (any file system Spark can reach)."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared(spark: SparkSession, label: str) -> str:
    """A fresh path below the cluster's shared folder; a temporary one only where none is set."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or None
    if base is None:
        current = sc._jsc.sc().getCheckpointDir()
        base = os.path.dirname(current.get()) if current.isDefined() else None
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/millrace-engine/{label}-{uuid.uuid4().hex}"


class Files:
    """Hadoop file system calls for the small metadata files of tables."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def write(self, path: str, text: str, overwrite: bool = False) -> None:
        """Fails if the file is there already, unless told otherwise: commits race safely."""
        fs, p = self._at(path)
        out = fs.create(p, overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    def write_bytes(self, path: str, data: bytes) -> None:
        fs, p = self._at(path)
        out = fs.create(p, False)
        out.write(bytearray(data))
        out.close()

    def read_bytes(self, path: str) -> bytes:
        fs, p = self._at(path)
        source = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source))
        finally:
            source.close()

    def read_end(self, path: str, size: int, n: int) -> bytes:
        """The last ``n`` bytes of a file of ``size`` bytes; nothing before them is read."""
        fs, p = self._at(path)
        source = fs.open(p)
        try:
            source.seek(max(0, size - n))
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source, min(size, n)))
        finally:
            source.close()

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        source = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def gather(self, path: str, local: str) -> None:
        """The part files of a folder, one after the other, as one file on the driver's disk."""
        out = self.jvm.java.io.FileOutputStream(local)
        try:
            for name in sorted(f for f, *_ in self.list(path) if f.rsplit("/", 1)[1].startswith("part-")):
                fs, p = self._at(name)
                source = fs.open(p)
                try:
                    self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
                finally:
                    source.close()
        finally:
            out.close()

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def list(self, path: str) -> list[tuple[str, int, int, bool]]:
        """(path, size, modified ms, is a folder) of a folder's entries."""
        fs, p = self._at(path)
        return [(s.getPath().toString(), s.getLen(), s.getModificationTime(), s.isDirectory()) for s in fs.listStatus(p)] if fs.exists(p) else []

    def walk(self, path: str) -> list[tuple[str, int, int]]:
        out = []
        for name, size, modified, folder in self.list(path):
            out += self.walk(name) if folder else [(name, size, modified)]
        return out

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)
