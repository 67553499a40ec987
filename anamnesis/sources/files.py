"""A few operations on the file system of a path, whichever it is, through Hadoop: what a log and its manifest need."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jvm = spark._jvm

    def _at(self, path: str):  # type: ignore[no-untyped-def]
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def put_if_absent(self, path: str, text: str) -> bool:
        """Create the file, unless there is one: of two writers one succeeds."""
        p, fs = self._at(path)
        try:
            out = fs.create(p, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def replace(self, path: str, text: str) -> None:
        p, fs = self._at(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, path: str) -> str | None:
        p, fs = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, path: str) -> list[str]:
        """What lies directly under a path, in order; nothing if it isn't there."""
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def walk(self, path: str) -> list[tuple[str, int, int]]:
        """(path below, bytes, time of the last change in ms) of every file below a path."""
        p, fs = self._at(path)
        if not fs.exists(p):
            return []
        root = fs.getFileStatus(p).getPath().toString().rstrip("/") + "/"
        out, it = [], fs.listFiles(p, True)
        while it.hasNext():
            s = it.next()
            out.append((s.getPath().toString().removeprefix(root), s.getLen(), s.getModificationTime()))
        return sorted(out)

    def rename(self, path: str, to: str) -> None:
        """Move; the parent of the new place is made, an existing place refused."""
        p, fs = self._at(path)
        q = self.jvm.org.apache.hadoop.fs.Path(to)
        fs.mkdirs(q.getParent())
        if fs.exists(q) or not fs.rename(p, q):
            raise FileExistsError(to)

    def delete(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.delete(p, True)
