"""Folders with a log of versions, through Spark's file system.

``log/<version>.json`` is the whole state after a commit. It appears whole or not at all, and never over another: by a hard
link on a local file system, elsewhere by a rename that never overwrites (atomic on HDFS; an object store needs one that
refuses, too).
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..session import sound


def name_of(version: int) -> str:
    return f"v{version:020d}"


class Versioned:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = sound(spark), root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _list(self, name: str) -> list[str]:
        files, path = self._path(name)
        return sorted(x.getPath().getName() for x in files.listStatus(path)) if files.exists(path) else []

    def _delete(self, name: str) -> None:
        files, path = self._path(name)
        files.delete(path, True)

    def _read(self, name: str) -> str:
        files, path = self._path(name)
        stream = files.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """A file of this text, whole; False where there is one."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        files, path = self._path(name)
        _, draft = self._path(f"drafts/{uuid.uuid4().hex}")
        files.mkdirs(path.getParent())
        stream = files.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if files.getUri().getScheme() == "file":
                local = lambda p: jvm.java.io.File(files.makeQualified(p).toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(path), local(draft))
            else:
                options = self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf).rename(draft, path, options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            files.delete(draft, False)
        return True

    def find_version(self) -> str | None:
        """The current version, or None where nothing has been written."""
        names = [x for x in self._list("log") if x.startswith("v") and x.endswith(".json")]
        return names[-1].removesuffix(".json") if names else None

    def changed(self, since: str | None) -> bool:
        """Whether there is another version than the one that a reader knows: what was derived from it is stale."""
        return self.find_version() != since
