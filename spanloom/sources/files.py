"""Small files of bookkeeping in a store that Spark reads: lists of paths, markers, versions."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


class Folder:
    """A folder of small JSON files, through Spark's own file systems; a file is there whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self) -> list[str]:
        """The names of all files and folders in it, in order."""
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        return sorted(n for n in names if not n.startswith((".", "_")))

    def files(self) -> list[str]:
        """The full paths of all files below it, in order."""
        if not self._fs.exists(self._at(self.path)):
            return []
        found, every = [], self._fs.listFiles(self._at(self.path), True)
        while every.hasNext():
            found.append(every.next().getPath().toString())
        return sorted(p for p in found if not p.rpartition("/")[2].startswith((".", "_")))

    def read(self, name: str) -> Any:
        stream = self._fs.open(self._at(f"{self.path}/{name}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, value: Any) -> None:
        """Written aside and then renamed; a file of that name that is there already stays as it is."""
        aside = self._at(f"{self.path}/.{name}.{self._jvm.java.util.UUID.randomUUID()}")
        stream = self._fs.create(aside, True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        if self._fs.exists(self._at(f"{self.path}/{name}")) or not self._fs.rename(aside, self._at(f"{self.path}/{name}")):
            self._fs.delete(aside, False)

    def remove(self, path: str) -> None:
        """A file or folder, by its full path or its name in the folder; nothing if it isn't there."""
        self._fs.delete(self._at(path if "/" in path else f"{self.path}/{path}"), True)
