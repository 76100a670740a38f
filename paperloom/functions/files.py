"""Files beside tables, through the file system that Spark itself uses: any store that its readers reach."""

from __future__ import annotations

import json

from pyspark import SparkContext
from pyspark.sql import SparkSession


class Files:
    """Small files and folders by their full paths."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.conf), at

    def exists(self, path: str) -> bool:
        system, at = self._at(path)
        return system.exists(at)

    def names(self, path: str) -> list[str]:
        """Names in a folder, ascending; none where there is no folder."""
        system, at = self._at(path)
        return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []

    def read_json(self, path: str):
        """The content of a file, None where there is none."""
        system, at = self._at(path)
        if not system.exists(at):
            return None
        stream = system.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def swap_json(self, path: str, content) -> None:
        """Puts a file in the place of what is there by one rename: readers see the old content or the new one, never a part."""
        system, at = self._at(path)
        fresh = self.jvm.org.apache.hadoop.fs.Path(path + ".next")
        stream = system.create(fresh, True)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        flags = SparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        flags[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(system.getUri(), self.conf).rename(system.makeQualified(fresh), system.makeQualified(at), flags)

    def delete(self, path: str) -> None:
        system, at = self._at(path)
        system.delete(at, True)
