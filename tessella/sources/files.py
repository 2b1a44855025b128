"""Small files and folders through Hadoop's file systems, so that an engine's root may be on any store that Spark reads."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import SparkSession

from ..errors import EngineError


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm  # noqa: SLF001
        self._conf = spark._jsc.hadoopConfiguration()  # noqa: SLF001
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        """Names in a folder, sorted; none if there is no such folder."""
        p = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def parts(self, path: str) -> list[str]:
        """The data files of a folder that Spark has written."""
        return [f"{path}/{n}" for n in self.names(path) if n.startswith("part-")]

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def move(self, old: str, new: str) -> None:
        self._fs.mkdirs(self._path(new).getParent())
        if not self._fs.rename(self._path(old), self._path(new)):
            raise EngineError("STORAGE_ERROR", f"{old} can't be moved.")

    def copy(self, old: str, new: str) -> None:
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._path(old), self._fs, self._path(new), False, self._conf)

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength() if self.exists(path) else 0

    def footer(self, path: str) -> tuple[int, int, int] | None:
        """Rows of a Parquet file, and least and greatest value of its first column, a long; None where the file has no such statistics."""
        hadoop = self._jvm.org.apache.parquet.hadoop
        reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(self._path(path), self._conf))
        try:
            rows, low, high = 0, None, None
            for group in reader.getRowGroups():
                rows += group.getRowCount()
                found = group.getColumns()[0].getStatistics()
                if found is None or not found.hasNonNullValue():
                    return None
                low = found.genericGetMin() if low is None else min(low, found.genericGetMin())
                high = found.genericGetMax() if high is None else max(high, found.genericGetMax())
            return (rows, low, high) if rows else (0, 0, -1)
        finally:
            reader.close()

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a file that wasn't there; False if another writer was first. The file appears whole, by a rename that doesn't replace."""
        temporary = f"{path}.{self._jvm.java.util.UUID.randomUUID().toString()}.tmp"
        self._put(temporary, text)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        kinds = self._array(self._jvm.org.apache.hadoop.fs.Options.Rename.NONE)
        try:
            context.rename(self._path(temporary), self._path(path), kinds)
            return True
        except Exception:  # noqa: BLE001  py4j wraps what the store says
            self.delete(temporary)
            if self.exists(path):
                return False
            raise

    def replace(self, path: str, text: str) -> None:
        """Write a file, over an older one if there is one; readers see the one or the other."""
        temporary = f"{path}.{self._jvm.java.util.UUID.randomUUID().toString()}.tmp"
        self._put(temporary, text)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(self._path(temporary), self._path(path), self._array(self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE))

    def _put(self, path: str, text: str) -> None:
        self._fs.mkdirs(self._path(path).getParent())
        stream = self._fs.create(self._path(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _array(self, option):
        out = SparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)  # noqa: SLF001
        out[0] = option
        return out
