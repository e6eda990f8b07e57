"""Small files beside a table, through Hadoop's file systems, so that they lie wherever Spark can write."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where a local session that names no checkpoint folder keeps its tables.
OWN_FOLDER = "quillframe.checkpoint.dir"


def scratch(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: the session's checkpoint folder.

    A session in local mode that names none gets a temporary folder; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_FOLDER, None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        # A running session does not let its checkpoint folder be set.
        spark.conf.set(OWN_FOLDER, folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, so that what follows sees the same rows in the same places, and starts from files.

    It stays until the folder is cleared.
    """
    path = f"{scratch(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Names, sizes and short texts below a path."""

    def __init__(self, spark: SparkSession, path: str):
        context = spark.sparkContext
        self.gateway, self.jvm, self.path = context._gateway, context._jvm, path.rstrip("/")
        self.conf = context._jsc.hadoopConfiguration()
        self.fs = self._at("").getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """Names in a folder; none where there is no such folder."""
        at = self._at(name)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def bytes_in(self, name: str) -> int:
        """Bytes of all files below a folder."""
        return self.fs.getContentSummary(self._at(name)).getLength()

    def text(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Writes a file under a temporary name and gives it its own, which must not be taken.

        Readers see the whole file or none.  An error tells that another writer came first.
        """
        temporary, final = self._at(f"{name}.writing"), self._at(name)
        stream = self.fs.create(temporary, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._move(temporary, final)

    def _move(self, old, new) -> None:
        kinds = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        context.rename(old, new, self.gateway.new_array(kinds, 0))

    def rename(self, old: str, new: str) -> None:
        """Gives a file or folder another name, which must not be taken."""
        self._move(self._at(old), self._at(new))

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)
