"""Whole files of any size, in any store that Spark writes.

Tables of lines are written by Spark in parallel, in their order, and their parts are
then copied end to end into the file, block by block: no row goes through Python, and
the driver holds one block.
"""

from __future__ import annotations

import uuid
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession

from linkloom.plans.loops import folder

BLOCK = 1 << 20


class Sink:
    """A file that is replaced; text and lines are appended in turn."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.jvm = spark, spark._jvm
        self.out = self._store(path).create(self.jvm.org.apache.hadoop.fs.Path(path), True)

    def _store(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def __enter__(self) -> Sink:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.out.close()

    def text(self, text: str) -> Sink:
        self.out.write(bytearray(text.encode("utf-8")))
        return self

    def lines(self, df: DataFrame, end: str = "\n", skip: int = 0) -> bool:
        """df's one column, a line each, in df's order; skip: bytes to leave out at the start.  Whether there were any."""
        path = f"{folder(self.spark)}/{uuid.uuid4().hex}"
        df.write.option("lineSep", end).text(path)
        store, some = self._store(path), False
        for part in sorted((x for x in store.listStatus(self.jvm.org.apache.hadoop.fs.Path(path)) if x.getPath().getName().startswith("part-") and x.getLen()), key=lambda x: x.getPath().getName()):
            source = store.open(part.getPath())
            try:
                if skip and not some:
                    source.seek(skip)
                some = True
                self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, self.out, BLOCK, False)
            finally:
                source.close()
        store.delete(self.jvm.org.apache.hadoop.fs.Path(path), True)
        return some
