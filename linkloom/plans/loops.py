"""Iteration: state that is written to the shared checkpoint folder between rounds; and numbering of all rows."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JError
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a loop's table for which a shuffle has a partition.
ROWS = 1 << 15


def folder(spark: SparkSession) -> str:
    """This application's own folder beneath spark.checkpoint.dir (only where that is unset, as in tests, a temporary
    one); it goes when the application ends."""
    sc = spark.sparkContext
    if getattr(sc, "_linkloom_rounds", None) is None:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="linkloom-"))
        sc._linkloom_rounds = f"{sc._jsc.sc().getCheckpointDir().get()}/rounds-{uuid.uuid4().hex}"
        atexit.register(_remove, sc, sc._linkloom_rounds)
    return sc._linkloom_rounds


def _remove(sc, folder: str) -> None:
    with contextlib.suppress(Py4JError, OSError):  # the JVM may have ended first
        if sc._jsc is not None:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df as a written table: its lineage ends, and losing executors loses nothing.

    A checkpoint would keep the plan's constraints and statistics, which grow from round to round; a table that is read
    again has neither, and its size is known.
    """
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Removes tables that cut wrote and no plan reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/rounds-" in path:
                _remove(sc, path)


def sized(df: DataFrame) -> DataFrame:
    """df, written, in a session of its own whose shuffles have a partition for each ``ROWS`` of its rows.

    A loop's rounds are many: where its tables are small, files for partitions that hold next to nothing are most of a
    round's time, and where they are large, partitions grow in number, not in size.
    """
    df = cut(df)
    own = df.sparkSession.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(max(1, -(-df.count() // ROWS))))
    return own.read.schema(df.schema).parquet(*{f.rsplit("/", 1)[0] for f in df.inputFiles()}) if df.inputFiles() else df


def back(df: DataFrame, spark: SparkSession) -> DataFrame:
    """df of a session of its own, written, as a table of spark."""
    df = cut(df)
    return spark.read.schema(df.schema).parquet(*{f.rsplit("/", 1)[0] for f in df.inputFiles()}) if df.inputFiles() else spark.createDataFrame([], df.schema)


def at_once(spark: SparkSession, *loops: Callable[[], DataFrame]) -> list[DataFrame]:
    """What each of some loops returns.  They run side by side: the short stages of one leave most cores to the others."""
    folder(spark)
    with ThreadPoolExecutor(len(loops)) as pool:
        return [x.result() for x in [pool.submit(inheritable_thread_target(spark)(f)) for f in loops]]


def ranked(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with the place of each row in the given order, from 0, found without sorting all rows in one task.

    Rows are dealt by ranges of the order and written; then each is numbered within its range, and the ranges' sizes,
    one number for each, are added up.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = sorted((r["__range"], r["count"]) for r in dealt.groupBy("__range").count().collect())
    before, offsets = 0, [(-1, 0)]
    for k, n in sizes:
        offsets.append((k, before))
        before += n
    start = F.broadcast(df.sparkSession.createDataFrame(offsets, "__range int, __before long"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return dealt.withColumn("__inside", inside).join(start, "__range").withColumn(name, F.col("__before") + F.col("__inside")).drop("__range", "__inside", "__before")
