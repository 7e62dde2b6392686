"""What the corpus operators share: sampling, attaching columns, checkpoints."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm import kernels as K


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % m, F.lit(0))


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """The rows with the smallest key hashes, most of them; the same rows however df is partitioned."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(most)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder in spark.checkpoint.dir; without that setting (as in tests) a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="linkloom-"))


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder beneath the shared checkpoint folder; it goes when the application ends."""
    sc = spark.sparkContext
    if getattr(sc, "_linkloom_folder", None) is None:
        ensure_checkpoint_dir(spark)
        sc._linkloom_folder = f"{sc._jsc.sc().getCheckpointDir().get()}/tables-{uuid.uuid4().hex}"
        atexit.register(_remove_at_exit, sc, sc._linkloom_folder)
    return sc._linkloom_folder


def _remove(sc, folder: str) -> None:
    if sc._jsc is not None:  # a context that was stopped can't remove anything
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _remove_at_exit(sc, folder: str) -> None:
    with contextlib.suppress(Py4JError, OSError):  # the JVM may have ended first
        _remove(sc, folder)


def let_go(spark: SparkSession, settle: float = 0.0) -> None:
    """Shuffle files and checkpoints that no plan refers to any more are removed.

    settle: seconds to wait, as plans that Python dropped this moment are told to the JVM within a second.
    """
    gc.collect()
    time.sleep(settle)
    spark._jvm.System.gc()


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Shuffle files of a query go as soon as it has ended, not only when the JVM finds that nothing refers to them.  For
#: queries whose whole result is written; it holds for frames that are made under it.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def cut(df: DataFrame) -> DataFrame:
    """df written as a table to the shared checkpoint folder and read back from there, so nothing before it runs again.

    Its shuffle files go with the end of writing; those that only tables written before needed are let go of first.
    """
    spark = df.sparkSession
    let_go(spark)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    with settings(spark, TIDY):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(*tables: DataFrame) -> None:
    """Removes tables that cut wrote and no plan reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f.startswith(shared_folder(df.sparkSession)):
                _remove(sc, f)


Batches = Iterator[pa.RecordBatch]


def map_arrow(df: DataFrame, run: Callable[[Batches], Batches], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema), after which an idle worker holds no memory of the task's arrays."""

    def tidy(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            K.release()

    return df.mapInArrow(tidy, schema)


ArrowColumns = Callable[[pa.Array], Sequence[pa.Array]]


def attach(df: DataFrame, make: Callable[[], ArrowColumns], fields: Sequence[T.StructField], keep: Sequence[str] | None = None, text: str = "text") -> DataFrame:
    """df with columns computed from its text column, batch by batch in Arrow.

    make() is called once in each Python task and returns the function from the
    texts to the columns.  keep: the columns of df to carry (all by default).
    New columns replace carried columns of the same name.
    """
    new = [f.name for f in fields]
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    source = df.select(*(F.col(f"`{c}`") for c in keep), F.col(text).cast("string").alias("__text"))
    schema = T.StructType([source.schema[c] for c in keep] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = make()
        for batch in batches:
            made = columns(batch.column("__text"))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + list(made), names=keep + new)

    return map_arrow(source, run, schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between the positions in first (one more than texts)."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64)
    np.cumsum(values, axis=0, dtype=np.float64, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


class HashTable:
    """A set of uint64 hashes kept sorted, with an index over their leading bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(np.asarray(hashes, dtype=np.uint64))
        bits = max(1, min(22, int(len(self.hashes)).bit_length() + 1))
        self.shift = np.uint64(64 - bits)
        lead = (self.hashes >> self.shift).astype(np.int64)
        self.start = np.searchsorted(lead, np.arange((1 << bits) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.start).max()) if len(self.hashes) else 0

    def find(self, q: np.ndarray) -> np.ndarray:
        """Positions of q in the sorted hashes, -1 where absent."""
        out = np.full(len(q), -1, dtype=np.int32)
        if not len(self.hashes):
            return out
        lead = (q >> self.shift).astype(np.int32)
        at, end = self.start[lead], self.start[lead + 1]
        last = len(self.hashes) - 1
        hit = (self.hashes[np.minimum(at, last)] == q) & (at < end)
        out[hit] = at[hit]
        open_ = np.flatnonzero(~hit & (at + 1 < end))
        step = 1
        while len(open_):
            pos = at[open_] + step
            hit = self.hashes[pos] == q[open_]
            out[open_[hit]] = pos[hit]
            step += 1
            open_ = open_[~hit & (pos + 1 < end[open_])]
        return out
