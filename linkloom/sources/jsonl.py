"""JSON Lines: scan with line numbers of what fails, write, append and upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def read(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Rows of a JSON Lines file; a missing file is an empty table and blank lines are skipped.

    strict: fail on a bad line; else bad lines come as rows of nulls with the line in _corrupt.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def unknown_keys(lines: DataFrame, known: list[str], column: str = "value") -> DataFrame:
    """Raw lines with the keys that a closed schema doesn't have; parsing alone would drop them silently."""
    extra = F.array_except(F.json_object_keys(column), F.array(*map(F.lit, known)))
    return lines.select("*", extra.alias("unknown")).where(F.size("unknown") > 0)


def to_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of JSON Lines parts; mode "append" adds parts."""
    to_lines(df).write.mode(mode).text(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new put in, by key."""
    return old.join(new, key, "left_anti").unionByName(new)


def line_count(spark: SparkSession, path: str) -> int | None:
    """Lines that aren't blank; None without the file."""
    return spark.read.text(path).where(F.trim("value") != "").count() if exists(spark, path) else None
