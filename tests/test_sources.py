"""JSON Lines, writers, and the decision stream."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import types as T

from linkloom.operators import exports
from linkloom.sources import jsonl
from linkloom.streaming import decisions

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


def test_jsonl_round_trip(spark, tmp_path):
    path = str(tmp_path / "x")
    assert jsonl.read(spark, path, SCHEMA).count() == 0 and jsonl.line_count(spark, path) is None
    df = spark.createDataFrame([(1, "é"), (2, None)], SCHEMA)
    jsonl.write(df, path)
    jsonl.write(spark.createDataFrame([(3, "c")], SCHEMA), path, "append")
    assert sorted(tuple(r) for r in jsonl.read(spark, path, SCHEMA).collect()) == [(1, "é"), (2, None), (3, "c")]
    assert jsonl.line_count(spark, path) == 3


def test_bad_lines(spark, tmp_path):
    f = tmp_path / "bad.jsonl"
    f.write_text('{"id": 1, "name": "a"}\n\n{oops\n{"id": 2, "extra": 3}\n')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        jsonl.read(spark, str(f), SCHEMA).collect()
    loose = jsonl.read(spark, str(f), SCHEMA, strict=False)
    assert [r["_corrupt"] for r in loose.where("id is null").collect()] == ["{oops"]
    lines = spark.read.text(str(f)).where("value like '{\"%'")
    assert [r["unknown"] for r in jsonl.unknown_keys(lines, ["id", "name"]).collect()] == [["extra"]]


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA), spark.createDataFrame([(2, "x"), (3, "y")], SCHEMA)
    assert sorted(tuple(r) for r in jsonl.upsert(old, new, "id").collect()) == [(1, "a"), (2, "x"), (3, "y")]


def test_graph_files(spark, tmp_path):
    v = spark.createDataFrame([(1, "A & <b>", None), (2, "B", 4)], "id long, name string, community long")
    e = spark.createDataFrame([(1, 2, 30)], "a long, b long, weight20 long")
    for write in (exports.graphml, exports.gexf):
        path = tmp_path / "g.xml"
        write(v, e, str(path))
        tags = [x.tag.rpartition("}")[2] for x in ET.parse(path).iter()]
        assert tags.count("node") == 2 and tags.count("edge") == 1
    exports.csv_with_bom(v.orderBy("id"), str(tmp_path / "v.csv"))
    assert (tmp_path / "v.csv").read_bytes().startswith(b"\xef\xbb\xbfid,name,community")
    exports.report({"Persons": v.orderBy("id")}, str(tmp_path / "r.md"))
    assert "## Persons\n\n| id | name | community |\n| --- | --- | --- |\n| 1 | A & <b> | — |\n| 2 | B | 4 |\n" in (tmp_path / "r.md").read_text()


def test_decision_stream(spark, tmp_path):
    log = "source long, seq long, item long, action string"
    source = tmp_path / "log"
    spark.createDataFrame([(1, 1, 5, "accept"), (1, 2, 6, "defer"), (2, 1, 7, "undo")], log).coalesce(1).write.parquet(str(source))
    q = decisions.standing(spark.readStream.schema(log).parquet(str(source))).writeStream.outputMode("update").format("memory").queryName("standing").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    spark.createDataFrame([(1, 3, None, "undo")], log).coalesce(1).write.mode("append").parquet(str(source))
    q.processAllAvailable()
    q.stop()
    rows = [tuple(r) for r in spark.sql("select * from standing").collect()]
    assert (1, 2, 6, "defer") in rows and (2, 0, None, None) in rows and (1, 1, 5, "accept") in rows
