"""The engine's tables derived from the star schema of the test data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import vocab as V
from linkloom.operators import funnel

#: Which order lines make links, by graph: a predicate on each line, and one on the pair.
GRAPHS = {
    "dense": ("l_discount >= 0.09 and l_returnflag = 'R'", "true"),
    "sparse": ("l_quantity >= 48 and l_returnflag = 'R'", "true"),
    "multi": ("true", "(7 * a + 13 * b) % 19 = 0"),
}
#: Phrases that stand for persons in the test corpora, and regular expressions that tell of relations (group, type, pattern).
ALIASES = [(1, "Apache License"), (2, "General Public License"), (3, "MIT License"), (4, "Rights Reserved"), (5, "Creative Commons"), (6, "CC BY-NC"), (2, "Public License version 3"), (7, "License"), (8, "General Public License")]
LEXICON = [
    ("sociedade", "societario", "licen[sc]ed? under"), ("sociedade", "societario", "of the (?:in|on|th)"), ("ensino", "mestre-aprendiz", "releas[a-z]+ under"), ("ensino", "mestre-aprendiz", "der (?:die|das)"),
    ("estudo", "estudo", "this (?:work|software)"), ("estudo", "estudo", "de l[ao]s? "), ("trabalho", "trabalho", "in the"), ("depoimento", None, "all rights"),
]
PRIORITY_TYPES = {"1-URGENT": "mestre-aprendiz", "2-HIGH": "estudo", "3-MEDIUM": "societario", "4-NOT SPECIFIED": "trabalho", "5-LOW": "heranca"}
STATUS_CONFIDENCES = {"F": "documentado", "O": "tradicao_oral", "P": "hipotese"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(c: Column, mapping: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in mapping.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    key, balance = F.col("s_suppkey"), F.col("s_acctbal")
    attribution = F.when(F.col("s_nationkey") % 6 < 5, F.element_at(F.array(*map(F.lit, V.ATTRIBUTIONS)), (F.col("s_nationkey") % 6 + 1).cast("int")))
    birth = F.when(key % 7 != 0, (1900 + key % 60).cast("int"))
    return s.select(
        key.alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("institution"),
        F.when(balance < 0, None).when(balance < 3000, "precursor").when(balance < 6000, "mestre").otherwise("discipulo").alias("role"),
        F.when(F.col("s_nationkey") % 6 < 5, attribution).alias("attribution"), birth.alias("birth"),
        F.when(key % 5 == 0, (1900 + key % 60 + key % 90).cast("int")).alias("death"),
        F.when(key % 4 == 0, "verificado").when(key % 4 == 1, "contestado").otherwise("rascunho").alias("status"),
        F.when(key % 10 == 3, "check dates").when(key % 10 == 4, "  ").alias("issue"), (key % 3).cast("int").alias("n_sources"),
        F.array(F.col("s_nationkey").cast("long")).alias("activities"), F.when(key % 3 == 0, F.array(((F.col("s_nationkey") + 1) % 25).cast("long"), F.col("s_nationkey").cast("long"))).otherwise(F.array().cast("array<bigint>")).alias("educations"),
        F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: key * i % 40).alias("source_ids"),
    )


def institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("kind"))


def links(spark: SparkSession, sf_dir: str, graph: str) -> DataFrame:
    """(a, b, ord): suppliers a < b that share an order, with the order."""
    line, pair = GRAPHS[graph]
    # a partition of an order's lines holds both sides of the self-join
    lines = table(spark, sf_dir, "lineitem").where(line).select(F.col("l_orderkey").alias("ord"), F.col("l_suppkey").alias("s")).distinct()
    return lines.withColumnRenamed("s", "a").join(lines.withColumnRenamed("s", "b"), "ord").where("a < b").where(pair)


def relations(spark: SparkSession, sf_dir: str, graph: str = "multi") -> DataFrame:
    """One row for each pair and type.  sources: the orders it stems from, as ids."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("state"), F.year("o_orderdate").alias("y"))
    typed = links(spark, sf_dir, graph).join(orders, "ord").withColumn("type", lookup(F.col("priority"), PRIORITY_TYPES))
    grouped = typed.groupBy("a", "b", "type").agg(F.min(F.struct("ord", "state", "y")).alias("f"), F.count_distinct("ord").alias("n_sources"), F.sort_array(F.collect_set("ord")).alias("sources"))
    first, y = F.col("f.ord"), F.col("f.y").cast("string")
    flip = first % 2 == 1
    decade = (F.floor(F.col("f.y") / 10) * 10).cast("int").cast("string")
    period = (
        F.when(first % 8 == 0, F.concat(y, F.lit("-"), (F.col("f.y") + 3).cast("string"))).when(first % 8 == 1, F.concat(y, F.lit("-"))).when(first % 8 == 2, y)
        .when(first % 8 == 3, F.concat(F.lit("-"), y)).when(first % 8 == 4, F.concat(F.lit("anos "), decade)).when(first % 8 == 5, F.concat(F.lit("c. "), y)).when(first % 8 == 6, "unknown")
    )
    return grouped.select(
        F.concat_ws("-", F.lit("rel"), "a", "b", "type").alias("id"), F.when(flip, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(flip, F.col("a")).otherwise(F.col("b")).alias("dst"),
        "type", lookup(F.col("f.state"), STATUS_CONFIDENCES).alias("confidence"), (first % 3 == 0).alias("symmetric"), period.alias("period"), "n_sources", "sources",
        F.when(first % 4 == 0, "verificado").when(first % 4 == 1, "contestado").otherwise("rascunho").alias("status"), F.when(first % 11 == 0, "review").alias("issue"),
        F.when(first % 23 == 0, 0).otherwise(F.col("n_sources")).cast("int").alias("evidence"), F.when(first % 19 == 0, 450).otherwise((first % 400)).cast("int").alias("excerpt_chars"), first.alias("first_order"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, idx, block): the lines of the documents."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("idx", "block"))


def chunks(spark: SparkSession, sf_dir: str, min_chars: int = 40) -> DataFrame:
    """The paragraphs of the documents, with the documents as pages."""
    return funnel.chunks(blocks(spark, sf_dir), min_chars)


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person, name): the persons' names and their variants in the test corpora."""
    aliases = spark.createDataFrame(ALIASES, "person long, name string")
    return persons(spark, sf_dir).select(F.col("id").alias("person"), "name").unionAll(aliases)


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.gazetteer(names(spark, sf_dir))


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "grp string, type string, pattern string")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' sources: processed ones and a priority by the length of their names."""
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("id")).where("id is not null").distinct()
    return names.select("id", (F.length("id") % 2 == 0).alias("processed"), F.when(F.length("id") % 3 != 0, F.length("id")).alias("priority"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("affirms"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as curation decisions: (seq, source, item, action)."""
    e = table(spark, sf_dir, "events")
    action = lookup(F.col("event_type"), {"purchase": "accept", "error": "discard", "view": "defer", "click": "undo"})
    return e.select("event_id", "ts", F.col("user_id").alias("source"), F.get_json_object("props", "$.k").cast("long").alias("item"), action.alias("action")).where("action is not null")
