"""Relations, the edges they collapse to, and what is counted on either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import vocab as V


def weight20(confidence: Column, n_sources: Column) -> Column:
    """Weight in twentieths: w * (1 + (n - 1) / 2) with w = 1, 0.6, 0.3; unknown confidence counts as a hypothesis."""
    w = F.lit(V.CONFIDENCE_TWENTIETHS["hipotese"])
    for name, x in V.CONFIDENCE_TWENTIETHS.items():
        w = F.when(confidence == name, x).otherwise(w)
    return (w * (n_sources + 1)).cast("long")


def with_weight(relations: DataFrame) -> DataFrame:
    return relations.withColumn("weight20", weight20(F.col("confidence"), F.col("n_sources")))


def type_order(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, V.RELATION_TYPES)), c).cast("int")


def filtered(relations: DataFrame, types: list[str] | None = None, hypotheses: bool = True, confidences: list[str] | None = None, statuses: list[str] | None = None) -> DataFrame:
    out = relations
    for column, wanted in (("type", types), ("confidence", confidences), ("status", statuses)):
        if wanted is not None:
            out = out.where(F.col(column).isin(wanted))
    return out if hypotheses else out.where(F.coalesce(F.col("confidence"), F.lit("")) != "hipotese")


def collapse(relations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One edge for each unordered pair (and keys): weight, dominant type (most frequent, then earliest in the
    vocabulary), types, confidences, relations and distinct sources."""
    keys = keys or []
    pairs = with_weight(relations).withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst"), "ord": type_order(F.col("type"))})
    by_type = pairs.groupBy(*keys, "a", "b", "ord").agg(
        F.count("*").alias("n"), F.sum("weight20").alias("w"), F.collect_set("confidence").alias("conf"), F.count_if(F.col("confidence") != "hipotese").alias("firm"), F.flatten(F.collect_set("sources")).alias("src")
    )
    edges = by_type.groupBy(*keys, "a", "b").agg(
        F.sum("n").alias("n_relations"), F.sum("w").alias("weight20"), F.max_by("ord", F.struct("n", -F.col("ord"))).alias("top"), F.sort_array(F.collect_set("ord")).alias("ords"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("conf")))).alias("confs"), F.sum("firm").alias("firm"), F.size(F.array_distinct(F.flatten(F.collect_list("src")))).cast("long").alias("n_sources"),
    )
    names = F.array(*map(F.lit, V.RELATION_TYPES))
    return edges.select(
        *keys, "a", "b", "n_relations", "weight20", F.element_at(names, F.col("top")).alias("dominant"), F.array_join(F.transform("ords", lambda i: F.element_at(names, i)), ",").alias("types"),
        F.array_join("confs", ",").alias("confidences"), (F.col("firm") == 0).alias("only_hypotheses"), "n_sources",
    )


def collapse_arcs(relations: DataFrame) -> DataFrame:
    """One arc for each ordered pair of directed relations that aren't symmetric."""
    r = with_weight(relations).where(F.col("type").isin(V.DIRECTED_TYPES) & ~F.coalesce("symmetric", F.lit(False)))
    return r.groupBy("src", "dst").agg(F.count("*").alias("n_relations"), F.sum("weight20").alias("weight20"))


def both_ways(edges: DataFrame, *columns: str) -> DataFrame:
    """Every edge from either end: (node, other, ...)."""
    rest = [F.col(c) for c in columns]
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other"), *rest).unionAll(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), *rest))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree and strength of every vertex, isolates included."""
    d = both_ways(edges, "weight20").groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight20").alias("strength20"))
    return vertices.join(d, vertices["id"] == d["node"], "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), F.coalesce("strength20", F.lit(0)).cast("long").alias("strength20"))


def top(df: DataFrame, k: int, keys: list[str], *order: Column | str, parts: int = 64) -> DataFrame:
    """The first k rows of each of a few keys, with their place from 1: first of each of several parts of a key, then of these,
    so no task holds more of a key than a part or k rows of each."""
    part = F.pmod(F.xxhash64(*(F.col(c) for c in df.columns)), F.lit(parts))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    first = df.withColumn("__part", part).withColumn("__place", place(*keys, "__part")).where(F.col("__place") <= k).drop("__part", "__place")
    return first.withColumn("place", place(*keys)).where(F.col("place") <= k)


def ranking(nodes: DataFrame, value: str, k: int = 10) -> DataFrame:
    """The k highest values (ties by id), of these the positive ones."""
    return nodes.orderBy(F.desc(value), "id").limit(k).where(F.col(value) > 0)


def pair_key(src: Column, dst: Column, kind: Column, symmetric: Column) -> list[Column]:
    """(origin, target): sorted where the direction carries no meaning."""
    loose = F.coalesce(symmetric, F.lit(False)) | ~F.coalesce(kind.isin(V.DIRECTED_TYPES), F.lit(False))
    return [F.when(loose, F.least(src, dst)).otherwise(src), F.when(loose, F.greatest(src, dst)).otherwise(dst)]


def audit(relations: DataFrame) -> DataFrame:
    """Relations by type and confidence, with a row of totals (type null), documented share in basis points."""
    c = lambda name: F.count_if(F.col("confidence") == name).alias(name)
    out = relations.rollup("type").agg(*(c(x) for x in V.CONFIDENCES), F.count("*").alias("total"))
    return out.withColumn("documented_bp", F.floor(F.col("documentado") * 10000 / F.col("total")).cast("long"))


def audit_verdict(relations: DataFrame) -> DataFrame:
    """One row: documented and all relations of teaching and of practice, and whether teaching is documented less often by
    more than a fifth."""
    teaching, practice = F.col("type").isin(V.TEACHING_TYPES), F.col("type").isin(V.PRACTICE_TYPES)
    firm = F.col("confidence") == "documentado"
    out = relations.agg(F.count_if(teaching & firm).alias("teaching_documented"), F.count_if(teaching).alias("teaching"), F.count_if(practice & firm).alias("practice_documented"), F.count_if(practice).alias("practice"))
    td, t, pd, p = (F.col(c) for c in out.columns)
    less = (pd * t - td * p) * 5 > p * t
    return out.withColumn("verdict", F.when((t == 0) | (p == 0), "too few").when(less, "teaching less documented").otherwise("alike"))


def mix(groups: DataFrame, persons: DataFrame, group: str) -> DataFrame:
    """(group, attribute, value, n): the roles and the attributions of each group's persons (node)."""
    p = persons.select(F.col("id").alias("node"), F.coalesce("role", F.lit("outro")).alias("role"), F.coalesce("attribution", F.lit("indefinida")).alias("attribution"))
    own = groups.join(p, "node")
    of = lambda c: own.groupBy(group, F.col(c).alias("value")).agg(F.count("*").alias("n")).select(group, F.lit(c).alias("attribute"), "value", "n")
    return of("role").unionAll(of("attribution"))


def institution_links(persons: DataFrame) -> DataFrame:
    """(institution, id): the distinct persons of an institution, by activity (activities: names) or education (educations)."""
    either = persons.select("id", F.explode("activities").alias("institution")).unionAll(persons.select("id", F.explode("educations").alias("institution")))
    return either.where("institution is not null").distinct()
