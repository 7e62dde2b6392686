"""Data-quality rules: each gives rows (level, rule, entity, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import vocab as V
from linkloom.operators.relations import pair_key


def problem(df: DataFrame, level: str, rule: str, table: str, key: str = "id", message: Column | str = "") -> DataFrame:
    said = F.lit(message) if isinstance(message, str) else message
    return df.select(F.lit(level).alias("level"), F.lit(rule).alias("rule"), F.concat(F.lit(f"{table}:"), F.col(key).cast("string")).alias("entity"), said.alias("message"))


def unique_id(df: DataFrame, table: str, key: str = "id") -> DataFrame:
    return problem(df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1"), "error", "duplicate-id", table, key, F.col("count").cast("string"))


def missing_reference(df: DataFrame, column: str, target: DataFrame, table: str, rule: str = "reference", level: str = "error") -> DataFrame:
    known = target.select(F.col("id").alias("__t")).distinct()
    return problem(df.join(known, F.col(column).eqNullSafe(F.col("__t")), "left_anti"), level, rule, table, message=F.lit(column))


def references(relations: DataFrame, statements: DataFrame, persons: DataFrame, sources: DataFrame) -> DataFrame:
    """All seven references: a relation's src, dst, source_ids and breaks (if any), a statement's person and source, a
    person's source_ids.  The message is the column."""
    each = lambda df: df.select("id", F.explode("source_ids").alias("source_ids"))
    return reduce(
        DataFrame.unionAll,
        (
            missing_reference(relations, "src", persons, "relations"), missing_reference(relations, "dst", persons, "relations"), missing_reference(each(relations), "source_ids", sources, "relations"),
            missing_reference(relations.where("breaks <> ''"), "breaks", relations, "relations"), missing_reference(statements, "person", persons, "statements"),
            missing_reference(statements, "source", sources, "statements"), missing_reference(each(persons), "source_ids", sources, "persons"),
        ),
    )


def vocabulary(persons: DataFrame, institutions: DataFrame) -> DataFrame:
    """Institutions of persons' activities and educations that the vocabulary doesn't have."""
    each = lambda c: missing_reference(persons.select("id", F.explode(c).alias(c)), c, institutions, "persons", "institution")
    return each("activities").unionAll(each("educations"))


def unknown_keys(lines: DataFrame, known: list[str], table: str) -> DataFrame:
    """Keys of raw JSON lines (id, value) that the closed schema doesn't have; reading them by a schema would drop them."""
    extra = F.array_sort(F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, known))))
    return problem(lines.withColumn("__extra", extra).where(F.size("__extra") > 0), "error", "schema", table, message=F.array_join("__extra", ","))


def where(df: DataFrame, condition: Column, level: str, rule: str, table: str) -> DataFrame:
    return problem(df.where(F.coalesce(condition, F.lit(False))), level, rule, table)


def single_token_name(persons: DataFrame) -> DataFrame:
    name = F.trim("name")
    return where(persons, (name != "") & (F.size(F.split(name, r"\s+")) == 1), "warning", "single-token-name", "persons")


def evidence(relations: DataFrame) -> DataFrame:
    """Documented without a source; a hypothesis with neither source nor open issue."""
    none = F.col("evidence") == 0
    return where(relations, ((F.col("confidence") == "documentado") & none) | ((F.col("confidence") == "hipotese") & none & (F.trim(F.coalesce("issue", F.lit(""))) == "")), "error", "evidence", "relations")


def direction(relations: DataFrame) -> DataFrame:
    return where(relations, F.col("symmetric") & F.col("type").isin(V.DIRECTED_TYPES), "warning", "direction", "relations")


def period_format(relations: DataFrame) -> DataFrame:
    return where(relations, (F.col("period") != "") & ~F.col("period").rlike(V.PERIOD_FORMAT), "warning", "period", "relations")


def long_excerpt(relations: DataFrame) -> DataFrame:
    return where(relations, F.col("excerpt_chars") > 400, "warning", "long-excerpt", "relations")


def duplicate_key(relations: DataFrame) -> DataFrame:
    a, b = pair_key(F.col("src"), F.col("dst"), F.col("type"), F.col("symmetric"))
    keyed = relations.select(F.concat_ws("-", a, b, "type").alias("id"))
    return problem(keyed.groupBy("id").count().where("count > 1"), "error", "duplicate", "relations", message=F.col("count").cast("string"))


def _outside(column: str, allowed: list[str], needed: bool = False) -> Column:
    inside = F.col(column).isin(allowed)
    return ~F.coalesce(inside, F.lit(False)) if needed else F.coalesce(~inside, F.lit(False))


def _empty(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) == ""


def schema(persons: DataFrame, relations: DataFrame, statements: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Required values, enumerations and row rules of the closed schema; the message names what breaks it."""
    checks = [
        (persons, "persons", {"id": _empty("id"), "name": _empty("name"), "attribution": _outside("attribution", V.ATTRIBUTIONS), "role": _outside("role", V.ROLES), "status": _outside("status", V.STATUSES), "death": F.coalesce(F.col("death") < F.col("birth"), F.lit(False))}),
        (relations, "relations", {"src": _empty("src"), "dst": _empty("dst"), "same": F.coalesce(F.col("src") == F.col("dst"), F.lit(False)), "type": _outside("type", V.RELATION_TYPES, True), "confidence": _outside("confidence", V.CONFIDENCES, True), "status": _outside("status", V.STATUSES)}),
    ]
    if statements is not None:
        checks.append((statements, "statements", {"id": _empty("id"), "person": _empty("person"), "argument": _empty("argument"), "source": _empty("source")}))
    if sources is not None:
        checks.append((sources, "sources", {"id": _empty("id"), "type": _outside("type", V.SOURCE_TYPES), "density": _outside("density", V.DENSITIES)}))
    out = []
    for df, table, broken in checks:
        said = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in broken.items())), lambda x: x.isNotNull())
        out.append(problem(df.withColumn("__said", said).where(F.size("__said") > 0), "error", "schema", table, message=F.array_join("__said", ",")))
    return reduce(DataFrame.unionAll, out)


def ambiguous_alias(aliases: DataFrame) -> DataFrame:
    """Variants (person, variant) that stand for more than one person."""
    v = aliases.groupBy(F.lower(F.trim("variant")).alias("id")).agg(F.count_distinct("person").alias("n")).where("n > 1")
    return problem(v, "warning", "ambiguous-alias", "aliases", message=F.col("n").cast("string"))


def summary(*problems: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, problems).groupBy("level", "rule").agg(F.count("*").alias("n"))
